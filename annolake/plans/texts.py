"""Text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from annolake.functions import text as T
from annolake.operators import nearest, similar
from annolake.plans.catalogue import query, table

_WS = r"[\s\x0B\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def _squish(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '{_WS}+', ' ', 'g'), '^ | $', '', 'g')"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


_FNV = "lower(lpad(printf('%x', list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({0}, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)), 8, '0'))"


@query("normalize_ws", f"SELECT doc_id, md5({_squish('text')}) AS line_md5, length({_squish('text')}) AS n FROM documents")
def normalize_ws(spark, sf_dir):
    line = T.one_line(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(line).alias("line_md5"), F.length(line).cast("long").alias("n"))


@query("fnv1a_id", "SELECT item_id, " + _FNV.format("text") + " AS h, 'hl-' || left(" + _FNV.format("(item_id::VARCHAR || ':' || left(text, 12))") + ", 6) AS hl_id FROM benchmark")
def fnv1a_id(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(
        "item_id", T.fnv1a(F.col("text")).alias("h"), T.digest_id("hl", F.col("item_id").cast("string"), F.substring("text", 1, 12)).alias("hl_id")
    )


@query(
    "html_text",
    "SELECT page_id, md5("
    + _squish(
        "replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&amp;', '&')"
    )
    + ") AS text_md5 FROM pages",
)
def html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.markup_text(F.col("html"))).alias("text_md5"))


@query(
    "nav_links",
    "SELECT page_id, len(l) AS n_links, array_to_string(l, '|') AS labels FROM (SELECT page_id, list_transform(regexp_extract_all(html, '(?is)<a\\b[^>]*>(.*?)</a>', 1), lambda x: "
    + _squish("regexp_replace(x, '<[^>]*>', ' ', 'g')")
    + ") AS l FROM pages)",
)
def nav_links(spark, sf_dir):
    links = T.link_texts(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.size(links).cast("long").alias("n_links"), F.array_join(links, "|").alias("labels"))


@query(
    "sanitize_name",
    """
    WITH s AS (SELECT page_id, trim(regexp_replace(url, '[/\\\\:*?"<>|]', '-', 'g')) AS a FROM pages),
    c AS (SELECT page_id, trim(regexp_replace(CASE WHEN length(a) > 200 THEN trim(left(a, 200)) ELSE a END, '\\.+$', '')) AS b FROM s)
    SELECT page_id, (CASE WHEN b = '' THEN '-' ELSE b END) || ' — Page ' || page_id AS name FROM c
    """,
)
def sanitize_name(spark, sf_dir):
    from annolake.functions.python import nfc

    return table(spark, sf_dir, "pages").select("page_id", T.base_name(F.col("url"), F.col("page_id"), nfc).alias("name"))


@query(
    "parse_region",
    """
    SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE user_id % 9 + 1 END AS page, CASE WHEN event_id % 5 = 0 THEN NULL ELSE round(value, 2) END AS x,
           CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id END AS y FROM events
    """,
)
def parse_region(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rect = F.concat_ws(" ", F.round("value", 2).cast("decimal(20,2)").cast("string"), F.col("event_id").cast("string"), F.lit("10"), F.when(F.col("event_id") % 5 == 0, "none").otherwise("20"))
    r = T.region(F.concat(F.lit("page: "), (F.col("user_id") % 9 + 1).cast("string"), F.lit("\nrect: "), rect, F.lit("\n")))
    return e.select("event_id", r).toDF("event_id", "r").select("event_id", F.col("r.page").cast("long").alias("page"), F.col("r.x").alias("x"), F.col("r.y").cast("long").alias("y"))


@query(
    "dehyphenate",
    "SELECT doc_id, md5(regexp_replace(regexp_replace(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: " + _strip("x") + "), lambda x: x <> ''), chr(10)), '(\\p{L})-\\n(\\p{L})', '\\1\\2', 'g'), '\\n', ' ', 'g')) AS joined_md5 FROM documents",
)
def dehyphenate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.dehyphenated(F.split("text", "\n"))).alias("joined_md5"))


@query("joined_line_spans")
def joined_line_spans(spark, sf_dir):
    """The fold that keeps each line's place (no SQL: the fold carries an array)."""
    j = T.joined_lines(F.split("text", "\n"))
    return table(spark, sf_dir, "benchmark").select("item_id", j.alias("j")).select("item_id", F.col("j.text").alias("text"), F.size("j.spans").alias("n_spans"))


@query("sentence_around")
def sentence_around(spark, sf_dir):
    """The sentence around the middle of each passage; checked against a loop in the tests."""
    b = table(spark, sf_dir, "benchmark").withColumn("at", F.floor(F.length("text") / 2).cast("int"))
    s = T.sentence_around(F.col("text"), F.col("at"), F.col("at") + 5)
    return b.select("item_id", s.alias("s"), "text").select("item_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"))


@query(
    "mark_sentence",
    """
    WITH m AS (SELECT item_id, text, left(text, 9) AS a, substr(text, 10, 6) AS b FROM benchmark)
    SELECT item_id, CASE WHEN 15 >= 0.75 * length(text) THEN text ELSE '==' || left(text, 15) || '==' || substr(text, 16) END AS marked FROM m
    WHERE strpos(text, a) = 1 AND strpos(text, b) = 10
    """,
)
def mark_sentence(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").withColumn("a", F.substring("text", 1, 9)).withColumn("b", F.substring("text", 10, 6))
    b = b.where((F.instr("text", F.col("a")) == 1) & (F.instr("text", F.col("b")) == 10))
    return b.select("item_id", T.marked_sentence(F.col("text"), F.array("b", "a")).alias("marked"))


@query("escape_text", "SELECT page_id, md5(regexp_replace(regexp_replace(html, '([<&])', '\\\\\\1', 'g'), '^>', '\\\\>')) AS escaped_md5 FROM pages")
def escape_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.escaped(F.col("html"))).alias("escaped_md5"))


@query(
    "anchor_words",
    r"""
    WITH l AS (SELECT item_id, regexp_extract_all(lower(text), '\p{L}{4,}') AS l FROM benchmark), w AS (SELECT item_id, unnest(l) AS word, generate_subscripts(l, 1) AS i FROM l),
    d AS (SELECT item_id, word, min(i) AS i FROM w GROUP BY item_id, word), t AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY length(word) DESC, i) <= 3)
    SELECT b.item_id, coalesce(string_agg(word, ',' ORDER BY length(word) DESC, i), '') AS words FROM benchmark b LEFT JOIN t USING (item_id) GROUP BY b.item_id
    """,
)
def anchor_words(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.anchor_words(T.folded(F.col("text"))), ",").alias("words"))


@query(
    "fuzzy_pairs",
    """
    SELECT a.p_partkey AS a_key, b.p_partkey AS b_key, 1 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name)) >= 0.6 AS same
    FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey
    """,
)
def fuzzy_pairs(spark, sf_dir):
    """Every pair that shares brand and size, and whether it is alike. There are as many rows as pairs, but far fewer different names, so two names are compared once in two blocks of a group and no pair is shuffled."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_name")
    pairs = nearest.all_pairs_by_text(p, ["p_brand", "p_size"], "p_partkey", "p_name", similar.same_line, "same", similar.shape_of)
    return pairs.select(F.col("a").alias("a_key"), F.col("b").alias("b_key"), "same")


@query("passage_lookup", "SELECT doc_id, item_id, strpos(regexp_replace(d.text, '\\s+', '', 'g'), regexp_replace(b.text, '\\s+', '', 'g')) - 1 AS at FROM documents d JOIN benchmark b ON strpos(regexp_replace(d.text, '\\s+', '', 'g'), regexp_replace(b.text, '\\s+', '', 'g')) > 0")
def passage_lookup(spark, sf_dir):
    """White-space-blind containment. Candidates share the passage's first five words, an equi-join on shingles, so texts are never crossed with passages."""
    b = table(spark, sf_dir, "benchmark").select("item_id", T.without_space(F.col("text")).alias("needle"))
    d = table(spark, sf_dir, "documents").select("doc_id", T.without_space(F.col("text")).alias("bare"))
    size = 16
    keyed = b.where(F.length("needle") >= size).withColumn("k", F.xxhash64(F.substring("needle", 1, size)))
    windows = F.array_distinct(F.transform(F.regexp_extract_all("bare", F.lit(f"(?=(.{{{size}}}))"), F.lit(1)), lambda w: F.xxhash64(w)))
    # only ids and keys are shuffled; the texts of the few candidates come back by id
    pairs = d.select("doc_id", F.explode(windows).alias("k")).join(keyed, "k").select("doc_id", "item_id", "needle")
    hits = d.join(pairs, "doc_id").where(F.contains("bare", F.col("needle"))).select("doc_id", "item_id", "bare", "needle")
    # passages too short for a key are looked up in every text
    short = d.join(b.where(F.length("needle") < size), F.contains("bare", F.col("needle"))).select(*hits.columns)
    return hits.unionByName(short).select("doc_id", "item_id", (F.instr("bare", F.col("needle")) - 1).cast("long").alias("at")).distinct()


@query("folded_text", "SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '[‘’‛′]', '''', 'g'), '[“”‟″]', '\"', 'g'), '[\\x{2010}-\\x{2015}\\x{2212}]', '-', 'g'), '[\\x{00A0}\\x{2007}\\x{202F}]', ' ', 'g')) AS folded_md5 FROM documents WHERE length(lower(text)) = length(text)")
def folded_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.folded(F.col("text"))).alias("folded_md5")).where(F.col("folded_md5").isNotNull())


@query(
    "transcript_render",
    """
    WITH p AS (SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'ok' WHEN 'user' THEN 'failed' ELSE 'skipped' END AS status, text FROM conversations),
    n AS (SELECT conv_id, count(*) AS pages FROM p GROUP BY conv_id),
    r AS (SELECT conv_id, turn, CASE WHEN status = 'ok' THEN text WHEN status = 'failed' THEN '> [!warning] Could not read this page' END AS body, status FROM p),
    k AS (SELECT conv_id, turn + 1 AS label, turn + 1 - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM p WHERE status = 'skipped'),
    m AS (SELECT conv_id, g, CASE WHEN count(*) >= 3 THEN min(label)::VARCHAR || '–' || max(label)::VARCHAR ELSE string_agg(label::VARCHAR, ', ' ORDER BY label) END AS part, count(*) AS c FROM k GROUP BY conv_id, g),
    t AS (SELECT conv_id, CASE WHEN sum(c) = 1 THEN '*No text on page ' ELSE '*No text on pages ' END || string_agg(part, ', ' ORDER BY g) || '.*' AS tail FROM m GROUP BY conv_id),
    s AS (SELECT conv_id, string_agg('### [[note.pdf#page=' || (turn + 1) || '|Page ' || (turn + 1) || ']]' || chr(10) || chr(10) || body, chr(10) || chr(10) ORDER BY turn) AS head FROM r WHERE status <> 'skipped' GROUP BY conv_id)
    SELECT n.conv_id, md5(CASE WHEN pages <= 1 THEN (SELECT max(coalesce(body, '')) FROM r WHERE r.conv_id = n.conv_id) ELSE concat_ws(chr(10) || chr(10), head, tail) END) AS transcript_md5
    FROM n LEFT JOIN s ON s.conv_id = n.conv_id LEFT JOIN t ON t.conv_id = n.conv_id
    """,
)
def transcript_render(spark, sf_dir):
    from annolake.operators.rendering import transcripts

    c = table(spark, sf_dir, "conversations")
    status = F.when(F.col("role") == "assistant", "ok").when(F.col("role") == "user", "failed").otherwise("skipped")
    pages = c.select(F.col("conv_id"), (F.col("turn") + 1).alias("label"), (F.col("turn") + 1).alias("embed"), status.alias("status"), "text")
    return transcripts(pages, "conv_id", F.lit("note.pdf")).select("conv_id", F.md5("transcript").alias("transcript_md5"))


_LINES = """
    raw AS (SELECT conv_id, turn, role = 'user' AS given, string_split(regexp_replace(coalesce(text, ''), '[^ -~]', '', 'g'), '. ') AS parts FROM conversations),
    lines AS (SELECT conv_id, given, regexp_replace(trim(regexp_replace(parts[i], '\\s+', ' ', 'g')), ' +', ' ', 'g') AS line, row_number() OVER (PARTITION BY conv_id ORDER BY NOT given, turn, i) AS n
              FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM raw))"""


@query(
    "lines_without_repeats",
    f"""
    WITH RECURSIVE {_LINES},
    fold AS (
      SELECT DISTINCT conv_id, 0::BIGINT AS n, []::VARCHAR[] AS kept FROM lines
      UNION ALL
      SELECT f.conv_id, l.n, CASE WHEN given OR len(list_filter(kept, lambda k: (k = '' AND line = '') OR 1 - levenshtein(k, line) / greatest(len(k), len(line), 1) >= 0.6 AND greatest(len(k), len(line)) > 0)) = 0 THEN list_append(kept, line) ELSE kept END
      FROM fold f JOIN lines l ON l.conv_id = f.conv_id AND l.n = f.n + 1
    )
    SELECT conv_id, len(arg_max(kept, n)) AS n_kept, max(n) AS n_lines, md5(array_to_string(arg_max(kept, n), '|')) AS kept_md5 FROM fold GROUP BY conv_id
    """,
)
def lines_without_repeats(spark, sf_dir):
    """The sentences of each conversation: what the user said stays, and of the answers' sentences those that are like none that stays before them."""
    c = table(spark, sf_dir, "conversations")
    bare = F.regexp_replace(F.coalesce("text", F.lit("")), F.lit("[^ -~]"), F.lit(""))
    parts = c.select("conv_id", "turn", (F.col("role") == "user").alias("given"), F.posexplode(F.split(bare, F.lit("\\. "), -1)).alias("i", "part"))
    lines = parts.select("conv_id", "given", F.struct("turn", "i").alias("ord"), T.line_shape(F.col("part")).alias("text"))
    kept = similar.without_repeats(lines, "conv_id").withColumn("late", ~F.col("given"))
    told = kept.groupBy("conv_id").agg(F.count("*").alias("n_kept"), F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("late", "ord", "text"))), lambda x: x["text"]), "|")).alias("kept_md5"))
    return lines.groupBy("conv_id").agg(F.count("*").alias("n_lines")).join(told, "conv_id")
