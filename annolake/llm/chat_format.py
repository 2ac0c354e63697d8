r"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs, sorted, and adjacent turns of one role are merged under one
header by slicing the sorted array at its role changes. A message reads

    <|role:user|>\n first text <|+|> next text <|end|>\n

(no blanks around the marks). In texts a backslash is doubled and one is put behind the first character of any control string,
the template's own as well as those of common templates, so that no text can open or close a turn; `unescaped` undoes both.
The loss mask marks each assistant text, without headers and separators.

Cases: null text or role counts as empty; turns with one number are ordered by role, then text; repeated rows are repeated turns; a null
conv_id is a conversation like any other; a null turn comes first; an empty table gives an empty result; other columns are not read.
The whole of one conversation is one output value, so it is one task's row by nature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annolake.llm.tables import table

END = "<|end|>\n"
AND = "<|+|>"
#: An escaped text has a backslash behind the first character of each of these.
_CONTROL = r"<(?=\||/?s>|</?SYS>>|/?<?SYS>)|\[(?=/?INST\])"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(_CONTROL), F.lit("$0\\\\"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"(?s)\\(.)"), F.lit("$1"))


def _runs(turns: Column) -> Column:
    """Slices of the sorted turns, each of one role."""
    starts = F.filter(
        F.sequence(F.lit(1), F.size(turns)),
        lambda i: (i == 1) | (F.element_at(turns, i)["role"] != F.element_at(turns, F.greatest(i - 1, F.lit(1)))["role"]),
    )
    bounds = F.concat(starts, F.array(F.size(turns) + 1))
    return F.transform(F.sequence(F.lit(1), F.size(bounds) - 1), lambda k: F.slice(turns, F.element_at(bounds, k), F.element_at(bounds, k + 1) - F.element_at(bounds, k)))


def _segments(run: Column, trained: str) -> Column:
    def piece(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    role = run[0]["role"]
    no = F.lit(False)
    head = piece(F.concat(F.lit("<|role:"), F.replace(escaped(role), F.lit(">"), F.lit("\\>")), F.lit("|>\n")), no)
    texts = F.flatten(
        F.transform(run, lambda t, i: F.array(piece(F.when(i == 0, F.lit("")).otherwise(F.lit(AND)), no), piece(escaped(t["text"]), role == F.lit(trained))))
    )
    return F.concat(F.array(head), texts, F.array(piece(F.lit(END), no)))


def format_chats(turns: DataFrame, trained: str = "assistant", conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, formatted string, segments array<struct<text, loss>>, n_messages): the segments joined are ``formatted``; those with
    ``loss`` are what is trained on."""
    blank = F.lit("")
    row = F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), blank).alias("role"), F.coalesce(F.col(text).cast("string"), blank).alias("text")
    )
    whole = turns.groupBy(F.col(conv).alias("conv_id")).agg(F.sort_array(F.collect_list(row)).alias("_turns"))
    runs = whole.select("conv_id", _runs(F.col("_turns")).alias("_runs"))
    cut = runs.select("conv_id", F.flatten(F.transform("_runs", lambda r: _segments(r, trained))).alias("segments"), F.size("_runs").alias("n_messages"))
    return cut.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments", "n_messages")


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation, one for each turn."""
    messages = F.split(formatted, r"<\|end\|>\n")
    messages = F.slice(messages, F.lit(1), F.size(messages) - 1)
    pattern = r"(?s)^<\|role:(.*?)\|>\n(.*)$"

    def turns(m: Column) -> Column:
        role = unescaped(F.regexp_extract(m, pattern, 1))
        return F.transform(F.split(F.regexp_extract(m, pattern, 2), r"<\|\+\|>"), lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(messages, turns))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    own = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(
        F.lit(-1).cast("long").alias("conv_id"), F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(own).alias("text")) for i, r in enumerate(("user", "assistant"))))).alias("t")
    ).select("conv_id", "t.turn", "t.role", "t.text")
    done = format_chats(given.unionByName(extra))
    back = done.withColumn("turns", read_back(F.col("formatted"))).withColumn(
        "loss", F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
    )
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP4_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, lag(role) OVER w IS NOT DISTINCT FROM role AS same,
         regexp_replace(replace(text, '\', '\\'), '(<)(\||/?s>|</?SYS>>|/?<?SYS>)', '\1\\\2', 'g') AS half
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), put AS (
  SELECT *, length(regexp_replace(half, '(\[)(/?INST\])', '\1\\\2', 'g'))
            + CASE WHEN same THEN 5 ELSE length(role) + 10 + 8 END AS chars
  FROM marked
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM put GROUP BY conv_id
"""
