"""Text expressions. All are built from Spark's own functions, so they stay in generated code and take part in pushdown;
lengths and places are counted in code points, from 0."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the annotated documents mean it: Java's \s leaves out the Unicode spaces and the byte order mark.
SPACE = r"[\s\x0B   -     　﻿]"
NOT_SPACE = "[^" + SPACE[1:]

# Fixed values of the note format.
FENCE_END = "%% managed block: end %%"
EMBED = r"!\[\[([^\]\n]+)\]\]"
RESERVED_NAMES = r"(?i)^(con|prn|aux|nul|com[0-9]|lpt[0-9])(\..*)?$"
MAX_NAME = 200
ANCHOR_WORDS = 4
FULLY_MARKED = 0.75
DEFAULT_ATTACHMENTS = "attachments"


def js_round(x: Column) -> Column:
    """Half up, towards plus infinity."""
    return F.floor(x + 0.5)


def clamp(x: Column, low, high) -> Column:
    return F.greatest(F.least(x, F.lit(high) if not isinstance(high, Column) else high), F.lit(low) if not isinstance(low, Column) else low)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(f"^{SPACE}+|{SPACE}+$"), F.lit(""))


def one_line(text: Column) -> Column:
    """Runs of white space become one space, none at the ends."""
    return strip(F.regexp_replace(text, F.lit(f"{SPACE}+"), F.lit(" ")))


def heading_title(title: Column) -> Column:
    """Without invisible characters and leading ornaments, in one line."""
    visible = F.regexp_replace(title, F.lit(r"[\p{Cc}\p{Cf}&&[^\t\n\r]]"), F.lit(""))
    return one_line(F.regexp_replace(visible, F.lit(f"^[{SPACE[1:-1]}\\p{{S}}]+"), F.lit("")))


#: Fixed: the named references that are decoded.
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ndash": "–", "mdash": "—", "hellip": "…", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "copy": "©", "middot": "·"}


def code_point(n: Column) -> Column:
    """The character of a code point; nothing for a number that is none."""
    valid = (n > 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))


def decode_references(text: Column) -> Column:
    """Hexadecimal, decimal and common named character references; others stay as they are."""
    pattern = r"&(#[xX][0-9a-fA-F]{1,6}|#[0-9]{1,7}|[A-Za-z][A-Za-z0-9]*);"
    names = F.create_map(*(F.lit(x) for pair in NAMED.items() for x in pair))

    def decoded(r: Column) -> Column:
        body = F.substring(r, F.lit(2), F.length(r) - 2)
        number = F.when(body.rlike("^#[xX]"), F.conv(F.substring(body, 3, 10), 16, 10)).when(body.startswith("#"), F.substring(body, 2, 10)).cast("long")
        return F.coalesce(code_point(number), names[body], r)

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.zip_with(F.split(text, pattern, -1), F.transform(found, decoded), lambda gap, r: F.concat(gap, F.coalesce(r, F.lit(""))))
    return F.when(text.contains("&"), F.array_join(parts, "")).otherwise(text)


def markup_text(source: Column) -> Column:
    """Text of (X)HTML: bodies of scripts and styles dropped, a tag is a space, references decoded, one line."""
    bare = F.regexp_replace(source, F.lit(r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>"), F.lit(" "))
    return one_line(decode_references(F.regexp_replace(bare, F.lit("<[^>]*>"), F.lit(" "))))


def link_texts(source: Column) -> Column:
    """Texts of all links, in order."""
    return F.transform(F.regexp_extract_all(source, F.lit(r"(?is)<a\b[^>]*>(.*?)</a>"), F.lit(1)), markup_text)


def nav_labels(ncx: Column) -> Column:
    """Labels of a navigation map, in order."""
    return F.transform(F.regexp_extract_all(ncx, F.lit(r"(?is)<navLabel\b[^>]*>\s*<text\b[^>]*>(.*?)</text>"), F.lit(1)), markup_text)


def toc_labels(xhtml: Column) -> Column:
    """Link texts of the first table of contents."""
    toc = F.regexp_extract(xhtml, r'(?is)<nav\b[^>]*epub:type\s*=\s*["\'][^"\']*\btoc\b[^>]*>(.*?)</nav>', 1)
    return F.when(toc != "", link_texts(toc)).otherwise(F.array().cast("array<string>"))


def heading_number(line: Column, title: Column) -> Column:
    """The number of a line that reads `number title`, else null."""
    # one class for the parts: a repeated group would need a stack as deep as the number is long
    numbered = rf"^(\d[\d.]*|[A-Z]\.?){SPACE}+(.*)$"
    number, rest = F.regexp_extract(line, numbered, 1), F.regexp_extract(line, numbered, 2)
    return F.when((number != "") & ~number.contains("..") & (rest == title), number)


def joined_lines(lines: Column) -> Column:
    """struct<text, spans array<struct<start, end>>>: lines joined by a space, a hyphen between letters at a break dropped."""
    span = "struct<start:int,end:int>"
    zero = F.struct(F.lit("").alias("text"), F.array().cast(f"array<{span}>").alias("spans"))

    def step(acc: Column, raw: Column) -> Column:
        line = strip(raw)
        text, spans = acc["text"], acc["spans"]
        glue = text.rlike(r"\p{L}-$") & line.rlike(r"^\p{L}")
        before = F.when(text == "", F.lit("")).when(glue, F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(F.concat(text, F.lit(" ")))
        # the hyphen leaves the last line that has a text
        last = F.array_max(F.transform(spans, lambda s, i: F.when(s["end"] > s["start"], i)))
        shrunk = F.when(glue & (text != ""), F.transform(spans, lambda s, i: F.when(i == last, F.struct(s["start"].alias("start"), (s["end"] - 1).alias("end"))).otherwise(s))).otherwise(spans)
        here = F.struct(F.length(before).alias("start"), (F.length(before) + F.length(line)).alias("end"))
        empty = F.struct(F.length(text).alias("start"), F.length(text).alias("end"))
        return (
            F.when(line == "", F.struct(text.alias("text"), F.concat(spans, F.array(empty)).cast(f"array<{span}>").alias("spans")))
            .otherwise(F.struct(F.concat(before, line).alias("text"), F.concat(shrunk, F.array(here)).cast(f"array<{span}>").alias("spans")))
        )

    return F.aggregate(lines, zero, step)


def dehyphenated(lines: Column) -> Column:
    """The text of `joined_lines` alone: one pass of a regular expression over the stripped lines."""
    kept = F.filter(F.transform(lines, strip), lambda x: x != "")
    return F.regexp_replace(F.regexp_replace(F.array_join(kept, "\n"), F.lit(r"(?<=\p{L})-\n(?=\p{L})"), F.lit("")), F.lit("\n"), F.lit(" "))


#: A mark that ends a sentence: what follows starts like a new one, or nothing does.
SENTENCE_END = rf"[.!?…](?=[\"'”’)\]]*{SPACE}+[\"'“„«(]*\p{{Lu}}|{SPACE}*$)"


def sentence_ends(text: Column) -> Column:
    """Places behind each sentence end."""
    gaps = F.split(text, SENTENCE_END, -1)
    lens = F.transform(F.slice(gaps, F.lit(1), F.size(gaps) - 1), lambda g: F.length(g) + 1)
    sums = F.aggregate(lens, F.array().cast("array<int>"), lambda a, n: F.concat(a, F.array(n + F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)))))
    return F.when(F.size(gaps) > 1, sums).otherwise(F.array().cast("array<int>"))


def sentence_around(text: Column, start: Column, end: Column) -> Column:
    """struct<start, end> of the sentence that holds [start, end)."""
    ends = sentence_ends(text)
    after = F.coalesce(F.array_max(F.filter(ends, lambda e: e <= start)), F.lit(0))
    blank = F.length(F.regexp_extract(F.substring(text, after + 1, F.greatest(start - after, F.lit(0))), f"^{SPACE}*", 0))
    first = after + blank
    until = F.array_min(F.filter(ends, lambda e: e > F.greatest(end - 1, first)))
    return F.struct(first.alias("start"), F.greatest(F.coalesce(until, F.length(text)), end).alias("end"))


def whole_words(text: Column, start: Column, end: Column) -> Column:
    """[start, end) without white space at its ends, widened to whole words; of nothing but white space it stays empty."""
    inner = F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))
    a = start + F.length(F.regexp_extract(inner, f"^{SPACE}*", 0))
    b = F.greatest(end - F.length(F.regexp_extract(inner, f"{SPACE}*$", 0)), a)
    left = F.length(F.regexp_extract(F.substring(text, F.lit(1), a), f"{NOT_SPACE}*$", 0))
    right = F.length(F.regexp_extract(F.substring(text, b + 1, F.length(text)), f"^{NOT_SPACE}*", 0))
    return F.when(a == b, F.struct(a.alias("start"), b.alias("end"))).otherwise(F.struct((a - left).alias("start"), (b + right).alias("end")))


def without_space(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(f"{SPACE}+"), F.lit(""))


def located(text: Column, wanted: Column, near: Column) -> Column:
    """struct<start, end> of the occurrence of ``wanted`` nearest to a place, white space ignored on both sides; the first of two equally near."""
    letters = F.filter(F.transform(F.split(text, ""), lambda c, i: F.struct(c.alias("c"), i.alias("i"))), lambda s: ~s["c"].rlike(f"^{SPACE}$") & (s["c"] != ""))
    bare, needle = without_space(text), without_space(wanted)
    places = F.filter(F.sequence(F.lit(1), F.length(bare) - F.length(needle) + 1), lambda p: F.substring(bare, p, F.length(needle)) == needle)
    nearest = F.array_min(F.transform(places, lambda p: F.struct(F.abs(F.try_element_at(letters, p)["i"] - near).alias("d"), p.alias("p"))))["p"]
    found = F.struct(F.try_element_at(letters, nearest)["i"].alias("start"), (F.try_element_at(letters, nearest + F.length(needle) - 1)["i"] + 1).alias("end"))
    return F.when((F.length(needle) > 0) & (F.length(needle) <= F.length(bare)) & nearest.isNotNull(), found)


def fnv1a(text: Column) -> Column:
    """FNV-1a of the characters, 32 bits, eight hexadecimal digits (equal to hashing UTF-16 units for characters up to U+FFFF)."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    h = F.aggregate(codes, F.lit(0x811C9DC5).cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(0x01000193)).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.lower(F.lpad(F.hex(h), 8, "0"))


def digest_id(prefix: str, page: Column, stroke: Column) -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.substring(fnv1a(F.concat(page, F.lit(":"), stroke)), 1, 6))


def sync_key(*parts: Column) -> Column:
    """Document, page (null for a whole notebook) and tag, by colons."""
    return F.concat_ws(":", *parts)


def file_name(name: Column, normalise=None) -> Column:
    """A name that every file system takes; ``normalise`` is the composition to NFC, for which Spark has no expression."""
    safe = F.regexp_replace(F.regexp_replace(name, F.lit(r'[/\\:*?"<>|]'), F.lit("-")), F.lit("[  ]"), F.lit(" "))
    safe = strip(normalise(safe) if normalise else safe)
    capped = F.when(F.length(safe) > MAX_NAME, strip(F.substring(safe, 1, MAX_NAME))).otherwise(safe)
    dotless = strip(F.regexp_replace(capped, F.lit(r"\.+$"), F.lit("")))
    base = F.when(dotless == "", F.lit("-")).otherwise(dotless)
    return F.when(base.rlike(RESERVED_NAMES), F.concat(base, F.lit("-"))).otherwise(base)


def base_name(name: Column, page: Column, normalise=None) -> Column:
    return F.concat(file_name(name, normalise), F.coalesce(F.concat(F.lit(" — Page "), page.cast("string")), F.lit("")))


def folder_of(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def without_end_slashes(folder: Column) -> Column:
    return F.regexp_replace(folder, F.lit("/+$"), F.lit(""))


def is_in_folder(path: Column, folder: Column) -> Column:
    return folder_of(path) == without_end_slashes(folder)


def in_folder(folder: Column, name: Column) -> Column:
    return F.when(folder == "", name).otherwise(F.concat(folder, F.lit("/"), name))


def attachment_path(folder: Column, doc: Column, page: Column) -> Column:
    return F.concat(without_end_slashes(folder), F.lit("/"), F.concat_ws("-", doc, page), F.lit(".pdf"))


def attachments_folder(given: Column) -> Column:
    bare = F.regexp_replace(strip(given), F.lit("^/+|/+$"), F.lit(""))
    odd = F.exists(F.split(bare, "/"), lambda s: s.isin(".", ".."))
    return F.when((bare == "") | odd, F.lit(DEFAULT_ATTACHMENTS)).otherwise(bare)


FRONT_MATTER = r"(?s)^---\r?\n.*?\r?\n---(?:\r?\n|$)"


def front_matter(note: Column) -> Column:
    return F.regexp_extract(note, FRONT_MATTER, 0)


def _body(note: Column) -> Column:
    return F.substring(note, F.length(front_matter(note)) + 1, F.length(note))


def _fence(body: Column, fence: str) -> Column:
    at = F.instr(body, fence)
    return F.when(at > 0, at - 1 + len(fence))


def managed_block(note: Column, fence: str = FENCE_END) -> Column:
    """The body up to and with its end fence, null without one."""
    return F.substring(_body(note), F.lit(1), _fence(_body(note), fence))


def free_area(note: Column, fence: str = FENCE_END) -> Column:
    """What stands behind the fence; without one, the whole body."""
    body = _body(note)
    return F.substring(body, F.coalesce(_fence(body, fence), F.lit(0)) + 1, F.length(body))


def transcript_of(note: Column, fence: str = FENCE_END) -> Column:
    at, head = F.instr(note, "\n## Transcript\n"), len("\n## Transcript\n")
    rest = F.substring(note, at + head, F.length(note))
    end = F.instr(rest, f"\n{fence}")
    return F.when((at > 0) & (end > 0), F.substring(rest, F.lit(1), end - 1))


def embed_of(note: Column) -> Column:
    return F.nullif(F.regexp_extract(note, EMBED, 1), F.lit(""))


def escaped(text: Column) -> Column:
    """Safe inside a note: no tag, no reference, no quote block."""
    return F.regexp_replace(F.regexp_replace(text, F.lit("[<&]"), F.lit("\\\\$0")), F.lit("^>"), F.lit("\\\\>"))


def anchor_title(line: Column) -> Column:
    """The first words of the line beside which a note stands."""
    words = F.filter(F.split(line, f"{SPACE}+"), lambda w: w != "")
    head = escaped(F.array_join(F.slice(words, 1, ANCHOR_WORDS), " "))
    return F.concat(F.lit("at »"), head, F.when(F.size(words) > ANCHOR_WORDS, F.lit("…")).otherwise(F.lit("")), F.lit("«"))


def marked_sentence(sentence: Column, runs: Column) -> Column:
    """The sentence with its runs between ==; runs with nothing but white space between them are one; plain if most of it is marked."""
    span = "array<struct<start:int,end:int>>"
    found = F.transform(F.filter(runs, lambda r: r != ""), lambda r: F.struct((F.instr(sentence, r) - 1).alias("start"), F.length(r).alias("n")))
    found = F.array_sort(F.filter(found, lambda s: s["start"] >= 0))

    def step(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        end = s["start"] + s["n"]
        joins = (F.size(acc) > 0) & (strip(F.substring(sentence, last["end"] + 1, F.greatest(s["start"] - last["end"], F.lit(0)))) == "")
        grown = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], end).alias("end"))))
        more = F.concat(acc, F.array(F.struct(s["start"].alias("start"), end.alias("end"))))
        return F.when(joins, grown.cast(span)).otherwise(more.cast(span))

    ranges = F.aggregate(found, F.array().cast(span), step)
    covered = F.aggregate(ranges, F.lit(0), lambda n, r: n + r["end"] - r["start"])
    starts = F.struct(F.lit("").alias("out"), F.lit(0).alias("cut"))
    put = F.aggregate(
        ranges, starts,
        lambda a, r: F.struct(F.concat(a["out"], F.substring(sentence, a["cut"] + 1, r["start"] - a["cut"]), F.lit("=="), F.substring(sentence, r["start"] + 1, r["end"] - r["start"]), F.lit("==")).alias("out"), r["end"].alias("cut")),
        lambda a: F.concat(a["out"], F.substring(sentence, a["cut"] + 1, F.length(sentence))),
    )
    return F.when(covered >= FULLY_MARKED * F.length(sentence), sentence).otherwise(put)


def region(source: Column) -> Column:
    """struct<page, x, y, width, height> of a block of `key: value` lines, null where any part of it is malformed."""
    lines = F.filter(F.split(source, "\n"), lambda x: strip(x) != "")
    well = ~F.exists(lines, lambda x: ~x.contains(":"))
    pairs = F.transform(lines, lambda x: F.struct(strip(F.substring_index(x, ":", 1)).alias("k"), strip(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("v")))

    def value(key: str) -> Column:
        return F.try_element_at(F.filter(pairs, lambda p: p["k"] == key), F.lit(-1))["v"]

    page = F.when(value("page").rlike(r"^\d+$"), value("page")).try_cast("int")
    parts = F.split(value("rect"), " +")
    numbers = F.transform(parts, lambda p: F.when(p.rlike(r"^-?\d+(\.\d+)?$"), p).try_cast("double"))
    whole = (F.size(parts) == 4) & F.forall(numbers, lambda n: n.isNotNull())
    return F.when(
        well & (page >= 1) & whole & (numbers[2] > 0) & (numbers[3] > 0),
        F.struct(page.alias("page"), numbers[0].alias("x"), numbers[1].alias("y"), numbers[2].alias("width"), numbers[3].alias("height")),
    )


def region_block(r: Column, language: str = "handwriting") -> Column:
    rect = F.concat_ws(" ", *(js_round(r[k]).cast("string") for k in ("x", "y", "width", "height")))
    return F.concat(F.lit(f"```{language}\npage: "), r["page"].cast("string"), F.lit("\nrect: "), rect, F.lit("\n```"))


def folded(text: Column) -> Column:
    """Lower case with quotes, dashes and spaces made plain; null where that changes the length."""
    out = F.lower(text)
    for pattern, plain in (("[‘’‛′]", "'"), ("[“”‟″]", '"'), ("[‐-―−]", "-"), ("[   ]", " ")):
        out = F.regexp_replace(out, F.lit(pattern), F.lit(plain))
    return F.when(F.length(out) == F.length(text), out)


def error_budget(length: Column) -> Column:
    return F.greatest(F.lit(2), F.floor(length * 0.15)).cast("int")


def anchor_words(quote: Column, most: int = 3) -> Column:
    """The longest distinct words of at least four letters, of one length in order of appearance."""
    words = F.array_distinct(F.regexp_extract_all(quote, F.lit(r"\p{L}{4,}"), F.lit(0)))
    keyed = F.array_sort(F.transform(words, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w"))))
    return F.transform(F.slice(keyed, 1, most), lambda s: s["w"])


def line_shape(line: Column) -> Column:
    """A line as text rather than as bytes: quotes, dashes and white space in one form. Compose it first (`functions.python.nfc`) where it may hold combining marks."""
    for pattern, plain in (("[‘’ʼ]", "'"), ("[“”]", '"'), ("[‐-―]", "-"), (SPACE + "+", " ")):
        line = F.regexp_replace(line, F.lit(pattern), F.lit(plain))
    return strip(line)


def is_same_line(a: Column, b: Column, least: float = 0.6) -> Column:
    """Whether two readings are of one line: edit distance at most 40 % of the longer; two empty ones are."""
    x, y = line_shape(a), line_shape(b)
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(longest == 0, F.lit(True)).otherwise(1 - F.levenshtein(x, y) / longest >= least)


def remapped_path(kind: Column, path: Column, old: Column, new: Column) -> Column:
    """Where a note is after a renaming: of itself, if the kind is file, or of a folder above it; null if the renaming is none of its business."""
    under = F.startswith(path, F.concat(old, F.lit("/")))
    return F.when((kind == "file") & (path == old), new).when((kind != "file") & under, F.concat(new, F.substring(path, F.length(old) + 1, F.length(path))))


def paint_operands(content: Column) -> Column:
    """Black operands put before colour operators that have neither a number nor a pattern name in front of them; null if there is none."""
    given = r"(?<!\d\s{0,47})(?<!/[^\s/]{1,47}\s{0,46})"
    fixed = F.regexp_replace(content, F.lit(rf"(?<![A-Za-z]){given}(scn|SCN)(?![A-Za-z])"), F.lit("0 0 0 $1"))
    return F.when(fixed != content, fixed)


def byte_size(n: Column) -> Column:
    """Gigabytes are rounded by their exact binary value, ties to even, as C does (``format_string`` rounds the shortest decimal up)."""
    return F.when(n >= 1e9, F.concat(F.call_function("format_number", n / 1e9, F.lit("0.0")), F.lit(" GB"))).otherwise(F.concat(js_round(n / 1e6).cast("string"), F.lit(" MB")))


def duration(seconds: Column) -> Column:
    """A span at a resolution that widens with it: a minute, five, ten, half an hour."""
    minutes = seconds / 60
    step = F.when(minutes < 30, 5).otherwise(10)
    rounded = F.greatest(js_round(minutes / step) * step, step).cast("int")
    halves = js_round(minutes / 60 * 2)
    hours = F.when(halves % 2 == 0, (halves / 2).cast("int").cast("string")).otherwise(F.format_string("%.1f", halves / 2))
    return (
        F.when(seconds < 90, F.lit("about a minute")).when(minutes < 90, F.concat(F.lit("about "), rounded.cast("string"), F.lit(" minutes")))
        .otherwise(F.concat(F.lit("about "), hours, F.lit(" hours")))
    )


def sanitized_transcript(text: Column) -> Column:
    """Without a first line that only announces the transcript, and without a plain or Markdown fence around all the rest; nothing inside is touched."""
    blank = r"[^\S\n]*"
    body = F.regexp_replace(strip(text), F.lit(rf"\A(?i:here (?:is|are)(?: the)? (?:transcript|transcription)[:.]?){blank}(?:\n(?:{blank}(?:\n|\z))?|\z)"), F.lit(""))
    return strip(F.regexp_replace(strip(body), F.lit(rf"(?s)\A```(?i:markdown|md)?{blank}\n(.*\n)?{blank}```\z"), F.lit("$1")))


def mapping_fingerprint(mapping: Column, version: int = 3) -> Column:
    """The version of the routing rules and the pairs of a mapping, by key."""
    pairs = F.transform(F.array_sort(F.map_entries(mapping)), lambda e: F.array(e["key"], e["value"]))
    return F.concat(F.lit(f"{version}:"), F.to_json(pairs))


#: What errors say when the machine is offline, and when it is turned away.
OFFLINE = r"(?i)network|failed to fetch|fetch failed|enotfound|econnrefused|eai_again|getaddrinfo|err_internet_disconnected|offline"
REJECTED = r"(?i)\b401\b|\b403\b|unauthorized|unauthorised|forbidden|invalid[ _-]?token|token[ _-]?expired"


def error_class(message: Column, context: Column) -> Column:
    """offline, code (whatever else goes wrong while connecting means a stale code), rejected or unexpected."""
    return F.when(message.rlike(OFFLINE), "offline").when(context == "connect", "code").when(message.rlike(REJECTED), "rejected").otherwise("unexpected")


def any_matches(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (text.rlike(p) for p in patterns))


def diagnostics(fields: dict[str, Column]) -> Column:
    return F.concat_ws("\n", *(F.concat(F.lit(f"{k}: "), F.coalesce(v.cast("string"), F.lit("-"))) for k, v in fields.items()))


def measured(text: Column, widths: dict[str, float], default: float) -> Column:
    """Sum of the advance widths of the characters."""
    table = F.create_map(*(F.lit(x) for pair in widths.items() for x in pair)) if widths else F.lit(None).cast("map<string,double>")
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(letters, F.lit(0.0), lambda n, c: n + F.coalesce(table[c], F.lit(float(default))))


def drawable(text: Column) -> Column:
    return F.regexp_replace(text, F.lit("[​-‍⁠﻿­]"), F.lit(""))


def break_chunks(paragraph: Column) -> Column:
    """Where a line may be broken: each space by itself, and behind every slash of a word."""
    words = F.transform(F.split(paragraph, " "), lambda w, i: F.concat(F.when(i > 0, F.array(F.lit(" "))).otherwise(F.array().cast("array<string>")), F.split(w, "(?<=/)")))
    return F.filter(F.flatten(words), lambda c: c != "")


def wrapped(paragraph: Column, width: float, widths: dict[str, float], default: float) -> Column:
    """Greedy lines against a measured width, array of struct<text, length>: what is drawn, and how many characters the line takes, spaces at its end and
    characters that are never drawn included. A space at the end never counts against the width; a chunk wider than the line has one to itself."""
    line = F.struct(F.lit("").alias("text"), F.lit(0).alias("length"))
    start = F.struct(F.array().cast("array<struct<text:string,length:int>>").alias("lines"), F.lit("").alias("line"))

    def closed(text: Column) -> Column:
        return F.struct(drawable(F.rtrim(text)).alias("text"), F.length(text).alias("length"))

    def step(state: Column, chunk: Column) -> Column:
        both = F.concat(state["line"], chunk)
        full = (chunk != " ") & (F.rtrim(state["line"]) != "") & (measured(F.rtrim(both), widths, default) > width)
        grown = F.when(full, F.concat(state["lines"], F.array(closed(state["line"])))).otherwise(state["lines"])
        return F.struct(grown.alias("lines"), F.when(full, chunk).otherwise(both).alias("line"))

    done = F.aggregate(break_chunks(paragraph), start, step, lambda s: F.concat(s["lines"], F.array(closed(s["line"]))))
    return F.when(paragraph == "", F.array(line)).otherwise(done)
