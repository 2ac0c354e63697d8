r"""Phrase collocations of each language: phrases whose words stand together far more often than their parts do.

Documents are dealt into blocks of bounded size, whatever their language or text. A block first hashes its different phrases of up to ``LONGEST`` words and sends each shard of hashes one compressed list with their counts; a
shard sums them and tells each block which of its hashes are frequent enough. Hashes only rule phrases out: one that collides is counted too high, never too low. Then
each block builds the generalised suffix automaton of what is left, by language, to the depth of ``LONGEST`` words, and its states give every phrase once with its count of
end places. Those go to the shards again, one compressed list from each block, and the shards sum them by the phrases themselves: these counts are exact.

A phrase's score comes from the cut of its words at which the parts are commonest. A phrase inside a longer candidate that is nearly as frequent is dropped: as counts only fall
from a phrase to its extensions, it is enough to look along the suffix link of each candidate (the phrase without its first word) and along the transition into it (without its last).

Cases: null text is empty; null languages are ``und``; repeated rows and rows with one id or none count each; ties go as the query's contract says, then nothing is left to tie; very long texts are read
whole, alone in their block; words are bytes, so no character is lost; an empty table gives an empty result; other columns are not read. The table must be a stored one: which block a row goes to
depends on where it stands.
"""

from __future__ import annotations

import string
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annolake.llm.blocks import packed, unpacked
from annolake.llm.columns import joined, release
from annolake.llm.suffix_automaton import automaton
from annolake.llm.tables import Scratch, blocks_by_bytes, table, text_or_empty
from annolake.llm.words import words

LONGEST, LEAST, TOP, COVERED = 4, 30, 2000, 80
#: Bytes of text of a block; bits of a hash beyond those that number the corpus' bytes; copies of a language's ranking, and of a part's count.
BLOCK, SPARE, RANKS, SALTS = 16 << 20, 16, 64, 16
_CUT = np.isin(np.arange(256), [ord(c) for c in ".,;:!?\x0a\x0b\x0c\x0d"])
_IS_WORD = ~_CUT & ~np.isin(np.arange(256), [9, 32])
_LISTS = pa.schema([("b", pa.int32()), ("shard", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])
_COUNTS = pa.schema([("lang", pa.string()), ("k", pa.int32()), ("phrase", pa.binary()), ("n", pa.int64())])
_CHUNKS = pa.schema([("shard", pa.int32()), ("chunk", pa.binary())])
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _planes(numbers: np.ndarray) -> bytes:
    """Compressed: the first bytes of all numbers, then the second ones and so on."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers).view(np.uint8).reshape(len(numbers), numbers.itemsize).T.tobytes())


def _numbers(planes: pa.Scalar, kind: type) -> np.ndarray:
    import zstandard

    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(planes.as_buffer()), np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _rising(hashes: np.ndarray) -> bytes:
    return _planes(np.diff(hashes, prepend=hashes.dtype.type(0)))


class Text:
    """A block's words of one language, and which places of phrases are left on each level."""

    def __init__(self, lang: str, texts: pa.Array, bits: int):
        import xxhash

        self.vocabulary, self.ids, piece = words(texts, _IS_WORD, _CUT)
        seed = lang.encode() + b"\0"
        own = np.array([xxhash.xxh3_64_intdigest(seed + w) for w in self.vocabulary.to_pylist()], np.uint64)
        self.single, self.piece, self.shift = own[self.ids] if len(own) else np.zeros(0, np.uint64), piece, np.uint64(64 - bits)

    def first(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and full hashes of single words."""
        return np.arange(len(self.ids)), self.single

    def longer(self, k: int, places: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of phrases of k words, from those of one less: all that have a word before them in their piece and whose beginning is left as well."""
        left = np.zeros(len(self.ids), bool)
        left[places] = True
        ok = places >= k - 1
        ok[ok] = (self.piece[places[ok]] == self.piece[places[ok] - k + 1]) & left[places[ok] - 1]
        at = places[ok]
        h = hashes[ok] * _A + self.single[at - k + 1]
        h ^= h >> np.uint64(32)
        h *= _B
        h ^= h >> np.uint64(29)
        return at, h


def _by_lang(chunks: pa.Table) -> dict[str, pa.Array]:
    """A block's texts of each language."""
    lots: dict[str, list[pa.Array]] = {}
    for batch in unpacked(chunks):
        coded = batch.column("lang").dictionary_encode()
        for i, lang in enumerate(coded.dictionary.to_pylist()):
            lots.setdefault(lang, []).append(batch.column("text").filter(pa.array(coded.indices.to_numpy() == i)))
    return {lang: pa.concat_arrays(lots.pop(lang)) for lang in list(lots)}


def _asked(longest: int, bits: int, shards: int) -> Callable[[tuple[pa.Scalar, ...], pa.Table], pa.Table]:
    """One list for each shard: a block's different hashes with their counts."""

    def run(key: tuple[pa.Scalar, ...], chunks: pa.Table) -> pa.Table:
        release()
        hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)]
        for lang, texts in _by_lang(chunks).items():
            text = Text(lang, texts, bits)
            places, full = text.first()
            for k in range(1, longest + 1):
                places, full = text.longer(k, places, full) if k > 1 else (places, full)
                own = np.sort(full >> text.shift)
                new = np.nonzero(np.concatenate([[True], own[1:] != own[:-1]]))[0] if len(own) else np.zeros(0, np.int64)
                hashes.append(own[new])
                counts.append(np.diff(new, append=len(own)).astype(np.uint32))
            del text
        every, n = np.concatenate(hashes), np.concatenate(counts)
        del hashes, counts
        order = np.argsort(every)
        every, n = every[order], n[order]
        limits = np.searchsorted(every, np.array([(s << bits) // shards for s in range(1, shards)], np.uint64))
        rows = [{"b": key[0].as_py(), "shard": s, "hashes": _rising(h), "counts": _planes(c)} for s, (h, c) in enumerate(zip(np.split(every, limits), np.split(n, limits), strict=True)) if len(h)]
        return pa.Table.from_pylist(rows, _LISTS)

    return run


def _frequent(least: int) -> Callable[[pa.Table], pa.Table]:
    """For each block those of its hashes whose counts of all blocks reach the limit."""

    def run(lists: pa.Table) -> pa.Table:
        release()
        blocks = lists.column("b").to_numpy()
        own = [np.cumsum(_numbers(h, np.uint64), dtype=np.uint64) for c in lists.column("hashes").chunks for h in c]
        n = np.concatenate([_numbers(c, np.uint32) for chunk in lists.column("counts").chunks for c in chunk])
        source = np.repeat(np.arange(len(own), dtype=np.int32), [len(h) for h in own])
        every = np.concatenate(own)
        del own
        order = np.argsort(every, kind="stable")
        every, source = every[order], source[order]
        new = np.nonzero(np.concatenate([[True], every[1:] != every[:-1]]))[0]
        often = np.repeat(np.add.reduceat(n[order], new, dtype=np.int64) >= least, np.diff(new, append=len(every)))
        every, source = every[often], source[often]
        order = np.argsort(source, kind="stable")
        every, source = every[order], source[order]
        starts = np.searchsorted(source, np.arange(len(blocks) + 1))
        rows = []
        for i, b in enumerate(blocks):
            mine = every[starts[i] : starts[i + 1]]
            if len(mine):
                rows.append({"b": int(b), "hashes": _rising(np.unique(mine))})
        return pa.Table.from_pylist(rows, pa.schema([("b", pa.int32()), ("hashes", pa.binary())]))

    return run


def _phrases(vocabulary: pa.Array, ids: np.ndarray, end: np.ndarray, k: int) -> pa.Array:
    """Phrases of k words that end at some places, with spaces between."""
    data, ends = (np.frombuffer(vocabulary.buffers()[2] or b"", np.uint8), np.frombuffer(vocabulary.buffers()[1], np.int32 if pa.types.is_binary(vocabulary.type) else np.int64)[vocabulary.offset :])
    own = ids[end[:, None] + np.arange(-k + 1, 1)].ravel()
    size = (ends[own + 1] - ends[own]).astype(np.int64)
    stops = np.cumsum(size + 1)  # each word and a space
    out = np.full(int(stops[-1]) if len(stops) else 0, 32, np.uint8)
    spot = np.arange(len(out) - len(own)) + np.repeat(np.arange(len(own)), size)
    out[spot] = data[np.repeat(ends[own] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
    last = np.zeros(len(out), bool)
    last[stops[k - 1 :: k] - 1] = True
    return joined(out[~last], np.concatenate([[0], stops[k - 1 :: k] - np.arange(1, len(end) + 1)]))


def _counted(longest: int, bits: int, shards: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A block's phrases of frequent hashes with their counts: one compressed list for each shard."""

    def run(chunks: pa.Table, told: pa.Table) -> pa.Table:
        release()
        known = np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.cumsum(_numbers(h, np.uint64), dtype=np.uint64) for c in told.column("hashes").chunks for h in c)]))
        limits = np.array([(s << bits) // shards for s in range(1, shards)], np.uint64)
        lots: list[list[pa.RecordBatch]] = [[] for _ in range(shards)]

        def add(lang: str, k: int, phrase: pa.Array, n: np.ndarray, hashes: np.ndarray) -> None:
            rows = pa.record_batch([pa.array([lang] * len(n), pa.string()), pa.array(np.full(len(n), k, np.int32)), phrase.cast(pa.binary()), pa.array(n.astype(np.int64))], schema=_COUNTS)
            order = np.argsort(hashes)
            cuts = [0, *np.searchsorted(hashes[order], limits), len(n)]
            rows = rows.take(pa.array(order))
            for own, start, end in zip(lots, cuts[:-1], cuts[1:], strict=True):
                if end > start:
                    own.append(rows.slice(start, end - start))

        for lang, texts in _by_lang(chunks).items():
            text = Text(lang, texts, bits)
            add(lang, 0, pa.array([b""], pa.binary()), np.array([len(text.ids)]), np.zeros(1, np.uint64))
            levels, hashes = [], []
            places, full = text.first()
            for k in range(1, longest + 1):
                places, full = text.longer(k, places, full) if k > 1 else (places, full)
                different, where = np.unique(full >> text.shift, return_inverse=True)
                spot = np.searchsorted(known, different)
                left = (np.append(known, np.uint64(0))[spot] == different) & (spot < len(known))
                places, full = places[left[where]], full[left[where]]
                levels.append(places)
                hashes.append(full >> text.shift)
            end, length, n = automaton(text.ids, levels).substrings()
            for k in range(1, longest + 1):
                here = length == k
                add(lang, k, _phrases(text.vocabulary, text.ids, end[here], k), n[here], hashes[k - 1][np.searchsorted(levels[k - 1], end[here])])
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=1))
        rows = []
        for s, own in enumerate(lots):
            if own:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, _COUNTS, options=options) as writer:
                    writer.write_table(pa.Table.from_batches(own).combine_chunks().sort_by("phrase"))
                rows.append({"shard": s, "chunk": sink.getvalue().to_pybytes()})
        return pa.Table.from_pylist(rows, _CHUNKS)

    return run


def _summed(least: int) -> Callable[[pa.Table], pa.Table]:
    """A shard's phrases, by themselves: (lang, k, phrase, f) of the frequent ones."""

    def run(chunks: pa.Table) -> pa.Table:
        import pyarrow.compute as pc

        release()
        every = pa.Table.from_batches(list(unpacked(chunks)), _COUNTS).group_by(["lang", "k", "phrase"]).aggregate([("n", "sum")])
        often = every.filter(pc.or_(pc.greater_equal(every.column("n_sum"), least), pc.equal(every.column("k"), 0)))
        return pa.table([often.column(c) for c in ("lang", "k", "phrase", "n_sum")], names=["lang", "k", "phrase", "f"])

    return run


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, lang: str = "lang", text: str = "text", size: int = BLOCK, scratch: Scratch | None = None, spare: int = SPARE) -> DataFrame:
    """(lang, k, phrase, f): how often each phrase of 1 to ``longest`` words stands, of those that stand ``least`` times, and of k = 0 how many words there are."""
    scratch = scratch or Scratch(docs.sparkSession)
    count = blocks_by_bytes(docs, text, size)
    bits = min(64, spare + (count * size).bit_length())
    shards = max(count, 8)
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), text_or_empty(text).alias("text")).withColumn("row", F.monotonically_increasing_id())
    chunks = scratch.bucketed(packed(rows, "row", count), count, "b", "phrases")
    lists = chunks.groupBy("b").applyInArrow(_asked(longest, bits, shards), "b int, shard int, hashes binary, counts binary")
    told = scratch.write(lists.groupBy("shard").applyInArrow(_frequent(least), "b int, hashes binary"), "frequent")
    found = chunks.groupBy("b").cogroup(told.groupBy("b")).applyInArrow(_counted(longest, bits, shards), "shard int, chunk binary")
    counts = found.groupBy("shard").applyInArrow(_summed(least), "lang string, k int, phrase binary, f bigint")
    return scratch.write(counts.select("lang", "k", F.col("phrase").cast("string").alias("phrase"), "f"), "counts")


def _words_of(n: Column) -> Column:
    """The first n words of a phrase, or the last -n."""
    return F.call_function("substring_index", F.col("phrase"), F.lit(" "), n)


def scored(counts: DataFrame, covered: int = COVERED) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the candidates that no longer one covers; ``counts`` as of `phrase_counts`, a written table."""
    candidates = counts.where("k > 1").select("lang", "k", "phrase", F.col("f").alias("a"))
    # parts of many phrases, like common words, are spread over salts
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")
    at = F.explode(F.sequence(F.lit(1), F.col("k") - 1))
    cuts = candidates.select("lang", "k", "phrase", "a", at.alias("cut"), salt.alias("salt"))
    parts_ = F.array(_words_of(F.col("cut")), _words_of(F.col("cut") - F.col("k")))
    cuts = cuts.select("*", F.posexplode(parts_).alias("side", "part"))
    known = counts.where("k > 0").select("lang", F.col("phrase").alias("part"), "f", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    # merged, not broadcast: the table is some MB as compressed files, of which its salted rows in the driver's memory would be hundreds of times as much
    both = cuts.join(known.hint("merge"), ["lang", "part", "salt"]).groupBy("lang", "phrase", "a", "cut").agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    score = F.expr("cast(2000000 * cast(a as decimal(20, 0)) div (cast(l as decimal(20, 0)) + r) as bigint)")
    worst = F.min(F.struct(score.alias("score"), "cut", "l", "r"))
    best = both.groupBy("lang", "phrase", "a").agg(worst.alias("w")).select("lang", "phrase", "a", "w.l", "w.r", "w.score")
    longer = candidates.where("k > 2")
    link, prefix = _words_of(1 - F.col("k")), _words_of(F.col("k") - 1)
    over = longer.select("lang", F.explode(F.array_distinct(F.array(link, prefix))).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("over"))
    return best.join(over.hint("merge"), ["lang", "phrase"], "left").where("over IS NULL OR 100 * cast(over as decimal(20, 0)) < %d * cast(a as decimal(20, 0))" % covered).drop("over")


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, longest: int = LONGEST, covered: int = COVERED, lang: str = "lang", text: str = "text", size: int = BLOCK) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases."""
    scratch = Scratch(docs.sparkSession)
    counts = phrase_counts(docs, least, longest, lang, text, size, scratch)
    order = (F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    # the best of each of a language's salts, then the best of those: no task ranks a whole language
    found = scored(counts, covered).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(RANKS)))
    found = found.withColumn("at", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).where(F.col("at") <= top).drop("at", "salt")
    found = found.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    n = counts.where("k = 0").select("lang", F.col("f").alias("n"))
    out = scratch.write(found.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations", keep=True)
    scratch.clear()
    return out


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


OP11_SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
),
worded AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM worded, (SELECT unnest([1, 2, 3, 4]) AS k))),
counts AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY lang, k, phrase),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k > 1 AND f >= {LEAST}),
cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM candidates),
judged AS (
  SELECT c.lang, c.k, c.phrase, c.a, cut, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a) // (x.f + y.f) AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:cut], ' ') JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[cut + 1:], ' ')
),
lowest AS (SELECT * FROM judged QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
kept AS (
  SELECT * FROM lowest c WHERE NOT EXISTS (
    SELECT 1 FROM candidates o WHERE o.lang = c.lang AND o.k > c.k AND 100 * o.a >= {COVERED} * c.a AND contains(' ' || o.phrase || ' ', ' ' || c.phrase || ' ')
  )
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM kept JOIN totals USING (lang) QUALIFY rank <= {TOP}
"""
