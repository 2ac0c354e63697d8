"""Quality classification by a modified Kneser-Ney model of the characters of running text, trained on trusted text.

A text is read from a start to an end mark with single spaces for white space, and its character n-grams, which go on across words, give for each language of the trusted documents
the counts of the highest order; each lower order counts in how many different grams a gram is a suffix. Discounts come from each order's own
counts of counts. A gram goes by a key of 64 bits. Counts, contexts and discounts are tables, joined into one probability for each gram of the model, and sharded by gram. A block of documents asks every shard for its
different grams, one compressed list for each shard; what a gram has that the model lacks comes from what its contexts leave. A document's logarithms are sums over what comes back.

A tenth of the trusted documents (by hash of the id) takes no part in the counts; for each language a quantile of their mean surprisal per
character is the threshold. A document's surprisal is lowered by an allowance for its length before it is compared, so a short clean text isn't rejected by chance.

Cases: null or empty text has no surprisal and is kept, as nothing speaks against it (``perplexity`` null); a null language is one of its own (''); a language without
trusted documents has no threshold and its documents are kept; repeated rows are judged each; a document labelled several times is trusted if no
label speaks against it; very long texts are scored whole; there are no ties to break (a surprisal that equals the threshold is kept); empty tables give an empty result; other
columns are not read, so clashing names do no harm.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annolake.llm.blocks import block_of, packed, unpacked
from annolake.llm.columns import release
from annolake.llm.tables import Scratch, blocks_by_bytes, table, text_or_empty

ORDER = 5
#: Share of held-out trusted documents whose surprisal is at most the threshold; standard errors by which a document's own surprisal is lowered.
QUANTILE, ALLOWANCE = 0.98, 1.0
HELD_OUT = 10
START, END = "\x02", "\x03"
#: Characters that are taken apart at once, and in one step of that; bytes of text of a block, and shards of the model at most.
LOT, PIECE, BLOCK, SHARDS = 1_000_000, 1 << 15, 32 << 20, 1024
#: Blocks whose lists of counts a task merges at once.
MERGED = 4096
_LISTS = pa.schema([("b", pa.int32()), ("shard", pa.int32()), ("lang", pa.string()), ("grams", pa.binary())])
_TOTALS = pa.schema([("lang", pa.string()), ("n", pa.int64()), ("keys", pa.list_(pa.int64())), ("contexts", pa.list_(pa.int64()))])
_SCORES = (("doc", pa.int64()), ("lang", pa.string()), ("nats", pa.float64()), ("squares", pa.float64()), ("chars", pa.int64()))


def _spaced(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Each text with single spaces: all that is scored."""
    return batch.set_column(2, "text", pa.array([" ".join(text.as_py().split()) for text in batch.column(2)], pa.string()))


def grams(text: str, order: int = ORDER) -> list[str]:
    """For each character of the text and its end mark: it, with what stands before it, ``order`` characters at most."""
    marked = START + text + END
    first = [marked[:i] for i in range(2, min(order, len(marked) + 1))]
    return first + [marked[i : i + order] for i in range(len(marked) - order + 1)]


@functools.cache
def _multipliers(order: int) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(bytes((k,))) | 1 for k in range(order)], np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Sums to keys, one to one."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h.view(np.int64)


def gram_key(gram: str) -> int:
    """A gram's key: of 64 bits, from a sum of its code points, each with the multiplier of its distance from the end."""
    codes = np.array([ord(c) + 1 for c in reversed(gram)], np.uint64)
    return int(_mixed((codes * _multipliers(max(len(gram), 1))[: len(gram)]).sum(keepdims=True, dtype=np.uint64))[0])


def distinct_grams(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different `grams` of some texts: their sums, their characters (one more than the code point, the last first, 0 where the text hasn't begun); then the place
    among them of each gram in order, and where each text's grams begin."""
    gap = "\0" * (order - 1)  # between texts, so that no gram reaches into the one before
    points = np.frombuffer((gap + "".join(f"{START}{t}{END}{gap}" for t in texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = order - 1 + np.cumsum([0, *(len(t) + order + 1 for t in texts)])
    codes, real, m = points + np.uint32(1), np.ones(len(points), bool), _multipliers(order)
    for back in range(1, order):
        real[starts - back] = False
    codes[~real] = 0
    real[starts[:-1]] = False  # a start mark is only ever a context
    sums = np.zeros(len(codes), np.uint64)
    for low in range(order - 1, len(codes), PIECE):  # pieces stay in a processor's cache
        piece = sums[low : low + PIECE]
        for back in range(order):
            piece += m[back] * codes[low - back : low - back + len(piece)]
    at = np.nonzero(real)[0]
    found = pa.array(sums[at]).dictionary_encode()
    place, where = np.asarray(found.indices), np.empty(len(found.dictionary), np.int64)
    where[place] = at
    return np.asarray(found.dictionary), codes[where[:, None] - np.arange(order)], place, np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])


def suffix_keys(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of grams by their characters: the keys of their last 1, 2, ... characters, and of what stands before the last character in each of those."""
    m, codes = _multipliers(letters.shape[1]), letters.astype(np.uint64)
    before = np.zeros_like(codes)
    before[:, 1:] = np.cumsum(codes[:, 1:] * m[:-1], axis=1)
    return _mixed(np.cumsum(codes * m, axis=1)), _mixed(before)


def _by_lang(chunks: pa.Table) -> Iterator[tuple[str, list[int], list[str]]]:
    """The documents of a block by language, in lots of about ``LOT`` characters."""
    for batch in unpacked(chunks):
        lots: dict[str, tuple[list, list]] = {}
        sizes: Counter = Counter()
        for doc, lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            docs, texts = lots.setdefault(lang, ([], []))
            docs.append(doc)
            texts.append(text.as_py())
            sizes[lang] += len(texts[-1])
            if sizes[lang] >= LOT:
                yield lang, *lots.pop(lang)
                sizes[lang] = 0
        for lang, (docs, texts) in lots.items():
            yield lang, docs, texts


def _merged(lots: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different grams of several lots of (sums, characters, counts), their counts summed."""
    sums, first, place = np.unique(np.concatenate([a for a, _, _ in lots]), return_index=True, return_inverse=True)
    return sums, np.concatenate([a for _, a, _ in lots])[first], np.bincount(place, np.concatenate([a for _, _, a in lots]), len(sums)).astype(np.int64)


def _sharded(keys: np.ndarray, shards: int) -> list[np.ndarray]:
    """The places of the keys of each shard, in order. A shard is a range of keys, so what it holds is close together."""
    shard = ((keys >> 32) + (1 << 31)) * shards >> 32
    return np.split(np.argsort(shard, kind="stable"), np.cumsum(np.bincount(shard, minlength=shards))[:-1])


def _counted(order: int, shards: int):
    """The grams of the highest order in a block's trusted documents, for each shard of the model one list."""

    def run(chunks: pa.Table, trusted: pa.Table) -> pa.Table:
        release()
        wanted = set(trusted.column("doc").to_pylist())
        lots: dict[str, list] = {}
        for lang, docs, texts in _by_lang(chunks) if wanted else ():
            if some := [t for d, t in zip(docs, texts, strict=True) if t and d in wanted]:
                sums, letters, at, _ = distinct_grams(some, order)
                lots.setdefault(lang, []).append((sums, letters, np.bincount(at, minlength=len(sums))))
        rows = []
        for lang, own in lots.items():
            sums, letters, n = _merged(own)
            rows += [{"b": chunks.column("b")[0].as_py(), "shard": k, "lang": lang, "grams": _packed_counts(letters[here], n[here])} for k, here in enumerate(_sharded(_mixed(sums), shards)) if len(here)]
        return pa.Table.from_pylist(rows, _LISTS)

    return run


def _totals(order: int, salted: bool):
    """A shard's lists as one, compressed again (``salted``) or with a row for each gram: its count, the keys of its suffixes, shortest first, and of their contexts."""

    def run(rows: pa.Table) -> pa.Table:
        m, lots = _multipliers(order), {}
        for lang, grams_ in zip(rows.column("lang").to_pylist(), (g for c in rows.column("grams").chunks for g in c), strict=True):
            letters, n = _unpacked_counts(grams_, order)
            lots.setdefault(lang, []).append(((letters.astype(np.uint64) * m).sum(1, dtype=np.uint64), letters, n))
        merged = {lang: _merged(own)[1:] for lang, own in lots.items()}
        if salted:
            b, shard = rows.column("b")[0].as_py(), rows.column("shard")[0].as_py()
            return pa.Table.from_pylist([{"b": b, "shard": shard, "lang": lang, "grams": _packed_counts(*own)} for lang, own in merged.items()], _LISTS)
        parts = [_TOTALS.empty_table()]
        for lang, (letters, n) in merged.items():
            keys, contexts = suffix_keys(letters)
            real = letters > 0
            ends = pa.array(np.concatenate([[0], np.cumsum(real.sum(1))]), pa.int32())
            lists = (pa.ListArray.from_arrays(ends, pa.array(x[real])) for x in (keys, contexts))
            parts.append(pa.Table.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(n), *lists], schema=_TOTALS))
        return pa.concat_tables(parts)

    return run


def _asked(order: int, shards: int):
    """For each shard of the model the keys of all suffixes of a block's grams."""

    def run(key: tuple[pa.Scalar, ...], chunks: pa.Table) -> pa.Table:
        release()
        lots: dict[str, list] = {}
        for lang, _, texts in _by_lang(chunks):
            if some := [t for t in texts if t]:
                letters = distinct_grams(some, order)[1]
                lots.setdefault(lang, []).append(np.unique(suffix_keys(letters)[0][letters > 0]))
        rows = []
        for lang, own in lots.items():
            asked = np.unique(np.concatenate([*own, [gram_key(""), gram_key(START)]]))
            rows += [{"b": key[0].as_py(), "shard": k, "lang": lang, "grams": _packed_keys(asked[here])} for k, here in enumerate(_sharded(asked, shards)) if len(here)]
        return pa.Table.from_pylist(rows, _LISTS)

    return run


def _planes(numbers: np.ndarray) -> bytes:
    """The bytes of numbers, all first ones, all second ones and so on: alike ones stand together."""
    return np.ascontiguousarray(numbers).view(np.uint8).reshape(len(numbers), -1).T.tobytes() if len(numbers) else b""


def _packed_counts(letters: np.ndarray, n: np.ndarray) -> bytes:
    """Characters and counts in the order of the characters."""
    import zstandard

    order = np.lexsort(letters.T)
    return zstandard.ZstdCompressor(level=3).compress(_planes(letters[order]) + _planes(n[order]))


def _unpacked_counts(packed_: pa.Scalar, order: int) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed_.as_buffer()), np.uint8).reshape(4 * order + 8, -1)
    return np.ascontiguousarray(planes[: 4 * order].T).view(np.uint32), np.ascontiguousarray(planes[4 * order :].T).view(np.int64).ravel()


def _packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys by their distances, high bytes first."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(_planes(np.diff(keys, prepend=0)))


def _unpacked_keys(packed_: pa.Scalar) -> np.ndarray:
    import zstandard

    return np.cumsum(np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(packed_.as_buffer()), np.uint8).reshape(8, -1).T).view(np.int64).ravel())


def _answers(asks: pa.Table, known: pa.Table) -> pa.Table:
    """A shard's answers: of each question's keys those that the model has, with minus the logarithm of a gram's probability and of what it leaves as a context."""
    tables: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    langs = np.array(known.column("lang").to_pylist(), object)
    keys, values = np.asarray(known.column("gram")), np.array([known.column(c).to_numpy() for c in ("nats", "less")], "<f4")
    for lang in set(langs.tolist()):
        here = np.nonzero(langs == lang)[0]
        here = here[np.argsort(keys[here])]
        tables[lang] = keys[here], values[:, here]
    grams_, nats = [], []
    for lang, question in zip(asks.column("lang").to_pylist(), (g for c in asks.column("grams").chunks for g in c), strict=True):
        asked, (own, told) = _unpacked_keys(question), tables.get(lang, (np.zeros(0, np.int64), np.zeros((2, 0), "<f4")))
        place = np.searchsorted(own, asked)
        has = np.append(own, 0)[place] == asked if len(own) else np.zeros(len(asked), bool)
        has &= place < len(own)
        grams_.append(_packed_keys(asked[has]))
        nats.append(_packed_values(told[:, place[has]]))
    return pa.table({"b": asks.column("b"), "lang": asks.column("lang"), "grams": pa.array(grams_, pa.binary()), "nats": pa.array(nats, pa.binary())})


def shares_of(totals: DataFrame, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """From counts (lang, n, keys, contexts) of the highest order, by keys of suffixes and of their contexts, the tables (lang, k, gram, ctx, rest, share) and (lang, ctx, left): a
    gram's discounted share of its context, and what the context leaves to the next lower order. ``rest`` is the gram without its first character."""
    # every suffix once, with its count where it is of the highest order or starts a text
    parts = totals.select("lang", "n", "keys", F.posexplode(F.arrays_zip("keys", "contexts")).alias("k", "p"))
    rest = F.when(F.col("k") > 0, F.try_element_at("keys", F.greatest("k", F.lit(1))))
    parts = parts.select("lang", (F.col("k") + 1).alias("k"), F.col("p.keys").alias("gram"), F.col("p.contexts").alias("ctx"), rest.alias("rest"), F.when(F.col("k") + 1 == F.size("keys"), F.col("n")).alias("n"))
    seen = parts.groupBy("lang", "gram").agg(F.min("k").alias("k"), F.min("ctx").alias("ctx"), F.min("rest").alias("rest"), F.sum("n").alias("n"))
    seen = scratch.write(seen, "seen") if scratch else seen
    extended = seen.where("rest IS NOT NULL").groupBy("lang", F.col("rest").alias("gram")).agg(F.count("*").alias("before"))
    counted = seen.join(extended, ["lang", "gram"], "left").select("lang", "k", "gram", "ctx", "rest", F.coalesce("n", "before").alias("a"))
    counted = scratch.write(counted, "grams") if scratch else counted
    tally = [F.count(F.when(F.col("a") == i, 1)).alias(f"n{i}") for i in (1, 2, 3, 4)]
    share = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))

    def discount(i: int) -> Column:
        # of an order with too few counts of counts: the plain absolute discount; never nothing, so every context leaves something
        return F.coalesce(F.when((F.col("n1") > 0) & (F.col(f"n{i}") > 0), F.greatest(i - (i + 1) * share * F.col(f"n{i + 1}") / F.col(f"n{i}"), F.lit(0.1))), F.lit(0.5))

    discounts = counted.groupBy("lang", "k").agg(*tally).select("lang", "k", *(discount(i).alias(f"d{i}") for i in (1, 2, 3)))
    own = F.when(F.col("a") == 1, F.col("d1")).when(F.col("a") == 2, F.col("d2")).otherwise(F.col("d3"))
    taken = counted.join(discounts, ["lang", "k"]).select("lang", "k", "gram", "ctx", "rest", "a", own.alias("d"))
    contexts = taken.groupBy("lang", "k", "ctx").agg(F.sum("a").alias("total"), (F.sum("d") / F.sum("a")).alias("left"))
    shares = taken.join(contexts.select("lang", "ctx", "k", "total"), ["lang", "ctx", "k"]).select("lang", "k", "gram", "ctx", "rest", ((F.col("a") - F.col("d")) / F.col("total")).alias("share"))
    return shares, contexts.select("lang", "ctx", "left")


def chances(shares: DataFrame, contexts: DataFrame, order: int) -> DataFrame:
    """(lang, gram, nats, less) of every gram of the model: minus the logarithm of the interpolated probability of its last character, and of what it leaves as a
    context. At the very bottom a character has the same chance as any other code point."""
    level = None
    every = []
    for n in range(1, order + 1):
        own = shares.where(F.col("k") == n).join(contexts, ["lang", "ctx"])
        if level is None:
            own = own.withColumn("below", F.lit(1 / 0x110000))
        else:
            own = own.join(level.select("lang", F.col("gram").alias("rest"), F.col("chance").alias("below")), ["lang", "rest"])
        level = own.select("lang", "gram", (F.col("share") + F.col("left") * F.col("below")).alias("chance"))
        every.append(level.select("lang", "gram", (-F.log("chance")).alias("nats")))
    known = functools.reduce(DataFrame.unionByName, every)
    return known.join(contexts.select("lang", F.col("ctx").alias("gram"), (-F.log("left")).alias("less")), ["lang", "gram"], "full_outer")


def _packed_values(values: np.ndarray) -> bytes:
    """Two rows of 4-byte floats without their NaN: which ones are there by a bit each, then the numbers."""
    there = ~np.isnan(values)
    return np.packbits(there).tobytes() + values[there].tobytes()


def _unpacked_values(packed_: bytes, n: int) -> np.ndarray:
    bits = -(-2 * n // 8)
    there = np.unpackbits(np.frombuffer(packed_, np.uint8, bits), count=2 * n).astype(bool)
    out = np.full(2 * n, np.nan, "<f4")
    out[there] = np.frombuffer(packed_, "<f4", offset=bits)
    return out.reshape(2, n)


class Answers:
    """What a block has been told of one language, and the surprisals that follow from it, each worked out once."""

    def __init__(self, keys: np.ndarray, nats: np.ndarray, less: np.ndarray):
        self.keys, self.nats, self.less = pa.array(keys), np.append(nats, np.nan).astype(np.float64), np.append(less, np.nan).astype(np.float64)
        self.sums, self.known = np.zeros(0, np.uint64), np.zeros(0)

    def of(self, sums: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """Minus the logarithm of each gram's probability."""
        place = _place(pa.array(sums), pa.array(self.sums))
        new = place < 0
        fresh = self._worked_out(letters[new])
        out = np.append(self.known, np.nan)[place]
        out[new] = fresh
        self.sums, self.known = np.concatenate([self.sums, sums[new]]), np.concatenate([self.known, fresh])
        return out

    def _worked_out(self, letters: np.ndarray) -> np.ndarray:
        """From the shortest suffix to the gram itself: told, or by what its context leaves to the one before."""
        size, order = letters.shape
        keys, contexts = suffix_keys(letters)
        place = _place(pa.array(np.concatenate([keys.ravel(), contexts.ravel()])), self.keys)
        told, less = self.nats[place[: keys.size].reshape(size, order)], self.less[place[keys.size :].reshape(size, order)]
        out = np.full(size, math.log(0x110000))
        for k in range(order):
            lower = out + np.where(np.isnan(less[:, k]), 0.0, less[:, k])
            out = np.where(letters[:, k] > 0, np.where(np.isnan(told[:, k]), lower, told[:, k]), out)
        return out


def _place(values: pa.Array, among: pa.Array) -> np.ndarray:
    """Where each value stands among others, -1 if it doesn't."""
    import pyarrow.compute as pc

    return pc.index_in(values, value_set=among).fill_null(-1).to_numpy()


def _scored(order: int):
    def run(chunks: pa.Table, told: pa.Table) -> pa.Table:
        release()
        answers: dict[str, list] = {}
        for lang, grams_, values in zip(told.column("lang").to_pylist(), (g for c in told.column("grams").chunks for g in c), told.column("nats").to_pylist(), strict=True):
            keys = _unpacked_keys(grams_)
            answers.setdefault(lang, []).append((keys, _unpacked_values(values, len(keys))))
        known = {lang: Answers(np.concatenate([k for k, _ in own]), *np.concatenate([v for _, v in own], axis=1)) for lang, own in answers.items()}
        del answers
        parts = [pa.table({name: pa.array([], kind) for name, kind in _SCORES})]
        for lang, docs, texts in _by_lang(chunks):
            full = np.array([bool(t) for t in texts])
            nats, squares, chars = np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            if full.any():
                some = [t for t in texts if t]
                sums, letters, at, starts = distinct_grams(some, order)
                each = known[lang].of(sums, letters)[at]
                nats[full], squares[full] = np.add.reduceat(each, starts), np.add.reduceat(each * each, starts)
                chars[full] = np.diff([*starts, len(each)])
            columns = (docs, [lang] * len(docs), nats, squares, chars)
            parts.append(pa.table({name: pa.array(c, kind) for (name, kind), c in zip(_SCORES, columns, strict=True)}))
        return pa.concat_tables(parts)

    return run


def scores(docs: DataFrame, labels: DataFrame, order: int, id_col: str, text: str, lang: str) -> tuple[DataFrame, DataFrame]:
    """(doc, lang, nats, squares, chars) for each row, and the ids of the trusted documents that are held out."""
    scratch, count = Scratch(docs.sparkSession), blocks_by_bytes(docs, text, BLOCK)
    shards = min(max(count, 8), SHARDS)
    salts = -(-count // (shards * 8))  # copies of the model, so that a shard's questions fit in a task
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), text_or_empty(text).alias("text"))
    chunks = scratch.bucketed(packed(rows, "doc", count, _spaced), count, "b", "spaced")
    label = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc"))
    trusted = label.agg(((F.min("quality") > 0) & (F.coalesce(F.max("toxic"), F.lit(0)) == 0)).alias("ok")).where("ok").select("doc")
    held = F.pmod(F.xxhash64(F.col("doc"), F.lit("held out")), F.lit(HELD_OUT)) == 0
    counted = trusted.where(~held).select("doc", block_of("doc", count).alias("b"))
    lists = "b int, shard int, lang string, grams binary"
    early = Scratch(docs.sparkSession)
    counts = early.write(chunks.groupBy("b").cogroup(counted.groupBy("b")).applyInArrow(_counted(order, shards), lists), "counts")
    if count > MERGED:  # so that a task merges so many lists at most, whatever the size of the corpus
        counts = counts.groupBy("shard", F.floor(F.col("b") / MERGED)).applyInArrow(_totals(order, True), lists)
    totals = counts.groupBy("shard").applyInArrow(_totals(order, False), "lang string, n bigint, keys array<bigint>, contexts array<bigint>")
    shares, contexts = shares_of(totals, scratch)
    shares, contexts = scratch.write(shares, "shares"), scratch.write(contexts, "contexts")
    early.clear()
    known = scratch.write(chances(shares, contexts, order).withColumn("shard", F.shiftright((F.shiftright("gram", 32) + (1 << 31)) * shards, 32).cast("int")), "model")
    known = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    asks = chunks.groupBy("b").applyInArrow(_asked(order, shards), lists).withColumn("salt", F.pmod("b", F.lit(salts)))
    told = scratch.write(asks.groupBy("shard", "salt").cogroup(known.groupBy("shard", "salt")).applyInArrow(_answers, "b int, lang string, grams binary, nats binary"), "told")
    scored = chunks.groupBy("b").cogroup(told.groupBy("b")).applyInArrow(_scored(order), "doc bigint, lang string, nats double, squares double, chars bigint")
    scored = scratch.write(scored, "scores", keep=True)
    scratch.clear()
    return scored, trusted.where(held)


def classify(
    docs: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = QUANTILE, allowance: float = ALLOWANCE, id_col: str = "doc_id", text: str = "text", lang: str = "lang"
) -> DataFrame:
    """(doc_id, lang, n_scored, perplexity, threshold, keep) for each row of documents; labels: (doc_id, quality, toxic)."""
    scored, held_out = scores(docs, labels, order, id_col, text, lang)
    mean, square = F.try_divide("nats", "chars"), F.try_divide("squares", "chars")  # null without characters
    error = F.sqrt(F.try_divide(F.greatest(square - mean * mean, F.lit(0.0)), F.col("chars")))
    rows = scored.withColumn("mean", mean).withColumn("low", F.col("mean") - F.lit(allowance) * error)
    limits = rows.join(held_out, "doc", "left_semi").groupBy("lang").agg(F.percentile_approx("mean", F.lit(quantile), F.lit(100_000)).alias("limit"))
    told = rows.join(limits, "lang", "left")
    return told.select(
        F.col("doc").alias("doc_id"), "lang", F.col("chars").alias("n_scored"), F.exp("mean").alias("perplexity"), F.exp("limit").alias("threshold"),
        (F.coalesce(F.col("low") <= F.col("limit"), F.lit(True))).alias("keep"),
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return classify(docs, table(spark, sf_dir, "labels"))
