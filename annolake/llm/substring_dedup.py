"""Removal of repeated substrings by suffix arrays.

A byte goes if it lies in a string of ``length`` bytes that also starts earlier (in a smaller document id, or earlier in the same one).

Each window of ``length`` bytes has a key that depends on its bytes alone: the smallest hash of its grams. Consecutive windows of one key are one
stretch. Keys are counted over the corpus: a window whose key stands in one place only has no equal and goes no further. The stretches of the
other keys are dealt by key as digests with places, equal ones as one with the earliest place. A key of which all stretches are equal is done by that. Of the others each different
stretch is fetched once, from where it stands first; a suffix array over them brings equal windows
together (common prefix of at least ``length``), and all but the earliest are repeats. What comes back to a document's block is one row for each
different stretch, sent to where it stands first: anywhere else the whole stretch is a repeat. A key that stands in very many places is dealt by window instead of by
stretch, so its group has no more rows than others. Stretches are equal as a whole if their 128 bits of BLAKE2b are; the suffix array is what finds equal windows in different stretches. Each step writes what
the next ones need and its shuffles are deleted, so the disk holds the blocks and one step's shuffles, however much of the corpus repeats.

Cases: null or empty texts have no bytes; texts shorter than ``length`` stay; rows repeated with one id are the same document in the same places, so each
keeps what the first keeps, and there are no other ties; a null id counts as larger than any other; very long texts are one row; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annolake.llm.blocks import block_of, packed, unpacked
from annolake.llm.columns import release
from annolake.llm.suffix_array import common_prefixes, suffix_array
from annolake.llm.tables import Scratch, blocks_by_bytes, table, text_or_empty

LENGTH, GRAM = 100, 32
#: Places of a key from which it is dealt by window, and bytes of different stretches that one suffix array takes.
HOT, ARRAY_BYTES = 8_000, 1 << 20
#: Bytes of text of a block, on average, whatever the size of the corpus.
BLOCK = 2 << 20
#: Bytes of text that are hashed together; small, so that the arrays stay in a core's cache.
_SPAN = 1 << 17
_NO_ID = 2**63 - 1
_BASE = 0x9E3779B97F4A7C15
_LAST = np.uint64(2**64 - 1)


class Windows:
    """Keys of all windows of some documents laid end to end."""

    def __init__(self, texts: list[bytes], length: int = LENGTH, gram: int = GRAM):
        sizes = np.array([len(t) for t in texts])
        self.length, self.first = length, np.concatenate([[0], np.cumsum(sizes)])
        self.bytes = b"".join(texts)
        data = np.frombuffer(self.bytes, np.uint8)
        n, width = len(data), length - gram + 1
        if n < length:
            self.start = self.end = self.doc = np.zeros(0, np.int64)
            self.key = self.places = np.zeros(0, np.uint64)
            self.tight = np.zeros(0, np.uint64)
            return
        hashes = _gram_hashes(data, gram)
        low = _sliding(np.minimum, hashes, width)
        inside = np.zeros(n - length + 1, bool)
        for a, b in zip(self.first[:-1], self.first[1:], strict=True):
            if b - a >= length:
                inside[a : b - length + 1] = True
        new = inside.copy()
        new[1:] &= ~inside[:-1] | (low[1:] != low[:-1])
        stop = inside.copy()
        stop[:-1] &= ~inside[1:] | (low[1:] != low[:-1])
        self.start, self.end = np.nonzero(new)[0], np.nonzero(stop)[0]  # of the windows of each stretch, last included
        self.key = low[self.start]
        self.doc = np.searchsorted(self.first, self.start, "right") - 1
        # a gram gives some window its key if the largest key of the windows around it is its own hash
        around = np.zeros(n - length + 1 + 2 * (width - 1), np.uint64)
        around[width - 1 : width - 1 + len(low)] = np.where(inside, low, 0)
        at = np.nonzero(_sliding(np.maximum, around, width)[: len(hashes)] == hashes)[0]
        self.places = hashes[at]
        # keys that stand twice within the reach of one window: only their stretches can hold equal windows
        by = np.argsort(self.places, kind="stable")
        key, where = self.places[by], at[by]
        self.tight = np.unique(key[1:][(key[1:] == key[:-1]) & (where[1:] - where[:-1] <= width)])


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    h, size, done = data.astype(np.uint64) + np.uint64(1), 1, None
    rest, taken = gram, 0
    while rest:
        if rest & 1:
            if done is None:
                done, taken = h, size
            else:
                n = len(data) - taken - size + 1
                done, taken = done[:n] * np.uint64(pow(_BASE, size, 2**64)) + h[taken : taken + n], taken + size
        rest >>= 1
        if rest:
            h = h[:-size] * np.uint64(pow(_BASE, size, 2**64)) + h[size:]
            size *= 2
    out = done ^ (done >> np.uint64(31))
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(32)
    return out


def _sliding(of, values: np.ndarray, width: int) -> np.ndarray:
    """of() over each ``width`` neighbours, by doubling."""
    out, size = values, 1
    while size * 2 <= width:
        out = of(out[:-size], out[size:])
        size *= 2
    if size < width:
        n = len(values) - width + 1
        out = of(out[:n], out[width - size : width - size + n])
    return out


def _spans(chunks: pa.Table, only: pa.Array | None = None) -> Iterator[tuple[list, list, list[bytes]]]:
    """(ids as ordered, ids as given, texts) of some documents; ``only``: of those ids."""
    import pyarrow.compute as pc

    docs, ids, texts, size = [], [], [], 0
    for batch in unpacked(chunks):
        batch = batch if only is None else batch.filter(pc.is_in(batch.column(0), only))
        for doc, own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            docs.append(doc)
            ids.append(own)
            texts.append(text.as_buffer().to_pybytes() if text.is_valid else b"")
            size += len(texts[-1])
            if size >= _SPAN:
                yield docs, ids, texts
                docs, ids, texts, size = [], [], [], 0
    if docs:
        yield docs, ids, texts


def _signed(keys: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(keys).view(np.int64))


def _keys(length: int):
    """Keys of a block with the number of their places."""

    def run(key: tuple[pa.Scalar, ...], chunks: pa.Table) -> pa.Table:
        release()
        found = [np.unique(Windows(texts, length).places, return_counts=True) for _, _, texts in _spans(chunks)]
        keys, by = np.unique(np.concatenate([np.zeros(0, np.uint64), *(k for k, _ in found)]), return_inverse=True)
        times = np.bincount(by, np.concatenate([np.zeros(0, np.int64), *(n for _, n in found)]), len(keys)).astype(np.int64)
        return pa.table({"b": pa.array(np.full(len(keys), key[0].as_py(), np.int32)), "m": _signed(keys), "n": pa.array(times)})

    return run


def _listed(key: tuple[pa.Scalar, ...], told: pa.Table) -> pa.Table:
    """A block's keys in order as one value, so what reads them has one row."""
    keys, parts = np.asarray(told.column("m"), dtype=np.int64).view(np.uint64), np.asarray(told.column("parts"), dtype=np.int32)
    order = np.argsort(keys)
    return pa.table({"b": pa.array([key[0].as_py()], pa.int32()), "keys": pa.array([keys[order].tobytes()], pa.binary()), "parts": pa.array([parts[order].tobytes()], pa.binary())})


class Asked:
    """The keys that stand in several places, as one block has them: at most one row of `_listed`."""

    def __init__(self, told: pa.Table):
        keys, parts = (b"".join(x.as_py() for x in told.column(c)) for c in ("keys", "parts"))
        self.keys, self.parts = np.append(np.frombuffer(keys, np.uint64), _LAST), np.append(np.frombuffer(parts, np.int32).astype(np.int64), 0)

    def stretches(self, w: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, document, key, parts) of the stretches with such keys; of a hot key each window is one."""
        at = np.searchsorted(self.keys, w.key)
        hit = np.nonzero((self.keys[np.minimum(at, len(self.keys) - 1)] == w.key) & (at < len(self.keys) - 1))[0]
        start, end, parts = w.start[hit], w.end[hit], self.parts[at[hit]]
        many = np.where(parts > 1, end - start + 1, 1)
        owner = np.repeat(np.arange(len(hit)), many)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        hot = parts[owner] > 1
        first = start[owner] + step
        return first, np.where(hot, first, end[owner]), w.doc[hit][owner], w.key[hit][owner], parts[owner]


def _digest(piece: bytes) -> bytes:
    return hashlib.blake2b(piece, digest_size=16).digest()


def _marks(length: int):
    """A block's different stretches as digests with their earliest places."""

    def run(chunks: pa.Table, told: pa.Table) -> pa.Table:
        release()
        asked, best, tight = Asked(told), {}, set()
        if len(asked.keys) > 1:
            for docs, _, texts in _spans(chunks):
                w = Windows(texts, length)
                tight.update(w.tight.tolist())
                first = w.first.tolist()
                for s, e, d, k, p in zip(*(x.tolist() for x in asked.stretches(w)), strict=True):
                    digest = _digest(w.bytes[s : e + length])
                    place = (docs[d], s - first[d], e - s + length)
                    known = best.get((k, p, digest))
                    if known is None or place < known:
                        best[k, p, digest] = place
        k, p, digest = zip(*best, strict=True) if best else ((), (), ())
        doc, start, size = zip(*best.values(), strict=True) if best else ((), (), ())
        halves = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
        return pa.table(
            {
                "m": _signed(np.array(k, np.uint64)), "part": pa.array(halves[:, 0] % np.array(p, np.int64), pa.int32()), "h1": pa.array(halves[:, 0]), "h2": pa.array(halves[:, 1]), "doc": pa.array(doc, pa.int64()),
                "start": pa.array(start, pa.int64()), "size": pa.array(size, pa.int32()), "tight": pa.array([x in tight for x in k], pa.bool_()),
            }
        )

    return run


def _fetched(chunks: pa.Table, asks: pa.Table) -> pa.Table:
    """The bytes of the stretches that are asked for, each once. Rows can share an id, so the digest tells which has it."""
    release()
    wanted: dict[int, dict[tuple[int, int, bytes], list[tuple[int, int]]]] = {}
    digests = np.stack([np.asarray(asks.column(c), dtype=np.int64) for c in ("h1", "h2")], 1)
    for i, (m, part, doc, start, size) in enumerate(zip(*(asks.column(c).to_pylist() for c in ("m", "part", "doc", "start", "size")), strict=True)):
        wanted.setdefault(doc, {}).setdefault((start, size, digests[i].tobytes()), []).append((m, part))
    rows = []
    for docs, _, texts in _spans(chunks, pa.array(wanted, pa.int64())) if wanted else ():
        for doc, text in zip(docs, texts, strict=True):
            own = wanted.get(doc, {})
            for start, size, digest in list(own):
                piece = text[start : start + size]
                if len(piece) == size and _digest(piece) == digest:
                    rows.extend((m, part, piece, doc, start) for m, part in own.pop((start, size, digest)))
    names, kinds = ("m", "part", "piece", "doc", "start"), (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.table({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)})


def repeats(pieces: list[bytes], places: list[tuple[int, int]], length: int) -> list[list[int]]:
    """For each piece the windows (by their start) that also start earlier, in any of the pieces."""
    sizes = np.array([len(p) for p in pieces])
    data = np.frombuffer(b"\xff".join(pieces) + b"\xff", np.uint8)  # 0xff is in no UTF-8 text
    first = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    window = np.zeros(len(data) + 1, np.int8)
    window[first] += 1
    window[first + sizes - length + 1] -= 1
    order = suffix_array(data, length, np.cumsum(window[:-1]) > 0)
    group = np.cumsum(common_prefixes(data, order, length) < length)
    owner = np.searchsorted(first, order, "right") - 1
    offset = order - first[owner]
    doc, start = np.array([d for d, _ in places], np.int64)[owner], np.array([s for _, s in places], np.int64)[owner] + offset
    by = np.lexsort((start, doc, group))
    g, d, s = group[by], doc[by], start[by]
    head = np.searchsorted(g, g)  # the earliest place of each window's group
    later = (d != d[head]) | (s != s[head])
    out: list[list[int]] = [[] for _ in pieces]
    for i, o in zip(owner[by][later].tolist(), offset[by][later].tolist(), strict=True):
        out[i].append(o)
    return [sorted(x) for x in out]


def _solved(length: int):
    """Over rows sorted by key: one row for each different stretch, with its repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[tuple] = []

        def out() -> Iterator[pa.RecordBatch]:
            if ready:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*ready, strict=True), kinds, strict=True)], names=["m", "doc", "start", "again"])
                ready.clear()

        waiting: list[tuple[int, bytes, tuple[int, int]]] = []
        size, now = 0, None

        def solve() -> None:
            for (m, _, place), again in zip(waiting, repeats([p for _, p, _ in waiting], [x for _, _, x in waiting], length), strict=True):
                ready.append((m, *place, again))
            waiting.clear()

        for batch in batches:
            for m, part, piece, doc, start in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if now != (m, part) and size >= ARRAY_BYTES:
                    solve()
                    size = 0
                now = (m, part)
                waiting.append((m, piece, (doc, start)))
                size += len(piece)
            if len(ready) > 50_000:
                yield from out()
        if waiting:
            solve()
        yield from out()

    return run


def _cut(length: int):
    def run(chunks: pa.Table, told: pa.Table) -> pa.Table:
        import pyarrow.compute as pc

        release()
        asked = Asked(told.filter(pc.is_valid(told.column("keys"))))
        own = told.filter(pc.is_null(told.column("keys")))
        earliest = {(d, s, m): a for d, s, m, a in zip(own.column("doc").to_pylist(), own.column("start").to_pylist(), np.asarray(own.column("m"), dtype=np.int64).view(np.uint64).tolist(), own.column("again").to_pylist(), strict=True)}
        rows = []
        for docs, ids, texts in _spans(chunks):
            w = Windows(texts, length)
            edge = np.zeros(len(w.bytes) + 1, np.int32)
            if len(asked.keys) > 1:
                first = w.first.tolist()
                start, end, doc, key, _ = asked.stretches(w)
                whole = np.ones(len(start), bool)
                for i, (s, d, k) in enumerate(zip(start.tolist(), doc.tolist(), key.tolist(), strict=True)):
                    again = earliest.get((docs[d], s - first[d], k))
                    if again is not None:
                        whole[i] = False
                        for o in again:
                            edge[s + o] += 1
                            edge[s + o + length] -= 1
                np.add.at(edge, start[whole], 1)
                np.add.at(edge, end[whole] + length, -1)
            gone = np.cumsum(edge[:-1]) > 0
            data = np.frombuffer(w.bytes, np.uint8)
            for j, given in enumerate(ids):
                a, b = int(w.first[j]), int(w.first[j + 1])
                mask = gone[a:b]
                turn = np.nonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))[0]
                spans = [{"start": int(x), "end": int(y)} for x, y in zip(turn[::2], turn[1::2], strict=True)]
                rows.append((given, b - a, int(mask.sum()), len(spans), spans, data[a:b][~mask].tobytes() if spans else texts[j]))
        names = ("doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept")
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())
        columns = zip(*rows, strict=True) if rows else [()] * len(names)
        return pa.table({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)})

    return run


def dedup_substrings(docs: DataFrame, length: int = LENGTH, hot: int = HOT, id_col: str = "doc_id", text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, spans, kept binary) for each row of documents. It reads tables in ``scratch``, which may be cleared when it has been written."""
    if length < GRAM:
        raise ValueError(f"length must be at least {GRAM}")
    scratch = scratch or Scratch(docs.sparkSession)
    count = blocks_by_bytes(docs, text, BLOCK)
    own = F.col(id_col).cast("long")
    rows = docs.select(F.coalesce(own, F.lit(_NO_ID)).alias("doc"), own.alias("own"), text_or_empty(text).alias("text"))
    chunks = scratch.bucketed(packed(rows, "doc", count, level=1), count, "b", "blocks")
    keys = chunks.groupBy("b").applyInArrow(_keys(length), "b int, m bigint, n bigint")
    places = F.sum("n").over(W.partitionBy("m"))
    several = keys.withColumn("places", places).where(F.col("places") > 1).select("b", "m", F.ceil(F.col("places") / F.lit(hot)).cast("int").alias("parts"))
    asked = scratch.write(several.repartition(count, "b").groupBy("b").applyInArrow(_listed, "b int, keys binary, parts binary"), "keys")
    marks = chunks.groupBy("b").cogroup(asked.groupBy("b")).applyInArrow(_marks(length), "m bigint, part int, h1 bigint, h2 bigint, doc bigint, start bigint, size int, tight boolean")
    different = marks.repartition(count, "m", "part").groupBy("m", "part", "h1", "h2").agg(F.min(F.struct("doc", "start", "size")).alias("at"), F.bool_or("tight").alias("tight"))
    of_key = W.partitionBy("m", "part")
    open_ = (F.count("*").over(of_key) > 1) | F.bool_or("tight").over(of_key)
    judged = scratch.write(different.select("m", "part", "h1", "h2", "at.doc", "at.start", "at.size", open_.alias("open")), "stretches")
    asks = judged.where("open").select(block_of("doc", count).alias("b"), "m", "part", "h1", "h2", "doc", "start", "size")
    pieces = chunks.groupBy("b").cogroup(asks.groupBy("b")).applyInArrow(_fetched, "m bigint, part int, piece binary, doc bigint, start bigint")
    solved = pieces.repartition(count, "m", "part").sortWithinPartitions("m", "part").mapInArrow(_solved(length), "m bigint, doc bigint, start bigint, again array<int>")
    solved = scratch.write(solved, "solved").unionByName(judged.where("NOT open").select("m", "doc", "start", F.array().cast("array<int>").alias("again")))
    nothing = [F.lit(None).cast(kind).alias(name) for name, kind in (("keys", "binary"), ("parts", "binary"), ("m", "bigint"), ("doc", "bigint"), ("start", "bigint"), ("again", "array<int>"))]
    back = solved.select(block_of("doc", count).alias("b"), *nothing[:2], "m", "doc", "start", "again")
    told = asked.select("b", "keys", "parts", *nothing[2:]).unionByName(back)
    out = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"
    return chunks.groupBy("b").cogroup(told.groupBy("b")).applyInArrow(_cut(length), out)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    done = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"), scratch=scratch)
    out = scratch.write(done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")), "deduplicated", keep=True)
    scratch.clear()
    return out
