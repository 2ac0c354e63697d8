"""Near duplicates by an exact Jaccard self-join on word shingles, with prefix filters under several token orders.

Documents of one and the same set of shingles are one node. Under any global order of tokens two sets that are similar enough share a token among the first
few of each (the prefix); so a node whose prefix tokens stand nowhere else goes no further. That is asked of all nodes under a first order of the tokens, and of those
left under a second one, with prefixes long enough that several tokens must be shared. Under a third order, rare tokens
first, what is left in the second prefix gives the pairs: candidates of one token. In a token's group every node is first paired with one central node only; a candidate pair must pass the
prefix test under the first and the second order as well before its sets are compared. Nodes that these links leave in different components of a group are then paired with
each other, so no link between components is missed, and pairs within a component, which can change nothing, are never made. Where many nodes share a token they are compared in blocks by matrix products,
and only links that connect them leave the task.

Cases: null or empty text, and text without words, has an empty set, is linked with nothing and is its own component; fewer than five words are one shingle; rows
repeated with one id are one document: what one of them is linked with, all are; a null id takes no part and has a null component; an empty table
gives an empty result; very long texts are taken apart whole, alone in their lot; of equal sets the smallest id is the node, and ties between tokens or centres go to the larger hash or id; other
columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annolake.llm.blocks import block_of, packed, unpacked
from annolake.llm.columns import parts, release, slices
from annolake.llm.components import components
from annolake.llm.tables import Scratch, blocks_by_bytes, table, text_or_empty

WORDS, PERCENT = 5, 80
#: Tokens that two similar sets must share in the longer prefixes: one in so many of the set, and one at least.
MORE = 7
#: Nodes of a token from which they are compared in blocks, and the nodes of a block.
LARGE, BLOCK = 64, 1024
#: Bytes of text that are taken apart at once (what stays in a processor's cache is taken apart fastest), and tokens of sets that a task holds.
LOT, HELD = 1 << 20, 4_000_000
PLACES = 64
#: ASCII white space.
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@functools.cache
def _word_table() -> np.ndarray:
    """A random number for each of ``PLACES`` places in a word and each byte: a word's hash is their sum. A-Z count as a-z, white space as nothing."""
    import xxhash

    out = np.array([xxhash.xxh3_64_intdigest(bytes((place + 128,)) + bytes((byte,)).lower()) for place in range(PLACES) for byte in range(256)], np.uint64).reshape(PLACES, 256)
    out[:, _BLANK] = 0
    return out.ravel()


def shingle_sets(texts: pa.Array, size: int = WORDS) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of all runs of ``size`` words (of all words, if fewer); the hash itself is the first order."""
    data, ends = parts(texts)
    blank = np.concatenate([[True], _BLANK[data]])
    before = blank[:-1].copy()
    before[ends[:-1][ends[:-1] < len(data)]] = True
    starts = np.nonzero(before & ~blank[1:])[0]
    if not len(starts):
        return [np.zeros(0, np.uint64) for _ in range(len(texts))]
    place = np.ones(len(data) - starts[0], np.int32)
    place[0] = 0
    place[starts[1:] - starts[0]] = 1 - np.diff(starts)
    np.cumsum(place, out=place)
    numbers = _word_table().take((place & PLACES - 1) << 8 | data[starts[0] :])
    if place.max() >= PLACES:
        numbers *= np.uint64(2) * (place // PLACES).astype(np.uint64) * _A + np.uint64(1)
    h = _mixed(np.add.reduceat(numbers, starts - starts[0]))
    first = np.searchsorted(starts, ends).tolist()
    runs = _runs(h, size) if len(h) >= size else h
    return [_distinct(runs[a : b - size + 1] if b - a >= size else _runs(h[a:b], b - a)) for a, b in zip(first, first[1:], strict=False)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= _B
    h ^= h >> np.uint64(29)
    return h


def _runs(h: np.ndarray, n: int) -> np.ndarray:
    """The hashes of all runs of n words."""
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out *= _A
        out ^= h[k : k + len(out)]
    return _mixed(out)


def _distinct(tokens: np.ndarray) -> np.ndarray:
    tokens = np.sort(tokens)
    new = tokens[1:] != tokens[:-1]
    return tokens if new.all() else tokens[np.concatenate([[True], new])]


def shingles(text: str, size: int = WORDS) -> np.ndarray:
    return shingle_sets(pa.array([text.encode("utf-8", "surrogatepass")]), size)[0]


def least(n: int, percent: int) -> int:
    """Tokens that a set of n shares at least with any set similar to it."""
    return -(-n * percent // 100)


def more(n: int) -> int:
    return max(1, n // MORE)


def first_prefix(tokens: np.ndarray, percent: int) -> np.ndarray:
    return tokens[: len(tokens) - least(len(tokens), percent) + 1]


def second_prefix(tokens: np.ndarray, percent: int) -> np.ndarray:
    """Longer by ``more`` under the second order: similar sets share as many tokens as the smaller's ``more``."""
    n = min(len(tokens), len(tokens) - least(len(tokens), percent) + more(len(tokens)))
    other = tokens * _A
    return tokens[np.argpartition(other, n - 1)[:n]] if n < len(tokens) else tokens


def needed(n: int, percent: int) -> int:
    """Shared tokens of the second prefix, whatever the partner's size."""
    return more(least(n, percent))


def _digests(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        release()
        for batch in slices(batches, 1, LOT):
            sets = shingle_sets(batch.column(1), size)
            digest = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, sets), pa.int64()), pa.array(digest, pa.binary())], names=["doc", "n", "digest"])

    return run


def _chosen(chunks: pa.Table, wanted: np.ndarray, size: int) -> Iterator[tuple[int, pa.Scalar, np.ndarray]]:
    for batch in slices(unpacked(chunks), 1, LOT):
        some = batch.filter(pa.array(np.isin(np.asarray(batch.column(0)), wanted)))
        yield from zip(some.column(0).to_pylist(), some.column(1), shingle_sets(some.column(1), size), strict=True)


def _column(told: pa.Table, step: int, name: str) -> np.ndarray:
    import pyarrow.compute as pc

    return np.asarray(told.filter(pc.equal(told.column("step"), step)).column(name), dtype=np.int64)


class Told:
    """What a block has been told: its nodes (step 0), the shared tokens of the first prefixes (1) and of the second ones (2)."""

    def __init__(self, told: pa.Table):
        self.nodes = np.unique(_column(told, 0, "v"))
        self.first = np.sort(_column(told, 1, "v").view(np.uint64))
        tokens, times = _column(told, 2, "v").view(np.uint64), _column(told, 2, "times")
        order = np.argsort(tokens)
        self.second, self.times = tokens[order], times[order]

    def passes(self, tokens: np.ndarray, percent: int) -> bool:
        return bool(_found(self.first, first_prefix(tokens, percent)).any())


def _found(table_: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    if not len(table_):
        return np.zeros(len(tokens), bool)
    return table_[np.minimum(np.searchsorted(table_, tokens), len(table_) - 1)] == tokens


def _tokens(step: int, size: int, percent: int):
    """Prefix tokens of a block's nodes, with the number of nodes that have each."""

    def run(key: tuple[pa.Scalar, ...], chunks: pa.Table, told: pa.Table) -> pa.Table:
        release()
        state, found = Told(told), [np.zeros(0, np.uint64)]
        for _, _, tokens in _chosen(chunks, state.nodes, size):
            if step == 1:
                found.append(first_prefix(tokens, percent))
            elif state.passes(tokens, percent):
                found.append(second_prefix(tokens, percent))
        tokens, times = np.unique(np.concatenate(found), return_counts=True)
        return pa.table({"b": pa.array(np.full(len(tokens), key[0].as_py(), np.int32)), "v": pa.array(tokens.view(np.int64)), "n": pa.array(times.astype(np.int64))})

    return run


def _candidates(size: int, percent: int):
    """For the nodes that pass both filters: one row for each token of the third prefix, and one with the text."""

    def run(chunks: pa.Table, told: pa.Table) -> pa.Table:
        import zstandard

        release()
        press = zstandard.ZstdCompressor(level=3)
        state, rows = Told(told), []
        for doc, text, tokens in _chosen(chunks, state.nodes, size):
            if not state.passes(tokens, percent):
                continue
            prefix = second_prefix(tokens, percent)
            prefix = prefix[_found(state.second, prefix)]
            need = needed(len(tokens), percent)
            if len(prefix) < need:
                continue
            times = state.times[np.searchsorted(state.second, prefix)]
            order = np.lexsort((prefix, times))[: len(prefix) - need + 1]
            centre = float(np.log2(times).mean())
            rows += [(int(t), doc, len(tokens), centre, None) for t in prefix[order].view(np.int64)]
            rows.append((None, doc, len(tokens), centre, press.compress(text.as_buffer())))
        names, kinds = ("token", "node", "n", "centre", "body"), (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.binary())
        columns = zip(*rows, strict=True) if rows else [()] * 5
        return pa.table({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)})

    return run


def _among(a: np.ndarray, b: np.ndarray) -> int:
    """Tokens that two sorted sets share."""
    if len(a) > len(b):
        a, b = b, a
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """All filters, then the exact test."""
    if not len(a) or not len(b) or min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    if not _among(first_prefix(a, percent), first_prefix(b, percent)):
        return False
    if _among(np.sort(second_prefix(a, percent)), np.sort(second_prefix(b, percent))) < min(more(len(a)), more(len(b))):
        return False
    both = _among(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


class _Sets(dict):
    """Sets of the texts met lately, up to about so many tokens. A text is known by a digest of what was sent, as an id can stand for
    several texts and for others in a later run."""

    def __init__(self, size: int):
        super().__init__()
        import zstandard

        self.size, self.held, self.press = size, 0, zstandard.ZstdDecompressor()

    def of(self, bodies: pa.Array) -> list[np.ndarray]:
        """The sets of several texts, those that are new taken apart together."""
        import xxhash

        if self.held > HELD:
            self.clear()
            self.held = 0
        sent = [body.as_buffer() for body in bodies]
        keys = [xxhash.xxh3_128_digest(b) for b in sent]
        new = {k: b for k, b in zip(keys, sent, strict=True) if k not in self}
        texts = pa.record_batch([pa.array([self.press.decompress(b) for b in new.values()], pa.binary())], ["text"])
        made = (s for part in slices(iter([texts]), 0, LOT) for s in shingle_sets(part.column(0), self.size))
        for k, tokens in zip(new, made, strict=True):
            self[k] = tokens
            self.held += len(tokens)
        return [self[k] for k in keys]


def _verified(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        sets = _Sets(size)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                both = sets.of(pa.concat_arrays([part.column(2), part.column(3)]))
                keep = [similar(a, b, percent) for a, b in zip(both, both[part.num_rows :], strict=False)]
                yield part.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    return run


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Shared tokens of each set on the left with each on the right: products of 0/1 matrices over a few thousand tokens at a time."""
    tokens = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])
    _, column, times = np.unique(tokens, return_inverse=True, return_counts=True)
    several = times > 1
    place = np.cumsum(several) - 1
    keep = several[column]
    owner, column = owner[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, int(several.sum()), 2048):
        a, b = np.searchsorted(column, (low, low + 2048))
        some = np.zeros((len(left) + len(right), 2048), np.float32)
        some[owner[a:b], column[a:b] - low] = 1
        out += some[: len(left)] @ some[len(left) :].T
    return out.astype(np.int64)


def spanning(linked: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of the links between rows and columns (which are the same nodes, if ``same``) as many as keep everything connected: fewer than nodes."""
    rows, columns = linked.shape
    left = np.zeros(rows, bool)
    right = left if same else np.zeros(columns, bool)
    xs, ys = [], []
    for start in np.nonzero(linked.any(1))[0].tolist():
        if left[start]:
            continue
        left[start] = True
        ahead = [(start, True)]
        while ahead:
            at, is_row = ahead.pop()
            new = np.nonzero(linked[at] & ~right)[0] if is_row else np.nonzero(linked[:, at] & ~left)[0]
            (right if is_row else left)[new] = True
            xs.append(np.full(len(new), at) if is_row else new)
            ys.append(new if is_row else np.full(len(new), at))
            ahead += [(n, same or not is_row) for n in new.tolist()]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *xs]), np.concatenate([none, *ys])


def _dense(size: int, percent: int):
    """Links between different components in two blocks of one token's nodes (or within one block), as many as connect them."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        node, label, block = (np.asarray(rows.column(c), dtype=np.int64) for c in ("node", "label", "block"))
        own = _Sets(size).of(rows.column("body").combine_chunks())
        a, b = np.nonzero(block == i)[0], np.nonzero(block == j)[0]
        n = np.array([len(s) for s in own], np.int64)
        both = overlaps([own[k] for k in a], [own[k] for k in b])
        linked = (100 * both >= percent * (n[a][:, None] + n[b][None, :] - both)) & (label[a][:, None] != label[b][None, :])
        x, y = spanning(linked, i == j)
        x, y = node[a][x], node[b][y]
        return pa.table({"x": pa.array(np.minimum(x, y)), "y": pa.array(np.maximum(x, y))})

    return run


def _links(pairs: DataFrame, bodies: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (x, y) whose sets are similar."""
    left = pairs.join(bodies.select(F.col("node").alias("x"), F.col("body").alias("bx")), "x")
    both = left.join(bodies.select(F.col("node").alias("y"), F.col("body").alias("by")), "y")
    return both.select("x", "y", "bx", "by").mapInArrow(_verified(size, percent), "x bigint, y bigint").distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT, size: int = WORDS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of documents."""
    scratch, count = Scratch(docs.sparkSession), blocks_by_bytes(docs, text)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), text_or_empty(text).alias("text"))
    members = scratch.write(rows.mapInArrow(_digests(size), "doc bigint, n bigint, digest binary"), "members", keep=True)
    nodes = members.where(F.col("digest").isNotNull() & F.col("doc").isNotNull()).groupBy("digest").agg(F.min("doc").alias("node"))
    nodes = scratch.write(nodes, "nodes", keep=True)
    # ids with several sets: the nodes of those sets belong together
    given = members.where(F.col("digest").isNotNull() & F.col("doc").isNotNull())
    told_apart = F.xxhash64("digest")
    several = given.groupBy("doc").agg(F.min(told_apart).alias("low"), F.max(told_apart).alias("high")).where(F.col("low") < F.col("high")).select("doc")
    of = given.join(several, "doc", "left_semi").join(nodes, "digest").select("doc", F.col("node").alias("y")).distinct()
    same = scratch.write(of.groupBy("doc").agg(F.min("y").alias("x")).join(of, "doc").where(F.col("x") < F.col("y")).select("x", "y").distinct(), "same")
    chunks = scratch.bucketed(packed(rows.where(F.col("doc").isNotNull()), "doc", count), count, "b", "texts")

    def step(n: int, v: DataFrame, *rest) -> DataFrame:
        return v.select("b", F.lit(n).alias("step"), "v", *(rest or (F.lit(0).cast("long").alias("times"),)))

    def shared(n: int, told: DataFrame) -> DataFrame:
        found = chunks.groupBy("b").cogroup(told.groupBy("b")).applyInArrow(_tokens(n, size, percent), "b int, v bigint, n bigint")
        several = found.withColumn("times", F.sum("n").over(W.partitionBy("v"))).where(F.col("times") > 1)
        return scratch.write(step(n, several, F.col("times").cast("long").alias("times")), f"shared-{n}")

    told = step(0, nodes.select(block_of("node", count).alias("b"), F.col("node").alias("v")).distinct())
    told = told.unionByName(shared(1, told))
    told = told.unionByName(shared(2, told))
    found = chunks.groupBy("b").cogroup(told.groupBy("b")).applyInArrow(_candidates(size, percent), "token bigint, node bigint, n bigint, centre double, body binary")
    found = scratch.write(found, "candidates")
    tokens = found.where(F.col("token").isNotNull()).drop("body").distinct()
    bodies = found.where(F.col("token").isNull()).select("node", "body")

    centres = tokens.groupBy("token").agg(F.max(F.struct("centre", "n", "node")).alias("c")).select("token", F.col("c.node").alias("y"), F.col("c.n").alias("m"))
    fits = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent
    first = scratch.write(tokens.join(centres, "token").where((F.col("node") != F.col("y")) & fits).select(F.col("node").alias("x"), "y").distinct(), "pairs")
    links = scratch.write(_links(first, bodies, size, percent), "links")
    labels = components(links)

    # groups that still have several components: pairs across them; of a large group in blocks, with no row for a pair
    placed = tokens.join(labels, "node", "left").select("token", "node", "n", F.coalesce("label", "node").alias("label"))
    mixed = placed.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("members")).where(F.col("low") < F.col("high")).select("token", "members")
    open_ = scratch.write(placed.join(mixed, "token"), "open")
    few = open_.where(F.col("members") < LARGE)
    other = few.select("token", F.col("node").alias("y"), F.col("n").alias("m"), F.col("label").alias("other"))
    across = few.withColumnRenamed("node", "x").join(other, "token").where((F.col("label") < F.col("other")) & fits).select("x", "y").distinct()
    across = across.join(first, ["x", "y"], "left_anti").join(first.select(F.col("x").alias("y"), F.col("y").alias("x")), ["x", "y"], "left_anti")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    many = open_.where(F.col("members") >= LARGE).withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).select("token", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "label")
    dense = many.join(bodies, "node").groupBy("token", "i", "j").applyInArrow(_dense(size, percent), "x bigint, y bigint").distinct()
    joined = _links(across, bodies, size, percent).unionByName(dense).unionByName(labels.select(F.col("node").alias("x"), F.col("label").alias("y"))).unionByName(same)
    final = components(joined)
    scratch.clear()

    named = nodes.join(final, "node", "left").select("digest", F.coalesce("label", "node").alias("label"))
    own = members.join(named, "digest", "left").select("doc", "n", F.coalesce("label", "doc").alias("label"))
    return own.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("doc").isNotNull(), F.col("label")).alias("component_id"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
