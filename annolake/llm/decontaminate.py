"""Benchmark decontamination: seeds of two words with gaps, counted, then Smith-Waterman alignment of words.

A passage is contaminated if its alignment with an item of L words scores at least ``min_score`` of a full match. Between two matched words that follow each other in
an alignment, a - 1 words of the item and b - 1 of the passage cost max(a, b) - 1 at least; so at least min_score * L - 1 of its steps have a and b of 1 or 2, each from a
word of the item of its own. Such steps are the seeds: two words of the item, next to each other or with one between, found so in the document. As many words
of an item as that number allows are left out as first words of seeds, those with the most seeds in the corpus (counted by a first pass), and where as many seeds as must still be there
lie close enough to be of one alignment, the item is aligned with the passage around them. So no passage that reaches ``min_score`` is missed, whatever its edits and however often it stands
in the corpus (if min_score * L is above 1; below, a seed is still asked for). Words are ASCII-lower-cased and split at ASCII white space and punctuation.

The items are a bounded side: they are taken in chunks of at most ``CHUNK_BYTES`` of text, whatever their number, and each chunk is one pass. Documents
are never shuffled; a passage that a third of them share is found in each where it stands.

An item of fewer than ``N`` words is found where its very words stand in a row: so few words in common say nothing unless they are all there.

Cases: null or empty texts, and items without words, match nothing; very long texts are read whole; a document that holds an item several times
gives its best passage, of equal ones the first; null ids of either side are passed through; columns of other names are left alone; repeated rows of documents give repeated rows, repeated items count once; empty tables give an empty result; other columns are
not read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolake.llm.columns import release
from annolake.llm.tables import table, text_or_empty

#: Fewest words of an item that is aligned; least score for a hit, as a share of the item's full score; scores of a pair of words.
N, MIN_SCORE = 4, 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
CHUNK_BYTES = 32 << 20
#: Of the seeds that an alignment must have, one in so many is still asked for when the frequent ones are left out.
KEPT = 3
#: Bytes of text that are looked up together.
_SPAN = 1 << 20
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def _pairs(ids: np.ndarray, apart: int) -> np.ndarray:
    """A key for each word and the one so many behind it; 0 if one of the two is 0 (unknown or a border)."""
    one, two = ids[:-apart], ids[apart:]
    return np.where((one > 0) & (two > 0), (one << np.uint64(32)) | two, np.uint64(0))


class Runs:
    """Items of n words, found by all their words in a row."""

    def __init__(self, n: int, items: list[tuple[int, list[int]]]):
        self.n, self.firsts = n, np.unique(np.array([own[:2] for _, own in items], np.uint64), axis=0) if n > 1 else None
        keys = self._keys(np.array([w for _, own in items for w in (*own, 0)], np.uint64))[:: n + 1]
        order = np.argsort(keys, kind="stable")
        self.keys, self.items = keys[order], [items[i][0] for i in order]

    def _keys(self, ids: np.ndarray) -> np.ndarray:
        """A key of n words for each place, 0 where there can be none. For three words the first two go by their number among those of the items."""
        if self.n == 1:
            return ids
        pair = np.concatenate([_pairs(ids, 1), [np.uint64(0)]])
        if self.n == 2:
            return pair
        known = np.sort((self.firsts[:, 0] << np.uint64(32)) | self.firsts[:, 1])
        at = np.minimum(np.searchsorted(known, pair), len(known) - 1)
        third = np.concatenate([ids[2:], np.zeros(2, np.uint64)])
        return np.where((known[at] == pair) & (third > 0), ((at.astype(np.uint64) + np.uint64(1)) << np.uint64(32)) | third, np.uint64(0))

    def found(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """(item, place)."""
        keys = self._keys(ids)
        low, high = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        for place in np.nonzero((high > low) & (keys > 0))[0].tolist():
            for i in range(low[place], high[place]):
                yield self.items[i], place


class Items:
    """A chunk of test items, as ids of their words."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.vocabulary: dict[bytes, int] = {}
        self.ids, self.words = [], []
        short: dict[int, list[tuple[int, list[int]]]] = {}
        for item, text in rows:
            own = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            if len(own) >= N:
                self.ids.append(item)
                self.words.append(np.array(own, np.uint64))
            elif own:
                short.setdefault(len(own), []).append((item, own))
        self.short = {n: Runs(n, some) for n, some in short.items()}
        self.pairs = [(_pairs(w, 1), _pairs(w, 2)) for w in self.words]
        self.all_pairs = np.unique(np.concatenate([np.zeros(0, np.uint64), *(p for both in self.pairs for p in both)]))

    def seeded(self, counts: dict[int, int], min_score: float) -> None:
        """Keeps the seeds: (pair, item, place), sorted by pair; and for each item how many a passage must have, and how far they lie apart in where the item would begin."""
        found, self.least, self.drift = [], [], []
        for i, (near, far) in enumerate(self.pairs):
            full = len(self.words[i])
            steps = max(1, math.ceil(min_score * full - 1e-9) - 1)
            least = min(max(1, steps // KEPT), full - 1)
            often = np.array([counts.get(int(p), 0) for p in near])
            often[: len(far)] += [counts.get(int(p), 0) for p in far]
            kept = np.sort(np.argsort(often, kind="stable")[: max(1, len(often) - (steps - least))]).astype(np.uint64)
            for pairs in (near, far):
                own = kept[kept < len(pairs)]
                found.append(np.stack([pairs[own], np.full(len(own), i, np.uint64), own], 1))
            self.least.append(least)
            self.drift.append(max(0, math.floor(2 * full * (1 - min_score) + 1e-9)))
        table_ = np.concatenate([np.zeros((0, 3), np.uint64), *found])
        self.seeds = table_[np.argsort(table_[:, 0], kind="stable")]


def _spans(batches: Iterator[pa.RecordBatch], vocabulary: dict[bytes, int]) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(document ids, word ids with N borders behind each document, first word of each document and the end)."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            docs, flat, firsts, size = [], [], [], 0
            while at < batch.num_rows and size < _SPAN:
                text = batch.column(1)[at].as_py()
                docs.append(batch.column(0)[at].as_py())
                firsts.append(len(flat))
                flat += map(vocabulary.get, words(text), itertools.repeat(0))
                flat += [0] * N
                size += len(text)
                at += 1
            yield docs, np.array(flat, np.uint64), np.array([*firsts, len(flat)])


def align(item: np.ndarray, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local score of the item in each row of word ids, and the place behind its last word."""
    columns = np.arange(passages.shape[1])
    above = np.zeros(passages.shape, np.int32)
    best, end = np.zeros(len(passages), np.int32), np.zeros(len(passages), np.int64)
    rows = np.arange(len(passages))
    for word in item:
        step = np.where(passages == word, MATCH, MISMATCH).astype(np.int32)
        step[:, 1:] += above[:, :-1]
        score = np.maximum(np.maximum(step, above + GAP), 0)
        # a gap along the row: the best of earlier columns, less one for each column between
        score = np.maximum.accumulate(score - GAP * columns, axis=1) + GAP * columns
        above = score.astype(np.int32)
        at = above.argmax(1)
        higher = above[rows, at] > best
        best[higher], end[higher] = above[rows, at][higher], at[higher] + 1
    return best, end


def _hits(items: Items, min_score: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
        names = ["doc_id", "item_id", "score", "first_word", "end_word", "n_seeds"]
        seeds = items.seeds[:, 0]
        lengths, drifts, least = np.array([len(w) for w in items.words]), np.array(items.drift), np.array(items.least)
        for docs, ids, firsts in _spans(batches, items.vocabulary):
            whole: dict[tuple[int, int], tuple] = {}
            for n, runs in items.short.items():
                for i, place in runs.found(ids):
                    doc = int(np.searchsorted(firsts, place, "right")) - 1
                    whole.setdefault((doc, i), (1.0, place - int(firsts[doc]), place - int(firsts[doc]) + n, n - 1))
            if whole:
                rows = [(docs[d], i, *found) for (d, i), found in sorted(whole.items(), key=lambda x: (x[0][0], x[1][1], x[1][3]))]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
            if not items.ids:
                continue
            found = []
            for apart in (1, 2):
                keys = _pairs(ids, apart)
                place = np.nonzero(keys)[0]
                low, high = np.searchsorted(seeds, keys[place], "left"), np.searchsorted(seeds, keys[place], "right")
                times = high - low
                row = np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())
                found.append((row, np.repeat(place, times)))
            row, place = (np.concatenate(part) for part in zip(*found, strict=True))
            if not len(row):
                continue
            item, start = items.seeds[row, 1].astype(np.int64), place - items.seeds[row, 2].astype(np.int64)
            doc = np.searchsorted(firsts, place, "right") - 1
            # one line for all: item, document, where the item would begin; of an item's seeds in a document, those within its drift can be of one alignment
            wide = len(ids) + 4 * int(lengths.max() + drifts.max())
            at = (item * len(docs) + doc) * wide + start + int(lengths.max())
            order = np.lexsort((place, at))
            item, start, doc, place, at = item[order], start[order], doc[order], place[order], at[order]
            new = np.ones(len(at), bool)
            new[1:] = (at[1:] != at[:-1]) | (place[1:] != place[:-1])
            item, start, doc, at = item[new], start[new], doc[new], at[new]
            behind = np.searchsorted(at, at + drifts[item], "right")
            enough = np.nonzero(behind - np.arange(len(at)) >= least[item])[0]
            covered = np.cumsum(np.bincount(enough, minlength=len(at) + 1) - np.bincount(behind[enough], minlength=len(at) + 1))[:-1] > 0
            item, start, doc, at = item[covered], start[covered], doc[covered], at[covered]
            if not len(at):
                continue
            new = np.ones(len(at), bool)
            new[1:] = at[1:] - at[:-1] > drifts[item[1:]]
            group = np.nonzero(new)[0]
            last = np.concatenate([group[1:], [len(item)]]) - 1
            count = last - group + 1
            item, first, doc = item[group], start[group], doc[group]
            begin = np.maximum(first - drifts[item], firsts[doc])
            end = np.minimum(start[last] + lengths[item] + drifts[item] + 1, firsts[doc + 1] - N)
            out: dict[tuple[int, int], tuple] = {}
            for i in np.unique(item):
                mine = np.nonzero(item == i)[0]
                mine = mine[np.argsort(end[mine] - begin[mine])]
                for part in np.array_split(mine, math.ceil(len(mine) / 64)):  # passages of like length together
                    wide = int((end[part] - begin[part]).max())
                    take = begin[part][:, None] + np.arange(wide)
                    passages = np.where(take < end[part][:, None], ids[np.minimum(take, len(ids) - 1)], np.uint64(0))
                    score, stop = align(items.words[i], passages)
                    back, start_back = align(items.words[i][::-1], passages[:, ::-1])
                    for j, g in enumerate(part):
                        share = float(score[j]) / (MATCH * len(items.words[i]))
                        if share >= min_score:
                            base = int(begin[g]) - int(firsts[doc[g]])
                            found = (share, base + wide - int(start_back[j]), base + int(stop[j]), int(count[g]))
                            key = (int(doc[g]), int(i))
                            if key not in out or (found[0], -found[1]) > (out[key][0], -out[key][1]):
                                out[key] = found
            rows = [(docs[d], items.ids[i], *found) for (d, i), found in sorted(out.items())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def _counted(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        total = np.zeros(len(items.all_pairs), np.int64)
        for _, ids, _ in _spans(batches, items.vocabulary):
            for apart in (1, 2):
                keys = _pairs(ids, apart)
                keys = keys[keys > 0]
                at = np.minimum(np.searchsorted(items.all_pairs, keys), len(total) - 1)
                total += np.bincount(at[items.all_pairs[at] == keys], minlength=len(total))
        some = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(items.all_pairs[some].view(np.int64)), pa.array(total[some])], names=["pair", "places"])

    return run


def contaminated(docs: DataFrame, items: DataFrame, min_score: float = MIN_SCORE, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, score 0 to 1, first_word, end_word, n_seeds) for each document and item that it holds."""
    spark = docs.sparkSession
    given = docs.where(F.col(text).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    tests = items.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    size = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, math.ceil(size / CHUNK_BYTES))
    out = None
    for k in range(chunks):
        chunk = Items(sorted((tuple(r) for r in tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks)) == k).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1])))
        if not chunk.ids and not chunk.short:
            continue
        counts = given.mapInArrow(_counted(chunk), "pair bigint, places bigint").groupBy("pair").agg(F.sum("places").alias("places"))
        chunk.seeded({r["pair"]: r["places"] for r in counts.collect()} if chunk.ids else {}, min_score)
        found = given.mapInArrow(_hits(chunk, min_score), "doc_id bigint, item_id bigint, score double, first_word bigint, end_word bigint, n_seeds bigint")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "doc_id bigint, item_id bigint, score double, first_word bigint, end_word bigint, n_seeds bigint")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
