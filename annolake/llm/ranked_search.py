"""Ranked lexical search over a bit-sliced impact index.

Documents are dealt into blocks as their tasks read them, in order of id. A block's row for a term holds the places of its documents that have it and, slice by slice, the bits of their impacts: what one occurrence more or less
is worth there, a whole number of 20 bits. A search looks up its terms' rows in all blocks, spreads the slices over bitmaps of the block, multiplies them by the term's weight
and adds the terms of each item, all by bitwise carries, and finds the block's best documents from the most significant slice down. The blocks' lists are merged by score.
A common term is one row in each block, and a term's rows are salted by block, so no key grows with the corpus faster than ``SALTED`` rows; items go in groups of ``ITEMS``, each a stated set of
queries against all blocks.

Cases: null or empty text, and text without terms, has none and is in no result; of documents, rows of one id are ranked each, and rows without an id take no part; of items, rows of one id
are one item with the terms of all its different texts, and rows without an id or terms give no result; equal scores go by ascending id; very long texts are a block of their own, read whole; an empty
table gives an empty result; other columns are not read. Scores of 2^62 and more raise an error.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annolake.llm import bit_slices as B
from annolake.llm.columns import joined, parts, release, slices
from annolake.llm.tables import Scratch, table, text_or_empty
from annolake.llm.words import LOT, runs, words

TOP = 20
#: Bits of an impact; bytes of text and documents of a block; items that are scored together; blocks whose rows of a term are one key of the look-up.
HEIGHT, BLOCK, MOST, ITEMS, SALTED = 20, 32 << 20, 1 << 16, 256, 512
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_IS_TERM = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
_INDEX = "block bigint, term string, n int, docs binary, slices binary"


def _tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for batch in slices(batches, "text", LOT):
        data, ends = parts(batch.column("text"))
        starts, _ = runs(_IS_TERM[data], ends)
        n = np.diff(np.searchsorted(starts, ends))
        yield pa.RecordBatch.from_pydict({"holding": [int((n > 0).sum())], "n": [int(n.sum())]})


def statistics(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> tuple[int, int]:
    """How many documents have terms, and how many terms they have."""
    own = docs.where(F.col(id_col).isNotNull()).select(text_or_empty(text).alias("text")).mapInArrow(_tallies, "holding bigint, n bigint")
    row = own.agg(F.sum("holding"), F.sum("n")).first()
    return row[0] or 0, row[1] or 0


def impacts(tf: np.ndarray, length: np.ndarray, count: int, total: int) -> np.ndarray:
    """Fixed by the contract of the query: what a term that stands so often in a document of that length counts there."""
    m = 75 + 25 * length * count // total
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def _rows(block: int, ids: np.ndarray, texts: pa.Array, count: int, total: int) -> pa.RecordBatch:
    """A block of the index: a row without a term holds the ids, the others one term each, in order."""
    vocabulary, word, owner = words(texts, _IS_TERM)
    order = pc.sort_indices(vocabulary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    size = max(len(ids), 1)
    pairs, tf = np.unique(rank[word] * size + owner, return_counts=True)
    term, place = np.divmod(pairs, size)
    worth = impacts(tf.astype(np.int64), np.bincount(owner, minlength=size)[place], count, total)
    n = np.bincount(term, minlength=len(order))
    first, byte = np.concatenate([[0], np.cumsum(n)]), -(-n // 8)
    offset = np.concatenate([[0], np.cumsum(byte)])
    spot = 8 * offset[term] + np.arange(len(term)) - first[term]  # each term's bits start with a byte
    own = np.repeat(np.arange(len(order)), byte)
    base = HEIGHT * offset[own] + np.arange(offset[-1]) - offset[own]
    out, bits = np.zeros(HEIGHT * offset[-1], np.uint8), np.zeros(8 * offset[-1], np.uint8)
    for p in range(HEIGHT):
        bits[spot] = worth >> p & 1
        out[base + p * byte[own]] = np.packbits(bits)
    places = joined(place.astype(np.uint16).view(np.uint8), 2 * first)
    columns = [
        pa.array(np.full(1 + len(order), block)), pa.concat_arrays([pa.array([None], pa.string()), vocabulary.take(pa.array(order)).cast(pa.string())]), pa.array(np.concatenate([[len(ids)], n]).astype(np.int32)),
        pa.concat_arrays([pa.array([ids.astype(np.int64).tobytes()], pa.binary()), places.cast(pa.binary())]), pa.concat_arrays([pa.array([b""], pa.binary()), joined(out, HEIGHT * offset).cast(pa.binary())]),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["block", "term", "n", "docs", "slices"])


def _blocks(count: int, total: int, size: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        release()
        block = TaskContext.get().partitionId() << 32
        for batch in slices(batches, "text", size):
            for at in range(0, batch.num_rows, most):
                own = batch.slice(at, most)
                ids = own.column("id").to_numpy()
                order = np.argsort(ids, kind="stable")
                own = own.take(pa.array(order))
                yield from _sliced(_rows(block, ids[order], own.column("text"), count, total))
                block += 1

    return run


def _sliced(batch: pa.RecordBatch, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def build_index(docs: DataFrame, stats: tuple[int, int], id_col: str = "doc_id", text: str = "text", size: int = BLOCK, most: int = MOST) -> DataFrame:
    """(block, term, n, docs, slices); a row without a term holds a block's ids. ``size``, ``most``: bytes of text and documents of a block."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), text_or_empty(text).alias("text"))
    return rows.mapInArrow(_blocks(stats[0], max(stats[1], 1), size, min(most, MOST)), _INDEX)


def item_terms(items: DataFrame, id_col: str = "item_id", text: str = "text") -> DataFrame:
    """(item, term, q): how often a term stands in an item."""
    rows = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("item"), text_or_empty(text).alias("text")).distinct()
    low = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    return rows.select("item", F.explode(F.regexp_extract_all(low, F.lit(TERM), F.lit(0))).alias("term")).groupBy("item", "term").agg(F.count("*").alias("q"))


def _best(k: int, height: int) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        release()
        ids = np.zeros(0, np.int64)
        shared: dict[int, list[tuple[int, int]]] = {}  # item: (row, q)
        weighted: dict[int, np.ndarray] = {}
        names, docs, packed, weight, wanted = (rows.column(c) for c in ("term", "docs", "slices", "w", "items"))
        blank = np.asarray(pc.is_null(names))
        for r in np.nonzero(blank)[0]:
            ids = np.frombuffer(docs[int(r)].as_py(), np.int64)
        wide = -(-len(ids) // 64)
        for r in np.nonzero(~blank)[0]:
            r = int(r)
            places = np.frombuffer(docs[r].as_py(), np.uint16)
            weighted[r] = B.times(B.spread(packed[r].as_py(), places, HEIGHT, wide), weight[r].as_py(), height)
            for use in wanted[r].as_py():
                shared.setdefault(use["item"], []).append((r, use["q"]))
        found = []
        for item, uses in shared.items():
            score = B.total([weighted[r] if q == 1 else B.times(weighted[r], q, height) for r, q in uses])
            best = B.top(score, k)
            found.append((np.full(len(best), item), ids[best], B.at(score, best)))
        columns = [np.concatenate([np.zeros(0, np.int64), *c]) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(("item", "doc", "score"), columns, strict=True)))

    return run


def search(index: DataFrame, count: int, terms: DataFrame, k: int = TOP, items: int = ITEMS, salted: int = SALTED) -> DataFrame:
    """(item, rank, doc, score): each item's k best documents. ``index`` is a written table, read until the result is; ``count``: documents with terms; ``terms`` as of `item_terms`."""
    spark, scratch = index.sparkSession, Scratch(index.sparkSession)
    holding = index.where("term IS NOT NULL")
    size = index.where("term IS NULL").count()
    salts = -(-size // salted) or 1
    terms = scratch.write(terms, "terms")
    df = holding.select("term", "n").join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum(F.col("n").cast("long")).alias("df"))
    # fixed by the contract of the query
    weight = F.floor(1000 * F.log((2.0 * count + 2) / (2 * F.col("df") + 1))).cast("long")
    groups = max(1, -(-terms.select("item").distinct().count() // items))
    use = terms.join(df.select("term", weight.alias("w")).where("w > 0"), "term").withColumn("group", F.pmod(F.xxhash64("item"), F.lit(groups)).cast("int"))
    use = scratch.write(use, "weights")
    heaviest = use.groupBy("item").agg(F.sum(F.col("w") * F.col("q")).alias("s")).agg(F.max("s")).first()[0] or 1
    height = HEIGHT + int(heaviest).bit_length()
    if height > 62:
        raise OverflowError(f"scores of {height} bits")
    salt = lambda column: F.pmod(column, F.lit(salts)).cast("int")
    asked = use.groupBy("term", "w", "group").agg(F.sort_array(F.collect_list(F.struct("item", "q"))).alias("items")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    hits = holding.withColumn("salt", salt(F.col("block"))).join(asked, ["term", "salt"]).select("block", "group", "term", "docs", "slices", "w", "items")
    ids = index.where("term IS NULL").select("block", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), "term", "docs", "slices", F.lit(0).cast("long").alias("w"), F.lit(None).cast(hits.schema["items"].dataType).alias("items"))
    best = hits.unionByName(ids).groupBy("block", "group").applyInArrow(_best(k, height), "item bigint, doc bigint, score bigint")
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(F.col("score").desc(), "doc"))).where(F.col("rank") <= k)
    return ranked.select("item", "rank", "doc", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score). The index goes when the search is done; `build_index` and `search` keep one for many searches."""
    stats, scratch = statistics(docs), Scratch(docs.sparkSession)
    index = scratch.write(build_index(docs, stats), "impacts")
    found = search(index, stats[0], item_terms(items), k)
    best = scratch.write(found.select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score"), "ranked", keep=True)
    scratch.clear()
    return best


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


_LOW = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_TERMS = rf"unnest(regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
OP12_SQL = rf"""
WITH words AS (SELECT doc_id, {_TERMS} AS term FROM documents),
lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
stats AS (SELECT count(*) AS c, sum(n)::BIGINT AS l FROM lengths),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
weights AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * c + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tfs, stats GROUP BY term, c),
wanted AS (SELECT item_id, term, count(*) AS q FROM (SELECT item_id, {_TERMS} AS term FROM benchmark) GROUP BY item_id, term),
scored AS (
  SELECT item_id, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * c) // l))))::BIGINT AS score
  FROM wanted JOIN weights USING (term) JOIN tfs USING (term) JOIN lengths USING (doc_id), stats GROUP BY item_id, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scored WHERE score > 0
QUALIFY rank <= {TOP}
"""
