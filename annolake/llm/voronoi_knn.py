"""Exact top-k search by inner product, as a Voronoi join.

Vectors are quantised to integers. Equal vectors are one class: of its rows only the k + 1 smallest ids can be in any answer,
so a vector that a third of the rows share is k + 1 rows from each task before anything is shuffled. A bounded sample of classes gives the pivots;
each class and each query vector belongs to its nearest pivot. The summaries hold, for each pivot, the few classes nearest to it:
the (k + 1)-th best score of a query among all of them bounds its answer from below, and so does that among one part of its own pivot's classes, the higher counts. Queries are grouped by
as many of the pivots as their number asks for. A group with pivot p, radius r and
lowest bound b needs a class x only if <x, p> + |x| r >= b, and only such classes are replicated to it, so never to more groups than there are. Each group is
solved locally, in as many parts as its share of the data asks for, and the parts are merged by score.

Cases: vectors that are null or hold a null or non-finite component take no part; shorter vectors are padded by zeros to the longest;
ties go to the smaller id; components of 2^62 and more and scores that 64 bits do not hold raise an error; a row repeated as it is counts once; null ids take no part; with fewer than k
candidates all are returned; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from annolake.llm.tables import materialise, table

#: Sampled pivots; also bounds everything that the driver collects.
PIVOTS = 64
#: Classes of data that one local solver gets, about, and query vectors of one group.
PART_ROWS, GROUP_QUERIES = 20_000, 512
_SLACK = 1e-6


def quantised(vectors: DataFrame, id_col: str, vector: str, scale: int) -> DataFrame:
    x = F.col(vector).cast("array<double>")
    whole = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    # what is no number takes no part, wherever the plan puts the test for it
    fits = lambda v: F.when(F.abs(v * scale) < float(2**62), v).when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(0.0)).otherwise(F.raise_error(F.lit("a component beyond 64 bits")).cast("double"))
    scaled = F.transform(x, lambda v: F.floor(fits(v) * F.lit(float(scale))).cast("long"))
    return vectors.where(F.col(id_col).isNotNull() & whole).select(F.col(id_col).cast("long").alias("id"), scaled.alias("q"))


def _matrix(column: pa.Array, dim: int):
    import numpy as np

    values = column.flatten() if isinstance(column, (pa.ListArray, pa.LargeListArray)) else column
    return np.asarray(values, dtype=np.float64).reshape(len(column), dim)


def _scores(data, queries, dim: int):
    """Integer inner products; in doubles where they are exact."""
    import numpy as np

    most = max(np.abs(data).max(initial=0), 1) * max(np.abs(queries).max(initial=0), 1) * max(dim, 1)
    if most < 2**53:
        return np.rint(queries.astype(np.float64) @ data.astype(np.float64).T).astype(np.int64)
    exact = queries.astype(object) @ data.astype(object).T
    if any(not -(2**63) <= v < 2**63 for v in exact.ravel()):
        raise OverflowError("a score beyond 64 bits")
    return exact.astype(np.int64)


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows where ``is_query`` (a function of the id column) holds, against all other rows."""
    import numpy as np

    spark = vectors.sparkSession
    out = "query_id long, rank int, vec_id long, score long"
    raw = quantised(vectors, id_col, vector, scale)
    dim = raw.agg(F.max(F.size("q"))).first()[0]
    if dim is None:
        return spark.createDataFrame([], out)
    dim = max(dim, 1)
    # equal rows are one row, so that a count of rows is a count of ids
    padded = raw.select("id", F.when(F.size("q") < dim, F.concat("q", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("q")))).otherwise(F.col("q")).alias("q")).distinct()
    first = W.partitionBy("q").orderBy("id")
    classes = padded.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1).groupBy("q").agg(F.sort_array(F.collect_list("id")).alias("ids"))

    sample = classes.orderBy(F.xxhash64("q"), "q").limit(PIVOTS).collect()
    pivots = np.array([r["q"] for r in sample], dtype=np.float64).reshape(-1, dim)
    squares = (pivots**2).sum(1)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(0), dim)
            away = np.sqrt(np.maximum((x**2).sum(1)[:, None] - 2 * x @ pivots.T + squares, 0))
            near = away.argmin(1)
            yield batch.append_column("g", pa.array(near.astype(np.int32))).append_column("d", pa.array(away[np.arange(len(x)), near]))

    data = materialise(classes.mapInArrow(assigned, "q array<bigint>, ids array<bigint>, g int, d double"), "voronoi-data")
    asked = padded.where(is_query(F.col("id")))
    wanted = materialise(asked.select("q").distinct().mapInArrow(assigned, "q array<bigint>, g int, d double"), "voronoi-queries")

    close = W.partitionBy("g").orderBy("d", "q")
    summary = data.withColumn("n", F.row_number().over(close)).where(F.col("n") <= k + 1).select("q", F.size("ids").alias("times")).collect()
    near = np.repeat(np.array([r["q"] for r in summary], dtype=np.float64).reshape(-1, dim), [r["times"] for r in summary], axis=0)
    n_data, n_queries = data.count(), wanted.count()
    several = min(len(pivots), max(1, math.ceil(n_queries / GROUP_QUERIES)))
    chunks, parts = max(1, math.ceil(n_queries / (several * GROUP_QUERIES))), max(1, math.ceil(n_data / PART_ROWS))

    def kth(scores):
        """Of each row the (k + 1)-th highest, as the query itself can be among them."""
        return np.partition(scores, scores.shape[1] - k - 1, axis=1)[:, scores.shape[1] - k - 1] if scores.shape[1] > k else np.full(len(scores), -np.inf)

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(0), dim)
            away = np.sqrt(np.maximum((x**2).sum(1)[:, None] - 2 * x @ pivots[:several].T + squares[:several], 0))
            group = away.argmin(1)
            columns = [batch.column(0), pa.array(group.astype(np.int32)), pa.array(away[np.arange(len(x)), group]), pa.array(kth(x @ near.T))]
            yield pa.RecordBatch.from_arrays(columns, names=["q", "h", "d", "low"])

    def own_part(_key, left: pa.Table, right: pa.Table) -> pa.Table:
        asked_q = left.column("q").combine_chunks()
        low = np.full(left.num_rows, -np.inf)
        if left.num_rows and right.num_rows:
            times = np.diff(np.asarray(right.column("ids").combine_chunks().offsets))
            x = np.repeat(_matrix(right.column("q").combine_chunks(), dim), times, axis=0)
            q = _matrix(asked_q, dim)
            low = np.concatenate([kth(q[at : at + 256] @ x.T) for at in range(0, len(q), 256)])
        return pa.table({"q": asked_q, "own": pa.array(low)})

    dealt = F.pmod(F.xxhash64("q", F.lit(1)), F.lit(parts)).cast("int")
    own_low = wanted.select("q", "g", dealt.alias("s")).groupBy("g", "s").cogroup(data.select("q", "ids", "g", dealt.alias("s")).groupBy("g", "s")).applyInArrow(own_part, "q array<bigint>, own double")
    chunk = (F.col("h") * chunks + F.pmod(F.xxhash64("q"), F.lit(chunks))).cast("int")
    placed = wanted.select("q").mapInArrow(bounded, "q array<bigint>, h int, d double, low double").join(own_low, "q")
    # a hair lower, as these scores are sums in doubles
    best = F.greatest("low", "own")
    bounds = materialise(placed.select("q", "d", chunk.alias("c"), (best - _SLACK * (F.abs(best) + 1)).alias("low")), "voronoi-bounds")
    groups = bounds.groupBy("c").agg(F.max("d").alias("r"), F.min("low").alias("low")).collect()
    if not groups:
        return spark.createDataFrame([], out)
    codes = np.array([r["c"] for r in groups], dtype=np.int32)
    centre, radius, low = pivots[codes // chunks], np.array([r["r"] for r in groups]), np.array([r["low"] for r in groups])

    def replicated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                x = _matrix(some.column(0), dim)
                reach = x @ centre.T + np.sqrt((x**2).sum(1))[:, None] * radius
                row, group = np.nonzero(reach + _SLACK * (np.abs(reach) + 1) >= low)
                for part in range(0, len(row), 4096):
                    take = pa.array(row[part : part + 4096])
                    yield pa.RecordBatch.from_arrays([some.column(0).take(take), some.column(1).take(take), pa.array(codes[group[part : part + 4096]])], names=["q", "ids", "c"])

    sent = data.select("q", "ids").mapInArrow(replicated, "q array<bigint>, ids array<bigint>, c int").withColumn("s", F.pmod(F.xxhash64("q"), F.lit(parts)).cast("int"))
    asking = bounds.select("q", "c").withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def solve(_key, left: pa.Table, right: pa.Table) -> pa.Table:
        queries, ids, scores = [], [], []
        if left.num_rows and right.num_rows:
            asked_q = left.column("q").combine_chunks()
            q, x = _matrix(asked_q, dim), _matrix(right.column("q").combine_chunks(), dim)
            lists = right.column("ids").combine_chunks()
            sizes = np.diff(np.asarray(lists.offsets))
            flat = np.asarray(lists.flatten(), dtype=np.int64)
            owner = np.repeat(np.arange(len(x)), sizes)
            for at in range(0, len(q), 64):
                block = _scores(x, q[at : at + 64], dim)
                for i, row in enumerate(block):
                    least = np.partition(row, len(row) - k - 1)[len(row) - k - 1] if len(row) > k else row.min()
                    among = np.nonzero((row >= least)[owner])[0]
                    best = among[np.lexsort((flat[among], -row[owner[among]]))][: k + 1]
                    queries += [at + i] * len(best)
                    ids.append(flat[best])
                    scores.append(row[owner[best]])
        none = np.zeros(0, np.int64)
        source = left.column("q").combine_chunks() if left.num_rows else pa.array([], pa.list_(pa.int64()))
        return pa.table({"q": source.take(pa.array(queries, pa.int64())), "vec_id": pa.array(np.concatenate([none, *ids])), "score": pa.array(np.concatenate([none, *scores]))})

    found = asking.groupBy("c", "s").cogroup(sent.groupBy("c", "s")).applyInArrow(solve, "q array<bigint>, vec_id bigint, score bigint")
    order = (F.col("score").desc(), F.col("vec_id"))
    merged = found.withColumn("n", F.row_number().over(W.partitionBy("q").orderBy(*order))).where(F.col("n") <= k + 1).select("q", "vec_id", "score")
    own = asked.select(F.col("id").alias("query_id"), "q").distinct().join(merged, "q").where(F.col("query_id") != F.col("vec_id"))
    ranked = own.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), lambda i: i % 50 == 0)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
