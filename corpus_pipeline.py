"""A corpus from raw documents to token ids: quality, repeated lines, near duplicates, benchmark leaks, encoding.

Every stage works on all rows that its predecessor kept. Rows of one doc_id are one document and stay or go together; a row without a
doc_id takes part in no comparison and stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolake.llm.byte_bpe import encode, vocabulary
from annolake.llm.decontaminate import contaminated
from annolake.llm.jaccard_join import near_duplicates
from annolake.llm.line_dedup import dedup_lines
from annolake.llm.quality import classify
from annolake.llm.tables import materialise, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    return docs.join(gone.distinct(), "doc_id", "left_anti").select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; of a repeated id, if it rejects every row."""
    judged = classify(docs, table(spark, sf_dir, "labels"))
    return _without(docs, judged.groupBy("doc_id").agg(F.max("keep").alias("keep")).where(~F.col("keep")).select("doc_id"))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, except in the first document; so do documents of which nothing is left that had something."""
    done = dedup_lines(docs.select(*COLUMNS).withColumn("_blank", F.trim(F.coalesce("text", F.lit(""))) == ""))
    left = done.where(F.col("_blank") | (F.col("n_dropped") == 0) | (F.trim("text") != ""))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest id stays."""
    groups = near_duplicates(docs.select("doc_id", "text"))
    return _without(docs, groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id"))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item, or an edited copy of one, go."""
    return _without(docs, contaminated(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark")).select("doc_id"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, token_ids, exact): ids as little-endian unsigned 32-bit integers, and whether they decode to the very text."""
    path, pattern = vocabulary()
    ids = encode(docs.select("doc_id", "text"), path, pattern, keep_digest=True, decoded=True)
    return ids.select("doc_id", "n_tokens", "token_ids", (F.sha2("decoded", 256) == F.col("text_sha256")).alias("exact"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality), ("repeated_lines", repeated_lines), ("near_copies", near_copies), ("leaks", leaks), ("token_ids", token_ids),
]

#: No SQL states the language model, the alignment or the encoding; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; each is written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{name}")
    return docs
