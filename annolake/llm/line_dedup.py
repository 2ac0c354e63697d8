"""Line deduplication: a line whose key stands in several documents stays in the smallest of them only.

Lines are exploded to (hash of the key, document, positions), one row for each document and key; the rows are
counted by hash with partial aggregation, and only hashes that two documents share go back to their
documents as lists of positions, by which the text is put together again. A line that a third of all
documents share is one aggregated row from each task, and its join is one that adaptive execution can split.

Cases: null or empty text is one empty line; keys shorter than ``min_chars`` code points are never
dropped; repeated rows and ties share a doc_id and count as one document, so a key found only there
stays; a null doc_id is no document: its lines all stay; an empty table gives an empty result; extra columns pass through
``dedup_lines`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolake.llm.columns import release
from annolake.llm.tables import table

MIN_CHARS = 10
#: Stripped from both ends of a line to get its key.
BLANK = b" \t\n\x0b\x0c\r"
_KEYS = "k1 bigint, k2 bigint, _doc bigint, _row bigint, _at array<int>"


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    key = line.strip(BLANK).lower()  # of bytes: A-Z only
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return key


def _hashed(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        release()
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            keys, docs, rows, at = [], [], [], []
            for doc, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                own: dict[bytes, list[int]] = {}
                for i, line in enumerate((text.as_py() or "").encode("utf-8", "surrogatepass").split(b"\n")):
                    if (key := line_key(line, min_chars)) is not None:
                        own.setdefault(digest(key), []).append(i)
                keys += own
                docs += [doc] * len(own)
                rows += [row] * len(own)
                at += own.values()
            pair = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(docs, pa.int64()), pa.array(rows, pa.int64()), pa.array(at, pa.list_(pa.int32()))],
                names=["k1", "k2", "_doc", "_row", "_at"],
            )

    return run


def dropped_positions(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = 2, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(_doc, _row, _drop array<int>) for the rows that lose lines; _row is the hash of the text, as an id may repeat."""
    keys = docs.select(F.col(id_col).cast("long"), F.xxhash64(text), F.col(text).cast("string")).where(F.col(id_col).isNotNull()).mapInArrow(_hashed(min_chars), _KEYS)
    # distinct documents: of two, the smallest and the largest tell; of more, they are counted
    found = F.when(F.min("_doc") < F.max("_doc"), 2).otherwise(1) if min_docs <= 2 else F.count_distinct("_doc")
    shared = keys.groupBy("k1", "k2").agg(F.min("_doc").alias("_owner"), found.alias("_found")).where(F.col("_found") >= min_docs).drop("_found")
    lost = keys.join(shared, ["k1", "k2"]).where(F.col("_doc") != F.col("_owner"))
    return lost.groupBy("_doc", "_row").agg(F.flatten(F.collect_list("_at")).alias("_drop"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = 2, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The documents with ``text`` cut, and ``n_lines`` and ``n_dropped`` appended (an input column of either name is
    replaced)."""
    docs = docs.drop("n_lines", "n_dropped")
    drops = dropped_positions(docs, min_chars, min_docs, text, id_col).withColumnRenamed("_doc", "_drop_id")
    joined = docs.join(drops, (F.col(id_col) == F.col("_drop_id")) & (F.xxhash64(text) == F.col("_row")), "left").drop("_drop_id", "_row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            at = batch.schema.get_field_index(text)
            kept, lines, dropped = [], [], []
            for value, drop in zip(batch.column(at), batch.column("_drop"), strict=True):
                own = (value.as_py() or "").split("\n")
                gone = set(drop.as_py() or ())
                lines.append(len(own))
                dropped.append(len(gone))
                kept.append("\n".join(x for i, x in enumerate(own) if i not in gone) if gone else value.as_py() or "")
            out = batch.set_column(at, text, pa.array(kept, batch.schema.field(at).type)).drop_columns(["_drop"])
            yield out.append_column("n_lines", pa.array(lines, pa.int64())).append_column("n_dropped", pa.array(dropped, pa.int64()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return joined.mapInArrow(run, f"{fields}, n_lines bigint, n_dropped bigint")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, u.i AS pos, u.line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents) d,
       LATERAL (SELECT unnest(parts) AS line, generate_subscripts(parts, 1) AS i) u
), keyed AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), shared AS (
  SELECT k, min(doc_id) AS owner FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT keyed.doc_id, pos, line, shared.owner IS NOT NULL AND shared.owner <> keyed.doc_id AS gone
  FROM keyed LEFT JOIN shared ON keyed.k = shared.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
