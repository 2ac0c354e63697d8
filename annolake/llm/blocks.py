"""Blocks of documents: every document belongs to one block by the hash of its id, and a block's documents travel as
compressed chunks. What a block asks of the whole corpus goes out keyed by content and comes back keyed by block, so a value
that many documents share is one row from each block, and texts are shuffled only as chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolake.llm.columns import release

#: Of the compression; higher ones cost more time than the shuffled bytes are worth.
LEVEL = 5


def block_of(id_col: str | Column, count: int) -> Column:
    return F.pmod(F.xxhash64(id_col), F.lit(count)).cast("int")


def packed(docs: DataFrame, id_col: str, count: int, prepare: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, level: int = LEVEL) -> DataFrame:
    """(b int, chunk binary): the rows of each input batch by block, as compressed Arrow; ``prepare`` may change them first, row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=level))
        for batch in batches:
            b = np.asarray(batch.column(0))
            order = np.argsort(b, kind="stable")
            starts = np.nonzero(np.r_[True, b[order][1:] != b[order][:-1]])[0] if len(b) else []
            rows, blocks, chunks = batch.select(batch.schema.names[1:]), [], []
            rows = prepare(rows) if prepare else rows
            for start, end in zip(starts, [*starts[1:], len(b)], strict=True):
                part = rows.take(pa.array(order[start:end]))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=options) as writer:
                    writer.write_batch(part)
                blocks.append(int(b[order[start]]))
                chunks.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(chunks, pa.binary())], names=["b", "chunk"])

    return docs.select(block_of(id_col, count).alias("b"), *docs.columns).mapInArrow(run, "b int, chunk binary")


def unpacked(chunks: pa.Table) -> Iterator[pa.RecordBatch]:
    for column in chunks.column("chunk").chunks:
        for chunk in column:
            with pa.ipc.open_stream(chunk.as_buffer()) as reader:
                yield from reader
