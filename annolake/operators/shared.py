"""Tables that a loop writes between its rounds, in the folder that all machines share, and groups that pass through tasks in batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def by_group(rows: DataFrame, key: str, order: list[str], run: Callable[[pd.DataFrame], Iterable[tuple]], schema: str) -> DataFrame:
    """The tuples that ``run`` makes of each group's rows, in order. Groups pass through a task one after another in whole batches, so many small ones cost little more than their rows; a task holds a batch
    and one group. There are twice as many tasks as a shuffle has: what a group costs is not told by its few bytes, by which adaptive execution would leave all groups to one or two tasks. (The very number
    of a shuffle would be left out where a join has dealt the rows by the same key, and its tasks are put together then.)"""
    names = StructType.fromDDL(schema).names

    def told(frame: pd.DataFrame, cuts: np.ndarray) -> pd.DataFrame:
        edges = [0, *cuts.tolist(), len(frame)]
        return pd.DataFrame([row for a, b in zip(edges, edges[1:], strict=False) for row in run(frame.iloc[a:b].reset_index(drop=True))], columns=names)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []  # of the group that is still open: put together once, when it ends
        for frame in frames:
            if not len(frame):
                continue
            if rest and frame[key].iloc[-1] == rest[-1][key].iloc[-1]:
                rest.append(frame)
                continue
            frame = pd.concat([*rest, frame], ignore_index=True) if rest else frame
            keys = frame[key].to_numpy()
            cuts = np.nonzero(keys[1:] != keys[:-1])[0] + 1
            rest = [frame]
            if len(cuts):
                rest = [frame.iloc[cuts[-1] :].copy()]
                yield told(frame.iloc[: cuts[-1]], cuts[:-1])
        if rest:
            yield told(pd.concat(rest, ignore_index=True) if len(rest) > 1 else rest[0], np.zeros(0, int))

    tasks = 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, key).sortWithinPartitions(key, *order).mapInPandas(batches, schema)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's folder for checkpoints; where it names none, the warehouse. Both must be folders that all machines see: a warehouse that was never set is the driver's own, and is only taken on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local") and not spark.sparkContext.getConf().contains("spark.sql.warehouse.dir"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return (named or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


class Rounds:
    """Writes a table and reads it back, so no round is computed again and a lost executor costs none of them."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label, self.paths = spark, label, []

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{shared_folder(self.spark)}/{self.label}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def forget(self, keep: int = 1, first: int = 0) -> None:
        """Deletes all but the latest ``keep`` tables and the ``first`` ones."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        while len(self.paths) > first + keep:
            folder = jvm.org.apache.hadoop.fs.Path(self.paths.pop(first))
            folder.getFileSystem(conf).delete(folder, True)
