"""Reading tables and shared settings of the training-data operators."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def block_count(spark: SparkSession, per_partition: int = 4) -> int:
    """How many blocks a corpus is dealt into: a few for each shuffle partition, so it follows the
    size that the cluster is set up for and one block stays small next to a task's memory."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))) * per_partition


#: Bytes of text of a block, on average.
BLOCK_BYTES = 16 << 20


def blocks_by_bytes(docs: DataFrame, text: str = "text", each: int = BLOCK_BYTES) -> int:
    """How many blocks a corpus is dealt into so that each holds so many bytes, whatever the number of partitions."""
    size = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")).cast("long"))).first()[0] or 0
    return -(-size // each) or 1


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; where it names none, the warehouse, which must be one that all machines see: one that was never set is the driver's own, and is only taken on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local") and not spark.sparkContext.getConf().contains("spark.sql.warehouse.dir"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return named or spark.conf.get("spark.sql.warehouse.dir")


@contextlib.contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """What a query shuffles is deleted when it is done, not only when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Scratch:
    """Tables written once to the shared folder and read back: they cut lineage, they outlive executors and, unlike cached tables, cost no
    executor memory. Those that nothing reads any more are deleted by `clear`."""

    def __init__(self, spark: SparkSession):
        self.spark, self.done, self.names = spark, [], []

    def path(self, label: str) -> str:
        return f"{checkpoint_dir(self.spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, label: str, keep: bool = False) -> DataFrame:
        """``keep``: what is returned is read later, so `clear` leaves it."""
        path = self.path(label)
        with shuffles_end(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        if not keep:
            self.done.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, count: int, column: str, label: str) -> DataFrame:
        """A table dealt by ``column`` once; reading it by that column needs no further shuffle."""
        path, name = self.path(label), f"{label}_{uuid.uuid4().hex}"
        with shuffles_end(self.spark):
            df.repartition(count, column).write.bucketBy(count, column).format("parquet").option("compression", "none").option("path", path).saveAsTable(name)
        self.done.append(path)
        self.names.append(name)
        return self.spark.table(name)

    def clear(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS `{name}`")
        self.names.clear()
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path in self.done:
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)
        self.done.clear()


def materialise(df: DataFrame, label: str) -> DataFrame:
    """A table that stays."""
    return Scratch(df.sparkSession).write(df, label, keep=True)
