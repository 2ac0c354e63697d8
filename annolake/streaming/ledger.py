"""A keyed table of state that runs replace part by part: dealt into buckets by key, with a version for each bucket.

A run writes the buckets that it touches anew and leaves the others; what counts as the state is a numbered list of buckets with their versions, which is put in place last, so a run that is stopped
before that leaves the old state. The list also holds the number of buckets, which every later run must share, and whatever the run wants to remember. Versions that two later lists no longer name are deleted."""

from __future__ import annotations

import json
import zlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


@dataclass(frozen=True)
class Listed:
    number: int = -1
    versions: dict[int, int] = field(default_factory=dict)
    meta: dict = field(default_factory=dict)


class Ledger:
    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int | None = BUCKETS):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets
        self.Path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def bucket(self) -> Column:
        return F.crc32(F.col(self.key).cast("string").cast("binary")) % self.buckets

    def bucket_of(self, key: str) -> int:
        return zlib.crc32(key.encode()) % self.buckets

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.Path(f"{self.path}/{name}"))

    def put(self, name: str, text: str) -> None:
        """A small file, whole or not at all."""
        draft, final = self.Path(f"{self.path}/{name}.draft"), self.Path(f"{self.path}/{name}")
        out = self.fs.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        self.fs.rename(draft, final)

    def text(self, name: str) -> str:
        return self.spark.read.text(f"{self.path}/{name}", wholetext=True).first()[0]

    def delete(self, name: str) -> None:
        self.fs.delete(self.Path(f"{self.path}/{name}"), True)

    def numbers(self) -> list[int]:
        at = self.Path(f"{self.path}/lists")
        return sorted(int(s.getPath().getName()) for s in self.fs.listStatus(at) if s.getPath().getName().isdigit()) if self.fs.exists(at) else []

    def listed(self, number: int) -> Listed:
        held = json.loads(self.text(f"lists/{number}"))
        self.buckets = self.buckets or held["buckets"]  # a reader takes what there is
        if held["buckets"] != self.buckets:
            raise ValueError(f"the state has {held['buckets']} buckets, not {self.buckets}")
        return Listed(number, {int(b): v for b, v in held["versions"].items()}, held["meta"])

    def latest(self) -> Listed:
        """The list that counts; of a state that was never committed an empty one."""
        numbers = self.numbers()
        return self.listed(numbers[-1]) if numbers else Listed()

    def read(self, listed: Listed, buckets: list[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/v={v}/b={b}" for b, v in listed.versions.items() if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def commit(self, number: int, before: Listed, rows: DataFrame, touched: list[int], meta: dict) -> None:
        """``rows`` become the whole content of the touched buckets."""
        dealt = rows.select(*(f.name for f in self.spark.createDataFrame([], self.schema).schema)).withColumn("b", self.bucket().cast("int"))
        dealt.repartition("b").write.mode("overwrite").partitionBy("b").parquet(f"{self.path}/v={number}")
        held = {b: number for b in touched if self.exists(f"v={number}/b={b}")}
        versions = {**{b: v for b, v in before.versions.items() if b not in touched}, **held}
        past = self.numbers()
        self.put(f"lists/{number}", json.dumps({"buckets": self.buckets, "versions": versions, "meta": meta}))
        for old in past[:-1]:
            for b, v in self.listed(old).versions.items():
                if before.versions.get(b) != v:
                    self.delete(f"v={v}/b={b}")
            self.delete(f"lists/{old}")
