"""The device's store: numbered generations of a document catalog over blobs that are named by what they hold.

    generations/<n>/entries/bucket=<b>/*.parquet    the entries of generation n, dealt by document
    generations/<n>/parts/*.parquet                 (bucket, hash): a hash of each bucket's entries
    generations/<n>/root                            a hash of all of them, put there last: without it there is no generation
    documents/<hh>/<hash>                           a document's files: JSON lines of (page_id, ord, hash, tags)
    blobs/<hh>/<hash>                               pages

So two generations are compared from the top: equal roots are equal, equal bucket hashes need no reading, and of the other buckets only the entries that differ come out. The data source ``device`` reads
entries in one of two ways. A batch reads one generation, or with ``since`` what differs from another one; comparisons of doc_id are pushed down to the buckets that can hold it. A stream's offsets are
generations: each batch reads what differs between its ends, so what was read before a restart is not read again.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

from annolake.sources.vault import Store, opened, write_files

BUCKETS = 64
SCHEMA = "generation int, doc_id string, hash string, name string, type string, parent string, tags array<string>, gone boolean"
_ENTRY = ("doc_id", "hash", "name", "type", "parent", "tags")
_ARROW = pa.schema(
    [("generation", pa.int32()), ("doc_id", pa.string()), ("hash", pa.string()), ("name", pa.string()), ("type", pa.string()), ("parent", pa.string()), ("tags", pa.list_(pa.string())), ("gone", pa.bool_())]
)


def bucket_of(doc_id: str, buckets: int) -> int:
    return zlib.crc32(doc_id.encode()) % buckets


def _bucket(doc_id: Column, buckets: int) -> Column:
    return (F.crc32(doc_id.cast("binary")) % buckets).cast("int")


def generations(store: Store) -> list[int]:
    numbers = (i.base_name for i in store.listed("generations") if i.type == pafs.FileType.Directory)
    return sorted(int(n) for n in numbers if n.isdigit() and store.exists(f"generations/{n}/root"))


def root_of(store: Store, generation: int) -> dict:
    """{root, buckets}; of the generation before the first nothing."""
    return json.loads(store.read(f"generations/{generation}/root")) if generation > 0 else {"root": None, "buckets": None}


def put_generation(entries: DataFrame, root: str, buckets: int = BUCKETS) -> int:
    """Adds a generation of (doc_id, hash, name, type, parent, tags); its number."""
    store = Store(root)
    number = max(generations(store), default=0) + 1
    base, own = f"{root.rstrip('/')}/generations/{number}", entries.select(*_ENTRY)
    dealt = own.withColumn("bucket", _bucket(F.col("doc_id"), buckets))
    dealt.repartition("bucket").sortWithinPartitions("bucket", "doc_id").write.mode("overwrite").partitionBy("bucket").parquet(f"{base}/entries")
    # order plays no part in a bucket's hash: two folds over its rows' hashes, and their number
    row = F.xxhash64(*(F.coalesce(F.to_json(F.col(c)) if c == "tags" else F.col(c), F.lit("\0")) for c in _ENTRY))
    parts = dealt.groupBy("bucket").agg(F.sha2(F.concat_ws("/", F.bit_xor(row), F.sum(row.cast("decimal(38,0)")), F.count("*")), 256).alias("hash"))
    parts.coalesce(1).write.mode("overwrite").parquet(f"{base}/parts")
    hashes = [r["hash"] for r in entries.sparkSession.read.parquet(f"{base}/parts").orderBy("bucket").collect()]  # one for each bucket
    top = hashlib.sha256("\n".join(hashes).encode()).hexdigest()
    store.put(f"generations/{number}/root", json.dumps({"root": top, "buckets": buckets}).encode())
    return number


def put_files(files: DataFrame, root: str, folder: str) -> None:
    """Blobs or listings of (hash, content) at their places; those that an earlier generation has put there are not written again, as their names tell what they hold."""
    write_files(files, root, F.concat(F.lit(f"{folder}/"), F.substring("hash", 1, 2), F.lit("/"), F.col("hash")), keep=True)


class Bucket(InputPartition):
    def __init__(self, generation: int, since: int, bucket: int):
        self.generation, self.since, self.bucket = generation, since, bucket


class _Entries:
    """What the batch reader and the stream reader share."""

    def __init__(self, root: str):
        self.root = root

    def _parts(self, store: Store, generation: int) -> dict[int, str]:
        if generation < 1:
            return {}
        table = pq.read_table(store.at(f"generations/{generation}/parts"), filesystem=store.fs, columns=["bucket", "hash"])
        return dict(zip(table.column("bucket").to_pylist(), table.column("hash").to_pylist(), strict=True))

    def between(self, since: int, generation: int, wanted: set[int] | None = None) -> list[Bucket]:
        """The buckets that differ, from the top down."""
        store = Store(self.root)
        old, new = root_of(store, since), root_of(store, generation)
        if old == new:
            return []
        if old["buckets"] not in (None, new["buckets"]):
            raise ValueError(f"generation {since} has {old['buckets']} buckets and generation {generation} {new['buckets']}")
        before, after = self._parts(store, since), self._parts(store, generation)
        return [Bucket(generation, since, b) for b in sorted(before.keys() | after.keys()) if before.get(b) != after.get(b) and (wanted is None or b in wanted)]

    def _entries(self, store: Store, generation: int, bucket: int) -> pa.Table:
        folder = f"generations/{generation}/entries/bucket={bucket}"
        if generation < 1 or not store.exists(folder):
            return pa.schema([f for f in _ARROW if f.name in _ENTRY]).empty_table()
        return pq.read_table(store.at(folder), filesystem=store.fs, columns=list(_ENTRY), partitioning=None)

    def read(self, part: Bucket | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # of a read without partitions
            return
        store = Store(self.root)
        new, old = self._entries(store, part.generation, part.bucket), self._entries(store, part.since, part.bucket)
        before = dict(zip(old.column("doc_id").to_pylist(), old.select(_ENTRY[1:]).to_pylist(), strict=True))
        ids, rows = new.column("doc_id").to_pylist(), new.select(_ENTRY[1:]).to_pylist()
        differs = pa.array([before.get(i) != r for i, r in zip(ids, rows, strict=True)], pa.bool_())
        gone = old.filter(pc.invert(pc.is_in(old.column("doc_id"), value_set=pa.array(ids, pa.string()))))
        for table, lost in ((new.filter(differs), False), (gone, True)):
            n = table.num_rows
            columns = [pa.array([part.generation] * n, pa.int32()), *(table.column(c) for c in _ENTRY), pa.array([lost] * n, pa.bool_())]
            yield from pa.table([pa.chunked_array(c, f.type) if isinstance(c, list) else c.cast(f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW).to_batches()


class EntryReader(_Entries, DataSourceReader):
    def __init__(self, root: str, generation: int | None, since: int):
        super().__init__(root)
        self.generation, self.since, self.ids = generation, since, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("doc_id",):
                values = {f.value} if isinstance(f, EqualTo) else {v for v in f.value if v is not None}
                self.ids = values if self.ids is None else self.ids & values
            else:
                yield f

    def partitions(self) -> Sequence[Bucket]:
        store = Store(self.root)
        number = self.generation if self.generation is not None else max(generations(store), default=0)
        if number == 0:
            return []
        buckets = root_of(store, number)["buckets"]
        return self.between(self.since, number, None if self.ids is None else {bucket_of(i, buckets) for i in self.ids})

    def read(self, part: Bucket | None) -> Iterator[pa.RecordBatch]:
        for batch in super().read(part):  # a bucket holds other documents as well
            yield batch if self.ids is None else batch.filter(pc.is_in(batch.column("doc_id"), value_set=pa.array(sorted(self.ids), pa.string())))


class EntryStream(_Entries, DataSourceStreamReader):
    def __init__(self, root: str, since: int, each: int):
        super().__init__(root)
        self.since, self.each, self.reached = since, each, None

    def initialOffset(self) -> dict:
        return {"generation": self.since}

    def latestOffset(self) -> dict:
        return {"generation": max(generations(Store(self.root)), default=self.since)}

    def partitions(self, start: dict, end: dict) -> Sequence[Bucket]:
        """What differs between the ends, or from each generation to the next."""
        known = [g for g in generations(Store(self.root)) if start["generation"] < g <= end["generation"]]
        steps = known if self.each else known[-1:]
        return [part for a, b in zip([start["generation"], *steps], steps, strict=False) for part in self.between(a, b)]


class Device(DataSource):
    @classmethod
    def name(cls) -> str:
        return "device"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> EntryReader:
        number = self.options.get("generation")
        return EntryReader(self.options["path"], None if number is None else int(number), int(self.options.get("since", 0)))

    def streamReader(self, schema) -> EntryStream:
        return EntryStream(self.options["path"], int(self.options.get("since", 0)), self.options.get("each", "false") == "true")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Device)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_entries(spark: SparkSession, root: str, generation: int | None = None, since: int = 0) -> DataFrame:
    """Entries of a generation, the latest if none is named; with ``since`` those that differ from it, and as ``gone`` those that it alone has."""
    register(spark)
    reader = spark.read.format("device").option("since", since)
    return (reader if generation is None else reader.option("generation", generation)).load(root)


def stream_entries(spark: SparkSession, root: str, since: int = 0, each: bool = False) -> DataFrame:
    register(spark)
    return spark.readStream.format("device").option("since", since).option("each", str(each).lower()).load(root)


def fetched(rows: DataFrame, root: str, folder: str, key: str = "hash", as_: str = "content") -> DataFrame:
    """The rows with the blob or listing that each one's hash names; null without a hash, and where there is none."""
    at = F.concat(F.lit(f"{folder}/"), F.substring(key, 1, 2), F.lit("/"), F.col(key))
    return opened(rows.withColumn("_at", at), root, "_at", as_, own=True).drop("_at")


LISTING = "page_id string, ord int, hash string, tags array<string>"


def listings(documents: DataFrame, root: str) -> DataFrame:
    """(doc_id, page_id, ord, page_hash, page_tags) of documents (doc_id, hash), and ``unreadable``: documents without a listing are one row of nulls with it set."""
    got = fetched(documents.select("doc_id", "hash"), root, "documents")
    text = F.col("content").cast("string")
    lines = F.filter(F.split(text, "\n"), lambda line: line != "")
    rows = got.select("doc_id", F.explode_outer(F.transform(lines, lambda line: F.from_json(line, LISTING))).alias("p"), F.col("content").isNull().alias("unreadable"))
    return rows.select("doc_id", "p.page_id", "p.ord", F.col("p.hash").alias("page_hash"), F.coalesce("p.tags", F.array().cast("array<string>")).alias("page_tags"), "unreadable").where("page_id IS NOT NULL OR unreadable")
