"""A vault: a folder of notes and attachments, as a data source that reads and writes files by their paths.

Writing has two steps. Each task puts its files under names of its own beside a list of them, and says in its commit message where that list is. When all tasks are done the driver puts one
small file in place that names the lists of the attempts that count; what other attempts left is ignored. Then `publish` renames the files to their paths, in tasks, and may be repeated: a
file that is at its place already is left there. A write that fails leaves the vault as it was; one that is stopped after its commit is finished by the next `publish`.

``spark.read.format("vault")`` lists folders on the driver until there are enough of them, and files in tasks; comparisons of the path are pushed down, so known paths are opened without any
listing. Paths are relative to the root, with ``/`` between; a path that would lead out of it or into the vault's own folder is refused. The root is a folder of a file system that all machines share.
"""

from __future__ import annotations

import json
import posixpath
import time
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage

OWN = ".vault"
SCHEMA = "path string, content binary"
_LIST = pa.schema([("path", pa.string()), ("staged", pa.string()), ("size", pa.int64())])
#: Folders that are listed apart, at least; bytes of content in a batch.
SPREAD, BATCH = 64, 16 << 20


class Store:
    """The few file operations of a vault, on whatever file system holds it."""

    def __init__(self, root: str):
        self.fs, self.root = pafs.FileSystem.from_uri(root)

    def at(self, path: str) -> str:
        return f"{self.root.rstrip('/')}/{path}"

    def kind(self, path: str) -> pafs.FileType:
        return self.fs.get_file_info(self.at(path)).type

    def exists(self, path: str) -> bool:
        """Whether anything at all, a file or a folder, is at a path."""
        return self.kind(path) != pafs.FileType.NotFound

    def listed(self, folder: str, deep: bool = False) -> list[pafs.FileInfo]:
        return self.fs.get_file_info(pafs.FileSelector(self.at(folder) if folder else self.root, allow_not_found=True, recursive=deep))

    def relative(self, info: pafs.FileInfo) -> str:
        return info.path[len(self.root.rstrip("/")) + 1 :]

    def read(self, path: str) -> bytes:
        with self.fs.open_input_stream(self.at(path)) as f:
            return f.readall()

    def put(self, path: str, content: bytes) -> None:
        """The whole file or nothing."""
        draft = f"{path}.{uuid.uuid4().hex}"
        self.fs.create_dir(posixpath.dirname(self.at(path)))
        with self.fs.open_output_stream(self.at(draft)) as f:
            f.write(content)
        self.fs.move(self.at(draft), self.at(path))

    def move(self, source: str, target: str) -> None:
        try:
            self.fs.move(self.at(source), self.at(target))
        except OSError:  # mostly the folder is there already; a second failure is a real one
            self.fs.create_dir(posixpath.dirname(self.at(target)))
            self.fs.move(self.at(source), self.at(target))

    def delete(self, folder: str) -> None:
        if self.exists(folder):
            self.fs.delete_dir(self.at(folder))


def inside(path: str | None) -> bool:
    """Whether a path stays inside the vault, and outside its own folder."""
    parts = (path or "").split("/")
    return bool(path) and not any(p in ("", ".", "..") for p in parts) and parts[0] != OWN and "\0" not in path


def checked(path: str | None) -> str:
    if not inside(path):
        raise ValueError(f"not a path of a vault: {path!r}")
    return path


@dataclass
class Listed(WriterCommitMessage):
    attempt: str
    files: int


class VaultWriter(DataSourceArrowWriter):
    def __init__(self, root: str, run: str, keep: bool = False):
        self.root, self.run, self.keep = root, run, keep

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Listed:
        store, attempt, rows = Store(self.root), uuid.uuid4().hex, []
        folder = f"{OWN}/{self.run}/{attempt}"
        store.fs.create_dir(store.at(folder))
        for batch in iterator:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                if self.keep and store.kind(checked(path)) == pafs.FileType.File:
                    continue
                staged, data = f"{folder}/{len(rows)}", content.as_buffer() or pa.py_buffer(b"")
                with store.fs.open_output_stream(store.at(staged)) as f:
                    f.write(data)
                rows.append((checked(path), staged, data.size))
        pq.write_table(pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_LIST)], schema=_LIST), store.at(f"{folder}/list.parquet"), filesystem=store.fs)
        return Listed(attempt, len(rows))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        own = [m for m in messages if isinstance(m, Listed) and m.files]
        Store(self.root).put(f"{OWN}/{self.run}/committed", json.dumps([m.attempt for m in own]).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        Store(self.root).delete(f"{OWN}/{self.run}")


class Part(InputPartition):
    """Known files, or a folder with or without what is below it."""

    def __init__(self, files: Sequence[str] = (), folder: str | None = None, deep: bool = False):
        self.files, self.folder, self.deep = tuple(files), folder, deep


class VaultReader(DataSourceReader):
    def __init__(self, root: str, names_only: bool = False):
        self.root, self.known, self.prefix, self.names_only = root, None, "", names_only

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("path",):
                self._only([f.value])
            elif isinstance(f, In) and f.attribute == ("path",):
                self._only([v for v in f.value if v is not None])
            elif isinstance(f, StringStartsWith) and f.attribute == ("path",) and f.value.startswith(self.prefix):
                self.prefix = f.value
            else:
                yield f

    def _only(self, paths: list[str]) -> None:
        self.known = sorted(set(paths) if self.known is None else set(paths) & set(self.known))

    def partitions(self) -> Sequence[Part]:
        store = Store(self.root)
        if self.known is not None:
            own = [p for p in self.known if p.startswith(self.prefix) and inside(p)]
            return [Part(own[i : i + 256]) for i in range(0, len(own), 256)] or [Part()]
        # folders whose files are listed alone, and those whose whole content is
        top = posixpath.dirname(self.prefix)
        flat, deep = [], [top] if not top or inside(top) else []
        while deep and len(flat) + len(deep) < SPREAD:
            below = [store.relative(i) for f in deep for i in store.listed(f) if i.type == pafs.FileType.Directory]
            flat, deep = flat + deep, [f for f in below if f != OWN and (f + "/").startswith(self.prefix[: len(f) + 1])]
        return [*(Part(folder=f) for f in flat), *(Part(folder=f, deep=True) for f in deep)] or [Part()]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        store = Store(self.root)
        if partition.folder is None:
            found = [p for p in partition.files if store.kind(p) == pafs.FileType.File]
        else:
            files = (store.relative(i) for i in store.listed(partition.folder, partition.deep) if i.type == pafs.FileType.File)
            found = sorted(p for p in files if p.startswith(self.prefix) and not p.startswith(OWN + "/"))
        paths, contents, size = [], [], 0
        for path in found:
            paths.append(path)
            contents.append(None if self.names_only else store.read(path))
            size += len(contents[-1] or b"") + len(path)
            if size > BATCH:
                yield pa.record_batch({"path": paths, "content": pa.array(contents, pa.binary())})
                paths, contents, size = [], [], 0
        yield pa.record_batch({"path": pa.array(paths, pa.string()), "content": pa.array(contents, pa.binary())})


class Vault(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vault"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> VaultReader:
        return VaultReader(self.options["path"], self.options.get("names", "false") == "true")

    def writer(self, schema, overwrite: bool) -> VaultWriter:
        if overwrite:
            raise ValueError("a vault holds other people's files: append to it")
        return VaultWriter(self.options["path"], self.options["run"], self.options.get("keep", "false") == "true")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Vault)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows in as many tasks as a shuffle has: each is a file to be opened or renamed, which its few bytes do not tell, so adaptive execution would leave them to a few tasks."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def read_vault(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of all files."""
    register(spark)
    return spark.read.format("vault").load(root)


def vault_paths(spark: SparkSession, root: str) -> DataFrame:
    """(path) of all files, none of which is opened."""
    register(spark)
    return spark.read.format("vault").option("names", "true").load(root).select("path")


def opened(rows: DataFrame, root: str, path: str = "path", as_: str = "content", own: bool = False) -> DataFrame:
    """The rows with the content of the file at each one's path; null without a path, and where there is no file. Files are opened in the tasks, one for each row. ``own``: any path of the root's file system
    below it, for stores that are no vaults."""
    field = pa.field(as_, pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(root)

        def content(at: str | None) -> bytes | None:
            return store.read(at) if at and (own or inside(at)) and store.kind(at) == pafs.FileType.File else None

        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                some = batch.slice(start, 64)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array([content(p) for p in some.column(path).to_pylist()], pa.binary())], schema=some.schema.append(field))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, `{as_}` binary")


def write_files(files: DataFrame, root: str, path: str | Column = "path", content: str | Column = "content", keep: bool = False) -> None:
    """Puts files at their paths, in place of what is there. A path that two rows want, or that is a folder, fails the write and changes nothing. ``keep``: files that are there already stay as they are and are not
    written again, for paths that tell what a file holds."""
    spark = files.sparkSession
    register(spark)
    publish(spark, root)
    column = content if isinstance(content, Column) else F.col(content)
    run = f"run-{time.time_ns():020d}-{uuid.uuid4().hex}"
    rows = files.select((path if isinstance(path, Column) else F.col(path)).alias("path"), column.cast("binary").alias("content"))
    rows.write.format("vault").mode("append").option("path", root).option("run", run).option("keep", str(keep).lower()).save()
    publish(spark, root)


def _lists(spark: SparkSession, store: Store, root: str, run: str) -> DataFrame | None:
    attempts = json.loads(store.read(f"{OWN}/{run}/committed"))
    return spark.read.parquet(*(f"{root.rstrip('/')}/{OWN}/{run}/{a}/list.parquet" for a in attempts)) if attempts else None


def publish(spark: SparkSession, root: str) -> int:
    """Renames what committed writes have left to its paths, oldest write first; how many writes that were."""
    store, done = Store(root), 0
    for run in sorted(store.relative(i).split("/")[-1] for i in store.listed(OWN) if i.type == pafs.FileType.Directory and i.base_name.startswith("run-")):
        if not store.exists(f"{OWN}/{run}/committed"):
            continue  # still being written, or given up without an abort
        files = _lists(spark, store, root, run)
        if files is not None:
            twice = files.groupBy("path").count().where("count > 1").select("path").head(1)
            if twice:
                store.delete(f"{OWN}/{run}")
                raise ValueError(f"two files for {twice[0][0]!r}")

            def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                own, moved = Store(root), 0
                for batch in batches:
                    for path, staged in zip(batch.column("path").to_pylist(), batch.column("staged").to_pylist(), strict=True):
                        if own.exists(staged):  # not moved by an earlier attempt
                            own.move(staged, path)
                            moved += 1
                yield pa.record_batch({"moved": [moved]})

            dealt(files.select("path", "staged"), "path").mapInArrow(put, "moved long").agg(F.sum("moved")).collect()
        store.delete(f"{OWN}/{run}")
        done += 1
    return done
