import json

import pytest
from annolake.sources import device as D
from annolake.sources.vault import Store

ENTRY = "doc_id string, hash string, name string, type string, parent string, tags array<string>"


def entries(spark, rows):
    return spark.createDataFrame([(i, h, f"name {i}", "DocumentType", None, ["t"] if h else None) for i, h in rows.items()], ENTRY)


def rows(frame):
    return sorted((r["generation"], r["doc_id"], r["hash"], r["gone"]) for r in frame.collect())


@pytest.fixture()
def store(spark, tmp_path):
    root = f"file://{tmp_path}"
    one = {f"d{i}": f"h{i}" for i in range(300)}
    D.put_generation(entries(spark, one), root, 16)
    two = {k: v for k, v in one.items() if k != "d7"} | {"d3": "new", "x": "h"}
    D.put_generation(entries(spark, two), root, 16)
    D.put_generation(entries(spark, two), root, 16)  # nothing changed
    return root, one, two


def test_generations_are_compared_from_the_top(spark, store):
    root, one, two = store
    assert rows(D.read_entries(spark, root, 1)) == sorted((1, k, v, False) for k, v in one.items())
    assert rows(D.read_entries(spark, root)) == sorted((3, k, v, False) for k, v in two.items())
    changed = [(3, "d3", "new", False), (3, "d7", "h7", True), (3, "x", "h", False)]
    assert rows(D.read_entries(spark, root, since=1)) == changed
    parts = D.EntryReader(root, 3, 1).partitions()
    assert {p.bucket for p in parts} == {D.bucket_of(i, 16) for i in ("d3", "d7", "x")}
    assert D.EntryReader(root, 3, 2).partitions() == [] and D.read_entries(spark, root, 3, 2).count() == 0
    assert D.root_of(Store(root), 2) == D.root_of(Store(root), 3)


def test_a_generation_without_its_root_is_none(spark, store):
    root, _, two = store
    s = Store(root)
    s.fs.delete_file(s.at("generations/3/root"))
    assert D.generations(s) == [1, 2] and rows(D.read_entries(spark, root)) == sorted((2, k, v, False) for k, v in two.items())
    assert D.put_generation(entries(spark, {"a": "b"}), root, 16) == 3 and rows(D.read_entries(spark, root)) == [(3, "a", "b", False)]


def test_filters_reach_the_buckets_and_the_plan(spark, store):
    root, one, _ = store
    reader = D.EntryReader(root, 1, 0)
    assert len(reader.partitions()) == 16
    list(reader.pushFilters([D.In(("doc_id",), ("d1", "d2", None))]))
    assert {p.bucket for p in reader.partitions()} == {D.bucket_of(i, 16) for i in ("d1", "d2")}
    frame = D.read_entries(spark, root, 1)
    for condition in ("doc_id = 'd5'", "doc_id IN ('d5', 'd6', 'none')", "doc_id = 'd5' AND hash = 'h6'", "doc_id > 'd9'"):
        want = spark.createDataFrame([(1, k, v, False) for k, v in one.items()], "generation int, doc_id string, hash string, gone boolean").where(condition)
        assert rows(frame.where(condition)) == rows(want), condition
    plan = frame.where("doc_id = 'd5'")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "d5" in plan.split("PushedFilters")[1].split("\n")[0]


def drained(frame, path, name):
    got = []

    def keep(batch, number):
        got.extend((number, *r) for r in rows(batch))

    query = frame.writeStream.foreachBatch(keep).option("checkpointLocation", f"file://{path}/{name}").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return [r[1:] for r in got]


def test_a_stream_reads_nothing_twice(spark, tmp_path):
    root = f"file://{tmp_path}/device"
    D.put_generation(entries(spark, {"a": "1", "b": "1"}), root, 4)
    assert drained(D.stream_entries(spark, root), tmp_path, "c") == [(1, "a", "1", False), (1, "b", "1", False)]
    assert drained(D.stream_entries(spark, root), tmp_path, "c") == []  # started again: nothing
    D.put_generation(entries(spark, {"a": "2", "b": "1"}), root, 4)
    D.put_generation(entries(spark, {"a": "3", "c": "1"}), root, 4)
    assert drained(D.stream_entries(spark, root), tmp_path, "c") == [(3, "a", "3", False), (3, "b", "1", True), (3, "c", "1", False)]
    assert drained(D.stream_entries(spark, root, each=True), tmp_path, "e") == [(1, "a", "1", False), (1, "b", "1", False), (2, "a", "2", False), (3, "a", "3", False), (3, "b", "1", True), (3, "c", "1", False)]


def test_blobs_and_listings(spark, tmp_path):
    root = f"file://{tmp_path}"
    D.put_files(spark.createDataFrame([("ab1", b"one"), ("cd2", b"")], "hash string, content binary"), root, "blobs")
    asked = spark.createDataFrame([(1, "ab1"), (2, "cd2"), (3, "zz"), (4, None), (5, "ab1")], "n int, hash string")
    got = {r["n"]: r["content"] for r in D.fetched(asked, root, "blobs").collect()}
    assert {k: v and bytes(v) for k, v in got.items()} == {1: b"one", 2: b"", 3: None, 4: None, 5: b"one"}
    listing = "\n".join(json.dumps(x) for x in ({"page_id": "p1", "ord": 0, "hash": "ab1", "tags": ["t"]}, {"page_id": "p2", "ord": 1, "hash": None}))
    D.put_files(spark.createDataFrame([("l1", listing.encode()), ("l2", b"")], "hash string, content binary"), root, "documents")
    docs = spark.createDataFrame([("d1", "l1"), ("d2", "l2"), ("d3", "l3")], "doc_id string, hash string")
    found = sorted(map(str, (tuple(r) for r in D.listings(docs, root).collect())))
    assert found == sorted(map(str, [("d1", "p1", 0, "ab1", ["t"], False), ("d1", "p2", 1, None, [], False), ("d3", None, None, None, [], True)]))
    assert D.read_entries(spark, root).count() == 0


def test_blobs_of_an_earlier_generation_are_not_written_again(spark, tmp_path):
    root, kinds = f"file://{tmp_path}", "hash string, content binary"
    D.put_files(spark.createDataFrame([("ab1", b"one"), ("cd2", b"")], kinds), root, "blobs")
    before = (tmp_path / "blobs/ab/ab1").stat()
    D.put_files(spark.createDataFrame([("ab1", b"one"), ("ef3", b"three")], kinds), root, "blobs")
    after = (tmp_path / "blobs/ab/ab1").stat()
    assert (after.st_ino, after.st_mtime_ns) == (before.st_ino, before.st_mtime_ns)
    assert sorted((p.name, p.read_bytes()) for p in tmp_path.glob("blobs/*/*")) == [("ab1", b"one"), ("cd2", b""), ("ef3", b"three")]
    (tmp_path / "blobs/99/99x").mkdir(parents=True)
    with pytest.raises(Exception, match="99x"):  # a folder is no blob
        D.put_files(spark.createDataFrame([("99x", b"?")], kinds), root, "blobs")
