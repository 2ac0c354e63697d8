import hashlib
import os
import random
import subprocess
import sys
import textwrap
from pathlib import Path

import pytest
from annolake.operators.moves import move_notes, move_plan
from annolake.sources import vault as V
from pyspark.sql import functions as F


def frame(spark, files):
    return spark.createDataFrame([(p, c, 0) for p, c in files], "path string, content binary, size int")


def held(root):
    return {str(p.relative_to(root)): p.read_bytes() for p in Path(root).rglob("*") if p.is_file() and V.OWN not in p.parts}


def test_files_are_put_and_read(spark, tmp_path):
    root = f"file://{tmp_path}"
    files = [("Work/a.md", b"one"), ("Work/deep/er/b.md", b""), ("c d é.md", None), ("Work/big.bin", os.urandom(300_000))]
    V.write_files(frame(spark, files).repartition(3), root)
    want = {p: c or b"" for p, c in files}
    assert held(tmp_path) == want and not list((tmp_path / V.OWN).iterdir())
    V.write_files(frame(spark, [("Work/a.md", b"two")]), root)  # in place
    V.write_files(frame(spark, []), root)
    want["Work/a.md"] = b"two"
    read = V.read_vault(spark, root)
    assert {r["path"]: bytes(r["content"]) for r in read.collect()} == want
    for condition in ("path = 'Work/a.md'", "path IN ('Work/a.md', 'none', 'c d é.md')", "path LIKE 'Work/%'", "path LIKE 'Work/de%' AND length(content) = 0", "path = 'Work'", "path LIKE '../%'", "path LIKE '/%'", "path = '../x'", "path LIKE '.vault/%'", "path LIKE '%.md'"):
        rows = spark.createDataFrame([(p, c) for p, c in want.items()], "path string, content binary").where(condition)
        assert sorted(map(tuple, read.where(condition).collect())) == sorted(map(tuple, rows.collect())), condition


def test_pushed_filters_show_in_the_plan_and_limit_what_is_opened(spark, tmp_path):
    for i in range(20):
        (tmp_path / f"f{i}").mkdir()
        (tmp_path / f"f{i}" / "n.md").write_bytes(b"x")
    reader = V.VaultReader(f"file://{tmp_path}")
    assert list(reader.pushFilters([V.EqualTo(("path",), "f3/n.md")])) == [] and [p.files for p in reader.partitions()] == [("f3/n.md",)]
    wide = V.VaultReader(f"file://{tmp_path}")
    assert len(wide.partitions()) == 21 and list(wide.pushFilters([V.StringStartsWith(("path",), "f1")])) == []
    assert {p.folder for p in wide.partitions()} == {"", "f1", *(f"f{i}" for i in range(10, 20))}
    plan = V.read_vault(spark, f"file://{tmp_path}").where("path = 'f3/n.md'")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PushedFilters" in plan and "f3/n.md" in plan.split("PushedFilters")[1].split("\n")[0]


@pytest.mark.parametrize("path", ["../x", "/x", "a//b", "", None, ".vault/x", "a/./b", "a/.."])
def test_paths_stay_inside(path):
    with pytest.raises(ValueError):
        V.checked(path)


def test_a_write_that_fails_changes_nothing(spark, tmp_path):
    root = f"file://{tmp_path}"
    V.write_files(frame(spark, [("a.md", b"old")]), root)
    with pytest.raises(Exception, match="not a path"):
        V.write_files(frame(spark, [("a.md", b"new"), ("b.md", b"new"), ("../c.md", b"new")]).repartition(3), root)
    with pytest.raises(ValueError, match="two files"):
        V.write_files(frame(spark, [("a.md", b"new"), ("a.md", b"newer")]).repartition(2), root)
    with pytest.raises(ValueError, match="append"):
        V.Vault({"path": root, "run": "x"}).writer(None, True)
    assert held(tmp_path) == {"a.md": b"old"} and not list((tmp_path / V.OWN).iterdir())


def test_a_write_that_was_stopped_is_finished_once(spark, tmp_path):
    """Attempts that are not in the commit count for nothing; renames that were done already are not done again."""
    root, store = f"file://{tmp_path}", V.Store(str(tmp_path))
    writer = V.VaultWriter(root, "run-1")
    batch = V.pa.record_batch({"path": ["x/1.md", "x/2.md"], "content": V.pa.array([b"1", b"2"], V.pa.binary())})
    lost, kept = writer.write(iter([batch.slice(0, 1)])), writer.write(iter([batch]))
    assert V.publish(spark, root) == 0 and held(tmp_path) == {}
    writer.commit([kept, None])
    store.move(f"{V.OWN}/run-1/{kept.attempt}/0", "x/1.md")  # then everything stopped
    assert V.publish(spark, root) == 1 and V.publish(spark, root) == 0
    assert held(tmp_path) == {"x/1.md": b"1", "x/2.md": b"2"} and lost.attempt != kept.attempt


def test_a_task_that_fails_and_is_repeated_leaves_each_file_once_and_whole(tmp_path):
    script = f"""
        from pyspark import TaskContext
        from pyspark.sql import SparkSession, functions as F
        from annolake.sources import vault as V
        spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").getOrCreate()

        def shaky(batches):
            for i, batch in enumerate(batches):
                yield batch
            if TaskContext.get().attemptNumber() < 2 and TaskContext.get().partitionId() % 2:
                raise RuntimeError("lost")

        rows = spark.range(0, 200, 1, 4).select(F.concat(F.lit("n/"), F.col("id") % 7, F.lit("/"), F.col("id"), F.lit(".md")).alias("path"), F.repeat(F.col("id").cast("string"), 5000).cast("binary").alias("content"))
        V.write_files(rows.mapInArrow(shaky, rows.schema), "file://{tmp_path}")
        """
    env = os.environ | {"PYTHONPATH": os.pathsep.join([str(Path(V.__file__).resolve().parents[2]), os.environ.get("PYTHONPATH", "")])}
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(script)], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
    assert "lost" in done.stderr
    assert held(tmp_path) == {f"n/{i % 7}/{i}.md": str(i).encode() * 5000 for i in range(200)} and not list((tmp_path / V.OWN).iterdir())


def moved(spark, root, moves, cut, run="r"):
    existing = V.read_vault(spark, root).select("path")
    plan = move_plan(spark.createDataFrame(moves, "src string, dst string"), existing, cut)
    move_notes(plan, root, run)
    return plan


def test_a_permutation_of_paths_loses_no_note(spark, tmp_path):
    r = random.Random(4)
    paths = [f"d{i % 5}/n{i}.md" for i in range(60)]
    V.write_files(frame(spark, [(p, p.encode()) for p in paths]), f"file://{tmp_path}")
    targets = [*paths[:45], *(f"new/{i}.md" for i in range(9)), *paths[54:]]
    r.shuffle(targets)
    moves = [(p, t) for p, t in zip(paths, targets, strict=True)]
    goes = dict(moves)
    while bad := {p for p, t in goes.items() if t in paths and t not in goes}:  # to a note that stays
        goes = {p: t for p, t in goes.items() if p not in bad}
    plan = moved(spark, f"file://{tmp_path}", [*goes.items(), ("gone.md", "x/y.md")], 4)
    assert held(tmp_path) == {goes.get(p, p): p.encode() for p in paths}
    rows = plan.collect()
    assert max(x["step"] for x in rows) >= 4 and max(sum(y["chain"] == x["chain"] and y["piece"] == x["piece"] for y in rows) for x in rows) <= 4
    move_notes(plan, f"file://{tmp_path}", "r")  # again: nothing happens
    assert held(tmp_path) == {goes.get(p, p): p.encode() for p in paths}


@pytest.mark.parametrize("stop", range(0, 14))
def test_a_move_that_was_stopped_goes_on(spark, tmp_path, monkeypatch, stop):
    """After any number of renames: the same end as that of an unbroken run."""
    ring, chain = [f"r{i}.md" for i in range(5)], [f"c{i}.md" for i in range(5)]
    for p in [*ring, *chain]:
        (tmp_path / p).write_bytes(p.encode())
    moves = [*zip(ring, [*ring[1:], ring[0]], strict=True), *zip(chain, [*chain[1:], "free.md"], strict=True)]
    global _plan
    if stop == 0:
        existing = spark.createDataFrame([(p,) for p in [*ring, *chain]], "path string")
        _plan = move_plan(spark.createDataFrame(moves, "src string, dst string"), existing, 3)
    # the steps as tasks would take them, stopped after so many renames
    left = [stop]
    plain = V.Store.move

    class Stopped(Exception):
        pass

    def counted(self, a, b):
        if not left[0]:
            raise Stopped
        left[0] -= 1
        plain(self, a, b)

    rows = _plan.collect()

    class Local:
        """A plan whose steps run here."""

        def __init__(self, own):
            self.own = own

        def where(self, _):
            return Local([x for x in self.own if x["via"]])

        def select(self, *_):
            return self

        def groupBy(self, *_):
            return self

        def mapInArrow(self, f, _):
            table = V.pa.Table.from_pylist([x.asDict() for x in self.own])
            return Job(lambda: list(f(iter(table.to_batches()))))

        def applyInArrow(self, f, _):
            groups = {}
            for x in self.own:
                groups.setdefault((x["chain"], x["piece"]), []).append(x.asDict())
            return Job(lambda: [f(V.pa.Table.from_pylist(g)) for _, g in sorted(groups.items())])

    class Job:
        def __init__(self, run):
            self.agg, self.collect = lambda *_: self, run

    monkeypatch.setattr(V.Store, "move", counted)
    try:
        move_notes(Local(rows), str(tmp_path), "r")
    except Stopped:
        pass
    monkeypatch.setattr(V.Store, "move", plain)
    move_notes(Local(rows), str(tmp_path), "r")
    assert held(tmp_path) == {d: s.encode() for s, d in moves}


def test_moves_that_clash_are_refused(spark, tmp_path):
    for p in ("a", "b", "c"):
        (tmp_path / p).write_bytes(p.encode())
    for moves in ([("a", "x"), ("b", "x")], [("a", "x"), ("a", "y")], [("a", "b")]):
        with pytest.raises(ValueError):
            moved(spark, f"file://{tmp_path}", moves, 3)
    moved(spark, f"file://{tmp_path}", [("a", "a"), ("none", "b")], 3)
    assert held(tmp_path) == {p: p.encode() for p in "abc"}


def test_digests_of_a_vault(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "n.md").write_bytes(b"abc")
    got = V.read_vault(spark, f"file://{tmp_path}").select("path", F.sha2("content", 256)).collect()
    assert got[0][1] == hashlib.sha256(b"abc").hexdigest()
