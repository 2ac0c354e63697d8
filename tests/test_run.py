import hashlib
import json
from pathlib import Path

import pytest
from annolake.sources import device as D
from annolake.sources import vault as V
from annolake.streaming import run as R
from annolake.streaming.ledger import Ledger
from pyspark.sql import functions as F


def hashed(content):
    return hashlib.sha256(content).hexdigest()


class Desk:
    """A device, a vault and a state in one folder."""

    def __init__(self, spark, path):
        self.spark, self.path = spark, path
        self.device, self.vault, self.state = (f"file://{path}/{n}" for n in ("device", "vault", "state"))
        self.folders, self.docs = {}, {}

    def put(self):
        """docs: id -> (name, parent, tags, {page: (text, tags)}); folders: id -> (parent, tags)."""
        blobs, lists, entries = {}, {}, []
        for i, (name, parent, tags, pages) in self.docs.items():
            rows = []
            for n, (page, (text, page_tags)) in enumerate(pages.items()):
                h = hashed(text.encode())
                blobs[h] = text.encode()
                rows.append({"page_id": page, "ord": n, "hash": h, "tags": page_tags})
            listing = "\n".join(map(json.dumps, rows)).encode()
            h = hashed(listing + i.encode())
            lists[h] = listing
            entries.append((i, h, name, "DocumentType", parent, tags))
        entries += [(i, "f", i, "CollectionType", parent, tags) for i, (parent, tags) in self.folders.items()]
        for folder, files in (("blobs", blobs), ("documents", lists)):
            D.put_files(self.spark.createDataFrame(list(files.items()), "hash string, content binary"), self.device, folder)
        D.put_generation(self.spark.createDataFrame(entries, "doc_id string, hash string, name string, type string, parent string, tags array<string>"), self.device, 8)

    def run(self, mapping, read=None, **more):
        def plain(pages):
            return pages.select("doc_id", "page_id", F.lit("ok").alias("status"), F.col("content").cast("string").alias("text"), F.col("content").alias("attachment"))

        done = R.run(self.spark, self.device, self.vault, self.state, self.spark.createDataFrame(list(mapping.items()), "tag string, folder string"), read or plain, buckets=8, **more)
        actions = {} if done.plan is None else {r["sync_key"]: r["action"] for r in done.plan.collect()}
        pages = set() if done.read is None else {(r["doc_id"], r["page_id"]) for r in done.read.collect()}
        warned = [] if done.warnings is None else [r["doc_id"] for r in done.warnings.collect()]
        done.forget()
        return actions, pages, warned

    def notes(self):
        root = Path(self.path) / "vault"
        return {str(p.relative_to(root)): p.read_text() for p in root.rglob("*") if p.is_file() and V.OWN not in p.parts}

    def rows(self):
        ledger = Ledger(self.spark, self.state, R.ROWS, "doc_id", 8)
        return {r["sync_key"]: r for r in ledger.read(ledger.latest()).collect()}


@pytest.fixture()
def desk(spark, tmp_path):
    d = Desk(spark, tmp_path)
    d.folders = {"f": ("", ["T1"])}
    d.docs = {
        "A": ("Alpha", "", ["T1"], {"a1": ("first", []), "a2": ("second", ["T2"])}), "B": ("Beta", "", [], {"b1": ("bee", ["T2"]), "b2": ("buzz", [])}), "C": ("Gamma", "f", [], {"c1": ("sea", [])}), "X": ("None", "", ["other"], {"x1": ("x", ["other"])}),
    }
    d.put()
    return d


ONE = {"T1": "Work", "T2": "Pages"}


def test_levels_are_compared_and_only_what_changed_is_read(desk):
    actions, pages, warned = desk.run(ONE)
    assert actions == {"A:T1": "write", "A:a2:T2": "write", "B:b1:T2": "write", "C:T1": "write"} and not warned
    assert pages == {("A", "a1"), ("A", "a2"), ("B", "b1"), ("C", "c1")}
    notes = desk.notes()
    assert set(notes) == {"Work/Alpha.md", "Work/Gamma.md", "Pages/Alpha — Page 2.md", "Pages/Beta — Page 1.md", "attachments/A.pdf", "attachments/A-a2.pdf", "attachments/B-b1.pdf", "attachments/C.pdf"}
    assert "first" in notes["Work/Alpha.md"] and "second" in notes["Work/Alpha.md"] and notes["attachments/A.pdf"] == "firstsecond" and "![[attachments/B-b1.pdf]]" in notes["Pages/Beta — Page 1.md"]
    assert desk.run(ONE) == ({}, set(), [])  # the root is the same: nothing is opened
    desk.docs["A"][3]["a1"] = ("first again", [])
    desk.docs["B"][3]["b2"] = ("not tagged", [])
    desk.put()
    actions, pages, _ = desk.run(ONE)
    assert actions == {"A:T1": "rewrite", "A:a2:T2": "skip", "B:b1:T2": "skip"} and pages == {("A", "a1"), ("A", "a2")}
    assert "first again" in desk.notes()["Work/Alpha.md"] and len(desk.notes()) == 8
    rows = desk.rows()
    assert len({rows[k]["entry_hash"] for k in ("A:T1", "A:a2:T2")}) == 1  # bumped where nothing was written
    assert desk.run(ONE) == ({}, set(), [])


def test_folders_renames_orphans_and_lost_notes(desk):
    desk.run(ONE)
    actions, pages, _ = desk.run({"T1": "Elsewhere", "T2": "Pages"})  # nothing changed on the device
    assert {k: v for k, v in actions.items() if v != "skip"} == {"A:T1": "move", "C:T1": "move"} and {"Elsewhere/Alpha.md", "Elsewhere/Gamma.md"} <= set(desk.notes()) and "Work/Alpha.md" not in desk.notes()
    (Path(desk.path) / "vault/Pages/Beta — Page 1.md").unlink()
    actions, pages, _ = desk.run({"T1": "Elsewhere", "T2": "Pages"})
    assert actions == {"B:b1:T2": "rewrite"} and "Pages/Beta — Page 1.md" in desk.notes()
    desk.docs["B"][3]["b1"] = ("bee", ["T1"])  # a page's tag was renamed
    del desk.docs["C"]
    desk.put()
    actions, _, _ = desk.run({"T1": "Elsewhere", "T2": "Pages"})
    assert actions == {"B:b1:T1": "move", "C:T1": "orphan"} and "Elsewhere/Beta — Page 1.md" in desk.notes() and "Pages/Beta — Page 1.md" not in desk.notes()
    rows = desk.rows()
    assert rows["C:T1"]["status"] == "orphaned" and "B:b1:T2" not in rows and "Elsewhere/Gamma.md" in desk.notes()
    desk.folders["f"] = ("", [])
    desk.docs["C"] = ("Gamma", "", ["T1"], {"c1": ("sea", [])})
    desk.put()
    actions, _, _ = desk.run({"T1": "Elsewhere", "T2": "Pages"})
    assert actions["C:T1"] == "rewrite" and desk.rows()["C:T1"]["status"] == "active" and desk.notes()["attachments/C.pdf"] == "sea"
    assert desk.run({"T2": "Pages"})[0] == {"A:T1": "orphan", "A:a2:T2": "skip", "B:b1:T1": "orphan", "C:T1": "orphan"}


def test_edited_notes_are_left_alone_and_own_text_stays(desk):
    desk.run(ONE)
    alpha, gamma = (Path(desk.path) / "vault/Work" / n for n in ("Alpha.md", "Gamma.md"))
    alpha.write_text(alpha.read_text().replace("first", "corrected"))
    gamma.write_text("---\nkey: 1\n---\n" + gamma.read_text() + "my own words\n")
    desk.docs["A"][3]["a1"] = ("changed", [])
    desk.docs["C"][3]["c1"] = ("changed too", [])
    desk.put()
    for _ in range(2):  # the row keeps its old hash, so it is looked at again when something changes
        actions, _, _ = desk.run(ONE, render_version=31)
        if actions:
            assert actions["A:T1"] == "edited"
    assert "corrected" in alpha.read_text() and "changed" not in alpha.read_text()
    text = gamma.read_text()
    assert text.startswith("---\nkey: 1\n---\n") and text.endswith("my own words\n") and "changed too" in text and "sea" not in text
    alpha.write_text(alpha.read_text().replace("corrected", "first"))  # taken back; A does not change, but something else does
    desk.docs["X"][3]["x1"] = ("y", [])
    desk.put()
    assert desk.run(ONE, render_version=31)[0]["A:T1"] == "rewrite" and "changed" in alpha.read_text()


def test_a_run_that_was_stopped_is_finished_by_its_plan(desk):
    def failing(pages):
        raise RuntimeError("stopped")

    with pytest.raises(RuntimeError):
        desk.run(ONE, failing)
    (Path(desk.path) / "vault/Work").mkdir(parents=True)
    desk.docs["N"] = ("New", "", ["T1"], {"n1": ("new", [])})
    desk.put()  # the device goes on meanwhile
    actions, _, _ = desk.run(ONE)
    assert "N:T1" not in actions and len(actions) == 4
    assert desk.run(ONE)[0] == {"N:T1": "write"}
    assert desk.run(ONE)[0] == {} and len([n for n in desk.notes() if n.endswith(".md")]) == 5


def test_a_document_that_cannot_be_read_is_named_and_skipped(desk):
    store = V.Store(desk.device)
    listing = D.read_entries(desk.spark, desk.device).where("doc_id = 'B'").first()["hash"]
    store.fs.delete_file(store.at(f"documents/{listing[:2]}/{listing}"))
    actions, _, warned = desk.run(ONE)
    assert warned == ["B"] and set(actions) == {"A:T1", "A:a2:T2", "C:T1"}
    desk.docs["X"][3]["x1"] = ("y", [])
    desk.put()  # the listing is there again
    assert desk.run(ONE)[0] == {"B:b1:T2": "write"}


def test_the_number_of_buckets_is_part_of_the_state(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}", "k string, n int", "k", 4)
    ledger.commit(0, ledger.latest(), spark.createDataFrame([("a", 1)], "k string, n int"), [ledger.bucket_of("a")], {"x": 1})
    assert ledger.latest().meta == {"x": 1} and [tuple(r) for r in ledger.read(ledger.latest()).collect()] == [("a", 1)]
    with pytest.raises(ValueError, match="4 buckets"):
        Ledger(spark, f"file://{tmp_path}", "k string, n int", "k", 8).latest()


def test_a_backfill_stopped_anywhere_ends_like_an_unbroken_one(desk):
    from annolake.streaming.backfill import transcribe_again

    def again(pages):
        return pages.select("doc_id", "page_id", F.lit("ok").alias("status"), F.upper(F.col("content").cast("string")).alias("text"), F.col("content").alias("attachment"))

    desk.run(ONE)
    gamma = Path(desk.path) / "vault/Work/Gamma.md"
    gamma.write_text(gamma.read_text() + "my own words\n")
    before = desk.notes()
    calls = iter([False, True])
    assert transcribe_again(desk.spark, desk.device, desk.vault, desk.state, again, "b", 1, lambda: next(calls)) == (1, True)
    part = desk.notes()
    assert sum(part[n] != before[n] for n in part) == 1 and desk.run(ONE)[0] == {}

    class Lost(Exception):
        pass

    def losing(pages):
        raise Lost

    with pytest.raises(Lost):
        transcribe_again(desk.spark, desk.device, desk.vault, desk.state, losing, "b", 1)
    shown = []
    assert transcribe_again(desk.spark, desk.device, desk.vault, desk.state, again, "b", 1, report=lambda done, total: shown.append((done, total))) == (4, False)
    assert shown == sorted(shown) and shown[-1] == (5, 5) and len({total for _, total in shown}) == 1
    assert transcribe_again(desk.spark, desk.device, desk.vault, desk.state, losing, "b", 1) == (4, False)  # all is done
    after = desk.notes()
    assert after["Work/Alpha.md"] == before["Work/Alpha.md"].replace("first", "FIRST").replace("second", "SECOND") and after["Work/Gamma.md"] == before["Work/Gamma.md"].replace("sea", "SEA")
    assert all(after[n] == before[n] for n in after if n.startswith("attachments/"))
    desk.docs["X"][3]["x1"] = ("y", [])
    desk.put()
    assert desk.run(ONE, render_version=31)[0] == {"A:T1": "rewrite", "A:a2:T2": "rewrite", "B:b1:T2": "rewrite", "C:T1": "rewrite"}  # nothing counts as edited


def test_progress_after_a_failed_and_repeated_task(tmp_path):
    import os
    import subprocess
    import sys
    import textwrap

    script = """
        from pyspark import TaskContext
        from pyspark.sql import SparkSession, functions as F
        from annolake.streaming.progress import Ticker
        spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").getOrCreate()

        def shaky(batches):
            yield from batches
            if TaskContext.get().attemptNumber() < 2 and TaskContext.get().partitionId() == 1:
                raise RuntimeError("lost")

        shown = []
        ticker = Ticker(40, lambda done, total: shown.append((done, total)))
        rows = spark.range(0, 20, 1, 4).mapInArrow(shaky, "id long")
        ticker.watched(rows, F.lit(1)).write.format("noop").mode("overwrite").save()
        ticker.finish(20)
        ticker.watched(spark.range(5), F.lit(1)).write.format("noop").mode("overwrite").save()
        ticker.finish(20)
        print(shown)
        """
    env = os.environ | {"PYTHONPATH": os.pathsep.join([str(Path(V.__file__).resolve().parents[2]), os.environ.get("PYTHONPATH", "")])}
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(script)], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and "lost" in done.stderr, done.stderr[-2000:]
    assert done.stdout.strip().splitlines()[-1] == "[(20, 40), (25, 40), (40, 40)]"
