"""Files are renamed by many tasks, however few bytes their names have."""

from annolake.operators.moves import move_notes, move_plan
from annolake.sources import vault as V


def tasks(spark, group, run):
    """The most tasks of any stage of what is run."""
    sc = spark.sparkContext
    sc.setJobGroup(group, group)
    run()
    sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    return max(i.numTasks for s in stages if (i := tracker.getStageInfo(s)))


def test_files_are_put_in_place_and_moved_by_many_tasks(spark, tmp_path):
    root, n = f"file://{tmp_path}", 600
    notes = spark.createDataFrame([(f"a/{i}.md", str(i).encode()) for i in range(n)], "path string, content binary").coalesce(1)
    assert tasks(spark, "put", lambda: V.write_files(notes, root)) >= 8
    moves = spark.createDataFrame([(f"a/{i}.md", f"b/{i // 2}/{i}.md" if i >= n - 2 else f"a/{i + 2}.md") for i in range(n)], "src string, dst string").coalesce(1)
    plan = move_plan(moves, V.vault_paths(spark, root), cut=64)
    assert tasks(spark, "move", lambda: move_notes(plan, root, "all")) >= 8
    told = {r.path: bytes(r.content) for r in V.read_vault(spark, root).collect()}
    assert told == {(f"b/{i // 2}/{i}.md" if i >= n - 2 else f"a/{i + 2}.md"): str(i).encode() for i in range(n)}
