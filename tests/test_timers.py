import datetime as dt

import pytest
from annolake.streaming import timers

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "key string, at timestamp, ord int, kind string, bytes long, hours double"


class Clock:
    """Events in files: each batch is one, and the watermark follows the latest event of the batch before."""

    def __init__(self, spark, path, make):
        self.spark, self.path, self.make, self.n = spark, path, make, 0

    def batch(self, *events):
        rows = [(k, T0 + dt.timedelta(seconds=s), i, kind, more.get("bytes"), more.get("hours")) for i, (k, s, kind, more) in enumerate(events)]
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.path}/in")

    def run(self):
        """Runs over what is there, from where the last one stopped."""
        got = []
        frame = self.make(self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{self.path}/in"))
        query = frame.writeStream.foreachBatch(lambda b, _: got.extend(b.collect())).outputMode("append").option("checkpointLocation", f"file://{self.path}/check").trigger(availableNow=True).start()
        query.awaitTermination(120)
        return [(r["key"], (r["at"] - T0).total_seconds(), r["action"]) for r in got]


@pytest.fixture(autouse=True)
def one_store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    yield
    spark.conf.set(name, before)


def test_back_off_doubles_starts_anew_on_progress_and_gives_up(spark, tmp_path):
    clock = Clock(spark, tmp_path, timers.retries)
    clock.batch(("a", 0, "failed", {"bytes": 0}), ("b", 0, "failed", {"bytes": 5}), ("c", 0, "failed", {"bytes": 1}))
    clock.batch(("z", 1.5, "done", {}))
    assert sorted(clock.run()) == [("a", 0, "wait"), ("b", 0, "wait"), ("b", 1, "retry"), ("c", 0, "wait"), ("c", 1, "retry"), ("z", 1.5, "done")]
    # started again: b's back-off is 2 s now, a moved on, c is called off before its timer
    clock.batch(("b", 2, "failed", {"bytes": 5}), ("a", 2.5, "failed", {"bytes": 7}), ("c", 2, "failed", {"bytes": 1}), ("c", 2.6, "cancelled", {}))
    clock.batch(("z", 3.7, "done", {}))
    first = clock.run()
    assert set(first) == {("b", 2, "wait"), ("a", 2.5, "wait"), ("c", 2, "wait"), ("c", 2.6, "cancelled"), ("z", 3.7, "done"), ("a", 3.5, "retry")}
    clock.batch(("z", 100, "done", {}))
    assert set(clock.run()) == {("b", 4, "retry"), ("z", 100, "done")}


def test_five_attempts_without_progress_are_enough(spark, tmp_path):
    clock = Clock(spark, tmp_path, timers.retries)
    clock.batch(*(("a", i, "failed", {"bytes": 0}) for i in range(6)), ("b", 9, "failed", {"bytes": 3}))
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")  # plays no part
    got = clock.run()
    spark.conf.set("spark.sql.session.timeZone", before)
    assert [x for x in got if x[0] == "a"][:5] == [("a", 0, "wait"), ("a", 1, "wait"), ("a", 2, "wait"), ("a", 3, "wait"), ("a", 4, "give-up")] and ("a", 5, "wait") in got


def test_intervals_are_armed_anew_by_runs_and_settings(spark, tmp_path):
    h = 3600
    clock = Clock(spark, tmp_path, timers.due_runs)
    clock.batch(("v", 0, "settings", {"hours": 2.0}), ("w", 0, "settings", {}), ("x", 0, "settings", {"hours": 1.0}))
    clock.batch(("v", 1.5 * h, "ran", {}))  # by hand: the next one is due two hours later
    assert clock.run() == [("x", h, "due")]
    clock.batch(("x", 1.6 * h, "settings", {"hours": 0.0}), ("y", 3.4 * h, "ran", {}))
    clock.batch(("y", 3.6 * h, "ran", {}))
    assert clock.run() == [("v", 3.5 * h, "due")]
    clock.batch(("y", 8 * h, "ran", {}))
    clock.batch(("y", 9 * h, "ran", {}))
    assert {x[0] for x in clock.run()} == {"v"}
