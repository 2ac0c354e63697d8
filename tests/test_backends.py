from annolake.operators import backends


def test_results_come_back_by_page(spark):
    pages = spark.createDataFrame([("a", b"x"), ("b", None), ("c", b"bad")], "page_id string, content binary")

    def read(content):
        if bytes(content) == b"bad":
            raise ValueError
        return "read"

    got = {r["page_id"]: (r["status"], r["text"]) for r in backends.recognised(pages, backends.per_page(read)).collect()}
    assert got == {"a": ("ok", "read"), "b": ("skipped", ""), "c": ("failed", "")}
    assert {r["status"] for r in backends.recognised(pages, backends.unavailable).collect()} == {"unavailable", "skipped"}


def test_registry():
    r = backends.Registry()
    r.register("off", backends.off)
    r.register("x", backends.off)
    r.register("x", backends.unavailable, True)
    assert r.names() == ["off", "x"] and r.get("x") is backends.unavailable and r.get("y") is None and r.others({"off"}) and not r.others({"off", "x"})


def test_inserted_lines(spark):
    lines = spark.createDataFrame([("p", 0, 90.0, "a"), ("p", 1, 50.0, "b"), ("p", 2, 10.0, "c")], "page_id string, ord int, center double, text string")
    extra = spark.createDataFrame([("p", 0, 60.0, "x"), ("p", 1, 5.0, "z"), ("p", 2, 55.0, "y")], "page_id string, ord int, center double, text string")
    got = backends.inserted_lines(lines, extra).orderBy("ord").collect()
    assert [r["text"] for r in got] == ["a", "x", "y", "b", "c", "z"]


def test_gates_and_fallbacks(spark):
    from pyspark.sql import functions as F

    def value(c):
        return spark.range(1).select(c.alias("v")).first()["v"]

    yes, no, gib = F.lit(True), F.lit(False), 1 << 30
    gates = [((no, yes, no, no), "auto-sync-off"), ((yes, yes, no, no), "already-running"), ((yes, no, no, no), "not-connected"), ((yes, no, yes, no), "no-background-consent"), ((yes, no, yes, yes), None)]
    assert [value(backends.background_blocked(*g)) for g, _ in gates] == [w for _, w in gates]
    assert value(backends.spend_blocked(yes, no)) == "no-consent-to-spend" and value(backends.spend_blocked(yes, yes)) is None and value(backends.spend_blocked(no, no)) is None
    machines = [("darwin", "arm64", 17 * gib, None), ("darwin", "arm64", 16 * gib, ("memory", 18, 16)), ("win32", "arm64", int(23.6 * gib), None), ("win32", "arm64", 18 * gib, ("memory", 24, 18)), ("darwin", "x64", 99 * gib, ("architecture", None, None)), ("linux", "arm64", 99 * gib, ("architecture", None, None))]
    for platform, arch, size, want in machines:
        got = value(backends.model_block(F.lit(platform), F.lit(arch), F.lit(size)))
        assert (got and tuple(got)) == want
    assert tuple(value(backends.unconfigured_fallback(F.lit("X"), no, no))) == ("unavailable", None)
    assert value(backends.gated_fallback(F.lit("X"), no, no))["use"] == "unavailable" and value(backends.gated_fallback(F.lit("X"), yes, yes))["notice"] is None
    assert value(backends.is_gated(yes, F.lit("free"))) and not value(backends.is_gated(yes, F.lit("trial")))


def test_model_states_and_cleanup(spark):
    from pyspark.sql import functions as F

    schema = "corrupt boolean, part_present boolean, lock_held_at_ms long, now_ms long, model_bytes long, mmproj_bytes long, verified_present boolean, runtime_present boolean"
    rows = [
        ((True, True, None, 100, 5, 5, True, True), "corrupt"), ((False, True, 90, 100, 5, 5, True, True), "downloading"), ((False, True, 500_000, 100, None, None, False, True), "downloading"),
        ((False, True, 0, 60_000, 5, 5, True, True), "partial"), ((False, True, None, 100, 5, 5, True, True), "partial"), ((False, False, 99, 100, 5, None, True, True), "absent"),
        ((False, False, None, 100, 4, 5, False, True), "verifying"), ((False, False, None, 100, 4, 5, True, True), "absent"), ((False, False, None, 100, 5, 5, True, False), "removed"), ((False, False, 99, 100, 5, 5, True, True), "ready"),
    ]
    for row, want in rows:
        assert spark.createDataFrame([row], schema).select(backends.model_state(F.struct("*"), 5, 5).alias("s")).first()["s"] == want
    folders = spark.createDataFrame([("v3", True, True), ("v2", True, False), ("v1", False, True), ("other", False, False)], "name string, complete boolean, has_part boolean")
    assert {x["name"]: x["action"] for x in backends.cleanup_plan(folders, "v3").collect()} == {"v3": "keep", "v2": "offer", "v1": "delete", "other": "keep"}


def test_licences(spark):
    from annolake.operators import incremental
    from pyspark.sql import functions as F

    schema = "key string, activation_id string, validated_at string, revoked_at string, trial_started_at string, ended_notice_shown boolean"
    day, now = 86_400_000, 1_709_251_200_000  # 2024-03-01
    rows = [
        ((None, None, None, None, None, False), ("free", "never-bought"), "none"), (("k", None, None, None, None, False), ("free", "not-activated"), "activate"),
        (("k", "a", "2024-02-28T00:00:00Z", None, None, False), ("pro", None, False), "none"), (("k", "a", "2024-01-20T00:00:00.000Z", None, None, False), ("pro", None, True), "validate"),
        (("k", "a", "2024-02-23T00:00:00Z", None, None, False), ("pro", None, False), "validate"), (("k", "a", "soon", None, "2024-02-20T00:00:00Z", False), ("trial", None), "validate"),
        ((None, None, None, None, "2024-02-16T00:00:00Z", False), ("free", "trial-ended"), "none"), (("k", "a", "2024-02-28T00:00:00Z", "2024-02-29T00:00:00Z", None, True), ("free", "revoked"), "none"),
    ]
    for row, want, call in rows:
        frame = spark.createDataFrame([row], schema)
        got = frame.select(incremental.entitlement(F.struct("*"), F.lit(now)).alias("e"), incremental.next_call(F.struct("*"), F.lit(now)).alias("c")).first()
        assert (got["e"]["tier"], got["e"]["reason"], got["e"]["stale"])[: len(want)] == want and got["c"] == call
        if want[0] == "trial":
            assert got["e"]["ends_at"] == now + 4 * day
    frame = spark.createDataFrame([rows[-1][0]], schema)
    after = {o: tuple(frame.select(incremental.licence_after(F.struct("*"), F.lit(o), F.lit("now")).alias("s")).first()["s"]) for o in ("valid", "withdrawn", "unknown-activation", "unreachable")}
    assert after["valid"] == ("k", "a", "now", None, None, False) and after["withdrawn"][3] == "now" and after["unknown-activation"][1] is None and after["unreachable"] == rows[-1][0]


def test_sources_that_nothing_can_be_drawn_on(spark):
    from annolake.operators import units

    rows = [("a", b"x", 2), ("b", b"", 2), ("c", None, 2), ("d", b"x", 0), ("e", b"x", None)]
    good, bad = units.guarded(spark.createDataFrame(rows, "doc_id string, content binary, n_pages int"))
    assert [r["doc_id"] for r in good.collect()] == ["a"]
    assert {r["doc_id"]: r["error"] for r in bad.collect()} == {"b": "the source is empty", "c": "the source is empty", "d": "the source has no pages", "e": "the source has no pages"}
    pages = spark.createDataFrame([("a", 3, False), ("a", 1, None), ("a", 3, False), ("a", 2, True), ("b", None, False)], "doc_id string, source_index int, appended boolean")
    assert {r["doc_id"]: r["source_pages"] for r in units.source_pages(pages).collect()} == {"a": [1, 3], "b": []}


def test_tag_names_of_names_and_objects(spark):
    from annolake.operators import units

    given = ['["a", "{b", "{\\"name\\":\\"c\\"}"]', '[{"name": "d", "timestamp": 1}, {"name": "{e}"}]', "[]", None, "no list"]
    rows = spark.createDataFrame(list(enumerate(given)), "n int, tags string")
    got = {r["n"]: r["names"] for r in rows.select("n", units.tag_names(rows.tags).alias("names")).collect()}
    assert got == {0: ["a", "{b", '{"name":"c"}'], 1: ["d", "{e}"], 2: [], 3: [], 4: []}
