"""Every page's file is parsed once, whatever is asked of it, and small pages share batches."""

import pyarrow as pa
import pytest
from annolake.plans import scenes as P
from annolake.sources import scene_writer as E
from annolake.sources import scenes as S
from annolake.sources import vault as V


@pytest.mark.parametrize("query", ["scene_strokes", "scene_parts"])
def test_every_file_is_parsed_once(spark, monkeypatch, tmp_path, query):
    read, plain = spark.sparkContext.accumulator(0), S._batches

    def counted(batches):
        def told():
            for b in batches:
                read.add(b.num_rows)
                yield b

        return plain(told())

    monkeypatch.setattr(S, "_batches", counted)
    spark.range(40).selectExpr("id % 5 AS user_id", "id AS event_id", "double(id) AS value").write.parquet(str(tmp_path / "events.parquet"))
    spark.range(40).selectExpr("id % 5 AS conv_id", "id DIV 5 AS turn", "'user' AS role", "concat('t', id) AS text").write.parquet(str(tmp_path / "conversations.parquet"))
    told = getattr(P, query)(spark, str(tmp_path))
    assert {x.page_id.lstrip("c") for x in told.collect()} == set("01234")
    assert read.value == 5


def test_small_pages_share_a_batch():
    page = E.page([E.layer((0, 11), "a"), E.stroke((1, 1), (0, 11), 1, 1, 1.0, [(0, 0, 0, 0, 0, 0)])])
    made = list(S._batches(iter([pa.record_batch({"page_id": [str(i) for i in range(50)], "content": [page] * 50})])))
    assert len(made) == 1 and made[0].num_rows == 150


def test_files_are_spread_over_folders_and_listed_in_tasks(spark, monkeypatch, tmp_path):
    """Pages whose ids begin alike share no folder, as a task reads a folder; and the driver lists no files."""
    plain, paths = V.write_files, []

    def kept(pages, root, path):
        paths.extend(x.p for x in pages.select(path.alias("p")).collect())
        plain(pages, root, path)

    def listed(*_):
        raise AssertionError("files are listed on the driver")

    monkeypatch.setattr(V, "write_files", kept)
    monkeypatch.setattr(S, "scan", listed)
    spark.range(200).selectExpr("1000 + id % 100 AS conv_id", "id DIV 100 AS turn", "'user' AS role", "CASE WHEN id % 3 > 0 THEN concat('t', id) END AS text").write.parquet(str(tmp_path / "conversations.parquet"))
    told = P.scene_parts(spark, str(tmp_path)).collect()
    assert {x.page_id for x in told} == {f"c{1000 + i}" for i in range(100)} and {x.n_runs for x in told} == {2}
    assert len({p.split("/")[0] for p in paths}) > 50


def test_numbers_of_one_byte_and_more():
    for n in (0, 1, 127, 128, 300, 2**21, 2**32 - 1):
        assert S.varint(E.varint(n) + b"\x05", 0) == (n, len(E.varint(n)))
        assert S.entity(b"\x03" + E.varint(n), 0) == (f"3:{n}", (b"\x03" + E.varint(n)).hex(), 1 + len(E.varint(n)))
    for broken in (b"", b"\x03", b"\x03\x80"):
        with pytest.raises(S.BrokenBlock):
            S.entity(broken, 0)
    with pytest.raises(S.BrokenBlock):
        S.varint(b"\x80", 0)
