import __spark_entry__


def test_flagship_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert len(queries) > 50 and set(sql) <= set(queries)


def test_the_rest_needs_nothing_of_the_training_data_operators():
    import pathlib

    root = pathlib.Path(__spark_entry__.__file__).parent / "annolake"
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert "annolake.llm" not in path.read_text()
