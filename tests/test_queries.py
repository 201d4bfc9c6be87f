"""Each query against its SQL, and the contract of the entry module."""

import pytest

import __spark_entry__ as entry
from spanveil.plans import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_agrees_with_sql(spark, duck, sf_dir, same, name):
    same(queries.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(queries.ORACLE_SQL[name]).df())


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "source", "n_entities", "sanitized"]
    assert df.count() > 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_library_does_not_import_the_data_operators():
    import pathlib

    root = pathlib.Path(queries.__file__).parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert "spanveil.llm" not in path.read_text(), path
