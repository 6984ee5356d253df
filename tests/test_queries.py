import pytest

from rasterloom import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, data_dir, same_rows, name):
    same_rows(queries.QUERIES[name](spark, data_dir), queries.ORACLES[name], data_dir)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_without_sql_gives_rows_twice_alike(spark, data_dir, name):
    first, again = (sorted(map(repr, queries.QUERIES[name](spark, data_dir).collect())) for _ in range(2))
    assert first and first == again


def test_entry_module_works_without_the_llm_folders():
    import __spark_entry__ as entry

    assert set(queries.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
