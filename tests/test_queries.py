"""Every query of the core against its SQL in DuckDB at the smallest scale."""

import duckdb
import pytest

from seqframe.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    result = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    assert found == sorted((tuple(r[names.index(c)] for c in columns) for r in result.fetchall()), key=str)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_no_python_but_in_the_reader(spark):
    for name in ("sam_mapq_accuracy", "reorder_by_sequence", "reorder_mates", "read_stats"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_misnamed_files_are_told_by_content(spark):
    """The files of `bare_lines` are compressed and named as if they weren't, so the reader by content takes them."""
    plan = QUERIES["bare_lines"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "lines_by_content" in plan
