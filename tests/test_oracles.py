"""Every query with SQL: the same rows from Spark and DuckDB."""

import duckdb
import pytest

from cambium.plans import registry

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(columns, table):
    show = lambda v: "\0" if v is None else repr(v + 0.0) if isinstance(v, float) else repr(v)
    return sorted(tuple(show(r[c]) for c in columns) for r in table)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, sf_dir, name):
    sql = registry.oracle_sql()[name]
    got = registry.queries()[name](spark, sf_dir)
    want = duck.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    want_rows = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
    assert rows(columns, [r.asDict() for r in got.collect()]) == rows(columns, want_rows)


@pytest.mark.parametrize("name, most", [("validated_rings", 6), ("chronology_tbrm", 6), ("changed_exclusions", 8), ("site_countries", 3)])
def test_plans_read_little(spark, sf_dir, name, most):
    """What is used several times is written once: few scans are left in the plan, and no nested loop."""
    plan = registry.queries()[name](spark, sf_dir)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("FileScan parquet") <= most
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())
