"""Every query of the engine's own operators against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import math
from datetime import date, datetime
from decimal import Decimal

import duckdb
import pytest

from tessera.plans.catalogue import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def database(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (int, float, Decimal)):
        return "None" if math.isnan(value) else repr(float(value))
    if isinstance(value, datetime):
        return value.isoformat()
    return value.isoformat() if isinstance(value, date) else str(value)


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([plain(r[i]) for i in order] for r in found)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(name, spark, sf_dir, database):
    df = QUERIES[name](spark, sf_dir)
    cursor = database.execute(ORACLE[name])
    names = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_planted_break(spark, sf_dir):
    """The last point before the break of the planted series is a changepoint, and no series has one that is not of its months."""
    from tessera.plans.reports import BREAK

    before = date(BREAK.year, BREAK.month - 1, 1)
    found = [(r.series, r.month) for r in QUERIES["Q26_series_changepoints"](spark, sf_dir).collect()]
    assert [m for s, m in found if s == "step"] == [before]
    near = {(r.series, r.month): r.days for r in QUERIES["Q29_ruptures_against_bounds"](spark, sf_dir).collect()}
    assert set(near) == set(found) and near["step", before] == (date(1999, 1, 1) - before).days


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 4


def test_phase_filter_reaches_the_scan(spark, sf_dir):
    plan = QUERIES["P11_in_phase"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThanOrEqual(ts" in plan


def test_only_two_columns_are_read(spark, sf_dir):
    plan = QUERIES["W4_share"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_returnflag:string,l_linestatus:string>" in plan
