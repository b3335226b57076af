"""Folds over ordered groups and selection by rank, against plain versions; with one group of many distinct values."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import statistics, summaries
from tessera.operators.ordering import Ordered


def hot(n=6_000):
    """Two thirds of the rows are in one group; nulls among groups and values; many equal values."""
    rng = random.Random(1)
    return [(i, rng.choice(["hot", "hot", "hot", "hot", "b", "c", None, ""]), None if rng.random() < 0.02 else float(rng.choice([rng.randrange(40), rng.randrange(10**6), 7]))) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, g string, v double").repartition(7)


def groups(rows):
    out = {}
    for i, g, v in rows:
        if v is not None:
            out.setdefault(g, []).append((v, i))
    return {g: sorted(x) for g, x in out.items()}


def test_scan(spark):
    rows = [r for r in hot() if r[2] is not None]
    scanned = Ordered(frame(spark, rows), ["g"], ["v", "id"]).scan(place=("sum", None), upto=("sum", F.col("id")), most=("max", -F.col("id") * 1.0))
    scanned = scanned.scan(least=("min", F.col("place") * 0 - F.col("upto")), again=("sum", F.col("place")))
    got = {r.id: r for r in scanned.rows.collect()}
    assert len(got) == len(rows)
    for own in groups(rows).values():
        place, upto, most, least, again = 0, 0, -float("inf"), float("inf"), 0
        for _, i in own:
            place, upto, most = place + 1, upto + i, max(most, -float(i))
            least, again = min(least, -upto), again + place
            assert (got[i].place, got[i].upto, got[i].most, got[i].least, got[i].again) == (place, upto, most, least, again)


def test_scan_of_nothing(spark):
    assert Ordered(frame(spark, []), ["g"], ["v"]).scan(n=("sum", None)).rows.count() == 0
    assert [r.n for r in Ordered(frame(spark, [(1, None, None)]), [], ["v"]).scan(n=("sum", None)).rows.collect()] == [1]


@pytest.mark.parametrize("bracket,small", [(50_000, 50_000), (0, 500), (50_000, 0), (50_000, 3_000)])
def test_quantiles_of_large_groups(spark, monkeypatch, bracket, small):
    monkeypatch.setattr(summaries, "BRACKET", bracket)
    monkeypatch.setattr(summaries, "SMALL", small)  # 0: brackets that are too narrow for small groups, so some are counted anew
    rows = hot() + [(10**6 + i, "few", float(v)) for i, v in enumerate([3, 1, 4, 1, 5, 9, 2])] + [(10**7, "none", None)]
    got = {r.g: r for r in summaries.with_quantiles(frame(spark, rows), ["g"], {"low": ("v", 0.1), "mid": ("v", 0.5), "ids": ("id", 0.25), "top": ("v", 1.0)}, F.count("*").alias("n")).collect()}
    own = groups(rows)
    assert set(got) == {"hot", "b", "c", None, "", "few", "none"}
    for g, r in got.items():
        values, ids = [v for v, _ in own.get(g, [])], [i for i, k, _ in rows if k == g]
        assert r.n == len(ids) and r.ids == pytest.approx(np.quantile(ids, 0.25))
        want = [np.quantile(values, q) for q in (0.1, 0.5, 1.0)] if values else [None] * 3
        assert [r.low, r.mid, r.top] == [pytest.approx(x) if x is not None else None for x in want]
    (whole,) = summaries.exact_quantiles(frame(spark, rows), [], "v", {"mid": 0.5}).collect()
    assert whole.mid == np.median([v for _, _, v in rows if v is not None])


def test_ranks_and_distribution_within_groups(spark):
    rows = hot(2_000)
    ranks = {r.id: r.r for r in statistics.ranked(frame(spark, rows), "v", ["g"]).collect()}
    shares = {(r.g, r.v): r.p for r in summaries.ecdf(frame(spark, rows), "v", ["g"]).collect()}
    for g, own in groups(rows).items():
        values = [v for v, _ in own]
        for v, i in own:
            below, upto = sum(x < v for x in values), sum(x <= v for x in values)
            assert shares[g, v] == pytest.approx(upto / len(values), abs=1e-6)
            if g is not None:
                assert ranks[i] == (below + 1 + upto) / 2


def test_adjusted_p_of_a_hot_group(spark):
    rows = [(i, g, None if v is None else (v % 97) / 97) for i, g, v in hot(3_000)]
    got = {r.id: r.p_adj for r in statistics.adjust(frame(spark, rows).withColumnRenamed("v", "p"), "p", ["g"]).collect()}
    assert len(got) == len(rows)
    for own in groups(rows).values():
        m, least = len(own), 1.0
        for k in range(m, 0, -1):
            p, i = own[k - 1]
            least = min(least, p * m / k)
            if k == 1 or own[k - 2][0] != p:
                for q, j in own[k - 1 :]:
                    if q != p:
                        break
                    assert got[j] == pytest.approx(least)
    assert all(got[i] is None for i, _, p in rows if p is None)


def test_a_hot_group_is_many_tasks_and_has_no_window(spark):
    rows = spark.range(300_000).select(F.col("id"), F.lit("hot").alias("g"), (F.col("id") * 7919 % 300_007 / 1e3).alias("v"), F.lit(0).alias("p"))
    ordered = Ordered(rows, ["g"], ["v"])
    sizes = [r[0] for r in ordered.rows.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(sizes) == 4 and max(sizes) < 1.5 * 300_000 / 4
    for df in (statistics.ranked(rows, "v", ["g"]), summaries.ecdf(rows, "v", ["g"]), statistics.adjust(rows, "v", ["g"]), ordered.scan(n=("sum", None)).rows):
        assert "Window" not in df._jdf.queryExecution().executedPlan().toString()
