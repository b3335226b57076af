"""Registers queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from tessera.config import Phase

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: Phases of the events table: three closed intervals of ten days.
EVENT_PHASES = tuple(Phase(f"P{i + 1}", f"days {10 * i + 1}-{10 * i + 10}", date(2024, 1, 10 * i + 1), date(2024, 1, 10 * i + 10)) for i in range(3))
EVENT_PHASE_SQL = "case " + " ".join(f"when cast(ts as date) between date '{p.start}' and date '{p.end}' then '{p.phase_id}'" for p in EVENT_PHASES) + " end"
#: Phases of the orders table: closed intervals of years.
ORDER_PHASES = (Phase("P1", "1995-96", date(1995, 1, 1), date(1996, 12, 31)), Phase("P2", "1997-98", date(1997, 1, 1), date(1998, 12, 31)), Phase("P3", "1999-2001", date(1999, 1, 1), date(2001, 7, 31)))
ORDER_PHASE_SQL = "case " + " ".join(f"when cast(o_orderdate as date) between date '{p.start}' and date '{p.end}' then '{p.phase_id}'" for p in ORDER_PHASES) + " end"
#: The tokens of documents: doc_id, lang, source, pos, lemma.
TOKENS_SQL = r"""tok as (
  select doc_id, lang, source, unnest(ts) as lemma, unnest(range(len(ts))) as pos
  from (select doc_id, lang, source, regexp_extract_all(lower(text), '[\p{L}_][\p{L}\p{N}_]*') as ts from documents)
)"""


def erfc_sql(x: str) -> str:
    """The complementary error function of x >= 0, by Simpson's rule over a thousand steps: good to eight decimals up to x = 10."""
    steps = 1000
    inner = f"(case when i = 0 or i = {steps} then 1 when i % 2 = 1 then 4 else 2 end) * exp(-pow(({x}) * i / {steps}.0, 2))"
    return f"greatest(0.0, 1 - 2 / sqrt(pi()) * ({x}) / {3 * steps} * list_sum(list_transform(range(0, {steps + 1}), lambda i: {inner})))"


def chi2_sql(x: str, df: str) -> str:
    """The upper tail of chi-square, by the series of the lower incomplete gamma function."""
    a, y = f"(({df}) / 2.0)", f"(({x}) / 2.0)"
    return f"case when ({x}) <= 0 then 1.0 else greatest(0.0, 1 - list_sum(list_transform(range(0, 600), lambda i: exp(({a} + i) * ln({y}) - {y} - lgamma({a} + i + 1))))) end"


def t_sql(t: str, df: str) -> str:
    """The two-sided p of Student's t, by Simpson's rule over its density."""
    steps = 2000
    at = f"(abs({t}) * i / {steps}.0)"
    density = f"exp(lgamma((({df}) + 1) / 2.0) - lgamma(({df}) / 2.0) - 0.5 * ln(({df}) * pi()) - (({df}) + 1) / 2.0 * ln(1 + {at} * {at} / ({df})))"
    inner = f"(case when i = 0 or i = {steps} then 1 when i % 2 = 1 then 4 else 2 end) * {density}"
    return f"greatest(0.0, 1 - 2 * abs({t}) / {3 * steps} * list_sum(list_transform(range(0, {steps + 1}), lambda i: {inner})))"


def rho_sql(select: str, source: str, group: str = "") -> str:
    """`select`, n, rho, p and stars of the ranks rx, ry of `source`."""
    stars = "case when p is null then null when p < .001 then '***' when p < .01 then '**' when p < .05 then '*' else 'ns' end"
    t = "(r * sqrt((n - 2) / (1 - r * r)))"
    return f"select {select}n, round(r, 4) as rho, round(p, 6) as p, {stars} as stars from (select *, {t_sql(t, 'n - 2')} as p from (select {group}count(*) as n, corr(rx, ry) as r from ({source}){' group by all' if group else ''}))"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
