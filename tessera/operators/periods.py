"""Phases and periods: interval assignment, period labels, complete calendars, extrapolation of the last period."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import Phase

#: Formats that are tried in turn when a timestamp is read from text.
FORMATS = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HHmmss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HHmm", "yyyy-MM-dd")


def parse_timestamp(text: Column) -> Column:
    """a timestamp from the first 19 characters in one of FORMATS, null if none fits."""
    cut = F.substring(text, 1, 19)
    return F.coalesce(*(F.try_to_timestamp(cut, F.lit(f)) for f in FORMATS))


def phase_of(when: Column, phases: Sequence[Phase]) -> Column:
    """The first phase (by start) whose closed interval of dates holds `when`, else null: a CASE, without a join."""
    day = when.cast("date")
    out = F.lit(None).cast("string")
    for phase in reversed(phases):
        out = F.when(day.between(F.lit(phase.start), F.lit(phase.end)), phase.phase_id).otherwise(out)
    return out


def in_phase(rows: DataFrame, when: str, phase: Phase) -> DataFrame:
    """Rows of a phase. The filter is a range of the column itself, so that scans can use it."""
    low, high = datetime.combine(phase.start, time.min), datetime.combine(phase.end, time.max)
    kind = rows.schema[when].dataType.simpleString()
    return rows.where(F.col(when).between(F.lit(str(low)).cast(kind), F.lit(str(high)).cast(kind)))


def period_of(when: Column, kind: str) -> Column:
    """Label of the day, week (Monday), week_sunday, month, quarter or year, as text."""
    if kind == "quarter":
        return F.concat(F.year(when).cast("string"), F.lit("-Q"), F.quarter(when).cast("string"))
    if kind == "year":
        return F.year(when).cast("string")
    if kind == "month":
        return F.date_format(when, "yyyy-MM")
    return start_of(when, kind).cast("string")


def start_of(when: Column, kind: str) -> Column:
    """The first date of the period. Weeks begin on Monday; those of week_sunday on Sunday."""
    day = when.cast("date")
    if kind == "day":
        return day
    if kind == "week_sunday":
        return F.date_sub(F.date_trunc("week", F.date_add(day, 1)).cast("date"), 1)
    return F.date_trunc(kind, day).cast("date")


def local(when: Column, zone: str) -> Column:
    """UTC to the zone's wall clock."""
    return F.from_utc_timestamp(when.cast("timestamp"), zone)


def calendar(rows: DataFrame, period: str, step: str = "1 month") -> DataFrame:
    """All periods from the least to the greatest of `rows`, one row each."""
    ends = rows.agg(F.min(period).alias("a"), F.max(period).alias("b")).where("a is not null")
    return ends.select(F.explode(F.expr(f"sequence(a, b, interval {step})")).alias(period)).withColumn(period, F.col(period).cast("date"))


def complete(counts: DataFrame, period: str, step: str = "1 month", fill: dict[str, object] | None = None, levels: dict[str, Sequence[str]] | None = None, skeleton: DataFrame | None = None) -> DataFrame:
    """A row for each period of the calendar (and each declared level); what is missing is null, or `fill`."""
    frame = calendar(counts, period, step) if skeleton is None else skeleton
    keys = [period]
    for name, values in (levels or {}).items():
        frame = frame.select("*", F.explode(F.array(*map(F.lit, values))).alias(name))
        keys.append(name)
    out = frame.join(counts, keys, "left")
    return out.na.fill(fill) if fill else out


def extrapolate_last(counts: DataFrame, month: str, value: str, last_seen: Column) -> DataFrame:
    """The month of the last observation scaled to its full length; other months, and all without such a day, stay."""
    last = last_seen.cast("date")
    covered = F.dayofmonth(last)
    whole = F.dayofmonth(F.last_day(last))
    return counts.withColumn(value, F.when(F.col(month) == F.date_trunc("month", last).cast("date"), F.col(value) * whole / covered).otherwise(F.col(value).cast("double")))
