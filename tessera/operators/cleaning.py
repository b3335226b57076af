"""Cleaning and selection: typed defaults, coercion, eligibility, field-level merge, dedup, incremental insertion."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ensure_columns(rows: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Absent columns as typed nulls."""
    return rows.withColumns({c: F.lit(None).cast(t) for c, t in wanted.items() if c not in rows.columns})


def safe(value: Column, kind: str) -> Column:
    """Coercion that gives null where it fails."""
    return value.try_cast(kind)


def blank_to_null(text: Column) -> Column:
    """P3."""
    return F.nullif(F.trim(text), F.lit(""))


def impute(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`<c>_missing` is set before nulls become 0."""
    flags = {f"{c}_missing": F.col(c).isNull() for c in columns}
    return rows.withColumns(flags | {c: F.coalesce(c, F.lit(0)) for c in columns})


def media_kind(kind: Column, path: Column | None = None, text_only: str = "text_only") -> tuple[Column, Column]:
    """P5: (kind, has_media): null and blank kinds are text only; media is another kind or a path."""
    shown = F.coalesce(blank_to_null(kind), F.lit(text_only))
    return shown, (shown != text_only) | (path.isNotNull() if path is not None else F.lit(False))


def media_from_mime(mime: Column) -> Column:
    """Video, audio or photo by a MIME type's beginning, document for any other, an empty one too; null where there is none."""
    kinds = F.when(F.startswith(mime, F.lit("video")), "video").when(F.startswith(mime, F.lit("audio")), "audio").when(F.startswith(mime, F.lit("image")), "photo")
    return kinds.when(mime.isNotNull(), "document")


def orientation(width: Column, height: Column, given: Column | None = None) -> Column:
    """The given label if not blank, else by comparison, null where a side is unknown."""
    told = F.when(width > height, "horizontal").when(width < height, "vertical").when(width == height, "square")
    return told if given is None else F.coalesce(blank_to_null(given), told)


def eligible(rows: DataFrame, key: str, ids: Sequence | None = None, kind: str | None = None, kinds: Sequence[str] | None = None, when: Column | None = None, start: str | None = None, end: str | None = None, done: Column | None = None, limit: int = 0) -> DataFrame:
    """Rows by id, kind, closed date range (whole end day), not yet done, and the first `limit` by key.

    No ids, no kinds, no bound and limit 0 mean no such filter. An unparseable date only matters when a bound is set.
    """
    if ids:
        rows = rows.where(F.col(key).isin(list(ids)))
    if kind and kinds:
        rows = rows.where(F.col(kind).isin(list(kinds)))
    if when is not None and start:
        rows = rows.where(when >= F.to_timestamp(F.lit(start)))
    if when is not None and end:
        rows = rows.where(when < F.to_timestamp(F.date_add(F.to_date(F.lit(end)), 1)))
    if done is not None:
        rows = rows.where(~F.coalesce(done, F.lit(False)))
    return rows.orderBy(key).limit(limit) if limit else rows


def is_done(columns: Sequence[str], null_is_done: bool = False) -> Column:
    """All fields are known; with null_is_done their presence in the table is enough."""
    return F.lit(True) if null_is_done else reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns))


def merge_fields(old: DataFrame, new: DataFrame, keys: Sequence[str], overwrite: bool = False) -> DataFrame:
    """New values fill nulls, or with `overwrite` replace what is there, with nulls too. Keys absent from `new` stay."""
    fields = [c for c in new.columns if c not in keys]
    renamed = new.withColumnsRenamed({c: f"{c}_new" for c in fields}).withColumn("met_", F.lit(True))
    joined = old.join(renamed, list(keys), "left")
    value = lambda c: F.when(F.col("met_"), F.col(f"{c}_new")).otherwise(F.col(c)) if overwrite else F.coalesce(c, f"{c}_new")
    return joined.select(*(value(c).alias(c) if c in fields else c for c in old.columns), *(F.col(f"{c}_new").alias(c) for c in fields if c not in old.columns))


def keep_best(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The best row of each key by `order`. As an aggregation of the least row it would shuffle less, but orders with descending
    nulls are clearer as a window; Spark cuts groups to one row before the shuffle."""
    return rows.withColumn("n_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("n_ = 1").drop("n_")


def inject(target: DataFrame, raw: DataFrame, key: str) -> DataFrame:
    """Rows of `raw` whose key the target has not, one for each key."""
    return raw.dropDuplicates([key]).join(target.select(key), key, "left_anti")


def repair(rows: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """Fields of rows replaced where a patch exists and has a value."""
    fields = [c for c in patches.columns if c != key]
    joined = rows.join(patches.withColumnsRenamed({c: f"{c}_new" for c in fields}), key, "left")
    return joined.select(*(F.coalesce(f"{c}_new", c).alias(c) if c in fields else c for c in rows.columns))
