"""Sharding along a Hilbert curve over several metadata dimensions.

Each row's source, language, id and size are quantised to `bits` bits, the Hilbert index of the resulting cell is
its place on the curve, rows are ordered by it, and the order is cut into equal runs. A run holds few cells of
each dimension, so that files written by shard (and slot) can be skipped by their minima and maxima.

The order is global but no task holds it: rows (without their text) are range-partitioned by (curve index, checksum,
hash, id), numbered within a partition, and shifted by the sizes of the partitions before it, a table with a row
for each partition. Equal cells are split by the tie-breakers, so a hot source does not make a hot partition.

Edge cases: very long texts count by their bytes, and are not moved; a null text has size 1 and checksum 0; null source and lang are cells of their own (0), null ids go with the
smallest. Rows that tie in every key are numbered in any order; they are equal. Fewer rows than shards leave shards
empty. Other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.ordering import durable, running_sum


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Distance along the Hilbert curve of each row of `cells` (n x dims, each below 2**bits).

    From the Gray-code description of the curve: from the highest bit down, a cell's orthant number is read through
    the orientation reached so far; low axes are then exchanged with, or reflected in, the first axis.
    """
    axes = cells.astype(np.uint64).T.copy()
    dims, one = len(axes), np.uint64(1)
    for level in range(bits - 1, 0, -1):
        bit = np.uint64(1 << level)
        low = bit - one
        for d in range(dims):
            is_set = (axes[d] & bit) != 0
            swap = np.where(is_set, np.uint64(0), (axes[0] ^ axes[d]) & low)
            axes[0] = np.where(is_set, axes[0] ^ low, axes[0] ^ swap)
            axes[d] ^= swap if d else np.uint64(0)
    for d in range(1, dims):
        axes[d] ^= axes[d - 1]
    turn = np.zeros_like(axes[0])
    for level in range(bits - 1, 0, -1):
        bit = np.uint64(1 << level)
        turn = np.where((axes[-1] & bit) != 0, turn ^ (bit - one), turn)
    axes ^= turn
    out = np.zeros_like(axes[0])
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            out = (out << one) | ((axes[d] >> np.uint64(level)) & one)
    return out.astype(np.int64)


def _ranks(rows: DataFrame, column: str, levels: int) -> DataFrame:
    """(column, cell): each value's place among all rows by value, as one of levels - 1 equal parts; a row for each distinct value."""
    counts = running_sum(rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")), [column], "n")
    total = counts.agg(F.max("upto")).first()[0] or 1
    return counts.select(column, (1 + F.floor((F.col("upto") - F.col("n")) * (levels - 1) / total)).cast("int").alias(f"{column}_cell"))


def hilbert_shards(docs: DataFrame, shards: int = 8, law: str = "rows", bits: int = 4) -> DataFrame:
    """A row for each row of `docs` (doc_id, text, source, lang): doc_id, size, text_crc32, law, shard, slot, grown_shard, curve.

    law "rows": the shards' row counts are at most one apart. law "bytes": a shard holds the rows whose middle byte, in curve order,
    is in its share of all bytes. slot numbers a shard's rows from 0 without gaps, along the curve.
    """
    if law not in ("rows", "bytes"):
        raise ValueError(law)
    levels = 1 << bits
    text = F.coalesce("text", F.lit(""))
    rows = durable(
        docs.select(
            "doc_id", "source", "lang", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
        )
    )
    # equi-depth bounds of the numeric dimensions: levels - 1 numbers each
    cuts = [i / levels for i in range(1, levels)]
    bounds = rows.agg(F.percentile_approx("doc_id", cuts).alias("doc_id"), F.percentile_approx("size", cuts).alias("size")).first()
    ids, sizes = (np.array(bounds[c] or [], dtype=np.int64) for c in ("doc_id", "size"))
    for column in ("source", "lang"):
        rows = rows.join(_ranks(rows, column, levels), column, "left")

    @F.pandas_udf("long")
    def curve(source: pd.Series, lang: pd.Series, doc_id: pd.Series, size: pd.Series) -> pd.Series:
        where = lambda cuts, x: np.searchsorted(cuts, x.to_numpy(), side="right")
        return pd.Series(hilbert_index(np.stack([source.to_numpy(), lang.to_numpy(), where(ids, doc_id), where(sizes, size)], axis=1), bits))

    least = F.lit(-(2**63)).cast("long")
    cells = [F.coalesce(f"{c}_cell", F.lit(0)) for c in ("source", "lang")]
    rows = rows.select(
        "doc_id", "size", "text_crc32", curve(*cells, F.coalesce("doc_id", least), "size").alias("curve"), F.xxhash64("doc_id", "text_crc32").alias("mix_")
    )
    order = ["curve", "text_crc32", "mix_", "doc_id"]  # equal texts of a cell stay together
    placed = running_sum(rows, order)
    if law == "rows":
        n = rows.count()
        placed = placed.withColumn("at_", F.col("upto") - 1)
        exact = F.expr(f"cast((at_ * {shards}) div {max(n, 1)} as int)")  # integers: no rounding
        # the first place of shard s is ceil(s * n / shards)
        first = F.expr(f"(cast(shard as bigint) * {n} + {shards - 1}) div {shards}")
        placed = placed.withColumn("shard", exact).withColumn("slot", (F.col("at_") - first).cast("long"))
    else:
        total = rows.agg(F.sum("size")).first()[0] or 1
        placed = placed.withColumnRenamed("upto", "row_")
        placed = running_sum(placed, order, "size").withColumn("shard", F.expr(f"cast(((upto * 2 - size) * {shards}) div {2 * total} as int)"))
        firsts = placed.groupBy("shard").agg(F.min("row_").alias("first_"))  # at most `shards` rows
        placed = placed.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("row_") - F.col("first_"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve"
    )
