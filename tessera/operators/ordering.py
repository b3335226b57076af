"""Global orders without a task that holds them: running sums over range partitions, and durable cuts of lineage."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of `df` with a reliable checkpoint.

    With `spark.cleaner.referenceTracking.cleanCheckpoints` (a setting of the cluster) the files go with the last reference to them."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder in `spark.checkpoint.dir`, which all executors share. Where that is absent, a temporary one if executors run in this process
    (tests, notebooks), and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="tessera-")


def partitions_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def running_sum(rows: DataFrame, order: Sequence[str], weight: str | None = None, name: str = "upto") -> DataFrame:
    """`rows` with the running sum of `weight` (a whole number; ones without) in `order`, the row itself included.

    Range partitions, a running sum in each, and the sums of the partitions before (a row for each partition): no task holds the whole
    order. The partitions' rows are written before their sums are taken, so a lost executor can't deal them anew.
    """
    given = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    schema = T.StructType([*rows.schema.fields, T.StructField("part_", T.IntegerType()), T.StructField("within_", T.LongType())])
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            if batch.num_rows:
                sums = total + np.cumsum(batch.column("weight_").to_numpy(zero_copy_only=False), dtype=np.int64)
                total = int(sums[-1])
                here = pa.array(np.full(batch.num_rows, part, np.int32))
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), here, pa.array(sums)], [*names, "part_", "within_"])

    dealt = rows.withColumn("weight_", given).repartitionByRange(partitions_of(rows), *order).sortWithinPartitions(*order)
    runs = durable(dealt.mapInArrow(run, schema))
    before, so_far = [], 0
    for part, size in sorted(runs.groupBy("part_").agg(F.max("within_")).collect()):
        before.append((part, so_far))
        so_far += size or 0
    offsets = rows.sparkSession.createDataFrame(before, "part_ int, before_ long")
    summed = runs.join(F.broadcast(offsets), "part_").withColumn(name, F.col("within_") + F.col("before_"))
    return summed.select(*names, name)


class Ordered:
    """`rows` of groups (by) in an order within each, for running folds; no task holds a group.

    Rows are in range partitions by (by.., order..), so a group of any size is many of them. Rows that are equal in all of these share a partition: callers
    count equal rows first, or add a column that tells them apart. A scan folds within each partition and takes what a group brings with it from the partitions before, a row for each
    partition. Scans add columns and leave the order, so one may build on another without a shuffle."""

    FOLDS = {"sum": (lambda g: g.cumsum(), np.add, "long"), "min": (lambda g: g.cummin(), np.minimum, "double"), "max": (lambda g: g.cummax(), np.maximum, "double")}

    def __init__(self, rows: DataFrame, by: Sequence[str], order: Sequence[Column | str]):
        self.by = list(by)
        self.rows = rows.repartitionByRange(partitions_of(rows), *by, *order).sortWithinPartitions(*by, *order)

    def scan(self, **folds: tuple[str, Column | None]) -> Ordered:
        """With a column for each of `folds`, name: (sum, min or max; of what, without nulls), from the group's first row to this one. sum of None: the rows' number."""
        kinds = [self.FOLDS[kind] for kind, _ in folds.values()]
        names = self.rows.columns
        # nulls leave a hash as it was, so it tells them apart only with their places
        key = F.xxhash64(*self.by, *(F.col(c).isNull() for c in self.by)) if self.by else F.lit(0).cast("long")
        given = {f"in_{i}": (F.lit(1) if x is None else x).cast(kind[2]) for i, (kind, (_, x)) in enumerate(zip(kinds, folds.values()))}
        added = [T.StructField("key_", T.LongType()), T.StructField("part_", T.IntegerType()), T.StructField("seq_", T.LongType())]
        outs = [T.StructField(f"out_{i}", T.LongType() if kind[2] == "long" else T.DoubleType()) for i, kind in enumerate(kinds)]
        schema = T.StructType([*self.rows.schema.fields, *added, *outs])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, seen, before, brought = TaskContext.get().partitionId(), 0, None, [0] * len(kinds)
            for batch in batches:
                if not batch.num_rows:
                    continue
                keys = batch.column(len(names)).to_numpy()
                group = np.cumsum(np.concatenate([[0], keys[1:] != keys[:-1]]))
                found = []
                for i, (fold, join, _) in enumerate(kinds):
                    out = fold(pd.Series(batch.column(len(names) + 1 + i).to_numpy()).groupby(group)).to_numpy().copy()
                    if before == keys[0]:
                        first = group == 0
                        out[first] = join(out[first], brought[i])
                    brought[i] = out[-1]
                    found.append(pa.array(out))
                before = keys[-1]
                number = pa.array(np.arange(seen, seen + batch.num_rows))
                seen += batch.num_rows
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names) + 1], pa.array(np.full(batch.num_rows, part, np.int32)), number, *found], [f.name for f in schema.fields])

        runs = durable(self.rows.select(*names, key.alias("key_"), *(c.alias(n) for n, c in given.items())).mapInArrow(run, schema))
        last = F.max_by(F.struct("key_", *(f"out_{i}" for i in range(len(kinds)))), "seq_").alias("last")
        ends = runs.groupBy("part_").agg(F.min_by("key_", "seq_").alias("first"), last).orderBy("part_").collect()  # a row for each partition
        carried, key_before, brought = [], None, []
        for part, first, end in ends:
            values = list(end[1:])
            if key_before == first:
                carried.append((part, first, *brought))
                if end[0] == first:
                    values = [join(a, b).item() for (_, join, _), a, b in zip(kinds, values, brought)]
            key_before, brought = end[0], values
        offsets = runs.sparkSession.createDataFrame(carried, ", ".join(["part_ int", "key_ long", *(f"from_{i} {kind[2]}" for i, kind in enumerate(kinds))]))
        met = runs.join(F.broadcast(offsets), ["part_", "key_"], "left")
        join = {"sum": lambda i: F.col(f"out_{i}") + F.coalesce(f"from_{i}", F.lit(0)), "min": lambda i: F.least(f"out_{i}", f"from_{i}"), "max": lambda i: F.greatest(f"out_{i}", f"from_{i}")}
        scanned = object.__new__(Ordered)
        scanned.by, scanned.rows = self.by, met.select(*names, *(join[kind](i).alias(name) for i, (name, (kind, _)) in enumerate(folds.items())))
        return scanned
