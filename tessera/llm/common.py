"""Helpers that several corpus operators share: Arrow batch limits, bitmaps of keys, components of link graphs."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.ordering import durable, partitions_of

__all__ = ["alone", "bound_batches", "components", "durable", "labels", "marked", "may_hold", "partitions_of", "tidy"]

#: Bits of the largest bitmap that is broadcast: 32 MB.
MOST_BITS = 1 << 28
#: Fixed value: bits of one of the engine's bitmaps.
BITMAP = 1 << 15


def bound_batches(spark: SparkSession, rows: int = 1000, size: int = 32 << 20) -> None:
    """Bound what one Arrow batch holds, so that very long texts do not meet in a Python worker. The session's lower bounds stay."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(name, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidy(task: Task) -> Task:
    """The task of a Python worker; when it ends, memory that it has freed goes back to the system: workers wait for their next task beside the executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # of the C library on Linux
                ctypes.CDLL(None).malloc_trim(0)

    return run


_held: dict[str, Callable[[], None]] = {}


def alone(name: str, clear: Callable[[], None] = lambda: None) -> None:
    """Called by a task of the operator `name` in its worker: what other operators keep there from task to task goes; `clear` drops its own."""
    for other in [x for x in _held if x != name]:
        _held.pop(other)()
    _held[name] = clear


def marked(rows: DataFrame, keys: DataFrame, by: Sequence[str], mark: str) -> DataFrame:
    """`rows` with the column `mark`: whether the row's `by` is, or may be, in `keys` (checkpointed). It costs no shuffle of the rows.

    Hashed keys are bits of bitmaps, which are broadcast: sixteen bits a key, and MOST_BITS at most. With more keys than those bits serve,
    more rows are marked than must; none is missed at any size.
    """
    parts = 1
    while BITMAP * parts < min(16 * keys.count(), MOST_BITS):
        parts *= 2
    bit = F.pmod(F.xxhash64(F.lit(77), *by), F.lit(BITMAP * parts))
    part, place = F.shiftright(bit, 15), (bit % BITMAP).cast("int")
    held = keys.select(part.alias("part_"), place.cast("long").alias("place_")).repartition(partitions_of(keys), "part_")
    maps = durable(held.groupBy("part_").agg(F.bitmap_construct_agg("place_").alias("map_")))
    at = rows.withColumns({"part_": part, "place_": place}).join(F.broadcast(maps), "part_", "left")
    byte = F.ascii(F.decode(F.expr("substring(map_, place_ div 8 + 1, 1)"), "ISO-8859-1"))
    return at.select(*rows.columns, F.coalesce(F.getbit(byte, F.col("place_") % 8) == 1, F.lit(False)).alias(mark))


def may_hold(rows: DataFrame, keys: DataFrame, by: Sequence[str]) -> DataFrame:
    """The rows that `marked` marks: a filter before a join."""
    return marked(rows, keys, by, "mark_").where("mark_").drop("mark_")


def labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest node reachable from each of n nodes over the links i-j."""
    lab = np.arange(n)
    while True:
        a, b = lab[i], lab[j]
        low = np.minimum(a, b)
        new = lab.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        while True:
            jump = new[new]
            if np.array_equal(jump, new):
                break
            new = jump
        if np.array_equal(new, lab):
            return lab
        lab = new


def components(links: DataFrame) -> DataFrame:
    """Connected components of `links` (a, b: long). Returns (node, root), a row for each node that has a link.

    Graph contraction: every node joins the neighbour (or itself) of least hashed priority, links are
    renamed and made distinct, and what is left goes to the next round. Priorities are random to the
    ids, so a round leaves a constant share of the nodes at most and a hub with all its leaves is done in two. Joins
    are plain equi-joins, which AQE splits where a hub is hot; minima combine before the shuffle.
    Self links and links with a null end are ignored. `root` is some node of the component.
    """
    graph = durable(
        links.where("a is not null and b is not null and a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    steps: list[DataFrame] = []
    while not graph.isEmpty():
        both = graph.select("a", "b").unionByName(graph.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b").alias("p"), F.col("b").alias("id"))).alias("n"))
        own = F.struct(F.xxhash64("a").alias("p"), F.col("a").alias("id"))
        step = durable(best.select(F.col("a").alias("node"), F.least("n", own)["id"].alias("root")))
        steps.append(step)
        left = step.select(F.col("node").alias("a"), F.col("root").alias("x"))
        right = step.select(F.col("node").alias("b"), F.col("root").alias("y"))
        graph = durable(
            graph.join(left, "a")
            .join(right, "b")
            .where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct()
        )
    if not steps:
        return graph.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = steps.pop()
    while steps:
        later = found.select(F.col("node").alias("root"), F.col("root").alias("last"))
        found = steps.pop().join(later, "root", "left").select("node", F.coalesce("last", "root").alias("root"))
    return found
