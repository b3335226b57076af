"""Structured Streaming forms of the incremental operators. Each has a batch twin with the same rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.cleaning import merge_fields
from tessera.operators.ordering import shared_folder


def ingest(stream: DataFrame, key: str, when: str, delay: str = "1 day") -> DataFrame:
    """Each key once. State is bounded by the watermark: a repeat that comes within `delay` is dropped."""
    return stream.withWatermark(when, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, when: str, category: str, width: str = "1 day", delay: str = "1 day") -> DataFrame:
    """(start, category, n) for each tumbling window; windows close when the watermark passes them."""
    counts = stream.withWatermark(when, delay).groupBy(F.window(when, width), category).count()
    return counts.select(F.col("window.start").alias("start"), category, F.col("count").alias("n"))


def sessions(stream: DataFrame, when: str, key: str, gap: str = "30 minutes", delay: str = "1 day") -> DataFrame:
    """(key, start, end, n) for each session of a key, which ends after `gap` without a row."""
    found = stream.withWatermark(when, delay).groupBy(F.session_window(when, gap), key).count()
    return found.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), F.col("count").alias("n"))


def album_ranks(stream: DataFrame, album: str, key: str, forget: str = "") -> DataFrame:
    """(album, key, rank): a running number for each album, kept in state; rows of a batch are ordered by key. State is a number for each album.
    `forget` (a duration, "30 days") drops that of albums without a row for so long: a row that comes later still would begin at 1."""

    def number(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = state.get[0] if state.exists else 0
        keys = sorted(k for frame in frames for k in frame[key])
        state.update((seen + len(keys),))
        if forget:
            state.setTimeoutDuration(int(pd.Timedelta(forget).total_seconds() * 1000))
        yield pd.DataFrame({album: [group[0]] * len(keys), key: keys, "rank": range(seen + 1, seen + len(keys) + 1)})

    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    schema = f"{album} {kinds[album]}, {key} {kinds[key]}, rank int"
    timeout = GroupStateTimeout.ProcessingTimeTimeout if forget else GroupStateTimeout.NoTimeout
    return stream.select(album, key).groupBy(album).applyInPandasWithState(number, schema, "seen int", "append", timeout)


BATCH = "batch_"


def enrich_into(path: str, keys: Sequence[str], format_: str = "parquet"):
    """A function for foreachBatch that keeps each batch's new fields (a row for each key) in a folder of its own: a batch that is run again
    replaces its own result, and none rewrites the table. `current` reads the table with them."""

    def merge(batch: DataFrame, number: int) -> None:
        new = batch.groupBy(*keys).agg(*(F.max(c).alias(c) for c in batch.columns if c not in keys))
        new.write.mode("overwrite").format(format_).save(f"{path}/{BATCH}={number}")

    return merge


def current(table: DataFrame, path: str, keys: Sequence[str], overwrite: bool = False, format_: str = "parquet") -> DataFrame:
    """`table` with the fields of all batches under `path`: the first value that came for a field that is null, or with `overwrite` the last batch's
    row of the key, nulls too. As merging the batches one after the other."""
    batches = table.sparkSession.read.format(format_).option("basePath", path).load(f"{path}/{BATCH}=*")
    fields = [c for c in batches.columns if c not in (*keys, BATCH)]
    if overwrite:
        rows = F.max_by(F.struct(*fields), F.col(BATCH)).alias("last_")
        new = batches.groupBy(*keys).agg(rows).select(*keys, "last_.*")
    else:
        new = batches.groupBy(*keys).agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), F.col(BATCH))).alias(c) for c in fields))
    return merge_fields(table, new, keys, overwrite)


def stream_of(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet files of a folder, or one file, as a stream. (A file is a source only where its path is a pattern.)"""
    path = path.rstrip("/")
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def drained(stream: DataFrame, keys: Sequence[str] = (), mode: str = "append", folder: str | None = None) -> DataFrame:
    """Run a stream over all that its source holds, and return the rows of its sink. A batch writes a folder of its own, so one that is run again replaces its rows.
    mode "update": the last row of each of `keys`. `folder`, on a file system that the cluster shares, holds the log and the rows; a second run with it goes on
    where the first one ended. Without one a new folder is made in that of `spark.checkpoint.dir`."""
    spark = stream.sparkSession
    folder = folder or f"{shared_folder(spark)}/stream-{uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/{BATCH}={number}")

    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{folder}/rows/{BATCH}=-1")  # for sources that hold nothing
    run = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    run.awaitTermination()
    names = stream.columns
    rows = spark.read.option("basePath", f"{folder}/rows").parquet(f"{folder}/rows/{BATCH}=*")
    if mode != "update":
        return rows.select(*names)
    last = F.max_by(F.struct(*(c for c in names if c not in keys)), F.col(BATCH)).alias("last_")
    return rows.groupBy(*keys).agg(last).select(*keys, "last_.*").select(*names)
