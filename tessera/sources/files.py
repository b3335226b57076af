"""Files: JSON lines, CSV, subtitles, vectors, media listings, interchange formats. Reading and writing go through Spark only."""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.functions.text import xml_escape
from tessera.operators.ordering import Ordered
from tessera.schema import MESSAGE, TOKENS


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType = MESSAGE) -> DataFrame:
    """JSON lines under a declared schema; blank lines are skipped, malformed ones fail."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(rows: DataFrame, path: str, mode: str = "overwrite", compressed: bool = False) -> None:
    """JSON lines, whole or appended (a failed append leaves no part of it), gzip on request."""
    rows.write.mode(mode).option("compression", "gzip" if compressed else "none").json(path)


def append_batch(rows: DataFrame, path: str, batch: str, format_: str = "json") -> None:
    """S3: appends a batch whole or not at all. It is written beside the table, where readers don't look, and moved to a folder of its own name when it is
    complete: a crash leaves the table as it was, and a batch that is run again, or twice at once, takes its own place."""
    spark = rows.sparkSession
    staged, final = f"{path}/_staged-{uuid.uuid4().hex}", f"{path}/batch={batch}"
    rows.write.format(format_).save(staged)
    there = spark._jvm.org.apache.hadoop.fs.Path(final)
    files = there.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    files.delete(there, True)
    if not files.rename(spark._jvm.org.apache.hadoop.fs.Path(staged), there):
        raise OSError(f"{staged} could not be moved to {final}")


def slim_copy(spark: SparkSession, path: str, heavy: Sequence[str], schema: str | StructType = MESSAGE) -> tuple[DataFrame, DataFrame]:
    """(rows without the heavy columns, malformed lines as they are). Both are lazy; a column `broken` is never pruned away."""
    declared = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    kept = StructType([f for f in declared.fields if f.name not in heavy]).add("broken", "string")
    lines = spark.read.text(path).where("trim(value) <> ''")
    parsed = lines.select(F.from_json("value", kept, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}).alias("j"), "value")
    return parsed.where("j.broken is null").select("j.*").drop("broken"), parsed.where("j.broken is not null").select("value")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """A token CSV with text types; rows without phase are left out. Lemmas such as null or NA stay words."""
    rows = spark.read.schema(TOKENS).option("header", True).option("nullValue", None).csv(path)
    return rows.where("phase is not null and trim(phase) <> ''")


def write_csv(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S9."""
    rows.write.mode(mode).option("header", True).option("encoding", "UTF-8").csv(path)


def append_new(rows: DataFrame, path: str, keys: Sequence[str], format_: str = "parquet") -> DataFrame:
    """Appends rows whose keys are not there yet, and returns them. A missing target has none."""
    spark = rows.sparkSession
    there = _exists(spark, path)
    new = rows.dropDuplicates(list(keys))
    if there:
        new = new.join(spark.read.format(format_).load(path).select(*keys), list(keys), "left_anti")
    new.write.mode("append").format(format_).save(path)
    return new


def checked_vectors(rows: DataFrame, vector: str, size: int) -> DataFrame:
    """Fails when a vector has not `size` components."""
    ok = F.size(vector) == size
    return rows.withColumn(vector, F.when(ok, F.col(vector)).otherwise(F.raise_error(F.concat(F.lit("vector of size "), F.size(vector).cast("string")))))


def npz_contents(rows: DataFrame, key: str, vector: str, parts: int) -> DataFrame:
    """(part, content): `parts` files of the vectors by hashed key, each with arrays named as the columns."""
    dealt = rows.select(F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("part"), key, vector)

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by(key)
        out = io.BytesIO()
        np.savez(out, **{key: table.column(key).to_numpy(), vector: np.array(table.column(vector).to_pylist(), dtype=np.float32)})
        return pa.table({"part": table.column("part").slice(0, 1), "content": pa.array([out.getvalue()], pa.binary())})

    return dealt.groupBy("part").applyInArrow(pack, "part int, content binary")


def vectors_of(contents: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """(key long, vector array<float>) of all files in `contents` (content), each vector of `size` components."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                with np.load(io.BytesIO(content.as_py())) as arrays:
                    keys, body = arrays[key].astype(np.int64), arrays[vector].astype(np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * body.shape[1]), pa.array(body.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(keys), lists], [key, vector])

    found = contents.select("content").mapInArrow(unpack, f"{key} long, {vector} array<float>")
    return checked_vectors(found, vector, size)


def write_npz(rows: DataFrame, key: str, vector: str, path: str, parts: int = 64) -> None:
    """The vectors as a table of `parts` files' contents, which `read_npz` reads; a part is one task's, so let `parts` grow with the rows."""
    npz_contents(rows, key, vector, parts).write.mode("overwrite").parquet(path)


def read_npz(spark: SparkSession, path: str, key: str, vector: str, size: int) -> DataFrame:
    """Vectors from a folder of .npz files or from a table that `write_npz` wrote."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path)
    contents = spark.read.parquet(path) if found.select("path").isEmpty() else found
    return vectors_of(contents, key, vector, size)


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """(path, vector) of reference vectors in .npy files."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [np.load(io.BytesIO(x.as_py())).astype(float).ravel().tolist() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.list_(pa.float64()))], ["path", "vector"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(unpack, "path string, vector array<double>")


def document_path(rows: DataFrame, key: str, bucket: int = 1000) -> DataFrame:
    """A folder number for each key, to write documents with partitionBy."""
    return rows.withColumn("folder", F.floor(F.col(key) / bucket))


def save_documents(rows: DataFrame, path: str, key: str, bucket: int = 1000) -> None:
    """Documents by key, in folders of `bucket` keys. A document that is saved again replaces the one there, the last save of a key counting; a save
    appends files and rewrites none."""
    stamped = document_path(rows, key, bucket).withColumn("saved_", F.current_timestamp())
    stamped.write.mode("append").partitionBy("folder").parquet(path)


def load_documents(spark: SparkSession, path: str, key: str, schema: str, keys: Sequence[int], bucket: int = 1000) -> DataFrame:
    """The documents of `keys`, a list; only their folders are read. None for keys that are absent, or an absent store."""
    declared = StructType.fromDDL(schema)
    if not _exists(spark, path):
        return spark.createDataFrame([], declared)
    rows = spark.read.schema(StructType([*declared.fields]).add("saved_", "timestamp").add("folder", "long")).parquet(path)
    some = rows.where(F.col("folder").isin(sorted({k // bucket for k in keys})) & F.col(key).isin(list(keys)))
    return some.groupBy(key).agg(F.max_by(F.struct(*declared.names), F.col("saved_")).alias("last")).select("last.*")


def _exists(spark: SparkSession, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(there)


def _seconds(stamp: Column) -> Column:
    part = lambda i: F.split_part(F.replace(F.trim(stamp), F.lit(","), F.lit(".")), F.lit(":"), F.lit(i)).try_cast("double")
    return part(1) * 3600 + part(2) * 60 + part(3)


def parse_srt(text: Column) -> Column:
    """array<struct<start, end, text>>: blocks of at least three lines with an arrow; a block's lines are joined by spaces."""
    blocks = F.split(F.trim(F.regexp_replace(text, "\r\n?", "\n")), r"\n\s*\n")
    lines = F.transform(blocks, lambda b: F.split(F.trim(b), "\n"))
    fine = F.filter(lines, lambda x: (F.size(x) >= 3) & F.contains(F.get(x, 1), F.lit(" --> ")))
    stamp = lambda x, i: _seconds(F.split_part(F.get(x, 1), F.lit(" --> "), F.lit(i)))
    words = lambda x: F.array_join(F.transform(F.slice(x, 3, F.size(x)), lambda y: F.trim(y)), " ")
    found = F.transform(fine, lambda x: F.struct(stamp(x, 1).alias("start"), stamp(x, 2).alias("end"), words(x).alias("text")))
    timed = F.filter(found, lambda s: s["start"].isNotNull() & s["end"].isNotNull())
    return F.coalesce(timed, F.array().cast("array<struct<start:double,end:double,text:string>>"))


def srt_stamp(seconds: Column) -> Column:
    """HH:MM:SS,mmm, rounded to milliseconds."""
    ms = F.round(seconds * 1000).cast("long")
    part = lambda div, mod: (F.floor(ms / div) % mod).cast("int")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3_600_000).cast("int"), part(60_000, 60), part(1000, 60), (ms % 1000).cast("int"))


def format_srt(segments: Column, skip_blank: bool = True) -> Column:
    """The subtitle file of an array of segments, numbered from 1; blank ones are skipped or kept."""
    kept = F.filter(segments, lambda s: F.trim(s["text"]) != "") if skip_blank else segments
    block = lambda s, i: F.concat((i + 1).cast("string"), F.lit("\n"), srt_stamp(s["start"]), F.lit(" --> "), srt_stamp(s["end"]), F.lit("\n"), F.trim(s["text"]), F.lit("\n"))
    return F.array_join(F.transform(kept, block), "\n")


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    """(path, segments) of each file; malformed ones have no segments. Spark leaves out files of no bytes."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", parse_srt(F.decode("content", "UTF-8")).alias("segments"))


def media_files(spark: SparkSession, path: str, pattern: str = "*", content: bool = False) -> DataFrame:
    """(path, frame, bytes[, content]) of files by name. Without `content` the bytes are not read."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    frame = F.regexp_extract("path", r"_kf_(\d+)", 1).try_cast("int")
    return rows.select("path", F.coalesce(frame, F.lit(1)).alias("frame"), F.col("length").alias("bytes"), *(["content"] if content else []))


def edge_table(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Edges in the column names of graph programs."""
    return edges.select(*by, F.col("a").alias("Source"), F.col("b").alias("Target"), F.col("pmi").alias("Weight"), F.col("count").alias("RawCount"))


def matrix(edges: DataFrame, labels: Sequence[str]) -> DataFrame:
    """The dense matrix of a bounded list of labels."""
    both = edges.select("a", "b", "pmi").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "pmi"))
    return both.groupBy("a").pivot("b", list(labels)).agg(F.first("pmi")).na.fill(0.0)


def gexf(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row (value) with a GEXF document of a small network, made by aggregation: nodes (lemma, freq), edges (a, b, pmi)."""
    node = F.concat(F.lit('<node id="'), xml_escape(F.col("lemma")), F.lit('" label="'), xml_escape(F.col("lemma")), F.lit('"/>'))
    edge = F.concat(F.lit('<edge source="'), xml_escape(F.col("a")), F.lit('" target="'), xml_escape(F.col("b")), F.lit('" weight="'), F.col("pmi").cast("string"), F.lit('"/>'))
    joined = lambda rows, text: rows.select(text.alias("x")).agg(F.array_join(F.array_sort(F.collect_list("x")), "").alias("x"))
    left, right = joined(nodes, node).withColumnRenamed("x", "n"), joined(edges, edge).withColumnRenamed("x", "e")
    head = '<?xml version="1.0" encoding="UTF-8"?><gexf xmlns="http://gexf.net/1.3" version="1.3"><graph defaultedgetype="undirected"><nodes>'
    return left.crossJoin(right).select(F.concat(F.lit(head), "n", F.lit("</nodes><edges>"), "e", F.lit("</edges></graph></gexf>")).alias("value"))


def first_seen_order(rows: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """The running rank of each row in its album, by id, whatever the albums' sizes."""
    return Ordered(rows, by, [order]).scan(rank=("sum", None)).rows
