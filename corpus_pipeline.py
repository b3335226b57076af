"""A corpus pipeline of five stages: language ID, line dedup, SimHash dedup, mixing to target weights, SentencePiece encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. `run` writes each stage's rows as Parquet to the shared folder
and reads them again for the next one, so no stage's lineage reaches into another's. All but the last return documents' columns, and any others that
the input has, whatever their names; the last has its own. Very long texts go through every stage whole. An empty table gives an empty one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import langid, line_dedup, mixing, pieces, simhash
from tessera.llm.common import durable
from tessera.llm.queries import TOKENIZERS
from tessera.operators.ordering import shared_folder
from tessera.session import ship

#: Words of a shingle in the near-duplicate stage, and the bits of 64 that linked fingerprints differ in at most. Of pairs with random bits
#: one in 2 * 10^10 is within seven, and one in 10^8 within ten: half a million pairs in ten million texts.
SHINGLE, BUDGET = 5, 7
#: A document whose language has a posterior below this is rejected, as is one without letters.
LEAST_SCORE = 0.5


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is told; a missing lang is filled in. Rows that repeat are judged alike, nulls in other
    columns stay, a null text goes (it has no language). Of languages that score alike the first by name is taken. Where no row has a lang, nothing can be
    learned and all rows go."""
    ship(spark)
    found = langid.identify(docs, langid.fit(docs), carry=docs.columns)
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    value = lambda i, c: F.coalesce(f"carry_{i}", "lang_pred") if c == "lang" else F.col(f"carry_{i}")
    return kept.select(*(value(i, c).alias(c) for i, c in enumerate(docs.columns)))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that are at most one edit from an earlier one, by id, then the text's hash; rows without id come last. n_chars follows the text. Documents
    stay, also if nothing is left; rows that repeat lose the same lines; a null text stays null."""
    ship(spark)
    rows = line_dedup.line_dedup(docs)
    return rows.select(*(F.char_length("text").cast("long").alias(c) if c == "n_chars" else c for c in docs.columns))


def _keyed(docs: DataFrame) -> DataFrame:
    """With the place of a row: its id (null last) and its text's hash. Rows that repeat share it."""
    return docs.withColumns({"__key_id": F.coalesce("doc_id", F.lit(2**63 - 1)), "__key_text": F.xxhash64("text")})


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of like fingerprints of five-word shingles (BUDGET bits apart at most): that with the least doc_id (then by the text's hash; rows without id
    last). Texts without words have the fingerprint 0 and are a group like any other. Of rows that repeat, one stays."""
    ship(spark)
    found = simhash.near_duplicates(_keyed(docs), BUDGET, carry=["__key_id", "__key_text"], words=SHINGLE)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("carry_0").alias("__key_id"), F.col("carry_1").alias("__key_text"))).alias("first"))
    kept = _keyed(docs).join(durable(first.select("first.*")), ["__key_id", "__key_text"], "left_semi")
    return kept.dropDuplicates(["__key_id", "__key_text"]).select(*docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it: none, one or two rows. Documents without words are not taken. Draws depend on ids
    and texts alone, so reruns agree; of rows that repeat both, the first in the order of their other columns are taken once more."""
    ship(spark)
    mixed = mixing.mix(_keyed(docs), carry=["__key_id", "__key_text"])
    taken = mixed.groupBy("__key_id", "__key_text").agg(F.sum(F.size("shards")).alias("__times"), F.count("*").alias("__rows"))
    others = [f.name for f in docs.schema.fields if f.name not in ("doc_id", "text") and f.dataType.typeName() in ("string", "long", "integer", "double")]
    place = F.row_number().over(Window.partitionBy("__key_id", "__key_text").orderBy(F.lit(1), *others))
    rows = _keyed(docs).join(durable(taken.where("__times > 0")), ["__key_id", "__key_text"]).withColumn("__place", place)
    times = F.floor(F.col("__times") / F.col("__rows")) + (F.col("__place") <= F.col("__times") % F.col("__rows")).cast("int")
    return rows.where(times > 0).withColumn("__copy", F.explode(F.sequence(F.lit(1), times.cast("int")))).select(*docs.columns)


def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, lang, n_pieces, ids, round_trip) of each row; source and lang are null where the input has no such column. A null text and an empty one
    have no pieces. Rows that repeat are encoded alike. Other columns go."""
    ship(spark)
    model = Path(TOKENIZERS, "piece_bpe_32k.model").read_bytes()
    own = [F.col(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("doc_id", "source", "lang")]
    whole = docs.select(F.struct(*own).alias("doc_id"), "text")  # the operator passes its key through
    return pieces.encode(whole, model).select("doc_id.*", "n_pieces", "ids", "round_trip")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", by_language),
    ("line dedup", without_repeated_lines),
    ("SimHash near-dedup", one_of_each_group),
    ("mixing to target weights", mixed_sources),
    ("SentencePiece encoding", as_pieces),
]

#: The language model and the mixing draws are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's folder goes when the next one is written; the last one stays for the reader."""
    base = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{number}")
        docs = spark.read.parquet(f"{base}/{number}")
        if number:
            before = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{number - 1}")
            before.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(before, True)
    return docs
