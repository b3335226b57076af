"""Table functions: a row for each token of a text, a row for each segment of a subtitle file; in SQL and as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.lexical import TOKEN
from tessera.sources.files import parse_srt


def register(spark: SparkSession) -> None:
    """Gives the session the SQL function tokens_of(text), to be used as `from documents, lateral tokens_of(text)`: (pos, token, lemma)."""
    spark.sql(f"""
        create or replace temporary function tokens_of(body string) returns table (pos int, token string, lemma string)
        return select pos, token, lower(token) from posexplode(regexp_extract_all(body, r'{TOKEN}', 0)) as found(pos, token)""")


def segments_of(rows: DataFrame, text: Column, *keep: str) -> DataFrame:
    """(keep.., number, start, end, text): a row for each segment of each subtitle file in `text`; malformed files have none."""
    return rows.select(*keep, F.posexplode(parse_srt(text)).alias("i", "s")).select(*keep, (F.col("i") + 1).alias("number"), "s.start", "s.end", "s.text")
