"""The pipeline against a brute-force version on a small fixture, and its stages' handling of odd rows."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import common, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def small(spark, sf_dir, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("small"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    junk = spark.createDataFrame([(9001, "123 456 !!", None, "junk", 10), (9002, None, None, "junk", None)], DOCS)
    docs.unionByName(junk.select(*docs.columns)).write.parquet(f"{folder}/documents.parquet")
    return folder


def test_stages(small, spark):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language ID", "line dedup", "SimHash near-dedup", "mixing to target weights", "SentencePiece encoding"]
    kept = stages["language ID"](spark, docs, small)
    assert kept.columns == docs.columns and {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()} == {9001, 9002}
    lines = stages["line dedup"](spark, kept, small).cache()
    assert lines.columns == docs.columns and lines.count() == kept.count()
    found = [x for r in lines.collect() for x in r.text.split("\n") if re.search(r"\S", x)]
    assert max(Counter(found).values()) == 1 and all(r.n_chars == len(r.text) for r in lines.collect())
    one = stages["SimHash near-dedup"](spark, lines, small).cache()
    rows = sorted(lines.collect(), key=lambda r: r.doc_id)
    prints = np.array([simhash.fingerprint(r.text, 5) for r in rows], dtype=np.uint64)
    i, j = np.nonzero(np.triu(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 2, 1))
    lab = common.labels(len(rows), i, j)
    want = {rows[n].doc_id for n in set(lab)}
    assert {r.doc_id for r in one.collect()} == want and one.count() == len(want) and one.columns == docs.columns
    mixed = stages["mixing to target weights"](spark, one, small).cache()
    assert mixed.columns == docs.columns and max(Counter(r.doc_id for r in mixed.collect()).values()) <= 2
    words = lambda rows: sum(len((r.text or "").split()) for r in rows)
    assert words(mixed.collect()) == pytest.approx(1.5 * words(one.collect()), rel=0.05)
    last = stages["SentencePiece encoding"](spark, mixed, small)
    assert last.count() == mixed.count() and all(r.round_trip for r in last.collect())


def test_run_equals_its_stages(small, spark):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
    key = lambda r: (r.doc_id, tuple(r.ids))
    assert Counter(map(key, corpus_pipeline.run(spark, small).collect())) == Counter(map(key, docs.collect()))


@pytest.mark.parametrize("number", range(5))
def test_stages_on_odd_and_empty_tables(number, spark, tmp_path):
    odd = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (None, "the cat and the dog", "en", None, 19), (5, "die katze und der hund", "de", "b", 22),
        (5, "die katze und der hund", "de", "b", 22), (7, "the cat and the dog", None, "c", None), (8, "word " * 50_000, "en", "c", 250_000),
    ]
    _, stage = corpus_pipeline.STAGES[number]
    df = spark.createDataFrame(odd, DOCS)
    rows = stage(spark, df, str(tmp_path)).collect()
    assert rows and len(rows) <= 2 * len(odd)
    assert stage(spark, df.limit(0), str(tmp_path)).count() == 0


@pytest.mark.parametrize("number", range(5))
def test_stages_keep_columns_that_clash(number, spark, tmp_path):
    """Columns named as the operators' own: those before the last keep them with their values."""
    extra = ["lang_pred", "score", "carry_0", "n_lines", "n_kept", "fp", "root", "component_id", "size", "block", "shards", "order", "target", "taken", "ids", "n_pieces", "mark_", "part_", "h1", "line"]
    odd = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (None, "the cat and the dog", "en", None, 19), (5, "die katze und der hund", "de", "b", 22), (7, "the cat and the dog\nand more", None, "c", None)]
    df = spark.createDataFrame(odd, DOCS)
    for c in extra:
        df = df.withColumn(c, F.concat(F.lit(f"{c}-"), F.coalesce("doc_id", F.lit(0))))
    name, stage = corpus_pipeline.STAGES[number]
    found = stage(spark, df, str(tmp_path))
    rows = found.collect()
    assert rows
    if number < 4:
        assert found.columns == df.columns and all(r[c] == f"{c}-{r.doc_id or 0}" for r in rows for c in extra), name


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_mixed_rows_against_the_operator(small, spark):
    """A row as many times as the operator takes it, rows that repeat counted together."""
    from tessera.llm import mixing

    docs = spark.read.parquet(f"{small}/documents.parquet")
    docs = docs.unionByName(docs.limit(5)).unionByName(docs.limit(5))
    want: Counter = Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id] += len(r.shards)
    got = Counter(r.doc_id for r in dict(corpus_pipeline.STAGES)["mixing to target weights"](spark, docs, small).collect())
    assert got == +want


def test_near_copies_go(spark, tmp_path):
    """Texts with a word changed, whose fingerprints are more than two bits apart: the first of them stays."""
    pick = np.random.default_rng(3)
    first = [" ".join(f"w{x}" for x in pick.integers(0, 5000, 200)) for _ in range(40)]
    copies = [" ".join([*t.split()[:100], "changed", *t.split()[101:]]) for t in first]
    apart = [(simhash.fingerprint(x, 5) ^ simhash.fingerprint(y, 5)).bit_count() for x, y in zip(first, copies)]
    assert sum(2 < n <= 7 for n in apart) > 20
    df = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(first + copies)], DOCS)
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["SimHash near-dedup"](spark, df, str(tmp_path)).collect()}
    assert kept == {*range(40), *(40 + i for i, n in enumerate(apart) if n > 7)}
