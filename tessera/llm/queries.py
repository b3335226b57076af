"""The thin queries over whole tables, one for each corpus operator, and the SQL of those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import backoff, bottom_k, conversations, embeddings, hilbert_shards, langid, line_dedup, mixing, pieces, secret_scan, simhash, spelling, wordpiece
from tessera.session import ship

#: Folder of the public tokenizers' files; a parameter of the queries that need one.
TOKENIZERS = os.environ.get("TESSERA_TOKENIZERS", "/opt/tokenizers")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/documents.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.secret_scan(documents(spark, sf_dir)))


def op2_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards.hilbert_shards(documents(spark, sf_dir), shards=8, law="rows")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.fit(docs.where(~langid.held_out()).select("doc_id", "text", "lang"))
    return langid.identify(docs, model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bottom_k.fingerprints(documents(spark, sf_dir))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(documents(spark, sf_dir).select("doc_id", "text"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(ship(spark).read.parquet(f"{sf_dir}/embeddings.parquet"))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.array_join(F.col("shards").cast("array<string>"), ",").alias("shards"), "order")


def op9_token_counts(spark: SparkSession, sf_dir: str, folder: str = TOKENIZERS) -> DataFrame:
    return wordpiece.token_counts(documents(spark, sf_dir), wordpiece.read_ranks(Path(folder, "byte_bpe_50k.tiktoken").read_bytes()))


def op10_pieces(spark: SparkSession, sf_dir: str, folder: str = TOKENIZERS) -> DataFrame:
    found = pieces.encode(documents(spark, sf_dir), Path(folder, "piece_bpe_32k.model").read_bytes())
    return found.select("doc_id", "n_pieces", "ids", "round_trip")


def op11_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff.scores(documents(spark, sf_dir).select("doc_id", "text", backoff.held_out().alias("held")))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ship(spark).read.parquet(f"{sf_dir}/conversations.parquet")
    return conversations.report(rows, conversations.damage(rows))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_secret_scan, op2_hilbert_shards, op3_language_id, op4_fingerprints, op5_line_dedup, op6_embedding_dedup, op7_simhash_dedup, op8_mixing, op9_token_counts, op10_pieces, op11_lm_scores, op12_spelling_variants, op13_conversation_repair)
}


def _spans(kind: str, number: int, pattern: str, least: str) -> str:
    """SQL for a rule's spans: matches, and the gaps between them for the positions."""
    quoted = pattern.replace("'", "''")
    return f"""
select doc_id, {number} as ord, '{kind}' as kind, start_, start_ + length(m) as end_
from (
  select doc_id, m, sum(length(gap) + length(m)) over (partition by doc_id order by i) - length(m) as start_
  from (
    select doc_id, unnest(ms) as m, unnest(list_slice(gaps, 1, len(ms))) as gap, unnest(range(1, len(ms) + 1)) as i
    from (select doc_id, regexp_extract_all(t, '{quoted}') as ms, string_split_regex(t, '{quoted}') as gaps from texts)
  )
)
where {least}"""


def _secret_sql() -> str:
    rules = secret_scan.BASE + secret_scan.EXTRA
    values = {"assign": "length(regexp_extract(m, '{0}', 2)) >= 6"}
    parts = [_spans(r.kind, n, r.pattern, values.get(r.kind, "true").replace("{0}", r.pattern.replace("'", "''"))) for n, r in enumerate(rules)]
    span = "kind || ':' || cast(start_ as bigint) || ':' || cast(end_ as bigint)"
    return f"""
with texts as (select doc_id, coalesce(text, '') as t from documents),
spans as ({" union all ".join(parts)}),
sums as (
  select doc_id, count(*) filter (where ord = 0) as n_assign, count(*) filter (where ord = 1) as n_access, count(*) filter (where ord = 2) as n_hex,
    coalesce(string_agg({span}, ',' order by start_, ord) filter (where ord < 3), '') as base,
    string_agg({span}, ',' order by start_, ord) as spans
  from spans group by doc_id
)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from documents d left join sums using (doc_id)"""


#: Pairs of distinct lines are found by an equal first or second half, one of which two lines at distance one share. The distance is
#: spelt out, in characters: the database's own works on bytes.
LINES_SQL = r"""
with raw as (
  select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as i from documents where text is not null
),
occ as (select * from raw where regexp_matches(line, '[^\s]')),
lines as (select line, min(doc_id * 1000000 + i) as first, length(line) as n from occ group by line),
classes as (
  select line, first, n, n as m from lines union all select line, first, n, n - 1 from lines
),
keys as (
  select *, 'h' || left(line, m // 2) as k from classes
  union all select *, 't' || right(line, m - m // 2) from classes
),
late as (
  select distinct case when a.first > b.first then a.line else b.line end as line
  from keys a join keys b on a.k = b.k and a.m = b.m and a.n = a.m and a.line <> b.line
  where case when a.n = b.n then len(list_filter(range(1, a.n + 1), lambda x: substr(a.line, x, 1) <> substr(b.line, x, 1))) = 1
    else len(list_filter(range(0, b.n), lambda x: left(b.line, x) || substr(b.line, x + 2) = a.line)) > 0 end
),
gone as (
  select doc_id, i from occ join lines using (line) left join late on late.line = occ.line
  where late.line is not null or doc_id * 1000000 + i <> first
),
kept as (
  select r.doc_id, string_agg(r.line, chr(10) order by r.i) filter (where g.i is null) as text, count(*) as n_lines, count(*) filter (where g.i is null) as n_kept
  from raw r left join gone g on r.doc_id = g.doc_id and r.i = g.i group by r.doc_id
)
select d.doc_id, case when d.text is null then null else coalesce(k.text, '') end as text, coalesce(n_lines, 0) as n_lines, coalesce(n_kept, 0) as n_kept
from documents d left join kept k using (doc_id)"""

VECTORS_SQL = """
with recursive v as (
  select vec_id, cast(embedding as double[]) as e from embeddings
),
links as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.95
),
reach as (
  select vec_id, vec_id as root from v
  union
  select l.b, r.root from reach r join links l on l.a = r.vec_id
)
select v.vec_id, (select count(*) from links where a = v.vec_id) as n_links, c.component_id, v.vec_id = c.component_id as kept
from v join (select vec_id, min(root) as component_id from reach group by vec_id) c using (vec_id)"""

ORACLE = {"op1_secret_scan": _secret_sql(), "op5_line_dedup": LINES_SQL, "op6_embedding_dedup": VECTORS_SQL}
