"""Lexicometry queries over documents (languages stand for phases) and conversations (roles stand for sources)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.operators import concordance, lexical, summaries
from tessera.operators.ordering import shared_folder
from tessera.plans.registry import TOKENS_SQL, chi2_sql, query, table


def _tokens(spark, d):
    return lexical.tokens(table(spark, d, "documents"), keep=("doc_id", "lang", "source"))


def _lists(spark, d):
    return concordance.token_lists(table(spark, d, "documents"))


_TURNS_SQL = r"""tok as (
  select conv_id * 1000 + turn as doc_id, role, unnest(ts) as lemma, unnest(range(len(ts))) as pos
  from (select conv_id, turn, role, regexp_extract_all(lower(text), '[\p{L}_][\p{L}\p{N}_]*') as ts from conversations)
)"""


def _turns(spark, d):
    c = table(spark, d, "conversations").withColumn("doc_id", F.col("conv_id") * 1000 + F.col("turn"))
    return lexical.tokens(c, keep=("doc_id", "role"))


def _stats_sql(by: str) -> str:
    return f"""with {TOKENS_SQL}, c as (select {by}, lemma, count(*) as n from tok group by all),
m as (select {by}, count(distinct doc_id) as messages from tok group by all)
select {by}, messages, cast(sum(n) as bigint) as tokens, count(*) as types, round(count(*) / sum(n), 4) as ttr, count(*) filter (where n = 1) as hapax
from c join m using ({by}) group by {by}, messages"""


@query("A10_lexical_stats", _stats_sql("lang"))
def _(spark, d):
    return lexical.lexical_stats(_tokens(spark, d), ["lang"])


@query("A11_period_stats", _stats_sql("source"))
def _(spark, d):
    return lexical.lexical_stats(_tokens(spark, d), ["source"])


@query("P23_token_filter", f"with {TOKENS_SQL} select lang, count(*) as n from tok where length(lemma) >= 3 and lemma not in ('the', 'les', 'der', 'que', 'und') group by 1")
def _(spark, d):
    stop = spark.createDataFrame([(x,) for x in ("the", "les", "der", "que", "und")], "lemma string")
    return lexical.filter_tokens(_tokens(spark, d), stop, least=3).groupBy("lang").agg(F.count("*").alias("n"))


@query("P25_sources", "with p as (select doc_id, trim(case when doc_id % 3 = 0 then '' else lang end) as c, case when doc_id % 10 / 10 >= .5 then source else '' end as s, case when doc_id % 7 = 0 then '' else 'x' end as o from documents) select * from (select doc_id, 'caption' as source, c as text from p union all select doc_id, 'dialogue', s from p union all select doc_id, 'ocr', o from p union all select doc_id, 'combined', array_to_string(list_filter([c, s, o], lambda x: x <> ''), ' ') from p) where text <> ''")
def _(spark, d):
    i = F.col("doc_id")
    rows = table(spark, d, "documents").select("doc_id", F.when(i % 3 == 0, " ").otherwise(F.col("lang")).alias("c"), F.col("source").alias("s"), F.when(i % 7 != 0, "x").alias("o"), ((i % 10) / 10).alias("conf"))
    return lexical.sources_of(rows, "c", "s", "o", "conf", least=0.5, keep=["doc_id"])


@query("L1_token_table", f"with {TOKENS_SQL} select doc_id, cast(pos as integer) as pos, lemma from tok")
def _(spark, d):
    return _tokens(spark, d).select("doc_id", "pos", "lemma")


@query("L2_tf_idf", f"""with {TOKENS_SQL}, tf as (select lang, lemma, count(*) as tf from tok group by 1, 2), g as (select count(distinct lang) as n from tf),
df as (select lemma, count(*) as df from tf group by 1),
r as (select lang, lemma, tf, tf * (ln((1 + n) / (1 + df)) + 1) as raw from tf join df using (lemma), g),
s as (select lang, lemma, tf, round(raw / sqrt(sum(raw * raw) over (partition by lang)), 6) as score from r)
select lang, lemma, tf, score, row_number() over (partition by lang order by score desc, lemma) as rank from s qualify rank <= 20""")
def _(spark, d):
    return lexical.tf_idf(_tokens(spark, d), "lang").select("lang", "lemma", "tf", "score", F.col("rank").cast("long").alias("rank"))


_VOLCANO_SQL = f"""with {TOKENS_SQL}, c as (select lang, lemma, count(*) as c from tok group by 1, 2), t as (select lang, sum(c) as t from c group by 1),
k as (select lemma from c group by 1 having max(c) >= 20),
p as (select a.lang as a, b.lang as b, a.t as ta, b.t as tb from t a join t b on a.lang < b.lang),
j as (select p.*, k.lemma, coalesce(x.c, 0) as ca, coalesce(y.c, 0) as cb from p cross join k left join c x on x.lang = p.a and x.lemma = k.lemma left join c y on y.lang = p.b and y.lemma = k.lemma),
s as (select *, cast(ca + cb as double) as r1, cast(ta + tb as double) as n, abs(ca - (ca + cb) * ta / cast(ta + tb as double)) as delta from j where ca + cb > 0),
v as (select a, b, lemma, ca, cb, round(log2(((cb + .5) / tb) / ((ca + .5) / ta)), 4) as log2fc,
  round((delta - least(.5, delta)) * (delta - least(.5, delta)) * n * n * n / (r1 * (n - r1) * ta * tb), 4) as chi2 from s)"""


@query("L3_volcano", _VOLCANO_SQL + " select * from v")
def _(spark, d):
    return lexical.volcano(_tokens(spark, d), "lang", 20)


@query("L3_volcano_p")
def _(spark, d):
    """The same with p-values and their adjustment; there is no erfc in SQL."""
    from tessera.operators.classify import significant
    from tessera.operators.statistics import adjust, normal_p

    rows = lexical.volcano(_tokens(spark, d), "lang", 20).withColumn("p", F.coalesce(normal_p(F.sqrt("chi2")), F.lit(1.0)))
    adjusted = adjust(rows, "p", ["a", "b"])
    logs = F.least(F.lit(50.0), -F.log10(F.greatest("p_adj", F.lit(1e-300))))
    return adjusted.withColumns({"neg_log10_p": F.round(logs, 4), "side": significant(F.col("p_adj"), F.col("log2fc"), F.greatest("ca", "cb"))})


@query("W13_adjust", _VOLCANO_SQL + ", r as (select a, b, lemma, exp(-chi2 / 2) as p, row_number() over (partition by a, b order by exp(-chi2 / 2), lemma) as k, count(*) over (partition by a, b) as m from v where chi2 is not null) select a, b, lemma, round(least(1.0, min(p * m / k) over (partition by a, b order by k desc rows unbounded preceding)), 6) as p_adj from r")
def _(spark, d):
    from tessera.operators.statistics import adjust

    rows = lexical.volcano(_tokens(spark, d), "lang", 20).where("chi2 is not null").withColumn("p", F.exp(-F.col("chi2") / 2))
    return adjust(rows, "p", ["a", "b"]).select("a", "b", "lemma", F.round("p_adj", 6).alias("p_adj"))


@query("P26_typical", _VOLCANO_SQL + " select a, b, lemma, case when exp(-chi2 / 2) < .05 and abs(log2fc) >= 1 and greatest(ca, cb) >= 5 then case when log2fc > 0 then 'b' else 'a' end else 'ns' end as side from v")
def _(spark, d):
    from tessera.operators.classify import significant

    rows = lexical.volcano(_tokens(spark, d), "lang", 20)
    return rows.select("a", "b", "lemma", significant(F.exp(-F.col("chi2") / 2), F.col("log2fc"), F.greatest("ca", "cb")).alias("side"))


_G2 = " + ".join(f"case when o{i} > 0 and e{i} > 0 then o{i} * ln(o{i} / e{i}) else 0 end" for i in range(4))


def _collocation_sql(by: str, least: int, top: int) -> str:
    group = f"{by}, " if by else ""
    part = f"partition by {by} " if by else ""
    on = f"using ({by})" if by else "on true"
    key = f"and f.{by} = b.{by}" if by else ""
    key2 = f"and g.{by} = b.{by}" if by else ""
    n = lambda c, t, v: f"(select {group}sum({c}) as {v} from {t} {f'group by {by}' if by else ''})"
    return f"""with {TOKENS_SQL}, n as (select {group}doc_id, lemma as w1, lead(lemma) over (partition by doc_id order by pos) as w2 from tok),
b as (select {group}w1, w2, count(*) as n from n where w2 is not null and w1 <> w2 group by all), f as (select {group}lemma, count(*) as f from tok group by all),
j as (select b.*, f.f as f1, g.f as f2, np, nw from b join f on f.lemma = b.w1 {key} join f g on g.lemma = b.w2 {key2} join {n('n', 'b', 'np')} x {on if not by else f'on x.{by} = b.{by}'} join {n('f', 'f', 'nw')} y {on if not by else f'on y.{by} = b.{by}'} where n >= {least}),
o as (select *, cast(n as double) as o0, cast(f1 - n as double) as o1, cast(f2 - n as double) as o2, cast(np - f1 - f2 + n as double) as o3 from j),
e as (select *, (o0 + o1) * (o0 + o2) / np as e0, (o0 + o1) * (o1 + o3) / np as e1, (o2 + o3) * (o0 + o2) / np as e2, (o2 + o3) * (o1 + o3) / np as e3 from o where o1 >= 0 and o2 >= 0 and o3 >= 0),
s as (select {group}w1, w2, n as count, f1 as freq_w1, f2 as freq_w2, round(2 * ({_G2}), 3) as g2, round(log2((o0 / np) / ((cast(f1 as double) / nw) * (cast(f2 as double) / nw))), 4) as pmi from e)
select {group}w1, w2, count, freq_w1, freq_w2, g2, pmi from s qualify row_number() over ({part}order by g2 desc, w1, w2) <= {top}"""


@query("L4_collocations", _collocation_sql("", 5, 200))
def _(spark, d):
    return lexical.collocations(lexical.followed(table(spark, d, "documents"), keep=()))


@query("L4_collocations_by_phase", _collocation_sql("lang", 4, 100))
def _(spark, d):
    return lexical.collocations(lexical.followed(table(spark, d, "documents"), keep=["lang"]), ["lang"], least=4, top=100).drop("rank")


def cooccurrence_sql(threshold: float, top: int = 60) -> str:
    return f"""{TOKENS_SQL}, f as (select lang, lemma, count(*) as f from tok group by 1, 2), vocab as (select lang, lemma from f qualify row_number() over (partition by lang order by f desc, lemma) <= {top}),
t as (select tok.* from tok join vocab using (lang, lemma)),
p as (select distinct x.lang, x.doc_id, least(x.lemma, y.lemma) as a, greatest(x.lemma, y.lemma) as b from t x join t y on x.doc_id = y.doc_id and y.pos - x.pos between 1 and 5 and x.lemma <> y.lemma),
c as (select lang, a, b, count(*) as count from p group by all having count(*) >= 3), df as (select lang, lemma, count(distinct doc_id) as df from t group by 1, 2), n as (select lang, count(distinct doc_id) as n from tok group by 1),
edges as (select c.lang, a, b, count, round(log2(count * n / cast(x.df * y.df as double)), 4) as pmi from c join n using (lang) join df x on x.lang = c.lang and x.lemma = a join df y on y.lang = c.lang and y.lemma = b
where round(log2(count * n / cast(x.df * y.df as double)), 4) >= {threshold})"""


def _edges(spark, d, threshold=-0.5):
    return lexical.cooccurrence(table(spark, d, "documents"), window=5, top=60, least=3, threshold=threshold, by=["lang"])


#: Networks: words commoner than these stand together in nearly every document, so their edges' PMI is negative.
NETWORK = {"top": 400, "threshold": 0.1}


def network_edges(spark, d):
    return lexical.cooccurrence(table(spark, d, "documents"), window=5, least=3, by=["lang"], **NETWORK)


@query("L5_cooccurrence", f"with {cooccurrence_sql(-0.5)} select * from edges")
def _(spark, d):
    return _edges(spark, d)


@query("L6_matrix", f"with {cooccurrence_sql(-0.5)} select lang, a, b, count, pmi from edges union all select lang, b, a, count, pmi from edges")
def _(spark, d):
    return lexical.symmetric(_edges(spark, d)).select("lang", "a", "b", "count", "pmi")


_KWIC_SQL = f"""with {TOKENS_SQL}, h as (select lang, doc_id, pos as hit from tok where lemma = 'with'),
w as (select h.lang, h.doc_id, h.hit, t.pos, t.lemma from h join tok t on t.doc_id = h.doc_id and t.pos between h.hit - 4 and h.hit + 4)"""


@query("L7_kwic", _KWIC_SQL + " select lang, doc_id, cast(hit as integer) as pos, coalesce(string_agg(lemma, ' ' order by pos) filter (where pos < hit), '') as before, 'with' as target, coalesce(string_agg(lemma, ' ' order by pos) filter (where pos > hit), '') as after from w group by 1, 2, 3")
def _(spark, d):
    return concordance.concordance(_lists(spark, d), ["with"], 4)


_TARGETS_SQL = f"""with {TOKENS_SQL}, h as (select lang, doc_id, pos as hit, lemma as target from tok where lemma in ('with', 'the', 'ung', 'ción')),
w as (select h.lang, h.doc_id, h.hit, target, t.pos, t.lemma from h join tok t on t.doc_id = h.doc_id and t.pos between h.hit - 3 and h.hit + 3)
select lang, doc_id, cast(hit as integer) as pos, coalesce(string_agg(lemma, ' ' order by pos) filter (where pos < hit), '') as before, target, coalesce(string_agg(lemma, ' ' order by pos) filter (where pos > hit), '') as after from w group by lang, doc_id, hit, target"""
_TARGETS = ["with", "the", "ung", "ción"]


@query("L7_several_targets", _TARGETS_SQL)
def _(spark, d):
    return concordance.concordance(_lists(spark, d), _TARGETS, 3)


@query("L7_by_index", _TARGETS_SQL)
def _(spark, d):
    """The same from a positional index that is written first."""
    path = f"{shared_folder(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
    concordance.write_index(_lists(spark, d), path)
    return concordance.indexed_concordance(_lists(spark, d), concordance.read_index(spark, path, _TARGETS), 3)


@query("L7_postings", f"with {TOKENS_SQL}, g as (select lemma, doc_id, pos, pos - coalesce(lag(pos) over (partition by lemma, doc_id order by pos), 0) as gap from tok) select lemma, doc_id, string_agg(gap, ',' order by pos) as gaps from g group by 1, 2")
def _(spark, d):
    return concordance.postings(_lists(spark, d)).select("lemma", "doc_id", F.array_join(F.col("gaps").cast("array<string>"), ",").alias("gaps"))


@query("L8_kwic_summary", f"""with {TOKENS_SQL}, f as (select lang, lemma, count(*) as f from tok group by 1, 2), n as (select lang, sum(f) as n, sum(f) filter (where lemma = 'with') as nt from f group by 1),
h as (select doc_id, pos as hit from tok where lemma = 'with'),
c as (select * from (select lang, case when pos < hit then 'left' else 'right' end as position, lemma as neighbor, count(*) as count from tok join h using (doc_id) where lemma <> 'with' and abs(pos - hit) <= 4 group by 1, 2, 3)
  qualify row_number() over (partition by lang, position order by count desc, neighbor) <= 10)
select c.lang, position, neighbor, count, round(log2(count * n / (nt * 4.0 * f)), 3) as pmi_local, cast(nt as bigint) as n_target from c join f on f.lang = c.lang and f.lemma = neighbor join n on n.lang = c.lang""")
def _(spark, d):
    return concordance.neighbours(_lists(spark, d), "with", "lang", 4, 10)


_DEGREES = "(select lang, a as lemma, pmi from edges union all select lang, b, pmi from edges)"


@query("L9_degrees", f"with {cooccurrence_sql(**NETWORK)} select lang, lemma, count(*) as degree, cast(round(sum(cast(pmi as decimal(20,4))), 3) as double) as weighted_degree from {_DEGREES} group by 1, 2")
def _(spark, d):
    from tessera.operators.graphs import degrees

    return degrees(network_edges(spark, d), ["lang"])


@query("L9_density", f"with {cooccurrence_sql(**NETWORK)}, v as (select lang, count(distinct lemma) as nodes from {_DEGREES} group by 1), e as (select lang, count(*) as edges from edges group by 1) select lang, nodes, edges, round(2.0 * edges / (nodes * (nodes - 1)), 6) as density from v join e using (lang)")
def _(spark, d):
    from tessera.operators.graphs import density

    return density(network_edges(spark, d), ["lang"])


@query("L9_centralities")
def _(spark, d):
    from tessera.operators.graphs import centralities

    return centralities(network_edges(spark, d), ["lang"])


@query("L10_evolution")
def _(spark, d):
    from tessera.operators.graphs import centralities

    nodes = centralities(network_edges(spark, d), ["lang"]).withColumnRenamed("lang", "phase")
    freq = _tokens(spark, d).groupBy(F.col("lang").alias("phase"), "lemma").agg(F.count("*").alias("freq"))
    return lexical.evolution(nodes.join(freq, ["phase", "lemma"]), ["de", "en", "es", "fr"])


@query("J7_edges_of_nodes", f"with {cooccurrence_sql(**NETWORK)}, v as (select lang, lemma from {_DEGREES} group by 1, 2 having count(*) > 4) select e.lang, a, b, count, pmi from edges e join v x on x.lang = e.lang and x.lemma = a join v y on y.lang = e.lang and y.lemma = b")
def _(spark, d):
    from tessera.operators.graphs import degrees

    edges = network_edges(spark, d)
    kept = degrees(edges, ["lang"]).where("degree > 4").select("lang", "lemma")
    left = edges.join(kept.withColumnRenamed("lemma", "a"), ["lang", "a"], "left_semi")
    return left.join(kept.withColumnRenamed("lemma", "b"), ["lang", "b"], "left_semi").select("lang", "a", "b", "count", "pmi")


_TOPS = "c as (select role, lemma, count(*) as f from tok where role in ('user', 'assistant') group by 1, 2), r as (select *, row_number() over (partition by role order by f desc, lemma) as k from c)"


@query("L14_divergence", f"with {_TURNS_SQL}, {_TOPS}, n as (select unnest([20, 50, 100, 200]) as top_n), s as (select top_n, lemma, max(case when role = 'user' then 1 else 0 end) as x, max(case when role = 'assistant' then 1 else 0 end) as y from r, n where k <= top_n group by 1, 2), z as (select top_n, sum(x) as a, sum(y) as b, sum(x * y) as i from s group by 1) select top_n, round(i / (a + b - i), 4) as jaccard, round(2 * i / (a + b), 4) as dice, round(i / least(a, b), 4) as overlap, cast(i as bigint) as n_shared from z")
def _(spark, d):
    return lexical.divergence(_turns(spark, d), "role", "user", "assistant")


@query("U4_only_in", f"with {_TURNS_SQL}, {_TOPS} select lemma, row_number() over (order by k) as rank from r where role = 'user' and k <= 50 and lemma not in (select lemma from r where role = 'assistant' and k <= 50)")
def _(spark, d):
    only = lexical.only_in(_turns(spark, d), "role", "user", "assistant", 50)
    return only.select("lemma", F.col("rank").cast("long").alias("rank"))


@query("L14_shared_chi2", f"with {_TURNS_SQL}, {_TOPS}, s as (select lemma from r where k <= 50 group by 1 having count(*) = 2), o as (select role, lemma, cast(f as double) as o from r where lemma in (select lemma from s)), e as (select *, sum(o) over (partition by role) * sum(o) over (partition by lemma) / sum(o) over () as e, sum(o) over () as n from o) select round(sum((o - e) * (o - e) / e), 4) as chi2, cast((count(distinct role) - 1) * (count(distinct lemma) - 1) as bigint) as df, round(sqrt(sum((o - e) * (o - e) / e) / (max(n) * (least(count(distinct role), count(distinct lemma)) - 1))), 4) as v, round({chi2_sql('sum((o - e) * (o - e) / e)', '(count(distinct role) - 1) * (count(distinct lemma) - 1)')}, 6) as p from e")
def _(spark, d):
    return lexical.shared_chi2(_turns(spark, d), "role", "user", "assistant", 50)


@query("L16_ratio", f"with {_TURNS_SQL}, t as (select doc_id % 7 as period, count(*) filter (where role = 'user') as n_one, count(*) filter (where role = 'assistant') as n_other from tok where role in ('user', 'assistant') group by 1) select period, n_one, n_other, case when n_other > 0 then round(n_one / n_other, 4) end as ratio, round(100.0 * n_one / (n_one + n_other), 4) as share from t")
def _(spark, d):
    rows = _turns(spark, d).withColumn("period", F.col("doc_id") % 7)
    return lexical.period_ratio(rows, "period", "role", "user", "assistant")


@query("A18_document_terms", f"with {TOKENS_SQL}, v as (select lemma from tok group by 1 order by count(*) desc, lemma limit 100), s as (select doc_id from tok group by 1 having count(*) >= 5) select doc_id, lemma, count(*) as n from tok where lemma in (select lemma from v) and doc_id in (select doc_id from s) group by 1, 2")
def _(spark, d):
    return lexical.document_terms(_tokens(spark, d), 100, 5)


@query("A19_documents_as_lists", f"with {TOKENS_SQL} select doc_id, string_agg(lemma, ' ' order by pos) as lemmas from tok group by 1")
def _(spark, d):
    return _lists(spark, d).where("size(tokens) > 0").select("doc_id", F.array_join("tokens", " ").alias("lemmas"))


@query("U5_vocabulary", f"with {TOKENS_SQL}, c as (select lang, lemma, count(*) as n from tok group by 1, 2) select lemma from c group by 1 having max(n) >= 10")
def _(spark, d):
    counts = _tokens(spark, d).groupBy("lang", "lemma").agg(F.count("*").alias("n"))
    return counts.groupBy("lemma").agg(F.max("n").alias("m")).where("m >= 10").select("lemma")


@query("L12_contingency", f"with {TOKENS_SQL}, v as (select lemma, count(distinct doc_id) as documents from tok group by 1 having count(*) >= 5 and count(distinct doc_id) >= 3 order by count(*) desc, lemma limit 150) select lang, lemma, documents, count(*) as n from tok join v using (lemma) group by all")
def _(spark, d):
    from tessera.operators.factors import correspondence_table

    return correspondence_table(_tokens(spark, d), "lang").select("lang", "lemma", "documents", "n")


@query("L12_correspondence")
def _(spark, d):
    from tessera.operators.factors import correspondence_analysis, correspondence_table

    return correspondence_analysis(correspondence_table(_tokens(spark, d), "lang"), "lang")


def _clusters(spark, d):
    from tessera.operators.factors import ward_clusters

    vectors = lexical.tf_idf_vectors(_tokens(spark, d), 200)
    return ward_clusters(vectors, "doc_id", "vector", 3).join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")


@query("L13_ward")
def _(spark, d):
    """Documents' clusters; migrants are not in the commonest cluster of their language."""
    found = _clusters(spark, d)
    home = summaries.modal(found, ["lang"], "cluster", "home")
    return found.join(F.broadcast(home.select("lang", "home")), "lang", "left").select("doc_id", "lang", "cluster", (F.col("cluster") != F.col("home")).alias("migrant"))


@query("L13_clusters_by_phase")
def _(spark, d):
    from tessera.operators.statistics import chi_square, contingency

    return chi_square(contingency(_clusters(spark, d), "cluster", "lang"))


def _chosen(spark, d):
    from tessera.operators import topics

    return topics.choose(_lists(spark, d).select("doc_id", F.col("tokens").alias("lemmas")))


@query("L11_topics")
def _(spark, d):
    """The final model at the number of topics of best coherence: each topic's words, and each document's topics."""
    from tessera.operators import topics

    found = _chosen(spark, d)
    words = [("word", t, i + 1, lemma, None, w) for t, own in enumerate(found.words) for i, (lemma, w) in enumerate(own)] if found else []
    named = spark.createDataFrame(words, "kind string, topic int, rank int, lemma string, doc_id long, weight double")
    if not found:
        return named
    each = topics.document_topics(found.model, found.rows, "doc_id").select("doc_id", F.posexplode("gamma").alias("topic", "weight"))
    return named.unionByName(each.select(F.lit("document").alias("kind"), "topic", F.lit(None).cast("int").alias("rank"), F.lit(None).cast("string").alias("lemma"), "doc_id", "weight"))


@query("L11_choose")
def _(spark, d):
    """Coherence and perplexity for each number of topics from 3 to 10, and which is taken."""
    found = _chosen(spark, d)
    rows = [(k, round(c, 6), round(p, 6), k == found.k) for k, c, p in found.scores] if found else []
    return spark.createDataFrame(rows, "k int, coherence double, log_perplexity double, taken boolean")


@query("L15_toponyms", "with n as (select doc_id, lang, unnest(regexp_extract_all(text, '[A-ZÀ-Þ][a-zà-ÿ]{6,}')) as e from documents), l as (select lower(e) as entity, lang from n) select entity, count(*) filter (where lang = 'de') as de, count(*) filter (where lang = 'en') as en, count(*) filter (where lang = 'es') as es, count(*) filter (where lang = 'fr') as fr, count(*) filter (where lang in ('de', 'en', 'es', 'fr')) as total from l group by 1 having total >= 5")
def _(spark, d):
    from tessera.functions.text import entity_name

    found = F.explode(F.regexp_extract_all("text", F.lit("[A-ZÀ-Þ][a-zà-ÿ]{6,}"), F.lit(0)))
    rows = table(spark, d, "documents").select("lang", found.alias("e")).select("lang", entity_name(F.col("e")).alias("entity"))
    return summaries.crosstab(rows, "entity", "lang", ["de", "en", "es", "fr"]).where("total >= 5")
