"""Statistics, similarity and parsing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as words
from tessera.operators import factors, periods, similarity, statistics
from tessera.plans.registry import EVENT_PHASE_SQL, EVENT_PHASES, chi2_sql, erfc_sql, query, rho_sql, table


def _events(spark, d):
    return table(spark, d, "events").withColumn("phase", periods.phase_of(F.col("ts"), EVENT_PHASES))


_CELLS = f"c as (select {EVENT_PHASE_SQL} as r, event_type as k, count(*) as o from events where {EVENT_PHASE_SQL} is not null group by 1, 2), a as (select x.r, y.k, cast(coalesce(o, 0) as double) as o from (select distinct r from c) x cross join (select distinct k from c) y left join c on c.r = x.r and c.k = y.k), e as (select *, sum(o) over (partition by r) as nr, sum(o) over (partition by k) as nk, sum(o) over () as n from a), f as (select *, nr * nk / n as e from e)"


@query("M1_chi_square", f"with {_CELLS} select round(sum((o - e) * (o - e) / e), 4) as chi2, cast((count(distinct r) - 1) * (count(distinct k) - 1) as bigint) as df, round(sqrt(sum((o - e) * (o - e) / e) / (max(n) * (least(count(distinct r), count(distinct k)) - 1))), 4) as v, round({chi2_sql('sum((o - e) * (o - e) / e)', '(count(distinct r) - 1) * (count(distinct k) - 1)')}, 6) as p from f")
def _(spark, d):
    return statistics.chi_square(statistics.contingency(_events(spark, d), "phase", "event_type"))


@query("M1_residuals", f"with {_CELLS} select r as row, k as col, cast(o as bigint) as o, round((o - e) / sqrt(e * (1 - nr / n) * (1 - nk / n)), 4) as residual from f")
def _(spark, d):
    return statistics.residuals(statistics.contingency(_events(spark, d), "phase", "event_type"))


@query("M1_yates", "with c as (select quality as r, toxic as k, cast(count(*) as double) as o from labels group by 1, 2), a as (select x.r, y.k, coalesce(o, 0) as o from (select distinct r from c) x cross join (select distinct k from c) y left join c on c.r = x.r and c.k = y.k), e as (select *, sum(o) over (partition by r) * sum(o) over (partition by k) / sum(o) over () as e, sum(o) over () as n from a), g as (select *, abs(o - e) - least(.5, abs(o - e)) as z from e) select round(sum(z * z / e), 4) as chi2, cast(1 as bigint) as df, round(sqrt(sum(z * z / e) / max(n)), 4) as v, round(" + chi2_sql("sum(z * z / e)", "1") + ", 6) as p from g")
def _(spark, d):
    return statistics.chi_square(statistics.contingency(table(spark, d, "labels"), "quality", "toxic"), correct=True)


@query("M2_odds_ratio", "with c as (select cast(count(*) filter (where p_size > 25 and p_retailprice > 1000) as double) as a, cast(count(*) filter (where p_size > 25 and not p_retailprice > 1000) as double) as b, cast(count(*) filter (where not p_size > 25 and p_retailprice > 1000) as double) as c, cast(count(*) filter (where not p_size > 25 and not p_retailprice > 1000) as double) as d from part), r as (select *, a * d / (b * c) as o, 1.96 * sqrt(1 / a + 1 / b + 1 / c + 1 / d) as w, a > 0 and b > 0 and c > 0 and d > 0 as ok from c) select cast(a as bigint) as a, cast(b as bigint) as b, cast(c as bigint) as c, cast(d as bigint) as d, case when ok then round(o, 4) end as odds_ratio, case when ok then round(exp(ln(o) - w), 4) end as low, case when ok then round(exp(ln(o) + w), 4) end as high from r")
def _(spark, d):
    return statistics.odds_ratio(table(spark, d, "part"), F.col("p_size") > 25, F.col("p_retailprice") > 1000)


@query("M2_proportion", "select source, count(*) as n, round(100 * avg(case when n_chars > 1500 then 1.0 else 0.0 end), 4) as percent, round(100 * 1.96 * sqrt(avg(case when n_chars > 1500 then 1.0 else 0.0 end) * (1 - avg(case when n_chars > 1500 then 1.0 else 0.0 end)) / count(*)), 4) as error from documents group by 1")
def _(spark, d):
    return statistics.proportion(table(spark, d, "documents"), "source", F.col("n_chars") > 1500)


def ranks_sql(value: str) -> str:
    """Rank sums of `value` by phase (s) and its ties (t)."""
    return f"x as (select {EVENT_PHASE_SQL} as g, {value} as v from events where {value} is not null and {EVENT_PHASE_SQL} is not null), r as (select g, v, rank() over (order by v) + (count(*) over (partition by v) - 1) / 2.0 as r from x), t as (select sum(cast(t as double) * t * t - t) as ties, sum(t) as n from (select count(*) as t from x group by v)), s as (select g, cast(count(*) as double) as n_g, sum(r) as r_g from r group by 1)"


#: H, its degrees of freedom and p, which is exp(-H / 2) for the three phases.
KRUSKAL_SQL = "cast(max(t.n) as bigint) as n, count(*) as k, count(*) - 1 as df, round((12.0 / (max(t.n) * (max(t.n) + 1)) * sum(r_g * r_g / n_g) - 3 * (max(t.n) + 1)) / (1 - max(ties) / (cast(max(t.n) as double) * max(t.n) * max(t.n) - max(t.n))), 4) as h, round(exp(-((12.0 / (max(t.n) * (max(t.n) + 1)) * sum(r_g * r_g / n_g) - 3 * (max(t.n) + 1)) / (1 - max(ties) / (cast(max(t.n) as double) * max(t.n) * max(t.n) - max(t.n)))) / 2), 6) as p from s, t"
_RANKS = ranks_sql("round(value)")


@query("M3_kruskal", f"with {_RANKS} select {KRUSKAL_SQL}")
def _(spark, d):
    return statistics.kruskal(_events(spark, d).withColumn("v", F.round("value")), "v", "phase")


_DUNN = f"with {_RANKS} select a.g as a, b.g as b, round((a.r_g / a.n_g - b.r_g / b.n_g) / sqrt((cast(t.n as double) * (t.n + 1) / 12 - ties / (12.0 * (t.n - 1))) * (1 / a.n_g + 1 / b.n_g)), 4) as z from s a join s b on a.g < b.g, t"


@query("M4_dunn", _DUNN)
def _(spark, d):
    return statistics.dunn(_events(spark, d).withColumn("v", F.round("value")), "v", "phase")


@query("M4_dunn_p", f"select a, b, z, round(p, 6) as p, round(least(1.0, min(p * m / k) over (order by k desc rows unbounded preceding)), 6) as p_adj from (select *, row_number() over (order by p) as k, count(*) over () as m from (select *, {erfc_sql('abs(z) / sqrt(2)')} as p from ({_DUNN})))")
def _(spark, d):
    z = statistics.dunn(_events(spark, d).withColumn("v", F.round("value")), "v", "phase").withColumns({"p": statistics.normal_p("z"), "all": F.lit(1)})
    return statistics.adjust(z, "p", ["all"]).select("a", "b", "z", *(F.round(c, 6).alias(c) for c in ("p", "p_adj")))


RANKED = "select {g}rank() over ({p}order by x) + (count(*) over ({p2}) - 1) / 2.0 as rx, rank() over ({p}order by y) + (count(*) over ({p3}) - 1) / 2.0 as ry from ({src})"


@query("M5_spearman", rho_sql("", RANKED.format(g="", p="", p2="partition by x", p3="partition by y", src="select p_size as x, round(p_retailprice / 10) as y from part")))
def _(spark, d):
    return statistics.spearman(table(spark, d, "part").withColumn("y", F.round(F.col("p_retailprice") / 10)), "p_size", "y")


@query("M5_spearman_by_group", rho_sql("g, ", RANKED.format(g="g, ", p="partition by g ", p2="partition by g, x", p3="partition by g, y", src="select l_returnflag as g, l_quantity as x, l_discount as y from lineitem"), "g, "))
def _(spark, d):
    rows = statistics.spearman(table(spark, d, "lineitem"), "l_quantity", "l_discount", ["l_returnflag"])
    return rows.withColumnRenamed("l_returnflag", "g")


def _rho_of(x: str, y: str) -> str:
    return rho_sql(f"'{x}' as x, '{y}' as y, ", RANKED.format(g="", p="", p2="partition by x", p3="partition by y", src=f"select {x} as x, {y} as y from lineitem where {x} is not null and {y} is not null"))


@query("M5_spearman_matrix", " union all ".join(_rho_of(x, y) for x, y in (("l_quantity", "l_discount"), ("l_quantity", "l_tax"), ("l_discount", "l_tax"))))
def _(spark, d):
    return statistics.spearman_matrix(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"])


_HASH = "h as (select doc_id, source, concat('0x', substr(md5(text), 1, 16))::ubigint as h from documents)"


def _hashes(spark, d):
    return table(spark, d, "documents").select("doc_id", "source", similarity.bits_of(F.substring(F.md5(F.col("text").cast("binary")), 1, 16)).alias("h"))


@query("F10_hamming", f"with {_HASH} select a.doc_id, cast(bit_count(xor(a.h, b.h)) as integer) as d from h a join h b on b.doc_id = a.doc_id + 1")
def _(spark, d):
    h = _hashes(spark, d)
    later = h.select((F.col("doc_id") - 1).alias("doc_id"), F.col("h").alias("h2"))
    return h.join(later, "doc_id").select("doc_id", similarity.hamming(F.col("h"), F.col("h2")).alias("d"))


@query("J15_nearest_earlier", f"with {_HASH} select b.doc_id, arg_min(a.doc_id, bit_count(xor(a.h, b.h)) * 1000000 + a.doc_id) as near, cast(min(bit_count(xor(a.h, b.h))) as double) as d from h a join h b on a.doc_id < b.doc_id group by 1")
def _(spark, d):
    return similarity.nearest_earlier(_hashes(spark, d), "doc_id", "h")


@query("J14_hamming_pairs", f"with {_HASH}, c as (select h, min(doc_id) as id, count(*) as n from h group by 1) select least(x.id, y.id) as a, greatest(x.id, y.id) as b, case when x.id < y.id then x.n else y.n end as n_a, case when x.id < y.id then y.n else x.n end as n_b, cast(bit_count(xor(x.h, y.h)) as integer) as d from c x join c y on (x.h < y.h and bit_count(xor(x.h, y.h)) <= 3) or (x.h = y.h and x.n > 1)")
def _(spark, d):
    return similarity.hamming_pairs(_hashes(spark, d), "doc_id", "h", 3)


@query("A31_mean_distance", f"with {_HASH} select a.source, count(distinct a.doc_id) + 1 as n, round(avg(bit_count(xor(a.h, b.h))), 6) as mean_distance from h a join h b on a.source = b.source and a.doc_id < b.doc_id group by 1")
def _(spark, d):
    return similarity.mean_distance(_hashes(spark, d), ["source"], "doc_id", "h")


@query("Q55_recycling", f"with {_HASH}, m as (select b.doc_id, min(bit_count(xor(a.h, b.h))) as d from h a join h b on a.doc_id < b.doc_id group by 1) select doc_id // 100 as month, round(quantile_cont(d, .25), 6) as p25, round(quantile_cont(d, .5), 6) as p50, round(quantile_cont(d, .75), 6) as p75 from m group by 1")
def _(spark, d):
    from tessera.operators.summaries import exact_quantiles

    near = similarity.nearest_earlier(_hashes(spark, d), "doc_id", "h")
    return exact_quantiles(near.withColumn("month", F.floor(F.col("doc_id") / 100)), ["month"], "d", {"p25": 0.25, "p50": 0.5, "p75": 0.75}, decimals=6)


@query("F9_equal_contents", "select md5(text) as md5, count(*) as n, min(doc_id) as first from documents group by 1 having count(*) > 1")
def _(spark, d):
    return similarity.equal_contents(table(spark, d, "documents"), "doc_id", "text")


@query("M10_top_cosine", "with v as (select vec_id, cast(embedding as double[]) as e from embeddings) select a.vec_id as query, b.vec_id as id, round(list_cosine_similarity(a.e, b.e), 6) as sim, row_number() over (partition by a.vec_id order by round(list_cosine_similarity(a.e, b.e), 6) desc, b.vec_id) as rank from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0 qualify rank <= 5")
def _(spark, d):
    e = table(spark, d, "embeddings")
    found = similarity.top_cosine(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding", 5)
    return found.select("query", "id", "sim", F.col("rank").cast("long").alias("rank"))


@query("J19_ratio_matches", """with v as (select vec_id, cast(embedding as double[]) as e from embeddings),
s as (select a.vec_id as query, b.vec_id as id, round(list_cosine_similarity(a.e, b.e), 6) as sim from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0),
r as (select *, row_number() over (partition by query order by sim desc, id) as k from s),
m as (select query, max(id) filter (where k = 1) as id, round(1 - max(sim) filter (where k = 1), 6) as d1, round(1 - max(sim) filter (where k = 2), 6) as d2 from r where k <= 2 group by 1)
select * from m where d1 < 0.75 * d2""")
def _(spark, d):
    e = table(spark, d, "embeddings")
    return similarity.ratio_matches(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding")


@query("M11_ellipse", """with m as (select label, cast(embedding[1] as double) as x, cast(embedding[2] as double) as y from embeddings),
s as (select label, count(*) as n, avg(x) as mx, avg(y) as my, var_samp(x) as vx, var_samp(y) as vy, covar_samp(x, y) as c from m group by 1),
a as (select *, (vx + vy) / 2 as h, sqrt((vx - vy) * (vx - vy) / 4 + c * c) as g, -2 * ln(1 - .8) as q from s where n > 2)
select label, n, round(mx, 6) as mx, round(my, 6) as my, round(sqrt(q * (h + g)), 6) as major, round(sqrt(q * greatest(h - g, 0)), 6) as minor, round(atan2(h + g - vx, c), 6) as angle from a""")
def _(spark, d):
    e = table(spark, d, "embeddings").select("label", *(F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate("xy")))
    return statistics.ellipse(e, "label", "x", "y", 0.8)


@query("M11_loess", f"""with p as (select {EVENT_PHASE_SQL} as phase, extract(hour from ts) * 60.0 + extract(minute from ts) as x, value as y from events where value is not null),
g as (select phase, count(*) as n, min(x) as lo, max(x) as hi, greatest(1, cast(floor(count(*) * 0.7 + 1e-5) as bigint)) as q from p where phase is not null group by 1),
z as (select *, lo + (hi - lo) * point / 79 as x0 from (select *, unnest(range(0, 80)) as point from g)),
d as (select z.*, p.x, p.y, abs(p.x - x0) as d, row_number() over (partition by z.phase, point order by abs(p.x - x0)) as k from z join p on p.phase = z.phase),
w as (select *, max(d) filter (where k <= q) over (partition by phase, point) as h from d),
u as (select *, pow(1 - pow(d / h, 3), 3) as w, (x - x0) / h as u from w where d < h),
m as (select phase, n, point, x0, sum(w) as s0, sum(w * u) as s1, sum(w * u * u) as s2, sum(w * u * u * u) as s3, sum(w * u * u * u * u) as s4, sum(w * y) as t0, sum(w * u * y) as t1, sum(w * u * u * y) as t2 from u group by all)
select phase, n, point, round(x0, 6) as x, round((t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)) / (s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)), 6) as fit from m""")
def _(spark, d):
    """The trend of a value over the time of day, for each phase."""
    minute = (F.hour("ts") * 60.0 + F.minute("ts")).cast("double")
    return statistics.loess(_events(spark, d).withColumn("minute", minute), ["phase"], "minute", "value")


@query("S10_vector_files", "select vec_id, round(cast(embedding[1] as double) + embedding[64], 6) as ends, len(embedding) as size from embeddings")
def _(spark, d):
    """The vectors packed into files' contents and read from them again."""
    from tessera.sources import files

    contents = files.npz_contents(table(spark, d, "embeddings"), "vec_id", "embedding", 16)
    back = files.vectors_of(contents, "vec_id", "embedding", 64)
    return back.select("vec_id", F.round(F.get("embedding", F.lit(0)).cast("double") + F.get("embedding", F.lit(63)), 6).alias("ends"), F.size("embedding").cast("long").alias("size"))


@query("M10_similarity", "with v as (select vec_id, label, cast(embedding as double[]) as e from embeddings) select a.label, (1 + cast(sqrt(1 + 8 * count(*)) as bigint)) // 2 as n, round(avg(list_cosine_similarity(a.e, b.e)), 6) as mean_sim from v a join v b on a.label = b.label and a.vec_id < b.vec_id group by 1")
def _(spark, d):
    return similarity.similarity_summary(table(spark, d, "embeddings"), "label", "embedding")


_PAIR_QUANTILES = "round(min(s), 6) as least, round(quantile_cont(s, .25), 6) as p25, round(quantile_cont(s, .5), 6) as p50 from (select a.label, list_cosine_similarity(a.e, b.e) as s from v a join v b on a.label = b.label and a.vec_id < b.vec_id) group by 1"


@query("M10_pair_quantiles", f"with v as (select vec_id, label, cast(embedding as double[]) as e from embeddings) select label, (1 + cast(sqrt(1 + 8 * count(*)) as bigint)) // 2 as n, {_PAIR_QUANTILES}")
def _(spark, d):
    return similarity.pair_quantiles(table(spark, d, "embeddings"), "label", "embedding", {"least": 0.0, "p25": 0.25, "p50": 0.5})


@query("M10_all_pairs", f"with v as (select vec_id, 'all' as label, cast(embedding as double[]) as e from embeddings) select label, (1 + cast(sqrt(1 + 8 * count(*)) as bigint)) // 2 as n, {_PAIR_QUANTILES}")
def _(spark, d):
    """One group of all rows, dealt into blocks."""
    rows = table(spark, d, "embeddings").withColumn("label", F.lit("all"))
    return similarity.pair_quantiles(rows, "label", "embedding", {"least": 0.0, "p25": 0.25, "p50": 0.5})


@query("F11_cosine", "with v as (select vec_id, cast(embedding as double[]) as e from embeddings) select a.vec_id, round(list_cosine_similarity(a.e, b.e), 6) as sim from v a join v b on b.vec_id = a.vec_id + 1")
def _(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    later = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("e2"))
    return e.join(later, "vec_id").select("vec_id", F.round(similarity.cosine(F.col("embedding"), F.col("e2")), 6).alias("sim"))


@query("M9_epsilon_components", """with recursive v as (select vec_id, label, cast(embedding as double[]) as e from embeddings),
near as (select a.label, a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and 1 - list_cosine_similarity(a.e, b.e) <= 0.55),
reach as (select label, vec_id, vec_id as root from v union select n.label, n.b, r.root from reach r join near n on n.label = r.label and n.a = r.vec_id),
c as (select label, vec_id, min(root) as root from reach group by 1, 2)
select label, vec_id, cast(dense_rank() over (partition by label order by root) - 1 as integer) as cluster_id from c""")
def _(spark, d):
    return similarity.epsilon_components(table(spark, d, "embeddings"), "label", "vec_id", "embedding", 0.55)


@query("M7_pca")
def _(spark, d):
    found, _ = factors.pca(table(spark, d, "embeddings"), "vec_id", "embedding")
    return found.select("vec_id", *(F.round(F.get("pc", F.lit(i)), 6).alias(f"pc{i + 1}") for i in range(3)))


@query("M7_explained")
def _(spark, d):
    """The components' shares of the variance, and their running sum."""
    _, shares = factors.pca(table(spark, d, "embeddings"), "vec_id", "embedding", 10)
    upto = shares.cumsum()
    return spark.createDataFrame([(i + 1, round(float(x), 6), round(float(upto[i]), 6)) for i, x in enumerate(shares)], "component int, share double, upto double")


@query("M8_kmeans")
def _(spark, d):
    components, _ = factors.pca(table(spark, d, "embeddings"), "vec_id", "embedding")
    return factors.kmeans(components, "vec_id", "pc", 3)[0]


@query("M6_changepoints")
def _(spark, d):
    months = table(spark, d, "orders").groupBy("o_orderstatus", periods.start_of(F.col("o_orderdate"), "month").alias("month")).agg(F.count("*").cast("double").alias("n"))
    return factors.changepoints(months, ["o_orderstatus"], "month", "n")


@query("F1_lengths", "select doc_id, length(text) as n, upper(lang) as lang, trim('  ' || source || ' ') as source from documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.char_length("text").cast("long").alias("n"), F.upper("lang").alias("lang"), F.trim(F.concat(F.lit("  "), "source", F.lit(" "))).alias("source"))


@query("F2_regex", "select doc_id, len(regexp_extract_all(text, '[0-9]+')) as numbers, regexp_extract(text, '[A-Z][a-z]+') as word, regexp_matches(text, 'password') as hit from documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.regexp_count("text", F.lit("[0-9]+")).cast("long").alias("numbers"), F.regexp_extract("text", "[A-Z][a-z]+", 0).alias("word"), F.col("text").rlike("password").alias("hit"))


@query("F4_utf16_slice", "select doc_id, substr(text, 3, 8) as part from documents")
def _(spark, d):
    # an astral character before the text takes two units of UTF-16
    rows = table(spark, d, "documents").withColumn("t", F.concat(F.lit("\U0001f600"), "text"))
    return rows.select("doc_id", words.utf16_slice(F.col("t"), F.lit(4), F.lit(8)).alias("part"))


@query("F5_dates", "select event_id, date_trunc('second', ts) as t from events")
def _(spark, d):
    formats = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HHmmss", "yyyy-MM-dd HH:mm:ss")
    i = F.col("event_id") % 3
    text = F.when(i == 0, F.date_format("ts", formats[0])).when(i == 1, F.date_format("ts", formats[1])).otherwise(F.date_format("ts", formats[2]))
    return table(spark, d, "events").select("event_id", periods.parse_timestamp(text).cast("timestamp_ntz").alias("t"))


@query("F15_numbered", "select conv_id, count(*) as n, string_agg(role, '|' order by turn) as items from conversations group by 1")
def _(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r"))
    lines = F.array_join(F.transform("r", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["role"])), "\n")
    return c.select("conv_id", F.size("r").cast("long").alias("n"), F.array_join(words.numbered(lines, F.size("r")), "|").alias("items"))


@query("F17_sizes", "select p_partkey, cast(p_size as varchar) || 'x' || cast(p_size * 2 as varchar) as resolution, round(p_partkey / (1024.0 * 1024.0), 6) as mb from part")
def _(spark, d):
    from tessera.functions.media import megabytes, resolution

    return table(spark, d, "part").select("p_partkey", resolution(F.col("p_size"), F.col("p_size") * 2).alias("resolution"), F.round(megabytes(F.col("p_partkey")), 6).alias("mb"))


@query("F20_hrefs", r"select page_id, len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) as n from pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", F.size(words.hrefs(F.col("html"))).cast("long").alias("n"))


@query("F21_xml_escape", "select page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') as shown from pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", words.xml_escape(F.col("html")).alias("shown"))


@query("S13_srt_round_trip", "select conv_id, count(*) as n, round(sum(cast(turn as double) * 1.5), 3) as seconds from conversations where trim(role) <> '' group by 1")
def _(spark, d):
    from tessera.sources.files import format_srt, parse_srt

    start = F.col("turn") * 1.5
    segment = F.struct(start.alias("start"), (start + 1).alias("end"), F.col("role").alias("text"))
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(segment)).alias("s"))
    back = c.select("conv_id", parse_srt(format_srt(F.col("s"))).alias("p"))
    return back.select("conv_id", F.size("p").cast("long").alias("n"), F.round(F.aggregate("p", F.lit(0.0), lambda a, x: a + x["start"]), 3).alias("seconds"))


@query("A12_faces", "with f as (select user_id as message_id, cast(ts as date) as frame, event_id % 5 - 1 as face, event_type = 'click' as tgt, event_id % 3 as cluster, value / 100 as sim from events) select message_id, count(distinct frame) as total_frames, count(*) filter (where face >= 0) as total_faces, count(distinct frame) filter (where face >= 0 and tgt) as frames_with_target, round(100.0 * count(distinct frame) filter (where face >= 0 and tgt) / count(distinct frame), 2) as pct_target, round(cast(count(*) filter (where face >= 0) as double) / count(distinct frame), 2) as avg_faces, round(coalesce(max(sim) filter (where face >= 0), 0.0), 4) as max_similarity, count(distinct cluster) filter (where face >= 0) as n_individuals from f group by 1")
def _(spark, d):
    from tessera.operators.summaries import faces_by_message

    e = table(spark, d, "events")
    faces = e.select(
        F.col("user_id").alias("message_id"), F.col("ts").cast("date").cast("string").alias("frame_filename"), F.lit(0.5).alias("frame_position"), (F.col("event_id") % 5 - 1).alias("face_index"),
        (F.col("event_id") % 3).alias("cluster_id"), (F.col("event_type") == "click").alias("is_target"), (F.col("value") / 100).alias("similarity"), F.lit("").alias("date"), F.lit("").alias("phase"),
    )
    return faces_by_message(faces).select("message_id", "total_frames", "total_faces", "frames_with_target", "pct_target", "avg_faces", "max_similarity", "n_individuals")


@query("A22_merge_boxes", "with b as (select conv_id, turn, role, role = 'system' as wm, row_number() over (partition by conv_id, role order by turn) as r from conversations) select conv_id, coalesce(string_agg(role, ' ' order by turn) filter (where not wm), '') as content, coalesce(string_agg(role, ' ' order by turn) filter (where wm), '') as mark from b where r = 1 group by 1")
def _(spark, d):
    from tessera.operators.summaries import merge_boxes

    c = table(spark, d, "conversations")
    text = F.when(F.col("turn") % 2 == 0, F.col("role")).otherwise(F.concat(F.col("role"), F.lit(" ")))
    boxes = c.select("conv_id", F.col("turn").alias("order"), text.alias("text"), (F.col("role") == "system").alias("watermark"), F.lit(0.5).alias("confidence"))
    found = merge_boxes(boxes, ["conv_id"])
    return found.select("conv_id", F.trim(F.regexp_replace("content", " +", " ")).alias("content"), F.trim("mark").alias("mark"))


@query("A23_audio_ratios", "with s as (select l_orderkey as k, case l_returnflag when 'A' then 'speech' when 'N' then 'music' else 'noise' end as label, l_quantity as q from lineitem) select k, round(coalesce(sum(q) filter (where label = 'speech'), 0.0) / sum(q), 4) as speech_ratio, round(coalesce(sum(q) filter (where label = 'music'), 0.0) / sum(q), 4) as music_ratio, 0.0::double as silence_ratio, round(coalesce(sum(q) filter (where label = 'noise'), 0.0) / sum(q), 4) as noise_ratio from s group by 1")
def _(spark, d):
    from tessera.operators.summaries import audio_ratios

    label = F.when(F.col("l_returnflag") == "A", "speech").when(F.col("l_returnflag") == "N", "music").otherwise("other")
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), label.alias("label"), F.lit(0.0).alias("start"), F.col("l_quantity").alias("end"))
    return audio_ratios(rows, ["k"])
