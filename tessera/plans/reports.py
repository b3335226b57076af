"""The report queries that combine operators: one for each kind of monthly, phase or category report."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tessera.functions.media import resolution
from tessera.operators import classify, cleaning, concordance, factors, lexical, periods, statistics, summaries
from tessera.operators.lexical import top_n
from tessera.plans.measures import KRUSKAL_SQL, RANKED, ranks_sql
from tessera.plans.registry import EVENT_PHASE_SQL, EVENT_PHASES, ORDER_PHASE_SQL, ORDER_PHASES, TOKENS_SQL, query, rho_sql, table

_MONTH_SQL = "cast(date_trunc('month', o_orderdate) as date)"


def _month():
    return periods.start_of(F.col("o_orderdate"), "month").alias("month")


def _events(spark, d):
    return table(spark, d, "events").withColumn("phase", periods.phase_of(F.col("ts"), EVENT_PHASES)).where("phase is not null")


def _orders(spark, d):
    return table(spark, d, "orders").withColumn("phase", periods.phase_of(F.col("o_orderdate"), ORDER_PHASES))


@query("Q01_extrapolated", f"with c as (select {_MONTH_SQL} as month, count(*) as n from orders group by 1) select month, case when month = (select max(month) from c) then n * 31 / 10 else cast(n as double) end as n from c")
def _(spark, d):
    counts = table(spark, d, "orders").groupBy(_month()).agg(F.count("*").alias("n"))
    last = counts.agg(F.max("month")).first()[0]
    seen = F.date_add(F.lit(last), 9)  # observed for ten days
    scaled = periods.extrapolate_last(counts, "month", "n", seen)
    days = F.dayofmonth(F.last_day(F.lit(last)))
    return scaled.withColumn("n", F.when(F.col("month") == F.lit(last), F.col("n") * 31 / days).otherwise(F.col("n")))


@query("Q08_orientation_mix", "with c as (select cast(date_trunc('week', ts) as date) as week, case when event_id % 3 = 0 then 'horizontal' when event_id % 3 = 1 then 'vertical' else 'square' end as o, count(*) as n from events where ts < timestamp '2024-01-25' group by 1, 2) select week, o as orientation, n, round(100.0 * n / sum(n) over (partition by week), 4) as share from c")
def _(spark, d):
    i = F.col("event_id") % 3
    shape = cleaning.orientation(F.when(i == 0, 2).otherwise(1), F.when(i == 1, 2).otherwise(1))
    e = table(spark, d, "events").where("ts < timestamp_ntz '2024-01-25 00:00:00'").groupBy(periods.start_of(F.col("ts"), "week").alias("week"), shape.alias("orientation")).agg(F.count("*").alias("n"))
    return summaries.share(e, "n", ["week"])


@query("Q13_top_by_month", "with c as (select p_brand, cast(p_size as varchar) || 'x' || cast(p_partkey % 3 as varchar) as r, count(*) as n from part group by 1, 2) select p_brand, r as resolution, n, row_number() over (partition by p_brand order by n desc, r) as rank from c qualify rank <= 4")
def _(spark, d):
    counts = table(spark, d, "part").groupBy("p_brand", resolution(F.col("p_size"), F.col("p_partkey") % 3).alias("resolution")).agg(F.count("*").alias("n"))
    return top_n(counts, ["p_brand"], [F.desc("n"), F.asc("resolution")], 4).withColumn("rank", F.col("rank").cast("long"))


@query("Q17_rates_by_phase", f"with e as (select event_id, {EVENT_PHASE_SQL} as phase, event_type from events), n as (select phase, count(*) as n_total from e where phase is not null group by 1), c as (select distinct event_id, phase, event_type from e), g as (select phase, event_type, count(*) as n from c where phase is not null group by 1, 2) select phase, event_type, n, n_total, round(100.0 * n / n_total, 4) as rate from g join n using (phase)")
def _(spark, d):
    e = _events(spark, d)
    total = e.groupBy("phase").agg(F.count("*").alias("n_total"))
    some = e.select("event_id", "phase", "event_type").distinct().groupBy("phase", "event_type").agg(F.count("*").alias("n"))
    return some.join(F.broadcast(total), "phase").withColumn("rate", F.round(100 * F.col("n") / F.col("n_total"), 4))


_TITLES = "select page_id, cast(page_id % 36 as integer) as month, " + "case when page_id % 8 = 3 then 'https://send.monobank.ua/jar' when page_id % 8 = 4 then 'https://forms.gle/abc' else url end as url, html from pages"


@query("Q17_fundraising_by_year", f"""with p as ({_TITLES}), l as (select page_id, month // 12 as year, {' '.join(['case', *(f"when contains(lower(url), '{pattern}') then '{label}'" for label, pattern in classify.FUNDRAISING), 'end'])} as service from p),
b as (select page_id, month // 12 as year, 'PrivatBank' as service from p where regexp_matches(lower(html), 'the secret|приватбанк|privatbank') and page_id not in (select page_id from l where service is not null))
select year, service, count(distinct page_id) as n, round(100.0 * count(distinct page_id) / sum(count(distinct page_id)) over (partition by year), 4) as share from (select * from l where service is not null union all select * from b) group by 1, 2""")
def _(spark, d):
    """Services by year, with the pages that name the bank and have no other fundraising link."""
    i = F.col("page_id") % 8
    url = F.when(i == 3, "https://send.monobank.ua/jar").when(i == 4, "https://forms.gle/abc").otherwise(F.col("url"))
    pages = table(spark, d, "pages").select("page_id", F.floor((F.col("page_id") % 36) / 12).cast("int").alias("year"), url.alias("url"), "html")
    rows = classify.with_bank_mentions(pages, "page_id", "url", "html", pattern="the secret|" + classify.BANK)
    counts = rows.where("service is not null").groupBy("year", "service").agg(F.countDistinct("page_id").alias("n"))
    return summaries.share(counts, "n", ["year"])


@query("Q19_heatmap_by_quarter", "select concat(year(o_orderdate), '-Q', quarter(o_orderdate)) as quarter, isodow(o_orderdate) as dow, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (partition by concat(year(o_orderdate), '-Q', quarter(o_orderdate))), 4) as share from orders group by 1, 2")
def _(spark, d):
    o = table(spark, d, "orders").groupBy(periods.period_of(F.col("o_orderdate"), "quarter").alias("quarter"), (F.weekday("o_orderdate") + 1).cast("long").alias("dow")).agg(F.count("*").alias("n"))
    return summaries.share(o, "n", ["quarter"])


@query("Q05_media_mix_by_week", "with k as (select cast(unnest(generate_series((select date_trunc('week', min(ts)) from events), (select date_trunc('week', max(ts)) from events), interval 7 day)) as date) as week), lv as (select distinct event_type from events union select 'poll'), c as (select cast(date_trunc('week', ts) as date) as week, event_type, count(*) as n from events group by 1, 2) select k.week, lv.event_type, coalesce(n, 0) as n from k cross join lv left join c on c.week = k.week and c.event_type = lv.event_type")
def _(spark, d):
    e = table(spark, d, "events")
    week = periods.start_of(F.col("ts"), "week")
    kinds = sorted(r[0] for r in e.select("event_type").distinct().collect())  # declared categories, here read from the table
    counts = e.groupBy(week.alias("week"), "event_type").agg(F.count("*").alias("n"))
    ends = e.select(F.min(week).alias("a"), F.max(week).alias("b"))
    weeks = ends.select(F.explode(F.sequence("a", "b", F.expr("interval 7 day"))).alias("week"))
    return periods.complete(counts, "week", fill={"n": 0}, levels={"event_type": [*kinds, "poll"]}, skeleton=weeks)


@query("Q11_horizontal_by_day", f"select cast(ts as date) as day, count(*) as n, round(100.0 * avg(case when event_id % 3 = 0 then 1.0 else 0.0 end), 4) as pct from events where {EVENT_PHASE_SQL} in ('P1', 'P2') group by 1")
def _(spark, d):
    i = F.col("event_id") % 3
    shape = cleaning.orientation(F.when(i == 0, 2).otherwise(1), F.when(i == 1, 2).otherwise(1))
    e = _events(spark, d).where("phase in ('P1', 'P2')").groupBy(F.col("ts").cast("date").alias("day"))
    return e.agg(F.count("*").alias("n"), F.round(summaries.rate(shape == "horizontal"), 4).alias("pct"))


@query("Q20_heatmap_by_year", "with t as (select ts + interval 1 hour as t from events), h as (select year(t) as year, isodow(t) as dow, hour(t) as hour, cast(count(*) as double) as n from t group by 1, 2, 3), q as (select year, quantile_cont(n, .98) as cap from h group by 1) select h.year, dow, hour, round(least(n, cap), 6) as n from h join q on q.year = h.year")
def _(spark, d):
    t = periods.local(F.col("ts"), "Europe/Paris")  # January: one hour ahead of UTC
    part = lambda x: x.cast("long")
    counts = table(spark, d, "events").groupBy(part(F.year(t)).alias("year"), part(F.weekday(t) + 1).alias("dow"), part(F.hour(t)).alias("hour")).agg(F.count("*").cast("double").alias("n"))
    caps = summaries.exact_quantiles(counts, ["year"], "n", {"cap": 0.98})
    return counts.join(caps, "year").select("year", "dow", "hour", F.round(F.least("n", "cap"), 6).alias("n"))


@query("Q23_text_length_by_month", "select doc_id % 12 as month, round(quantile_cont(length(text), .25), 6) as p25, round(quantile_cont(length(text), .5), 6) as p50, round(quantile_cont(length(text), .75), 6) as p75 from documents where trim(text) <> '' group by 1")
def _(spark, d):
    rows = table(spark, d, "documents").where(cleaning.blank_to_null(F.col("text")).isNotNull()).select((F.col("doc_id") % 12).alias("month"), F.char_length("text").alias("n"))
    return summaries.exact_quantiles(rows, ["month"], "n", {"p25": 0.25, "p50": 0.5, "p75": 0.75}, decimals=6)


#: The first month of the planted break.
BREAK = date(1998, 3, 1)


def _series(spark, d):
    o = table(spark, d, "orders").withColumn("month", _month())
    o = summaries.with_quantiles(o, ["month"], {"price": ("o_totalprice", 0.5)}, F.count("*").cast("double").alias("n"), F.avg((F.col("o_orderstatus") == "O").cast("double")).alias("open"))
    # a series with a known break: a level of its own from BREAK on
    o = o.withColumn("step", F.col("n") + F.when(F.col("month") >= F.lit(BREAK), 1000.0).otherwise(0.0))
    return o.unpivot("month", ["n", "price", "open", "step"], "series", "value")


@query("Q26_series_changepoints")
def _(spark, d):
    return factors.changepoints(_series(spark, d), ["series"], "month", "value")


@query("Q29_ruptures_against_bounds")
def _(spark, d):
    """Each changepoint's distance in days to the nearest phase bound."""
    found = factors.changepoints(_series(spark, d), ["series"], "month", "value")
    bounds = F.array(*(F.lit(p.start) for p in ORDER_PHASES))
    gaps = F.transform(bounds, lambda b: F.abs(F.datediff(F.col("month"), b)))
    return found.withColumn("days", F.array_min(gaps))


@query("Q27_kruskal_metrics", " union all ".join(f"select '{m}' as metric, * from (with {ranks_sql(v)} select {KRUSKAL_SQL})" for m, v in (("hour", "cast(hour(ts) as double)"), ("rounded", "round(value)"))))
def _(spark, d):
    e = _events(spark, d).withColumns({"hour": F.hour("ts").cast("double"), "rounded": F.round("value")})
    parts = [statistics.kruskal(e, m, "phase").withColumn("metric", F.lit(m)) for m in ("hour", "rounded")]
    return parts[0].unionByName(parts[1])


@query("Q28_by_type_and_phase", f"select {EVENT_PHASE_SQL} as phase, event_type, round(median(value), 4) as med, count(*) as n, round(sum(value), 4) as total from events where value is not null and {EVENT_PHASE_SQL} is not null group by 1, 2")
def _(spark, d):
    e = _events(spark, d).where("value is not null")
    return summaries.with_quantiles(e, ["phase", "event_type"], {"med": ("value", 0.5)}, F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), decimals=4)


@query("Q32_presence_classes", f"with e as (select {EVENT_PHASE_SQL} as phase, case when value = 0 then 'absent' when value / 100 <= .5 then 'partial' when value is not null then 'dominant' end as class from events), c as (select phase, class, count(*) as n from e where phase is not null group by 1, 2) select phase, class, n, round(100.0 * n / sum(n) over (partition by phase), 4) as share from c")
def _(spark, d):
    e = _events(spark, d).groupBy("phase", classify.ratio_class(F.col("value") / 100).alias("class")).agg(F.count("*").alias("n"))
    return summaries.share(e, "n", ["phase"])


@query("Q34_topic_shares_by_source")
def _(spark, d):
    from tessera.operators import topics

    docs = table(spark, d, "documents")
    rows, _ = topics.vectors(concordance.token_lists(docs, keep=("doc_id",)).withColumnRenamed("tokens", "lemmas"))
    found = topics.document_topics(topics.fit(rows, 3), rows, "doc_id").join(docs.select("doc_id", "source"), "doc_id")
    means = found.select("source", F.posexplode("gamma").alias("topic", "g")).groupBy("source", "topic").agg(F.avg("g").alias("g"))
    return summaries.share(means, "g", ["source"]).drop("g")


@query("Q34r_rhythm", "with s as (select l_orderkey as k, count(*) - 1 as cuts, sum(l_quantity) as q from lineitem group by 1) select o_orderstatus as status, round(median(q / (cuts + 1)), 4) as scene, round(median(cuts / (q / 60)), 4) as per_minute, round(100.0 * avg(case when cuts = 0 then 1.0 else 0.0 end), 4) as pct_zero from s join orders on o_orderkey = k group by 1")
def _(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg((F.count("*") - 1).alias("cuts"), F.sum("l_quantity").alias("q"))
    met = s.join(table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status")), "o_orderkey")
    scene, rate = F.col("q") / (F.col("cuts") + 1), F.col("cuts") / (F.col("q") / 60)
    met = met.withColumns({"s": scene, "r": rate})
    return summaries.with_quantiles(met, ["status"], {"scene": ("s", 0.5), "per_minute": ("r", 0.5)}, F.round(summaries.rate(F.col("cuts") == 0), 4).alias("pct_zero"), decimals=4)


@query("Q35_written_against_spoken", f"with {TOKENS_SQL}, t as (select source, count(*) filter (where lang = 'en') as n_one, count(*) filter (where lang = 'fr') as n_other from tok where lang in ('en', 'fr') group by 1) select source, n_one, n_other, case when n_other > 0 then round(n_one / n_other, 4) end as ratio, round(100.0 * n_one / (n_one + n_other), 4) as share from t")
def _(spark, d):
    rows = lexical.tokens(table(spark, d, "documents"), keep=("doc_id", "lang", "source"))
    return lexical.period_ratio(rows, "source", "lang", "en", "fr")


@query("Q38_phase_calendar", f"with c as (select {_MONTH_SQL} as month, round(avg(o_totalprice), 2) as mean from orders where {ORDER_PHASE_SQL} = 'P1' group by 1), k as (select cast(unnest(generate_series(date '1995-01-01', date '1996-12-01', interval 1 month)) as date) as month) select k.month, mean from k left join c on c.month = k.month")
def _(spark, d):
    first = ORDER_PHASES[0]
    rows = periods.in_phase(table(spark, d, "orders"), "o_orderdate", first)
    counts = rows.groupBy(_month()).agg(F.round(F.avg("o_totalprice"), 2).alias("mean"))
    months = spark.range(1).select(F.explode(F.sequence(F.lit(first.start), F.lit(first.end), F.expr("interval 1 month"))).alias("month"))
    return periods.complete(counts, "month", skeleton=months)


@query("Q41_technical_medians", f"select {ORDER_PHASE_SQL} as phase, round(median(o_totalprice / 1000), 4) as med, round(quantile_cont(o_totalprice / 1000, .25), 4) as p25, count(*) as n from orders where {ORDER_PHASE_SQL} is not null group by 1")
def _(spark, d):
    o = _orders(spark, d).where("phase is not null").withColumn("x", F.col("o_totalprice") / 1000)
    return summaries.with_quantiles(o, ["phase"], {"med": ("x", 0.5), "p25": ("x", 0.25)}, F.count("*").alias("n"), decimals=4)


@query("Q44_spearman_by_phase", rho_sql("phase, ", RANKED.format(g="phase, ", p="partition by phase ", p2="partition by phase, x", p3="partition by phase, y", src=f"select * from (select {EVENT_PHASE_SQL} as phase, hour(ts) as x, round(value) as y from events where value is not null) where phase is not null"), "phase, "))
def _(spark, d):
    e = _events(spark, d).withColumns({"x": F.hour("ts"), "y": F.round("value")})
    return statistics.spearman(e, "x", "y", ["phase"])


@query("Q48_presence_by_month", f"with c as (select {_MONTH_SQL} as month, round(100.0 * avg(case when o_orderstatus = 'P' then 1.0 else 0.0 end), 4) as pct, count(*) as n from orders group by 1) select * from c where n >= 3")
def _(spark, d):
    o = table(spark, d, "orders").groupBy(_month())
    return o.agg(F.round(summaries.rate(F.col("o_orderstatus") == "P"), 4).alias("pct"), F.count("*").alias("n")).where("n >= 3")


@query("Q48_cross_validation", "select p_size > 25 as detected, p_retailprice > 1000 as read, count(*) as n from part group by 1, 2")
def _(spark, d):
    return table(spark, d, "part").groupBy((F.col("p_size") > 25).alias("detected"), (F.col("p_retailprice") > 1000).alias("read")).agg(F.count("*").alias("n"))


@query("Q49_phase_by_type", f"with c as (select {EVENT_PHASE_SQL} as r, event_type as k, cast(count(*) as double) as o from events where {EVENT_PHASE_SQL} is not null group by 1, 2) select r as row, k as col, cast(o as bigint) as o, round(100 * o / sum(o) over (partition by r), 4) as share from c")
def _(spark, d):
    cells = statistics.contingency(_events(spark, d), "phase", "event_type").withColumn("o", F.col("o").cast("long"))
    return summaries.share(cells, "o", ["row"])


@query("Q50_quartiles_long", "with m as (select label, 'x0' as metric, cast(embedding[1] as double) as v from embeddings union all select label, 'x1', cast(embedding[2] as double) from embeddings) select label, metric, round(quantile_cont(v, .25), 6) as p25, round(quantile_cont(v, .5), 6) as p50, round(quantile_cont(v, .75), 6) as p75 from m group by 1, 2")
def _(spark, d):
    e = table(spark, d, "embeddings").select("label", *(F.get("embedding", F.lit(i)).cast("double").alias(f"x{i}") for i in range(2)))
    return summaries.exact_quantiles(e.unpivot("label", ["x0", "x1"], "metric", "v"), ["label", "metric"], "v", {"p25": 0.25, "p50": 0.5, "p75": 0.75}, decimals=6)


@query("Q50_clusters_by_label")
def _(spark, d):
    e = table(spark, d, "embeddings")
    clusters, _ = factors.kmeans(factors.pca(e, "vec_id", "embedding")[0], "vec_id", "pc", 3)
    counts = clusters.join(e.select("vec_id", "label"), "vec_id").groupBy("cluster", "label").agg(F.count("*").alias("n"))
    return summaries.share(counts, "n", ["cluster"])


@query("Q52_character_ratio", "with c as (select doc_id % 12 as month, cast(sum(length(text)) filter (where lang = 'en') as bigint) as a, cast(sum(length(text)) filter (where lang = 'de') as bigint) as b from documents group by 1) select month, a, b, round(a / b, 4) as ratio from c")
def _(spark, d):
    size = F.char_length("text")
    docs = table(spark, d, "documents").groupBy((F.col("doc_id") % 12).alias("month"))
    sums = docs.agg(*(F.sum(F.when(F.col("lang") == lang, size)).alias(c) for c, lang in (("a", "en"), ("b", "de"))))
    return sums.withColumn("ratio", F.round(F.col("a") / F.col("b"), 4))


@query("Q53_dominant_by_month", "with x as (select l_orderkey % 12 as month, case when greatest(l_discount, l_tax, .05) < .04 then 'mixte' when greatest(l_discount, l_tax, .05) = l_discount then 'parole' when greatest(l_discount, l_tax, .05) = l_tax then 'musique' else 'silence' end as class from lineitem) select month, class, count(*) as n from x group by 1, 2")
def _(spark, d):
    dominant = classify.audio_class(F.col("l_discount"), F.col("l_tax"), F.lit(0.05), 0.04)
    return table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 12).alias("month"), dominant.alias("class")).agg(F.count("*").alias("n"))


def _nodes(spark, d):
    from tessera.operators.graphs import centralities
    from tessera.plans.lexicometry import network_edges

    return centralities(network_edges(spark, d), ["lang"])


@query("Q56_top_betweenness")
def _(spark, d):
    return top_n(_nodes(spark, d), ["lang"], [F.desc("betweenness"), F.asc("lemma")], 20)


@query("Q57_rank_trajectories")
def _(spark, d):
    ranks = _nodes(spark, d).withColumn("rank", summaries.capped_rank("betweenness", ["lang"], 20))
    wide = ranks.groupBy("lemma").agg(*(F.coalesce(F.min(F.when(F.col("lang") == x, F.col("rank"))), F.lit(21)).alias(x) for x in ("de", "en", "es", "fr")))
    return wide.withColumn("trend", summaries.trend(F.col("de"), F.col("fr")))


@query("Q58_typical_lemmas")
def _(spark, d):
    rows = lexical.volcano(lexical.tokens(table(spark, d, "documents")), "lang", 20).withColumn("p", F.coalesce(statistics.normal_p(F.sqrt("chi2")), F.lit(1.0)))
    adjusted = statistics.adjust(rows, "p", ["a", "b"])
    side = classify.significant(F.col("p_adj"), F.col("log2fc"), F.greatest("ca", "cb"))
    score = F.least(F.lit(50.0), -F.log10(F.greatest("p_adj", F.lit(1e-300)))) * F.abs("log2fc")
    typical = adjusted.withColumns({"side": side, "score": F.round(score, 4)}).where("side <> 'ns'")
    return top_n(typical, ["a", "b", "side"], [F.desc("score"), F.asc("lemma")], 20)
