"""Relational queries: selection, phases and periods, joins, aggregations, windows, set operations, reshaping."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import classify, cleaning, periods, summaries
from tessera.operators.lexical import top_n
from tessera.plans.registry import EVENT_PHASE_SQL, EVENT_PHASES, ORDER_PHASE_SQL, ORDER_PHASES, query, table

# --- selection and cleaning ---------------------------------------------------------------------------------------------------


@query("P1_ensure_columns", "select region.*, cast(null as double) as duree, cast(null as varchar) as legende from region")
def _(spark, d):
    return cleaning.ensure_columns(table(spark, d, "region"), {"duree": "double", "legende": "string", "r_name": "string"})


@query("P2_safe_cast", "select event_id, try_cast(regexp_extract(props, ':\\s*(.*?)\\}', 1) as integer) as k, try_cast(event_type as double) as bad from events")
def _(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", cleaning.safe(F.regexp_extract("props", r":\s*(.*?)\}", 1), "int").alias("k"), cleaning.safe(F.col("event_type"), "double").alias("bad"))


@query("P3_blank_to_null", "select conv_id, turn, nullif(trim(case when turn % 3 = 0 then '  ' else role end), '') as role from conversations")
def _(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", cleaning.blank_to_null(F.when(F.col("turn") % 3 == 0, "  ").otherwise(F.col("role"))).alias("role"))


@query("P4_impute", "select d.doc_id, coalesce(quality, 0) as quality, quality is null as quality_missing from documents d left join labels l using (doc_id)")
def _(spark, d):
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return cleaning.impute(rows, ["quality"])


@query("P5_media_kind", "select event_id, coalesce(nullif(case when event_type = 'view' then ' ' else event_type end, ' '), 'text_only') as kind, event_type <> 'view' or value > 50 as has_media from events")
def _(spark, d):
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "view", " ").otherwise(F.col("event_type"))
    shown, media = cleaning.media_kind(kind, F.when(F.col("value") > 50, "path"))
    return e.select("event_id", shown.alias("kind"), media.alias("has_media"))


@query("P6_orientation", "select p_partkey, case when p_size > p_partkey % 50 then 'horizontal' when p_size < p_partkey % 50 then 'vertical' else 'square' end as orientation, case when p_partkey % 50 > 0 then round(p_size / (p_partkey % 50), 4) end as ratio from part")
def _(spark, d):
    p, h = table(spark, d, "part"), F.col("p_partkey") % 50
    return p.select("p_partkey", cleaning.orientation(F.col("p_size"), h, F.lit(" ")).alias("orientation"), F.round(F.when(h > 0, F.col("p_size") / h), 4).alias("ratio"))


@query("P7_eligible", "select event_id, event_type from events where event_type in ('click', 'purchase') and ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-13' and event_id % 7 <> 0 order by event_id limit 100")
def _(spark, d):
    e = table(spark, d, "events")
    kept = cleaning.eligible(e, "event_id", kind="event_type", kinds=["click", "purchase"], when=F.col("ts").cast("timestamp"), start="2024-01-05", end="2024-01-12", done=F.col("event_id") % 7 == 0, limit=100)
    return kept.select("event_id", "event_type")


@query("P8_is_done", "select d.doc_id, quality is not null and toxic is not null as done from documents d left join labels l using (doc_id)")
def _(spark, d):
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return rows.select("doc_id", cleaning.is_done(["quality", "toxic"]).alias("done"))


_OLD = "(select doc_id, case when doc_id % 3 = 0 then null else lang end as lang, case when doc_id % 5 = 0 then null else source end as source from documents)"
_NEW = "(select doc_id, case when doc_id % 4 = 0 then null else 'new' end as lang, 'x' as extra from documents where doc_id % 2 = 0)"


def _merge_sides(spark, d):
    docs = table(spark, d, "documents")
    i = F.col("doc_id")
    old = docs.select("doc_id", F.when(i % 3 != 0, F.col("lang")).alias("lang"), F.when(i % 5 != 0, F.col("source")).alias("source"))
    new = docs.where(i % 2 == 0).select("doc_id", F.when(i % 4 != 0, "new").alias("lang"), F.lit("x").alias("extra"))
    return old, new


@query("P9_merge_fields", f"select o.doc_id, coalesce(o.lang, n.lang) as lang, o.source, n.extra from {_OLD} o left join {_NEW} n using (doc_id)")
def _(spark, d):
    return cleaning.merge_fields(*_merge_sides(spark, d), ["doc_id"])


@query("P9_merge_overwrite", f"select o.doc_id, case when n.doc_id is not null then n.lang else o.lang end as lang, o.source, n.extra from {_OLD} o left join {_NEW} n on o.doc_id = n.doc_id")
def _(spark, d):
    return cleaning.merge_fields(*_merge_sides(spark, d), ["doc_id"], overwrite=True)


@query("P10_phase", f"select {EVENT_PHASE_SQL} as phase, count(*) as n from events group by 1")
def _(spark, d):
    return table(spark, d, "events").groupBy(periods.phase_of(F.col("ts"), EVENT_PHASES).alias("phase")).agg(F.count("*").alias("n"))


@query("P11_in_phase", "select event_type, count(*) as n from events where cast(ts as date) between date '2024-01-11' and date '2024-01-20' group by 1")
def _(spark, d):
    return periods.in_phase(table(spark, d, "events"), "ts", EVENT_PHASES[1]).groupBy("event_type").agg(F.count("*").alias("n"))


@query("P12_period_labels", "select strftime(o_orderdate, '%Y-%m') as month, concat(year(o_orderdate), '-Q', quarter(o_orderdate)) as quarter, cast(year(o_orderdate) as varchar) as year, cast(date_trunc('week', o_orderdate) as date) as week, count(*) as n from orders group by all")
def _(spark, d):
    when = F.col("o_orderdate")
    labels = [periods.period_of(when, k).alias(k) for k in ("month", "quarter", "year")]
    return table(spark, d, "orders").groupBy(*labels, periods.start_of(when, "week").alias("week")).agg(F.count("*").alias("n"))


@query("P13_ratio_class", "select case when l_discount * 10 = 0 then 'absent' when l_discount * 10 <= .5 then 'partial' else 'dominant' end as class, count(*) as n from lineitem group by 1")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy(classify.ratio_class(F.col("l_discount") * 10).alias("class")).agg(F.count("*").alias("n"))


def _case(column: str, rules, contains: bool = False) -> str:
    test = lambda p: f"contains({column}, '{p}')" if contains else f"regexp_matches({column}, '{p}')"
    return "case " + " ".join(f"when {test(p)} then '{label}'" for label, p in rules) + " end"


_URLS = "lower(case page_id % 8 when 0 then 'https://youtu.be/' || page_id when 1 then 'https://www.YouTube.com/@x.army' when 2 then 'https://t.me/c/' || page_id when 3 then 'https://send.monobank.ua/jar' when 4 then 'https://forms.gle/abc' when 5 then null else url end)"


def _urls():
    number = F.col("page_id").cast("string")
    i = F.col("page_id") % 8
    return (
        F.when(i == 0, F.concat(F.lit("https://youtu.be/"), number)).when(i == 1, "https://www.YouTube.com/@x.army").when(i == 2, F.concat(F.lit("https://t.me/c/"), number))
        .when(i == 3, "https://send.monobank.ua/jar").when(i == 4, "https://forms.gle/abc").when(i != 5, F.col("url"))
    )


@query("P14_platform", f"select page_id, {_case('u', classify.PLATFORMS)} as platform from (select page_id, {_URLS} as u from pages)")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", classify.first_match(_urls(), classify.PLATFORMS).alias("platform"))


@query("P15_fundraising", f"with p as (select page_id, {_URLS} as u, html from pages), s as (select page_id, {_case('u', classify.FUNDRAISING, True)} as service from p) select * from s union all select page_id, 'PrivatBank' from p where regexp_matches(lower(html), 'приватбанк|privatbank|password') and page_id not in (select page_id from s where service is not null)")
def _(spark, d):
    pages = table(spark, d, "pages").select("page_id", _urls().alias("u"), "html")
    return classify.with_bank_mentions(pages, "page_id", "u", "html", pattern=classify.BANK + "|password").select("page_id", "service")


_WORDS = (("the", "the "), ("secret", "password|token"), ("mail", "@[a-z0-9.]+"), ("card", "[0-9]{16}"))


@query("P16_mentions", "select * from (" + " union all ".join(f"select doc_id, '{label}' as category from documents where regexp_matches(lower(text), '{p}')" for label, p in _WORDS) + " union all select doc_id, 'key' from documents where regexp_matches(text, 'AKIA[A-Z0-9]{16}'))")
def _(spark, d):
    return classify.mentions(table(spark, d, "documents"), "doc_id", F.col("text"), _WORDS, (("key", "AKIA[A-Z0-9]{16}"),))


@query("P16_platform_mentions", "select * from (" + " union all ".join(f"select page_id, '{label}' as category from pages where regexp_matches(lower(concat_ws(' ', html, {_URLS})), '{p}')" for label, p in classify.PLATFORM_MENTIONS) + ")")
def _(spark, d):
    return classify.mentions(table(spark, d, "pages"), "page_id", F.concat_ws(" ", "html", _urls()), classify.PLATFORM_MENTIONS, ())


@query("P17_branding", "select conv_id, turn, case when regexp_matches(t || ' ' || role, '414') then 'strong' when regexp_matches(t || ' ' || role, 'system') then 'second' when regexp_matches(role, 'user') then 'name' when regexp_matches(t || ' ' || role, '.') then 'other' else 'none' end as brand from (select *, text as t from conversations)")
def _(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", classify.branding(F.col("text"), F.col("role"), "414", "system", "user").alias("brand"))


@query("P18_families", "select event_id, case when regexp_matches(lower(event_type), 'click|cart') then 'H.264' when regexp_matches(lower(event_type), 'view') then 'H.265' else 'other' end as family, coalesce(trim(case when event_id % 4 = 0 then null when event_id % 4 = 1 then 'NA' when event_id % 4 = 2 then '' else '7' end) not in ('', 'NA'), false) as album from events")
def _(spark, d):
    codec = F.regexp_replace(F.regexp_replace("event_type", "^.*(click|cart).*$", "avc1"), "^.*view.*$", "hevc")
    i = F.col("event_id") % 4
    album = F.when(i == 1, "NA").when(i == 2, "").when(i == 3, "7")
    return table(spark, d, "events").select("event_id", classify.codec_family(codec).alias("family"), classify.is_album(album).alias("album"))


_LUMP = "kept as (select p_brand from part group by 1 order by count(*) desc, p_brand limit 4)"


@query("P19_lump", f"with {_LUMP} select case when k.p_brand is null then 'Autres' else p.p_brand end as p_brand, count(*) as n, cast(sum(p_size) as bigint) as size from part p left join kept k on p.p_brand = k.p_brand group by 1")
def _(spark, d):
    return classify.lump(table(spark, d, "part"), "p_brand", 4).groupBy("p_brand").agg(F.count("*").alias("n"), F.sum("p_size").alias("size"))


@query("P20_recode", "select c_custkey, case c_mktsegment when 'BUILDING' then 'batiment' when 'MACHINERY' then 'machines' else c_mktsegment end as segment from customer")
def _(spark, d):
    names = spark.createDataFrame([("BUILDING", "batiment"), ("MACHINERY", "machines")], "from string, to string")
    return classify.translate(table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment")), "segment", names)


@query("P21_exclusions", "select count(*) as n, round(sum(o_totalprice), 2) as total from orders where o_orderkey not in (1, 5, 9) and o_orderdate <= timestamp '1999-10-31'")
def _(spark, d):
    o = table(spark, d, "orders").where(~F.col("o_orderkey").isin(1, 5, 9) & (F.col("o_orderdate") <= F.lit("1999-10-31").cast("timestamp_ntz")))
    return o.agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("P22_contains_nocase", "select doc_id, lang from documents where regexp_matches(lang, '(?i)EN|F')")
def _(spark, d):
    return table(spark, d, "documents").where(F.col("lang").rlike("(?i)EN|F")).select("doc_id", "lang")


@query("P28_needs_translation", "select doc_id, len(regexp_extract_all(t, '[Ѐ-ӿ]')) >= 2 as needs from (select doc_id, case when doc_id % 3 = 0 then text || ' пд' when doc_id % 3 = 1 then 'п ' || text else text end as t from documents)")
def _(spark, d):
    i = F.col("doc_id") % 3
    text = F.when(i == 0, F.concat("text", F.lit(" пд"))).when(i == 1, F.concat(F.lit("п "), "text")).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", classify.needs_translation(text).alias("needs"))


@query("P30_image_format", "select p_partkey, case when h = 0 then null when p_size / h between 0.5 and 0.6 then 'story' when p_size / h between 0.95 and 1.05 then 'square' when p_size / h between 1.7 and 1.8 then 'wide' else 'autre' end as format from (select *, p_partkey % 50 as h from part)")
def _(spark, d):
    buckets = (("story", 0.5, 0.6), ("square", 0.95, 1.05), ("wide", 1.7, 1.8))
    return table(spark, d, "part").select("p_partkey", classify.image_format(F.col("p_size"), F.col("p_partkey") % 50, buckets).alias("format"))


@query("P31_media_type", "select event_id, case when m like 'image/%' then 'photo' when m like 'video/%' then 'video' when m like 'audio/%' then 'audio' when m is not null then 'document' end as kind from (select event_id, case event_id % 7 when 0 then 'image/png' when 1 then 'video/mp4' when 2 then 'audio/ogg' when 3 then 'application/pdf' when 4 then 'text/plain' when 5 then '' end as m from events)")
def _(spark, d):
    mimes = ("image/png", "video/mp4", "audio/ogg", "application/pdf", "text/plain", "")
    mime = F.get(F.array(*map(F.lit, mimes)), (F.col("event_id") % 7).cast("int"))
    return table(spark, d, "events").select("event_id", cleaning.media_from_mime(mime).alias("kind"))


@query("P32_audio_class", "select l_orderkey, l_linenumber, case when greatest(l_discount, l_tax, 0.05) < .06 then 'mixte' when greatest(l_discount, l_tax, 0.05) = l_discount then 'parole' when greatest(l_discount, l_tax, 0.05) = l_tax then 'musique' else 'silence' end as class from lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", classify.audio_class(F.col("l_discount"), F.col("l_tax"), F.lit(0.05), 0.06).alias("class"))


# --- joins ---------------------------------------------------------------------------------------------------------------------


@query("J1_left", "select d.doc_id, quality, toxic from documents d left join labels l using (doc_id)")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", "quality", "toxic")


@query("J2_inner", "select n_name, count(*) as n, round(sum(c_acctbal), 2) as balance from customer join nation on c_nationkey = n_nationkey group by 1")
def _(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("J3_full", "select coalesce(c.k, s.k) as nation, n_c, n_s from (select c_nationkey + 3 as k, count(*) as n_c from customer group by 1) c full join (select s_nationkey as k, count(*) as n_s from supplier group by 1) s on c.k = s.k")
def _(spark, d):
    # keys moved by three, so that either side has some of its own
    c = table(spark, d, "customer").groupBy((F.col("c_nationkey") + 3).alias("nation")).agg(F.count("*").alias("n_c"))
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("n_s"))
    return c.join(s, "nation", "full")


@query("J4_full_two_keys", "select coalesce(a.m, b.m) as month, coalesce(a.p, b.p) as priority, n_open, n_done from (select cast(date_trunc('month', o_orderdate) as date) as m, o_orderpriority as p, count(*) as n_open from orders where o_orderstatus = 'O' group by 1, 2) a full join (select cast(date_trunc('month', o_orderdate) as date) as m, o_orderpriority as p, count(*) as n_done from orders where o_orderstatus = 'F' group by 1, 2) b on a.m = b.m and a.p = b.p")
def _(spark, d):
    o = table(spark, d, "orders").select(periods.start_of(F.col("o_orderdate"), "month").alias("month"), F.col("o_orderpriority").alias("priority"), "o_orderstatus")
    part = lambda s, name: o.where(F.col("o_orderstatus") == s).groupBy("month", "priority").agg(F.count("*").alias(name))
    return part("O", "n_open").join(part("F", "n_done"), ["month", "priority"], "full")


@query("J6_denominators", f"select t.phase, t.n_total, coalesce(c.n, 0) as n, round(100.0 * coalesce(c.n, 0) / t.n_total, 6) as pct from (select {EVENT_PHASE_SQL} as phase, count(*) as n_total from events group by 1) t left join (select {EVENT_PHASE_SQL} as phase, count(*) as n from events where event_type = 'purchase' group by 1) c on t.phase = c.phase where t.phase is not null")
def _(spark, d):
    e = table(spark, d, "events").select(periods.phase_of(F.col("ts"), EVENT_PHASES).alias("phase"), "event_type").where("phase is not null")
    total = e.groupBy("phase").agg(F.count("*").alias("n_total"))
    some = e.where("event_type = 'purchase'").groupBy("phase").agg(F.count("*").alias("n"))
    return total.join(some, "phase", "left").na.fill(0, ["n"]).withColumn("pct", F.round(100 * F.col("n") / F.col("n_total"), 6))


@query("J7_semi", "select l_orderkey, l_linenumber from lineitem where l_partkey in (select p_partkey from part where p_size > 40) and l_suppkey in (select s_suppkey from supplier where s_acctbal > 0)")
def _(spark, d):
    p = table(spark, d, "part").where("p_size > 40").select(F.col("p_partkey").alias("l_partkey"))
    s = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return table(spark, d, "lineitem").join(p, "l_partkey", "left_semi").join(s, "l_suppkey", "left_semi").select("l_orderkey", "l_linenumber")


@query("J8_anti", "select doc_id from documents where doc_id not in (select doc_id from labels)")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left_anti")


@query("S21_inject", "select doc_id, lang from documents where doc_id not in (select doc_id from documents where doc_id % 3 = 0) order by doc_id")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return cleaning.inject(docs.where("doc_id % 3 = 0"), docs, "doc_id").orderBy("doc_id")


@query("J9_dimension", "select r_name, count(*) as n from customer, nation, region where c_nationkey = n_nationkey and n_regionkey = r_regionkey group by 1")
def _(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("r_name").agg(F.count("*").alias("n"))


@query("J18_fallback", "select d.doc_id, coalesce(case when d.doc_id % 2 = 0 then d.source end, cast(l.quality as varchar)) as shown from documents d left join labels l using (doc_id)")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("source"))
    return docs.join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", F.coalesce("source", F.col("quality").cast("string")).alias("shown"))


# --- aggregations and windows --------------------------------------------------------------------------------------------------

_MONTHS = "months as (select cast(unnest(generate_series((select min(m) from c), (select max(m) from c), interval 1 month)) as date) as m)"


@query("A1_complete", f"with c as (select cast(date_trunc('month', o_orderdate) as date) as m, o_orderstatus as s, count(*) as n from orders group by 1, 2), {_MONTHS}, lv as (select unnest(['F', 'O', 'P', 'X']) as s) select months.m as month, lv.s as status, coalesce(n, 0) as n from months cross join lv left join c on c.m = months.m and c.s = lv.s")
def _(spark, d):
    o = table(spark, d, "orders")
    counts = o.groupBy(periods.start_of(F.col("o_orderdate"), "month").alias("month"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    return periods.complete(counts, "month", fill={"n": 0}, levels={"status": ["F", "O", "P", "X"]})


@query("A2_sums", "select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as qty, round(sum(l_extendedprice), 2) as price, round(avg(l_quantity), 6) as mean from lineitem group by 1, 2")
def _(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus")
    return g.agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum("l_extendedprice"), 2).alias("price"), F.round(F.avg("l_quantity"), 6).alias("mean"))


@query("A4_quantiles", "select event_type, round(quantile_cont(value, .25), 6) as p25, round(quantile_cont(value, .5), 6) as p50, round(quantile_cont(value, .75), 6) as p75 from events group by 1")
def _(spark, d):
    return summaries.exact_quantiles(table(spark, d, "events"), ["event_type"], "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75}, decimals=6)


@query("A5_distinct", "select event_type, count(distinct user_id) as users, count(distinct cast(ts as date)) as days from events group by 1")
def _(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), F.countDistinct(F.col("ts").cast("date")).alias("days"))


@query("A6_distinct_count", "select event_type, count(*) as n from (select distinct user_id, event_type from events) group by 1")
def _(spark, d):
    return table(spark, d, "events").select("user_id", "event_type").distinct().groupBy("event_type").agg(F.count("*").alias("n"))


@query("A7_rate", "select source, round(100.0 * avg(case when n_chars > 1000 then 1.0 else 0.0 end), 6) as pct_long, count(*) filter (where lang = 'en') as n_en from documents group by 1")
def _(spark, d):
    g = table(spark, d, "documents").groupBy("source")
    return g.agg(F.round(summaries.rate(F.col("n_chars") > 1000), 6).alias("pct_long"), F.count_if(F.col("lang") == "en").alias("n_en"))


@query("A9_first_last", "select user_id, min(ts) as first_ts, max(ts) as last_ts, arg_min(event_type, (ts, event_id)) as first_type from events group by 1")
def _(spark, d):
    g = table(spark, d, "events").groupBy("user_id")
    return g.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.min_by("event_type", F.struct("ts", "event_id")).alias("first_type"))


@query("A14_strategies", "select l_returnflag, round(avg(l_discount), 4) as l_discount, round(max(l_tax), 4) as l_tax, round(quantile_cont(l_quantity, .75), 4) as l_quantity, round(avg(l_discount), 4) >= .05 as l_discount_flag, round(max(l_tax), 4) >= .05 as l_tax_flag, round(quantile_cont(l_quantity, .75), 4) >= .05 as l_quantity_flag from lineitem group by 1")
def _(spark, d):
    return summaries.by_strategy(table(spark, d, "lineitem"), ["l_returnflag"], {"l_discount": "mean", "l_tax": "max", "l_quantity": "p75"}, 0.05)


@query("A15_modal", "select p_brand, p_type as modal, n from (select p_brand, p_type, count(*) as n, row_number() over (partition by p_brand order by count(*) desc, p_type) as r from part group by 1, 2) where r = 1")
def _(spark, d):
    return summaries.modal(table(spark, d, "part"), ["p_brand"], "p_type")


@query("A16_crosstab", f"select {EVENT_PHASE_SQL} as phase, count(*) filter (where event_type = 'click') as click, count(*) filter (where event_type = 'view') as view, count(*) filter (where event_type in ('click', 'view')) as total from events group by 1")
def _(spark, d):
    e = table(spark, d, "events").select(periods.phase_of(F.col("ts"), EVENT_PHASES).alias("phase"), "event_type")
    return summaries.crosstab(e, "phase", "event_type", ["click", "view"])


@query("A17_entities", "with c as (select regexp_extract(lower(text), '[a-z]+') as entity, role from conversations) select entity, count(*) filter (where role = 'user') as user, count(*) filter (where role = 'assistant') as assistant, count(*) filter (where role in ('user', 'assistant')) as total from c group by 1 having total >= 2")
def _(spark, d):
    c = table(spark, d, "conversations").select(F.regexp_extract(F.lower("text"), "[a-z]+", 0).alias("entity"), "role")
    return summaries.crosstab(c, "entity", "role", ["user", "assistant"]).where("total >= 2")


@query("A20_histogram", "with x as (select vec_id, label, unnest(embedding) as v from embeddings), t as (select vec_id, label, sum(abs(cast(v as double))) as t from x group by 1, 2) select x.vec_id, round(-sum(case when v <> 0 then abs(cast(v as double)) / t * log2(abs(cast(v as double)) / t) else 0 end), 6) as entropy, round(stddev_pop(cast(v as double)), 6) as spread from x join t using (vec_id) group by 1")
def _(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("h"), "embedding")
    n = F.size("embedding")
    mean = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")) / n
    spread = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + (x.cast("double") - mean) * (x.cast("double") - mean)) / n)
    return e.select("vec_id", F.round(summaries.entropy(F.col("h")), 6).alias("entropy"), F.round(spread, 6).alias("spread"))


@query("A21_mean_vector", "with x as (select label, unnest(embedding) as v, unnest(range(len(embedding))) as i from embeddings) select label, cast(i as integer) as i, round(avg(cast(v as double)), 6) as mean from x group by 1, 2")
def _(spark, d):
    e = table(spark, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v"))
    means = summaries.mean_vector(e, ["label"], "v")
    return means.select("label", F.posexplode("mean").alias("i", "m")).select("label", "i", F.round("m", 6).alias("mean"))


@query("A26_with_totals", "select lang, count(*) as n, round(avg(n_chars), 6) as mean from documents group by 1 union all select 'all', count(*), round(avg(n_chars), 6) from documents")
def _(spark, d):
    return summaries.with_totals(table(spark, d, "documents").select("lang", "n_chars"), "lang").groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean"))


@query("A28_albums", "select conv_id, count(*) as size, list_aggregate(list_sort(list_distinct(list(role))), 'string_agg', '+') as composition from conversations group by 1")
def _(spark, d):
    return summaries.albums(table(spark, d, "conversations"), "conv_id", "role")


@query("W1_row_number", "select event_id, row_number() over (partition by event_type order by ts, event_id) as n from events")
def _(spark, d):
    from tessera.operators.ordering import Ordered

    return Ordered(table(spark, d, "events").select("event_type", "ts", "event_id"), ["event_type"], ["ts", "event_id"]).scan(n=("sum", None)).rows.select("event_id", "n")


@query("W2_top_n", "select o_orderpriority, o_orderkey, r as rank from (select *, row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) as r from orders) where r <= 5")
def _(spark, d):
    best = top_n(table(spark, d, "orders"), ["o_orderpriority"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 5)
    return best.select("o_orderpriority", "o_orderkey", F.col("rank").cast("long").alias("rank"))


@query("W2_top_n_ties", "select p_brand, p_partkey, p_size from (select *, rank() over (partition by p_brand order by p_size desc) as r from part) where r <= 3")
def _(spark, d):
    p = table(spark, d, "part").withColumn("r", F.rank().over(Window.partitionBy("p_brand").orderBy(F.desc("p_size"))))
    return p.where("r <= 3").select("p_brand", "p_partkey", "p_size")


@query("W3_capped_rank", "select event_type, day, n, case when n > 0 then least(rank() over (partition by event_type order by n desc), 11) else 11 end as rank from (select event_type, cast(ts as date) as day, count(*) as n from events group by 1, 2)")
def _(spark, d):
    counts = table(spark, d, "events").groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"))
    return counts.withColumn("rank", summaries.capped_rank("n", ["event_type"], 10).cast("long"))


@query("W4_share", "select l_returnflag, l_linestatus, n, round(100.0 * n / sum(n) over (partition by l_returnflag), 4) as share from (select l_returnflag, l_linestatus, count(*) as n from lineitem group by 1, 2)")
def _(spark, d):
    return summaries.share(table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n")), "n", ["l_returnflag"])


_MONTHLY = "(select cast(date_trunc('month', o_orderdate) as date) as month, count(*) as n, median(o_totalprice) as med from orders group by 1)"


def _monthly(spark, d):
    o = table(spark, d, "orders").withColumn("month", periods.start_of(F.col("o_orderdate"), "month"))
    return summaries.with_quantiles(o, ["month"], {"med": ("o_totalprice", 0.5)}, F.count("*").alias("n"))


@query("W5_index", f"select month, n, round(100.0 * (n - min(n) over ()) / (max(n) over () - min(n) over ()), 4) as index, round(100 - 100.0 * (med - min(med) over ()) / (max(med) over () - min(med) over ()), 4) as inverted from {_MONTHLY}")
def _(spark, d):
    one = summaries.index_100(_monthly(spark, d), "n")
    return summaries.index_100(one, "med", name="inverted", inverted=True).drop("med")


@query("W6_extrapolate", "select m as month, case when m = (select max(cast(date_trunc('month', o_orderdate) as date)) from orders) then n * l.days / l.covered else cast(n as double) end as n from (select cast(date_trunc('month', o_orderdate) as date) as m, count(*) as n from orders group by 1), (select day(last_day(max(o_orderdate))) as days, day(max(o_orderdate)) as covered from orders) l")
def _(spark, d):
    o = table(spark, d, "orders")
    last = o.agg(F.max("o_orderdate")).first()[0]
    counts = o.groupBy(periods.start_of(F.col("o_orderdate"), "month").alias("month")).agg(F.count("*").alias("n"))
    return periods.extrapolate_last(counts, "month", "n", F.lit(last))


@query("W7_change_points", "select day, before, top from (select day, top, lag(top) over (order by day) as before from (select day, event_type as top from (select cast(ts as date) as day, event_type, row_number() over (partition by cast(ts as date) order by count(*) desc, event_type) as r from events group by 1, 2) where r = 1)) where before is not null and before <> top")
def _(spark, d):
    tops = summaries.modal(table(spark, d, "events").withColumn("day", F.col("ts").cast("date")), ["day"], "event_type", "top")
    return summaries.change_points(tops, "top", ["day"]).select("day", "before", "top")


@query("W10_album_rank", "select conv_id, turn, row_number() over (partition by conv_id order by turn) as rank from conversations")
def _(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long").alias("rank"))


@query("W11_keep_best", "select user_id, day, event_id from (select *, row_number() over (partition by user_id, day order by value desc nulls last, ts, event_id) as r from (select *, cast(ts as date) as day from events)) where r = 1")
def _(spark, d):
    e = table(spark, d, "events").withColumn("day", F.col("ts").cast("date"))
    return cleaning.keep_best(e, ["user_id", "day"], [F.desc_nulls_last("value"), F.asc("ts"), F.asc("event_id")]).select("user_id", "day", "event_id")


@query("W12_calendar", "select cast(unnest(generate_series((select min(cast(date_trunc('month', o_orderdate) as date)) from orders), (select max(cast(date_trunc('month', o_orderdate) as date)) from orders), interval 1 month)) as date) as month")
def _(spark, d):
    return periods.calendar(table(spark, d, "orders").select(periods.start_of(F.col("o_orderdate"), "month").alias("month")), "month")


@query("W14_average_ranks", "select event_id, rank() over (partition by event_type order by k) + (count(*) over (partition by event_type, k) - 1) / 2.0 as r from (select event_id, event_type, round(value) as k from events)")
def _(spark, d):
    from tessera.operators.statistics import ranked

    e = table(spark, d, "events").select("event_id", "event_type", F.round("value").alias("k"))
    return ranked(e, "k", ["event_type"]).select("event_id", "r")


@query("W15_position", "select conv_id, turn, case when n > 1 then (r - 1) / (n - 1) else 0.0 end as position from (select conv_id, turn, row_number() over (partition by conv_id order by turn) as r, count(*) over (partition by conv_id) as n from conversations)")
def _(spark, d):
    from tessera.functions.media import relative_position

    w = Window.partitionBy("conv_id")
    c = table(spark, d, "conversations").select("conv_id", "turn", F.row_number().over(w.orderBy("turn")).alias("r"), F.count("*").over(w).alias("n"))
    return c.select("conv_id", "turn", relative_position(F.col("r"), F.col("n")).alias("position"))


@query("W16_cumulative", f"select month, n, cast(sum(n) over (order by month) as bigint) as upto from {_MONTHLY}")
def _(spark, d):
    return _monthly(spark, d).select("month", "n", F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("month")).alias("upto"))


@query("W17_middle", "select conv_id, list_sort(list(turn))[len(list(turn)) // 2 + 1] as middle from conversations group by 1")
def _(spark, d):
    from tessera.functions.media import middle

    return table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list("turn").alias("t")).select("conv_id", middle(F.col("t")).alias("middle"))


@query("W18_winsorise", "with h as (select hour(ts) as hour, isodow(ts) as dow, cast(count(*) as double) as n from events group by 1, 2) select hour, dow, least(n, (select quantile_cont(n, .98) from h)) as n from h")
def _(spark, d):
    h = table(spark, d, "events").groupBy(F.hour("ts").cast("long").alias("hour"), (F.weekday("ts") + 1).cast("long").alias("dow")).agg(F.count("*").cast("double").alias("n"))
    return summaries.winsorise(h, "n", 0.98)


@query("W19_ecdf", "select distinct event_type, k, round(cume_dist() over (partition by event_type order by k), 6) as p from (select event_type, round(value) as k from events)")
def _(spark, d):
    return summaries.ecdf(table(spark, d, "events").select("event_type", F.round("value").alias("k")), "k", ["event_type"])


@query("T1_systematic_sample", "select doc_id from (select doc_id, row_number() over (order by doc_id) - 1 as r from documents) where r % 10 = 0")
def _(spark, d):
    # systematic sampling is the feature: every tenth row in order of id
    from tessera.operators.ordering import running_sum

    return running_sum(table(spark, d, "documents").select("doc_id"), ["doc_id"]).where("(upto - 1) % 10 = 0").select("doc_id")


# --- sets and shapes -----------------------------------------------------------------------------------------------------------


@query("U1_union_all", "select c_nationkey as k, 'c' as kind from customer union all select s_nationkey, 's' from supplier")
def _(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.lit("c").alias("kind"))
    return c.unionByName(table(spark, d, "supplier").select(F.lit("s").alias("kind"), F.col("s_nationkey").alias("k")))


@query("U2_union", "select c_nationkey as k from customer union select s_nationkey from supplier")
def _(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


@query("R1_longer", "select p_partkey, 'p_size' as name, cast(p_size as double) as value from part union all select p_partkey, 'p_retailprice', p_retailprice from part")
def _(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return p.unpivot("p_partkey", ["p_size", "p_retailprice"], "name", "value")


@query("R2_wider", "select cast(ts as date) as day, count(*) filter (where event_type = 'click') as click, count(*) filter (where event_type = 'view') as view from events group by 1")
def _(spark, d):
    e = table(spark, d, "events").withColumn("day", F.col("ts").cast("date"))
    return e.groupBy("day").pivot("event_type", ["click", "view"]).count().na.fill(0)


@query("R3_unnest", r"select page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) as url from pages")
def _(spark, d):
    from tessera.functions.text import hrefs

    return table(spark, d, "pages").select("page_id", F.explode(hrefs(F.col("html"))).alias("url"))


# --- the report queries --------------------------------------------------------------------------------------------------------


@query("Q01_posts_by_month", f"with c as (select cast(date_trunc('month', o_orderdate) as date) as m, count(*) as n from orders group by 1), {_MONTHS} select months.m as month, coalesce(n, 0) as n from months left join c on c.m = months.m")
def _(spark, d):
    o = table(spark, d, "orders")
    return periods.complete(o.groupBy(periods.start_of(F.col("o_orderdate"), "month").alias("month")).agg(F.count("*").alias("n")), "month", fill={"n": 0})


@query("Q02_median_by_month", f"with c as (select cast(date_trunc('month', o_orderdate) as date) as m, round(median(o_totalprice), 4) as med from orders where o_orderstatus = 'P' group by 1), {_MONTHS} select months.m as month, med from months left join c on c.m = months.m")
def _(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'P'")
    rows = o.select(periods.start_of(F.col("o_orderdate"), "month").alias("month"), "o_totalprice")
    return periods.complete(summaries.exact_quantiles(rows, ["month"], "o_totalprice", {"med": 0.5}, decimals=4), "month")


@query("Q03_overlay", "with a as (select cast(date_trunc('month', o_orderdate) as date) as month, count(*) as n from orders group by 1), b as (select cast(date_trunc('month', o_orderdate) as date) as month, avg(o_totalprice) as mean from orders where o_orderstatus = 'F' group by 1), j as (select coalesce(a.month, b.month) as month, n, mean from a full join b on a.month = b.month) select month, 'n' as series, round(100.0 * (n - min(n) over ()) / (max(n) over () - min(n) over ()), 4) as index from j union all select month, 'mean', round(100.0 * (mean - min(mean) over ()) / (max(mean) over () - min(mean) over ()), 4) from j")
def _(spark, d):
    o = table(spark, d, "orders").withColumn("month", periods.start_of(F.col("o_orderdate"), "month"))
    a = o.groupBy("month").agg(F.count("*").cast("double").alias("n"))
    b = o.where("o_orderstatus = 'F'").groupBy("month").agg(F.avg("o_totalprice").alias("mean"))
    long = a.join(b, "month", "full").unpivot("month", ["n", "mean"], "series", "value")
    return summaries.index_100(long, "value", ["series"]).drop("value")


@query("Q04_media_mix", f"select {EVENT_PHASE_SQL} as phase, event_type, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (partition by {EVENT_PHASE_SQL}), 4) as share from events where {EVENT_PHASE_SQL} is not null group by 1, 2")
def _(spark, d):
    e = table(spark, d, "events").select(periods.phase_of(F.col("ts"), EVENT_PHASES).alias("phase"), "event_type").where("phase is not null")
    return summaries.share(e.groupBy("phase", "event_type").agg(F.count("*").alias("n")), "n", ["phase"])


@query("Q12_resolutions", "with b as (select case when r <= 12 then s else 'Autres' end as resolution, n from (select cast(p_size as varchar) || 'x' || cast(p_partkey % 4 as varchar) as s, count(*) as n, row_number() over (order by count(*) desc, cast(p_size as varchar) || 'x' || cast(p_partkey % 4 as varchar)) as r from part group by 1)) select resolution, cast(sum(n) as bigint) as n from b group by 1")
def _(spark, d):
    from tessera.functions.media import resolution

    p = table(spark, d, "part").select(resolution(F.col("p_size"), F.col("p_partkey") % 4).alias("resolution"))
    return classify.lump(p, "resolution", 12).groupBy("resolution").agg(F.count("*").alias("n"))


@query("Q17_links_by_platform", f"with l as (select distinct page_id, {_case('u', classify.PLATFORMS)} as platform from (select page_id, {_URLS} as u from pages)), c as (select platform, count(*) as n from l where platform is not null group by 1) select coalesce(platform, 'none') as platform, n from (select * from c union all select 'none', (select count(*) from pages) - (select count(distinct page_id) from l where platform is not null))")
def _(spark, d):
    pages = table(spark, d, "pages").select("page_id", classify.first_match(_urls(), classify.PLATFORMS).alias("platform")).distinct()
    return pages.groupBy(F.coalesce("platform", F.lit("none")).alias("platform")).agg(F.count("*").alias("n"))


@query("Q18_heatmap", "select isodow(t) as dow, hour(t) as hour, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 4) as share from (select ts + interval 1 hour as t from events) group by 1, 2")
def _(spark, d):
    t = periods.local(F.col("ts"), "Europe/Paris")  # January: one hour ahead of UTC
    counts = table(spark, d, "events").groupBy((F.weekday(t) + 1).cast("long").alias("dow"), F.hour(t).cast("long").alias("hour")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    return counts.crossJoin(F.broadcast(total)).select("dow", "hour", "n", F.round(100 * F.col("n") / F.col("t"), 4).alias("share"))


@query("Q22_caption_length", "select role, round(quantile_cont(length(text), .25), 6) as p25, round(quantile_cont(length(text), .5), 6) as p50, round(quantile_cont(length(text), .75), 6) as p75 from conversations where trim(text) <> '' group by 1")
def _(spark, d):
    c = table(spark, d, "conversations").where(cleaning.blank_to_null(F.col("text")).isNotNull()).withColumn("n", F.char_length("text"))
    return summaries.exact_quantiles(c, ["role"], "n", {"p25": 0.25, "p50": 0.5, "p75": 0.75}, decimals=6)


@query("Q28_views_by_week", "select cast(date_trunc('week', ts) as date) as week, round(sum(value), 4) as total, round(sum(value) / count(*), 7) as mean, count(*) as n from events where event_type = 'view' and value is not null group by 1")
def _(spark, d):
    e = table(spark, d, "events").where("event_type = 'view' and value is not null").groupBy(periods.start_of(F.col("ts"), "week").alias("week"))
    return e.agg(F.round(F.sum("value"), 4).alias("total"), F.round(F.sum("value") / F.count("*"), 7).alias("mean"), F.count("*").alias("n"))


@query("Q28_views_by_sunday_week", "select cast(date_trunc('week', ts + interval 1 day) as date) - 1 as week, count(*) as n from events group by 1")
def _(spark, d):
    return table(spark, d, "events").groupBy(periods.start_of(F.col("ts"), "week_sunday").alias("week")).agg(F.count("*").alias("n"))


@query("Q36_index_by_phase", f"with m as (select {ORDER_PHASE_SQL} as phase, cast(date_trunc('month', o_orderdate) as date) as month, count(*) as n from orders group by 1, 2) select phase, month, n, round(100.0 * (n - min(n) over (partition by phase)) / nullif(max(n) over (partition by phase) - min(n) over (partition by phase), 0), 4) as index from m where phase is not null")
def _(spark, d):
    o = table(spark, d, "orders").select(periods.phase_of(F.col("o_orderdate"), ORDER_PHASES).alias("phase"), periods.start_of(F.col("o_orderdate"), "month").alias("month")).where("phase is not null")
    return summaries.index_100(o.groupBy("phase", "month").agg(F.count("*").alias("n")), "n", ["phase"])


@query("Q37_cross_category", "select cast(date_trunc('quarter', o_orderdate) as date) as quarter, o_orderstatus || ' ' || o_orderpriority as category, count(*) as n from orders group by 1, 2")
def _(spark, d):
    category = F.concat_ws(" ", "o_orderstatus", "o_orderpriority")
    return table(spark, d, "orders").groupBy(periods.start_of(F.col("o_orderdate"), "quarter").alias("quarter"), category.alias("category")).agg(F.count("*").alias("n"))


@query("Q39_speech", f"select {EVENT_PHASE_SQL} as phase, round(median(value / 100), 6) as med, round(avg(value / 100), 6) as mean, round(100.0 * avg(case when value > 10 then 1.0 else 0.0 end), 6) as pct from events where {EVENT_PHASE_SQL} is not null group by 1")
def _(spark, d):
    e = table(spark, d, "events").select(periods.phase_of(F.col("ts"), EVENT_PHASES).alias("phase"), "value").where("phase is not null")
    e = e.withColumn("x", F.col("value") / 100)
    return summaries.with_quantiles(e, ["phase"], {"med": ("x", 0.5)}, F.round(F.avg("x"), 6).alias("mean"), F.round(summaries.rate(F.col("value") > 10), 6).alias("pct"), decimals=6)


@query("Q40_two_step_lump", "with top as (select p_type from part group by 1 order by count(*) desc, p_type limit 6), c as (select p_brand, case when t.p_type is null then 'Autres' else p.p_type end as p_type, count(*) as n from part p left join top t on p.p_type = t.p_type group by 1, 2) select p_brand, p_type, n, round(100.0 * n / sum(n) over (partition by p_brand), 4) as share from c")
def _(spark, d):
    lumped = classify.lump(table(spark, d, "part"), "p_type", 6)
    return summaries.share(lumped.groupBy("p_brand", "p_type").agg(F.count("*").alias("n")), "n", ["p_brand"])


@query("Q42_brand_dates", "select event_type, min(cast(ts as date)) as first_day, max(cast(ts as date)) as last_day, count(*) as n from events where value > 90 group by 1")
def _(spark, d):
    e = table(spark, d, "events").where("value > 90").groupBy("event_type")
    return e.agg(F.min(F.col("ts").cast("date")).alias("first_day"), F.max(F.col("ts").cast("date")).alias("last_day"), F.count("*").alias("n"))


@query("Q43_album_sizes", "select size, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 4) as share from (select conv_id, count(*) as size from conversations group by 1) group by 1")
def _(spark, d):
    sizes = summaries.albums(table(spark, d, "conversations"), "conv_id", "role").groupBy("size").agg(F.count("*").alias("n"))
    return summaries.share(sizes.withColumn("all", F.lit(1)), "n", ["all"]).drop("all")


@query("Q45_ratios", "select cast(date_trunc('month', o_orderdate) as date) as month, round(median(1000 * l / o_totalprice), 6) as per_mille from (select o_orderdate, o_totalprice, count(*) as l from orders join lineitem on l_orderkey = o_orderkey where o_totalprice > 0 group by o_orderkey, o_orderdate, o_totalprice) group by 1")
def _(spark, d):
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("l"))
    o = table(spark, d, "orders").where("o_totalprice > 0").join(n, "o_orderkey")
    rows = o.select(periods.start_of(F.col("o_orderdate"), "month").alias("month"), (1000 * F.col("l") / F.col("o_totalprice")).alias("x"))
    return summaries.exact_quantiles(rows, ["month"], "x", {"per_mille": 0.5}, decimals=6)


@query("Q46_synthesis", f"with m as (select cast(date_trunc('month', o_orderdate) as date) as month, median(o_totalprice) as price, avg(case when o_orderstatus = 'O' then 1.0 else 0.0 end) as open, count(*) as n from orders group by 1), l as (select month, 'price' as series, price as v from m union all select month, 'open', open from m union all select month, 'n', n from m) select month, series, round(100.0 * (v - min(v) over (partition by series)) / nullif(max(v) over (partition by series) - min(v) over (partition by series), 0), 4) as index from l")
def _(spark, d):
    o = table(spark, d, "orders").withColumn("month", periods.start_of(F.col("o_orderdate"), "month"))
    m = summaries.with_quantiles(o, ["month"], {"price": ("o_totalprice", 0.5)}, F.avg((F.col("o_orderstatus") == "O").cast("double")).alias("open"), F.count("*").cast("double").alias("n"))
    return summaries.index_100(m.unpivot("month", ["price", "open", "n"], "series", "v"), "v", ["series"]).drop("v")


@query("Q51_audio_means", "select l_shipmode_, round(avg(l_discount), 6) as discount, round(avg(l_tax), 6) as tax, count(*) as n from (select *, l_returnflag || l_linestatus as l_shipmode_ from lineitem) group by 1")
def _(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("l_shipmode_"))
    return g.agg(F.round(F.avg("l_discount"), 6).alias("discount"), F.round(F.avg("l_tax"), 6).alias("tax"), F.count("*").alias("n"))


@query("X2_windowed_counts", "select cast(date_trunc('day', ts) as timestamp) as start, event_type, count(*) as n from events group by 1, 2")
def _(spark, d):
    e = table(spark, d, "events").groupBy(F.window("ts", "1 day"), "event_type").count()
    return e.select(F.col("window.start").alias("start"), "event_type", F.col("count").alias("n"))


@query("X2_sessions", "with f as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hour then 0 else 1 end as new from events), g as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as s from f) select user_id, min(ts) as start, count(*) as n from g group by user_id, s")
def _(spark, d):
    e = table(spark, d, "events").groupBy(F.session_window("ts", "6 hours"), "user_id").count()
    return e.select("user_id", F.col("session_window.start").alias("start"), F.col("count").alias("n"))
