"""Queries for operators that the other catalogues use only in passing: scalar functions, nested records, sinks, twins of streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import media
from tessera.functions import text as words
from tessera.operators import classify, cleaning, concordance, lexical, periods, statistics, summaries
from tessera.plans.lexicometry import NETWORK, cooccurrence_sql, network_edges
from tessera.plans.registry import TOKENS_SQL, erfc_sql, query, table


@query("P24_confidence_gate", "select event_id, case when coalesce(c, 0) >= .5 then event_type else '' end as strict, case when coalesce(c, 1) >= .5 then event_type else '' end as lenient from (select *, case when event_id % 3 <> 0 then value / 100 end as c from events)")
def _(spark, d):
    rows = table(spark, d, "events").select("event_id", "event_type", F.when(F.col("event_id") % 3 != 0, F.col("value") / 100).alias("c"))
    gate = lambda default: F.when(F.coalesce("c", F.lit(default)) >= 0.5, F.col("event_type")).otherwise("")
    return rows.select("event_id", gate(0.0).alias("strict"), gate(1.0).alias("lenient"))


#: Texts with their vowels and commonest consonants as Cyrillic letters, so that a segment's letters are of both scripts.
_LATIN, _CYRILLIC = "aeiounrstldhcmA", "аеіоунрстлдхцмА"


@query("P27_clean_segments", rf"with s as (select conv_id, translate(text, '{_LATIN}', '{_CYRILLIC}') as t from conversations), n as (select *, len(regexp_extract_all(t, '\p{{L}}')) as letters, len(regexp_extract_all(t, '[Ѐ-ӿ]')) as cyrillic from s) select conv_id, count(*) filter (where not regexp_matches(t, '[A-Za-z]{{4,}}') and (letters = 0 or (letters - cyrillic) / letters <= .4)) as kept from n group by 1")
def _(spark, d):
    text = F.translate("text", _LATIN, _CYRILLIC)
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct(text.alias("text"))).alias("s"))
    return c.select("conv_id", F.size(classify.clean_segments(F.col("s"))).cast("long").alias("kept"))


@query("P29_watermark", "select l_orderkey, l_linenumber, l_returnflag = 'R' or l_quantity < 15 or l_quantity > 85 as mark from lineitem")
def _(spark, d):
    point = lambda dy: F.array(F.lit(0.0), F.col("l_quantity") + dy)
    box = F.array(point(-2), point(2), point(-1), point(1))
    mark = classify.is_watermark(F.col("l_returnflag"), box, "r", F.lit(100.0))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", mark.alias("mark"))


@query("P33_message_rows", "select event_id as message_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') as date, event_id % 2 = 0 as est_transfere, nullif(case when event_id % 3 = 0 then '' else event_type end, '') as legende, 30 as largeur from events")
def _(spark, d):
    e = table(spark, d, "events")
    sizes = F.array(F.struct(F.lit(10).alias("w"), F.lit(10).alias("h")), F.struct(F.lit(30).alias("w"), F.lit(20).alias("h")))
    api = F.struct(
        F.col("event_id").alias("id"), F.col("ts").alias("date"), F.lit(None).cast("long").alias("grouped_id"), F.when(F.col("event_id") % 2 == 0, "x").alias("fwd_from"),
        F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("event_type")).alias("message"), sizes.alias("photo_sizes"),
        F.lit(None).cast("struct<w:int,h:int,duration:double>").alias("video"), F.lit(1).cast("long").alias("views"), F.lit(0).cast("long").alias("forwards"),
    )
    return e.select(media.message_row(api).alias("m")).select("m.message_id", "m.date", "m.est_transfere", "m.legende", "m.largeur")


@query("J5_calendar_join", "with c as (select cast(ts as date) + case when day(ts) % 5 = 0 then 1 else 0 end as day, count(*) as n from events group by 1), k as (select cast(unnest(generate_series(date '2024-01-01', date '2024-01-31', interval 1 day)) as date) as day) select k.day, coalesce(n, 0) as n from k left join c on c.day = k.day")
def _(spark, d):
    day = F.date_add(F.col("ts").cast("date"), F.when(F.dayofmonth("ts") % 5 == 0, 1).otherwise(0))  # every fifth day has no rows
    counts = table(spark, d, "events").groupBy(day.alias("day")).agg(F.count("*").alias("n"))
    days = spark.range(1).select(F.explode(F.expr("sequence(date '2024-01-01', date '2024-01-31', interval 1 day)")).alias("day"))
    return periods.complete(counts, "day", fill={"n": 0}, skeleton=days)


@query("J10_child_parent", "select l_orderkey, l_linenumber, o_orderstatus from lineitem left join (select * from orders where o_orderstatus <> 'P') on o_orderkey = l_orderkey")
def _(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").join(o, "l_orderkey", "left")


@query("J12_lookup", "select e.vec_id, d.lang from embeddings e join documents d on d.doc_id = e.vec_id")
def _(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "lang")
    return table(spark, d, "embeddings").select("vec_id").join(docs, "vec_id")


@query("J13_window_pairs", f"with {TOKENS_SQL}, v as (select unnest(['the', 'of', 'and', 'de', 'la']) as lemma), t as (select tok.* from tok join v using (lemma)) select distinct x.doc_id, least(x.lemma, y.lemma) as a, greatest(x.lemma, y.lemma) as b from t x join t y on x.doc_id = y.doc_id and y.pos - x.pos between 1 and 5 and x.lemma <> y.lemma")
def _(spark, d):
    rows = lexical.tokens(table(spark, d, "documents"), keep=("doc_id",))
    vocabulary = spark.createDataFrame([(x,) for x in ("the", "of", "and", "de", "la")], "lemma string")
    return lexical.window_pairs(rows, vocabulary, 5)


@query("J17_topics_by_date")
def _(spark, d):
    from tessera.operators import topics

    docs = table(spark, d, "documents")
    lists = concordance.token_lists(docs, keep=("doc_id",)).withColumnRenamed("tokens", "lemmas")
    rows, _ = topics.vectors(lists)
    found = topics.document_topics(topics.fit(rows, 4), rows, "doc_id")
    return found.join(docs.select("doc_id", "lang"), "doc_id", "left").groupBy("lang", "dominant").agg(F.count("*").alias("n"))


@query("A3_median", "select event_type, median(value) as med from events group by 1")
def _(spark, d):
    return summaries.exact_quantiles(table(spark, d, "events"), ["event_type"], "value", {"med": 0.5})


@query("A8_share_of_total", "select o_orderpriority, count(*) as n, round(100.0 * count(*) / (select count(*) from orders), 4) as share from orders group by 1")
def _(spark, d):
    counts = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")).withColumn("all", F.lit(1))
    return summaries.share(counts, "n", ["all"]).drop("all")


@query("A13_faces_by_phase", "with f as (select user_id as m, cast(ts as date) as frame, event_id % 5 - 1 as face, event_type = 'click' as tgt from events), g as (select m, m % 3 as phase, count(distinct frame) as fr, count(*) filter (where face >= 0) as n, count(distinct frame) filter (where face >= 0 and tgt) as hit from f group by 1) select phase, count(*) as n_messages, round(100.0 * avg(case when hit > 0 then 1.0 else 0.0 end), 2) as pct_with_target from g group by 1")
def _(spark, d):
    faces = table(spark, d, "events").select(
        F.col("user_id").alias("message_id"), F.col("ts").cast("date").cast("string").alias("frame_filename"), F.lit(0.5).alias("frame_position"), (F.col("event_id") % 5 - 1).alias("face_index"),
        F.lit(0).alias("cluster_id"), (F.col("event_type") == "click").alias("is_target"), F.lit(0.5).alias("similarity"), F.lit("").alias("date"), (F.col("user_id") % 3).alias("phase"),
    )
    return summaries.faces_by(summaries.faces_by_message(faces), ["phase"]).select("phase", "n_messages", "pct_with_target")


@query("A24_speech", "select conv_id, round(sum(length(role) / 10.0), 6) as seconds, round(sum(length(role) / 10.0) / (10.0 * count(*)), 6) as ratio, round(exp(avg(-length(role) / 20.0)), 6) as confidence from conversations group by 1")
def _(spark, d):
    size = F.char_length("role") / 10
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct(F.lit(0.0).alias("start"), size.alias("end"))).alias("s"), F.collect_list(-size / 2).alias("p"), F.count("*").alias("n"))
    seconds, ratio = summaries.speech(F.col("s"), F.col("n") * 10.0)
    return c.select("conv_id", F.round(seconds, 6).alias("seconds"), F.round(ratio, 6).alias("ratio"), F.round(summaries.confidence(F.col("p")), 6).alias("confidence"))


@query("A25_scenes", "select l_orderkey, count(*) - 1 as cuts, round((count(*) - 1) / (sum(l_quantity) / 60), 4) as per_minute, round(sum(l_quantity) / count(*), 4) as mean from lineitem group by 1")
def _(spark, d):
    o = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("s"), F.sum("l_quantity").alias("q"))
    cuts, rate, mean = summaries.scene_summary(F.col("s"), F.col("q"))
    return o.select("l_orderkey", cuts.cast("long").alias("cuts"), rate.alias("per_minute"), mean.alias("mean"))


@query("A27_grouped_correlation", "select l_returnflag, count(*) as n, round(corr(l_quantity, l_extendedprice), 4) as r from lineitem group by 1")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.corr("l_quantity", "l_extendedprice"), 4).alias("r"))


@query("A29_reactions", "select user_id, cast(sum(event_id % 10) as bigint) as total, count(*) filter (where event_id % 4 <> 0) as plain from events group by 1")
def _(spark, d):
    reaction = F.struct(F.when(F.col("event_id") % 4 != 0, F.col("event_type")).alias("emoji"), (F.col("event_id") % 10).alias("count"))
    e = table(spark, d, "events").groupBy("user_id").agg(F.collect_list(reaction).alias("r"))
    total, plain = summaries.reaction_totals(F.col("r"))
    return e.select("user_id", total.alias("total"), words.length_of(plain).cast("long").alias("plain"))


@query("A30_unit_means", "with x as (select label, unnest(embedding) as v, unnest(range(len(embedding))) as i from embeddings), m as (select label, i, avg(cast(v as double)) as m from x group by 1, 2) select label, cast(i as integer) as i, round(m / sqrt(sum(m * m) over (partition by label)), 6) as u from m")
def _(spark, d):
    rows = table(spark, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v"))
    means = summaries.mean_vector(rows, ["label"], "v")
    return means.select("label", F.posexplode(summaries.normalised(F.col("mean"))).alias("i", "u")).withColumn("u", F.round("u", 6))


@query("W8_bigrams", f"with {TOKENS_SQL}, n as (select lemma as w1, lead(lemma) over (partition by doc_id order by pos) as w2 from tok) select w1, w2, count(*) as n from n where w2 is not null and w1 <> w2 group by 1, 2 having count(*) >= 5")
def _(spark, d):
    pairs = lexical.adjacent(table(spark, d, "documents"), keep=()).where("w1 <> w2")
    return pairs.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n >= 5")


@query("W9_contexts", "with w as (select conv_id, turn, role, list(role) over (partition by conv_id order by turn rows between 2 preceding and 1 preceding) as b, list(role) over (partition by conv_id order by turn rows between 1 following and 2 following) as a from conversations) select conv_id, turn, coalesce(array_to_string(b, ' '), '') as before, coalesce(array_to_string(a, ' '), '') as after from w")
def _(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    near = lambda low, high: F.array_join(F.collect_list("role").over(w.rowsBetween(low, high)), " ")
    return table(spark, d, "conversations").select("conv_id", "turn", near(-2, -1).alias("before"), near(1, 2).alias("after"))


@query("U3_set_overlap", "with c as (select distinct lang, source from documents where lang is not null and source is not null), n as (select lang, count(*) as n from c group by 1), i as (select a.lang as a, b.lang as b, count(*) as i from c a join c b on a.source = b.source and a.lang < b.lang group by 1, 2) select x.lang as a, y.lang as b, coalesce(i, 0) as i, round(coalesce(i, 0) / (x.n + y.n - coalesce(i, 0)), 4) as jaccard, round(2 * coalesce(i, 0) / (x.n + y.n), 4) as dice, round(coalesce(i, 0) / least(x.n, y.n), 4) as overlap from n x join n y on x.lang < y.lang left join i on i.a = x.lang and i.b = y.lang")
def _(spark, d):
    pairs = table(spark, d, "documents").where("lang is not null and source is not null").select("lang", "source").distinct()
    sizes = pairs.groupBy("lang").agg(F.count("*").alias("n"))  # a row for each language
    both = pairs.select(F.col("lang").alias("a"), "source").join(pairs.select(F.col("lang").alias("b"), "source"), "source").where("a < b").groupBy("a", "b").agg(F.count("*").alias("i"))
    every = sizes.select(F.col("lang").alias("a"), F.col("n").alias("x")).join(sizes.select(F.col("lang").alias("b"), F.col("n").alias("y")), F.col("a") < F.col("b"))
    met, i = every.join(both, ["a", "b"], "left").na.fill(0, ["i"]), F.col("i")
    return met.select("a", "b", "i", F.round(i / (F.col("x") + F.col("y") - i), 4).alias("jaccard"), F.round(2 * i / (F.col("x") + F.col("y")), 4).alias("dice"), F.round(i / F.least("x", "y"), 4).alias("overlap"))


@query("U6_evolution", f"with {TOKENS_SQL}, c as (select lemma, lang, count(*) as n from tok group by 1, 2) select lemma, " + ", ".join(f"coalesce(max(n) filter (where lang = '{x}'), 0) as {x}_freq" for x in ("de", "en", "es", "fr")) + " from c group by 1")
def _(spark, d):
    rows = lexical.tokens(table(spark, d, "documents")).groupBy("lemma", F.col("lang").alias("phase")).agg(F.count("*").alias("freq"))
    return lexical.evolution(rows, ["de", "en", "es", "fr"], ("freq",), "freq")


@query("F3_letters_tokens", r"select doc_id, len(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: regexp_matches(x, '^\p{L}'))) as n from documents")
def _(spark, d):
    found = F.regexp_extract_all(F.lower("text"), F.lit(lexical.LETTERS_TOKEN), F.lit(0))
    return table(spark, d, "documents").select("doc_id", F.size(found).cast("long").alias("n"))


@query("F6_date_parts", "select event_id, hour(ts) as hour, isodow(ts) as weekday, quarter(ts) as quarter, year(ts) as year, cast(date_trunc('month', ts) as date) as month from events")
def _(spark, d):
    part = lambda x: x.cast("long")
    return table(spark, d, "events").select("event_id", part(F.hour("ts")).alias("hour"), part(F.weekday("ts") + 1).alias("weekday"), part(F.quarter("ts")).alias("quarter"), part(F.year("ts")).alias("year"), periods.start_of(F.col("ts"), "month").alias("month"))


@query("F7_local_time", "select event_id, cast(ts + interval 1 hour as date) as day from events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", periods.local(F.col("ts"), "Europe/Paris").cast("date").alias("day"))


@query("F8_maths", "select p_partkey, round(log2(p_size), 6) as l2, round(log10(p_size), 6) as l10, round(ln(p_size), 6) as l, round(exp(-p_size / 10.0), 6) as e, round(sqrt(p_size), 6) as s, least(p_size, 25) as low, greatest(p_size, 25) as high, abs(25 - p_size) as a from part")
def _(spark, d):
    x = F.col("p_size")
    maths = {"l2": F.log2(x), "l10": F.log10(x), "l": F.log(x), "e": F.exp(-x / 10), "s": F.sqrt(x)}
    return table(spark, d, "part").select("p_partkey", *(F.round(v, 6).alias(k) for k, v in maths.items()), F.least(x, F.lit(25)).alias("low"), F.greatest(x, F.lit(25)).alias("high"), F.abs(25 - x).alias("a"))


@query("F12_frame_index", "select vec_id, case when vec_id % 2 = 0 then cast(vec_id % 100 as integer) else 1 end as frame from embeddings")
def _(spark, d):
    i = F.col("vec_id")
    name = F.concat(i.cast("string"), F.when(i % 2 == 0, F.concat(F.lit("_kf_"), F.format_string("%03d", i % 100))).otherwise(""), F.lit(".jpg"))
    return table(spark, d, "embeddings").select("vec_id", media.frame_index(name).alias("frame"))


@query("F13_channel_names", "select page_id, 'chan' || (page_id % 10) as name from pages")
def _(spark, d):
    i = F.col("page_id")
    name = F.concat(F.lit("chan"), (i % 10).cast("string"))
    shown = F.when(i % 3 == 0, F.concat(F.lit("https://t.me/s/"), name, F.lit("/12"))).when(i % 3 == 1, F.concat(F.lit(" @"), name)).otherwise(F.concat(F.lit("t.me/"), name, F.lit("?before=3")))
    return table(spark, d, "pages").select("page_id", words.channel_name(shown).alias("name"))


@query("F14_probe", "select p_partkey, p_size as largeur, cast(p_partkey % 50 as integer) as hauteur, case when p_size > p_partkey % 50 then 'horizontal' when p_size < p_partkey % 50 then 'vertical' else 'square' end as orientation, 29.97::double as fps, round(p_retailprice, 2) as duree, p_partkey % 2 = 0 as audio_present from part")
def _(spark, d):
    video = F.format_string('{"codec_type":"video","codec_name":"h264","width":%d,"height":%d,"avg_frame_rate":"30000/1001"}', F.col("p_size"), F.col("p_partkey") % 50)
    audio = F.when(F.col("p_partkey") % 2 == 0, ',{"codec_type":"audio","codec_name":"aac"}').otherwise("")
    text = F.concat(F.lit('{"streams":['), video, audio, F.lit('],"format":{"duration":"'), F.col("p_retailprice").cast("string"), F.lit('"}}'))
    found = table(spark, d, "part").select("p_partkey", media.probe(text).alias("m"))
    return found.select("p_partkey", "m.largeur", "m.hauteur", "m.orientation", "m.fps", "m.duree", "m.audio_present")


@query("F16_list_length", "select conv_id, count(*) as n from conversations group by 1")
def _(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(words.length_of(F.collect_list("turn")).cast("long").alias("n"))


@query("F18_p_values", f"with v as (select p_partkey, p_size / 5 as x from part) select p_partkey, round({erfc_sql('sqrt(x / 2)')} + sqrt(2 * x / pi()) * exp(-x / 2), 6) as p3, round({erfc_sql('x / sqrt(2)')}, 6) as pz from v")
def _(spark, d):
    x = table(spark, d, "part").select("p_partkey", (F.col("p_size") / 5).alias("x"))
    return x.select("p_partkey", F.round(statistics.chi2_p(F.col("x"), F.lit(3)), 6).alias("p3"), F.round(statistics.normal_p(F.col("x")), 6).alias("pz"))


@query("F19_entities", r"select conv_id, turn, lower(regexp_replace(regexp_replace(trim(text), '^[\s\p{P}]+', ''), '[\s\p{P}]+$', '')) as entity from conversations")
def _(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", words.entity_name(F.col("text")).alias("entity"))


@query("L17_communities")
def _(spark, d):
    from tessera.operators.graphs import centralities

    return centralities(network_edges(spark, d), ["lang"]).groupBy("lang", "community").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("lemma")).alias("lemmas"))


@query("M12_softmax", "select l_orderkey, l_linenumber, round(1 / (1 + exp(100 * (l_tax - l_discount))), 6) as p from lineitem")
def _(spark, d):
    p = media.softmax_pair(F.col("l_discount"), F.col("l_tax"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(p, 6).alias("p"))


@query("S12_done_keys", "select doc_id from documents where doc_id not in (select doc_id from labels where quality is not null)")
def _(spark, d):
    done = table(spark, d, "labels").where(cleaning.is_done(["quality"]))
    return cleaning.inject(done, table(spark, d, "documents").select("doc_id"), "doc_id")


@query("S20_repair", "select d.doc_id, coalesce(case when l.toxic = 1 then 'fixed' end, case when d.doc_id % 3 <> 0 then d.source end) as source from documents d left join labels l using (doc_id)")
def _(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("source"))
    patches = table(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "fixed").alias("source"))
    return cleaning.repair(rows, patches, "doc_id")


@query("S25_edges", f"with {cooccurrence_sql(**NETWORK)} select lang, a as \"Source\", b as \"Target\", pmi as \"Weight\", count as \"RawCount\" from edges")
def _(spark, d):
    from tessera.sources.files import edge_table

    return edge_table(network_edges(spark, d), ["lang"])


@query("S17_gexf")
def _(spark, d):
    from tessera.sources.files import gexf

    edges = lexical.cooccurrence(table(spark, d, "documents"), window=5, top=400, least=3, threshold=0.1)
    return gexf(edges.select(F.explode(F.array("a", "b")).alias("lemma")).distinct(), edges)


@query("X1_ingest_once", "select event_id, event_type from events")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type")
    return e.unionByName(e.where("event_id % 3 = 0")).dropDuplicates(["event_id"])


@query("X3_album_ranks", "select user_id % 5 as album, event_id, row_number() over (partition by user_id % 5 order by event_id) as rank from events")
def _(spark, d):
    from tessera.sources.files import first_seen_order

    rows = table(spark, d, "events").select((F.col("user_id") % 5).alias("album"), "event_id")
    return first_seen_order(rows, ["album"], "event_id").withColumn("rank", F.col("rank").cast("long"))


@query("X4_idempotent_enrichment", "select doc_id, coalesce(case when doc_id % 2 = 0 then lang end, 'new') as lang from documents")
def _(spark, d):
    docs = table(spark, d, "documents")
    old = docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("lang"))
    new = docs.select("doc_id", F.lit("new").alias("lang"))
    return cleaning.merge_fields(cleaning.merge_fields(old, new, ["doc_id"]), new, ["doc_id"])


def _event_stream(spark, d):
    from tessera.streaming.incremental import stream_of

    return stream_of(spark, f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query("X1_stream_ingest", "select event_id, event_type from events")
def _(spark, d):
    """The events twice over, as a stream into its sink."""
    from tessera.streaming import incremental

    e = _event_stream(spark, d)
    return incremental.drained(incremental.ingest(e.unionByName(e), "event_id", "ts")).select("event_id", "event_type")


@query("X2_stream_counts", "select cast(date_trunc('day', ts) as timestamp) as start, event_type, count(*) as n from events group by 1, 2")
def _(spark, d):
    from tessera.streaming import incremental

    counts = incremental.windowed_counts(_event_stream(spark, d), "ts", "event_type")
    return incremental.drained(counts, ["start", "event_type"], "update")


@query("X3_stream_album_ranks", "select user_id as album, event_id, row_number() over (partition by user_id order by event_id) as rank from events")
def _(spark, d):
    """A running number for each user."""
    from tessera.streaming import incremental

    ranks = incremental.album_ranks(_event_stream(spark, d).withColumnRenamed("user_id", "album"), "album", "event_id")
    return incremental.drained(ranks).withColumn("rank", F.col("rank").cast("long"))


@query("X4_stream_enrichment", "select doc_id, coalesce(case when doc_id % 2 = 0 then lang end, source) as lang from documents")
def _(spark, d):
    """A connector's stream of results merged into a table of which half is enriched."""
    from uuid import uuid4

    from tessera.operators.ordering import shared_folder
    from tessera.streaming import incremental

    path = f"{shared_folder(spark)}/stream-{uuid4().hex}"
    results = incremental.stream_of(spark, f"{d}/documents.parquet").select("doc_id", F.col("source").alias("lang"))
    merge = incremental.enrich_into(f"{path}/rows", ["doc_id"])
    results.writeStream.foreachBatch(merge).option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start().awaitTermination()
    old = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("lang"))
    return incremental.current(old, f"{path}/rows", ["doc_id"])
