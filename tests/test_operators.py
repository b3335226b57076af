"""Hand-made fixtures for operators whose results the tables don't exercise."""

from __future__ import annotations

import itertools
import json
import math
from collections import Counter
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.config import Phase, load, parse_phase
from tessera.functions import media, text
from tessera.operators import classify, cleaning, factors, graphs, lexical, periods, similarity, statistics, summaries

PHASES = (Phase("P1", "one", date(2022, 9, 1), date(2022, 9, 30)), Phase("P2", "two", date(2022, 10, 5), date(2022, 10, 31)))


def column(df):
    return [r[0] for r in df.collect()]


def test_phase_edges(spark):
    days = ["2022-08-31T23:59:59", "2022-09-01T00:00:00", "2022-09-30T23:59:59", "2022-10-01T00:00:00", "garbage", None]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "i int, d string").orderBy("i")
    assert column(df.select(periods.phase_of(periods.parse_timestamp(F.col("d")), PHASES))) == [None, "P1", "P1", None, None, None]


def test_messy_dates(spark):
    df = spark.createDataFrame([("2022-09-01T145235",), ("2022-09-01 1452",), ("2022-09-01",), ("  ",), ("x",)], "d string")
    assert column(df.select(periods.parse_timestamp(F.col("d")))) == [datetime(2022, 9, 1, 14, 52, 35), datetime(2022, 9, 1, 14, 52), datetime(2022, 9, 1), None, None]


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("phases:\n- {id: B, start: 2023-01-01, end: 2023-12-31}\n- {id: A, label: first, start: '2022-01-01', end: '2022-12-31'}\n")
    assert [p.phase_id for p in load(tmp_path / "c.yaml")["phases"]] == ["A", "B"]
    assert parse_phase("2022-01-01:2022-02-01:x").label == "x"


def test_merge_keeps_and_overwrites(spark):
    old = spark.createDataFrame([(1, None, "a"), (2, "o", "b"), (3, "o", "c")], "k int, x string, y string")
    new = spark.createDataFrame([(1, "n"), (2, "n"), (3, None)], "k int, x string")
    assert [tuple(r) for r in cleaning.merge_fields(old, new, ["k"]).orderBy("k").collect()] == [(1, "n", "a"), (2, "o", "b"), (3, "o", "c")]
    assert [tuple(r) for r in cleaning.merge_fields(old, new, ["k"], overwrite=True).orderBy("k").collect()] == [(1, "n", "a"), (2, "n", "b"), (3, None, "c")]


def test_eligible_without_filters_is_everything(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, m string")
    assert cleaning.eligible(df, "k", ids=[], limit=0).count() == 2
    assert column(cleaning.eligible(df, "k", ids=[2]).select("k")) == [2]


def test_repair_and_inject(spark):
    df = spark.createDataFrame([(1, None), (2, "p")], "k int, path string")
    patch = spark.createDataFrame([(1, "q")], "k int, path string")
    assert sorted(map(tuple, cleaning.repair(df, patch, "k").select("k", "path").collect())) == [(1, "q"), (2, "p")]
    raw = spark.createDataFrame([(2, "x"), (3, "y"), (3, "y")], "k int, path string")
    assert column(cleaning.inject(df, raw, "k").select("k")) == [3]


def test_complete_levels_and_gaps(spark):
    df = spark.createDataFrame([(date(2022, 1, 1), "a", 2), (date(2022, 4, 1), "b", 1)], "m date, s string, n long")
    found = periods.complete(df, "m", fill={"n": 0}, levels={"s": ["a", "b", "z"]})
    assert found.count() == 12 and found.agg(F.sum("n")).first()[0] == 3


def test_last_month_is_scaled(spark):
    df = spark.createDataFrame([(date(2022, 8, 1), 5), (date(2022, 9, 1), 5)], "m date, n long")
    assert column(periods.extrapolate_last(df, "m", "n", F.lit("2022-09-10")).orderBy("m").select("n")) == [5.0, 15.0]


def test_week_starts_and_zones(spark):
    df = spark.createDataFrame([(datetime(2022, 9, 4, 23, 30),)], "t timestamp")  # a Sunday
    got = df.select(periods.start_of(F.col("t"), "week"), periods.start_of(F.col("t"), "week_sunday"), periods.local(F.col("t"), "Europe/Paris").cast("date")).first()
    assert tuple(got) == (date(2022, 8, 29), date(2022, 9, 4), date(2022, 9, 5))


def test_segments_and_watermarks(spark):
    df = spark.createDataFrame([([("привіт як справи",), ("hello привіт",), ("так ок",), ("...",)],)], "s array<struct<text:string>>")
    assert [s["text"] for s in df.select(classify.clean_segments(F.col("s"))).first()[0]] == ["привіт як справи", "так ок", "..."]
    box = spark.createDataFrame([("news", [[0.0, 5.0], [10.0, 15.0]]), ("news", [[0.0, 45.0], [9.0, 55.0]]), ("BRAND x", [[0.0, 50.0]])], "t string, b array<array<double>>")
    assert column(box.select(classify.is_watermark(F.col("t"), F.col("b"), "brand", F.lit(100.0)))) == [True, False, True]


def test_utf16_and_links(spark):
    df = spark.createDataFrame([("😀 see here", [("text_url", 7, 4, "http://x"), ("url", 3, 3, None), ("bold", 0, 1, None)])], "t string, e array<struct<type:string,offset:int,length:int,url:string>>")
    assert [tuple(x) for x in df.select(text.links_of(F.col("t"), F.col("e"))).first()[0]] == [("http://x", "here"), ("see", None)]


def test_numbered_channel_entity(spark):
    df = spark.createDataFrame([("1. a\n2. b", 2), ("1. a", 2)], "t string, n int")
    assert column(df.select(text.numbered(F.col("t"), F.col("n")))) == [["a", "b"], None]
    names = spark.createDataFrame([("https://t.me/s/chan/12",), ("@chan",), ("chan",)], "t string")
    assert column(names.select(text.channel_name(F.col("t")))) == ["chan"] * 3
    assert spark.range(1).select(text.entity_name(F.lit(" «Kyiv»,"))).first()[0] == "kyiv"


def test_probe(spark):
    video = {"streams": [{"codec_type": "audio", "codec_name": "aac"}, {"codec_type": "video", "codec_name": "h264", "width": 1080, "height": 1920, "avg_frame_rate": "30000/1001", "bit_rate": "2500"}], "format": {"size": "77"}}
    video["streams"][0]["duration"] = "9.5"
    image = {"streams": [{"codec_type": "video", "codec_name": "png", "width": 5, "height": 5, "avg_frame_rate": "0/0"}], "format": {"duration": "0.04"}}
    df = spark.createDataFrame([(json.dumps(x),) for x in (video, image, {"streams": [], "format": {}})], "j string")
    a, b, c = (r[0].asDict() for r in df.select(media.probe(F.col("j"))).collect())
    assert (a["fps"], a["orientation"], a["audio_present"], a["duree"], a["fichier_taille"], a["video_bitrate"]) == (29.97, "vertical", True, 9.5, 77, 2)
    assert (b["fps"], b["duree"], b["orientation"], b["audio_present"]) == (None, None, "square", False)
    assert (c["largeur"], c["orientation"], c["audio_present"]) == (None, None, False)


def test_message_row(spark):
    schema = "id int, date timestamp, grouped_id long, fwd_from string, message string, photo_sizes array<struct<w:int,h:int>>, video struct<w:int,h:int,duration:double>, views long, forwards long"
    df = spark.createDataFrame([(7, datetime(2022, 9, 1, 1, 2, 3), 2**60, None, "", [(10, 10), (30, 20)], None, 5, 1)], schema)
    got = df.select(media.message_row(F.struct("*"))).first()[0].asDict()
    assert (got["date"], got["album_id"], got["legende"], got["largeur"], got["est_transfere"]) == ("2022-09-01T01:02:03", str(2**60), None, 30, False)


def test_small_scalars(spark):
    one = spark.range(1)
    assert one.select(media.frame_index(F.lit("9_kf_12.jpg")), media.frame_index(F.lit("9.jpg")), F.round(media.softmax_pair(F.lit(0.3), F.lit(0.3)), 3)).first()[:] == (12, 1, 0.5)
    assert one.select(summaries.confidence(F.array(F.lit(0.0), F.lit(0.0)))).first()[0] == 1.0
    assert tuple(one.select(*summaries.scene_summary(F.array(F.lit(1), F.lit(2), F.lit(3)), F.lit(60.0))).first()) == (2, 2.0, 20.0)
    total, plain = one.select(*summaries.reaction_totals(F.array(F.struct(F.lit("x").alias("emoji"), F.lit(2).cast("long").alias("count")), F.struct(F.lit(None).cast("string").alias("emoji"), F.lit(3).cast("long").alias("count"))))).first()
    assert total == 5 and len(plain) == 1


def test_tokens_tiny_collocations(spark):
    docs = spark.createDataFrame([(1, "a b a b c"), (2, "b b d"), (3, "")], "doc_id long, text string")
    rows = lexical.tokens(docs, keep=("doc_id",))
    got = {(r.w1, r.w2): r["count"] for r in lexical.collocations(rows, least=1).collect()}
    assert got == {("a", "b"): 2, ("b", "a"): 1, ("b", "c"): 1, ("b", "d"): 1}
    pairs = {(r.a, r.b) for r in lexical.window_pairs(rows, rows.select("lemma").distinct(), 2).where("doc_id = 1").collect()}
    assert pairs == {("a", "b"), ("a", "c"), ("b", "c")}


def test_collocations_count_pairs_in_one_scan(spark, sf_dir):
    from tessera.plans.catalogue import QUERIES

    docs = spark.createDataFrame([(1, "a b a b c"), (2, "b b d"), (3, ""), (4, None)], "doc_id long, text string")
    rows = lexical.followed(docs, keep=("doc_id",))
    assert sorted((r.doc_id, r.lemma, r.next) for r in rows.where("doc_id = 2").fillna("-").collect()) == [(2, "b", "b"), (2, "b", "d"), (2, "d", "-")]
    tokens = lexical.tokens(docs, keep=("doc_id",))
    assert sorted(lexical.collocations(rows, least=1).collect()) == sorted(lexical.collocations(tokens, least=1).collect())
    for name in ("L4_collocations", "L4_collocations_by_phase"):  # lemmas and totals are read from a checkpoint
        assert QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString().count("Generate ") == 1, name


def test_correspondence_table_takes_lemmas_until_enough_are_in_many_documents(spark):
    rows = [(i, "en" if i % 2 else "fr", f"rare{k}") for k in range(30) for i in [k] for _ in range(50 - k)]
    rows += [(i, "en" if i % 2 else "fr", w) for w, n in (("x", 9), ("y", 8), ("z", 7)) for i in range(n)] + [(0, None, "x"), (9, None, "few")]
    table = spark.createDataFrame(rows, "doc_id long, lang string, lemma string")
    found = factors.correspondence_table(table, "lang", top=2)
    assert sorted(map(tuple, found.select("lemma", "lang", "documents", "n").collect())) == [("x", "en", 9, 4), ("x", "fr", 9, 5), ("y", "en", 8, 4), ("y", "fr", 8, 4)]
    assert "Expand" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "LocalTableScan" not in plan and "count(distinct" not in plan
    few = factors.correspondence_table(table, "lang", top=50)
    assert {r.lemma for r in few.collect()} == {"x", "y", "z"}


def test_window_counts_what_is_left_out(spark):
    rows = lexical.tokens(spark.createDataFrame([(1, "a x x x b")], "doc_id long, text string"), keep=("doc_id",))
    vocabulary = spark.createDataFrame([("a",), ("b",)], "lemma string")
    assert lexical.window_pairs(rows, vocabulary, 3).count() == 0 and lexical.window_pairs(rows, vocabulary, 4).count() == 1


def test_p_values():
    assert statistics.upper_gamma(0.5, 3.841458820694124 / 2) == pytest.approx(0.05, abs=1e-12)
    assert statistics.upper_gamma(1.5, 7.814727903251179 / 2) == pytest.approx(0.05, abs=1e-12)
    assert statistics.upper_gamma(1, 2.0) == pytest.approx(math.exp(-2), abs=1e-14)


def test_adjust(spark):
    df = spark.createDataFrame([("g", 0.01), ("g", 0.02), ("g", 0.9), ("h", 0.5)], "g string, p double")
    got = sorted((r.g, round(r.p_adj, 6)) for r in statistics.adjust(df, "p", ["g"]).collect())
    assert got == [("g", 0.03), ("g", 0.03), ("g", 0.9), ("h", 0.5)]


def test_kruskal_guards(spark):
    few = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "g string, v double")
    assert statistics.kruskal(few, "v", "g").first().h is None


def test_pelt():
    pick = np.random.default_rng(0)
    step = np.concatenate([pick.normal(0, 1, 30), pick.normal(8, 1, 30)])
    assert factors.pelt(step) == [30]
    assert factors.pelt(pick.normal(0, 1, 60)) == []


def test_pelt_against_all_segmentations():
    pick = np.random.default_rng(3)

    def cost(x):
        return len(x) * (math.log(2 * math.pi) + math.log(max(float(np.var(x)), 1e-10)) + 1) + math.log(len(x))

    for trial in range(60):
        n = int(pick.integers(5, 15))
        at = int(pick.integers(1, n))
        x = np.concatenate([pick.normal(0, 1, at), pick.normal(trial % 7, 1 + trial % 3, n - at)])
        best = {}
        for cuts in (c for k in range(n // 2) for c in itertools.combinations(range(2, n - 1), k)):
            edges = (0, *cuts, n)
            if min(b - a for a, b in itertools.pairwise(edges)) >= 2:
                best[cuts] = sum(cost(x[a:b]) for a, b in itertools.pairwise(edges)) + 4 * math.log(n) * len(cuts)
        found = tuple(factors.pelt(x))
        assert best[found] == pytest.approx(min(best.values()))


def test_exact_quantiles(spark):
    pick = np.random.default_rng(4)
    data = [(g, None if pick.random() < 0.1 else float(pick.integers(0, 9))) for g in ("a", "b", None, "c") for _ in range(1 if g == "c" else 57)] + [("none", None)]
    df = spark.createDataFrame(data, "g string, v double")
    got = {r.g: (r.low, r.mid) for r in summaries.exact_quantiles(df, ["g"], "v", {"low": 0.1, "mid": 0.5}).collect()}
    for g in ("a", "b", None, "c"):
        own = [v for k, v in data if k == g and v is not None]
        assert got[g] == (pytest.approx(np.quantile(own, 0.1)), pytest.approx(np.median(own))) if own else (None, None)
    assert got["none"] == (None, None)


def test_neighbours_and_pairs_come_from_arrays(spark, sf_dir):
    from tessera.plans.catalogue import QUERIES

    for name, least in (("L8_kwic_summary", "Generate"), ("L3_volcano", "Generate")):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert least in plan and "(pos" not in "".join(line for line in plan.splitlines() if "Join Inner" in line)


def test_cooccurrence_shuffles_no_tokens(spark):
    """Counts of documents and pairs against plain ones, with null groups and texts; documents' tokens are in no exchange and in no collected list."""
    pick = np.random.default_rng(13)
    docs = [(i, [None, "x", "y"][i % 3], " ".join(pick.choice(list("abcdefgh"), int(n), p=[0.3, 0.2, 0.1, 0.1, 0.1, 0.1, 0.05, 0.05]))) for i, n in enumerate(pick.integers(0, 15, 90))]
    df = spark.createDataFrame([*docs, (90, "x", None), (91, "z", "1 2")], "doc_id long, g string, text string").repartition(3)
    for by in ([], ["g"]):
        want: Counter = Counter()
        for g in {x for _, x, _ in docs} if by else [None]:
            own = [t.split() for _, x, t in docs if not by or x == g]
            f = Counter(w for t in own for w in t)
            top = {w for w, _ in sorted(f.items(), key=lambda x: (-x[1], x[0]))[:5]}
            for t in own:
                want.update({(g, *sorted((t[i], t[j]))) for i in range(len(t)) for j in range(i + 1, min(i + 3, len(t))) if t[i] != t[j] and {t[i], t[j]} <= top})
        vocabulary = lexical.top_n(lexical.tokens(df, keep=["g"]).groupBy(*by, "lemma").agg(F.count("*").alias("f")), by, [F.desc("f"), F.asc("lemma")], 5)
        found = lexical.document_pairs(df, vocabulary, 2, by)
        assert {(r["g"] if by else None, r.a, r.b): r["count"] for r in found.collect()} == want
        assert "collect_list" not in found._jdf.queryExecution().toString()


def test_changepoints_skip_gaps_and_short_series(spark):
    rows = [("s", i, float(i >= 20) * 9 + (i % 3) * 0.1) for i in range(40)] + [("s", 50, None), ("t", 1, 1.0), ("t", 2, 5.0)]
    df = spark.createDataFrame(rows, "k string, i int, v double")
    assert [tuple(r) for r in factors.changepoints(df, ["k"], "i", "v").collect()] == [("s", 19)]


def test_toy_graph(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("x", "y", 2.0)], "a string, b string, pmi double")
    got = {r.lemma: r for r in graphs.centralities(edges).collect()}
    assert got["b"].betweenness == pytest.approx(1 / 6, abs=1e-6) and got["a"].betweenness == 0  # 2 of 12 ordered pairs, n = 5
    assert got["b"].closeness == pytest.approx(0.5) and got["a"].degree == 1
    assert got["a"].component == got["c"].component != got["x"].component
    assert got["a"].community == got["b"].community and got["x"].community == got["y"].community


def test_correspondence():
    table = np.array([[10.0, 0, 5, 3], [2, 8, 4, 4], [3, 3, 9, 1]])
    found = factors.correspondence(table)
    n = table.sum()
    expected = np.outer(table.sum(1), table.sum(0)) / n
    assert float(found["total"]) == pytest.approx(((table - expected) ** 2 / expected).sum() / n)
    assert found["row_contrib"].sum(axis=0) == pytest.approx(np.ones(2)) and found["row_cos2"].sum(axis=1) == pytest.approx(np.ones(3))


def test_ward():
    points = np.array([[0.0], [0.1], [5.0], [5.2], [20.0]])
    assert factors.cut(5, factors.ward(points), 3) == [0, 0, 1, 1, 2]


@pytest.mark.parametrize("small", [True, False])
def test_ward_over_groups(small, spark):
    pick = np.random.default_rng(2)
    blobs = [(3000, 0, 0, 0.01), (3000, 4, 0, 0.01), (150, 0, 100, 1), (150, 12, 100, 1)]
    points = np.concatenate([np.array([x, y]) + spread * pick.normal(size=(n // 25 if small else n, 2)) for n, x, y, spread in blobs])
    got = factors.ward_clusters(spark.createDataFrame(list(enumerate(points.tolist())), "k long, v array<double>"), "k", "v", 3)
    if small:
        want = factors.cut(len(points), factors.ward(points), 3)
    else:  # the two large groups are worth 24,000 apart, the small ones 10,800
        want = [0] * 3000 + [1] * 3000 + [2] * 300
    assert [r.cluster for r in got.orderBy("k").collect()] == want


def test_kmeans_is_written_and_lets_go_of_its_vectors(spark):
    df = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(30)], "k long, v array<double>")
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    found, _ = factors.kmeans(df, "k", "v", 3, runs=1)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "InMemoryRelation" not in plan and "LogicalRDD" in plan and spark.sparkContext._jsc.getPersistentRDDs().size() <= held
    assert found.groupBy("cluster").count().count() == 3


def test_hamming_pairs(spark):
    rows = [(1, "0" * 16), (2, "0" * 15 + "1"), (3, "f" * 16), (4, "0" * 16), (5, "8" + "0" * 15), (6, "abc")]
    df = spark.createDataFrame(rows, "k long, x string").withColumn("h", similarity.bits_of(F.col("x")))
    got = {tuple(r) for r in similarity.hamming_pairs(df, "k", "h", 3).collect()}  # 1 and 4 are a class
    assert got == {(1, 1, 2, 2, 0), (1, 2, 2, 1, 1), (1, 5, 2, 1, 1), (2, 5, 1, 1, 2)}


@pytest.mark.parametrize("radii", [(), (3,), (1, 3, 5)])
def test_nearest_earlier_by_radius(spark, radii):
    """Near copies, equal hashes, rows without a neighbour, nulls, a sign bit and an order that repeats."""
    pick = np.random.default_rng(4)
    base = [int(x) for x in pick.integers(0, 2**64, 25, dtype=np.uint64)]
    signed = lambda v: v - (v >> 63 << 64)
    flip = lambda v, n: signed(v ^ sum(1 << int(b) for b in pick.choice(64, n, replace=False)))
    values = [flip(base[pick.integers(25)], pick.choice([0, 0, 1, 2, 3, 4, 6])) for _ in range(150)]
    rows = [*enumerate(values), (150, None), (None, 5), (149, values[3])]
    got = {r.k: (r.near, r.d) for r in similarity.nearest_earlier(spark.createDataFrame(rows, "k long, h long"), "k", "h", block=40, radii=radii).collect()}
    given = [(k, h) for k, h in rows if k is not None and h is not None]
    want = {}
    for k, h in given:
        for j, g in given:
            if j < k:
                want[k] = min(want.get(k, (99.0, 0)), (float(((h ^ g) & (2**64 - 1)).bit_count()), j))
    assert got == {k: (j, d) for k, (d, j) in want.items()}
    assert similarity.nearest_earlier(spark.createDataFrame([], "k long, h long"), "k", "h", radii=radii).count() == 0


def test_pair_quantiles(spark):
    """Groups of many blocks, of equal vectors, of two and of one; vectors that are left out."""
    pick = np.random.default_rng(5)
    groups = {"many": pick.normal(size=(90, 4)), "equal": np.ones((40, 4)), "two": np.array([[1.0, 0, 0, 0], [-1.0, 0, 0, 0]]), "one": np.ones((1, 4))}
    groups["tied"] = pick.integers(0, 2, (60, 4)) + np.array([1, 0, 0, 0.0])
    rows = [(g, v.tolist()) for g, x in groups.items() for v in x]
    rows += [("many", None), ("many", [0.0] * 4), ("many", [1.0, None, 0.0, 0.0]), ("many", [float("nan"), 0.0, 0.0, 1.0]), ("many", [float("inf"), 0.0, 0.0, 1.0]), (None, [1.0] * 4)]
    points = {"least": 0.0, "p10": 0.1, "mid": 0.5, "most": 1.0}
    df = spark.createDataFrame(rows, "g string, v array<double>")
    got = {r.g: r for r in similarity.pair_quantiles(df, "g", "v", points, block=16).collect()}
    assert set(got) == {"many", "equal", "two", "tied"}
    for g, r in got.items():
        unit = groups[g] / np.linalg.norm(groups[g], axis=1, keepdims=True)
        sims = (unit @ unit.T)[np.triu_indices(len(unit), 1)]
        assert r.n == len(unit)
        for name, q in points.items():
            assert r[name] == pytest.approx(np.quantile(sims, q), abs=2e-6), (g, name)
    assert similarity.pair_quantiles(df.limit(0), "g", "v", points).count() == 0


def test_loess(spark):
    """Against weighted least squares: uneven places, ties, groups too small for a curve, rows left out."""
    pick = np.random.default_rng(6)
    x = np.round(pick.gamma(2, 3, 300), 1)
    groups = {"many": (x, np.sin(x) + pick.normal(0, 0.3, 300)), "two": (np.array([1.0, 2.0]), np.array([5.0, 7.0])), "one": (np.array([4.0]), np.array([9.0])), "flat": (np.full(9, 3.0), np.arange(9.0))}
    tied = np.repeat([0.0, 1.0, 5.0, 6.0], [40, 3, 3, 1])
    groups["tied"] = (tied, pick.normal(size=len(tied)))
    rows = [(g, float(a), float(b)) for g, (xs, ys) in groups.items() for a, b in zip(xs, ys)] + [("many", None, 1.0), ("many", 1.0, None), ("many", float("nan"), 1.0), ("many", 2.0, float("inf")), (None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    found = statistics.loess(df, ["g"], "x", "y", span=0.4, points=9).collect()
    assert len(found) == 9 * len(groups)
    for r in found:
        xs, ys = groups[r.g]
        q = max(1, math.floor(len(xs) * 0.4 + 1e-5))
        x0 = xs.min() + (xs.max() - xs.min()) * r.point / 8
        d = np.abs(xs - x0)
        h = np.sort(d)[q - 1]
        w = (1 - (d / h).clip(0, 1) ** 3) ** 3 if h else (d == 0).astype(float)
        degree = min(2, len(set(xs[w > 0])) - 1)
        if degree < 0:  # all within reach are at its end
            assert r.fit is None
            continue
        at = np.vander((xs - x0) / (h or 1), degree + 1, increasing=True)
        want = np.linalg.lstsq(at * np.sqrt(w)[:, None], ys * np.sqrt(w), rcond=None)[0][0]
        assert r.n == len(xs) and r.x == pytest.approx(x0, abs=1e-6) and r.fit == pytest.approx(want, abs=1e-5), (r, want)
    assert statistics.loess(df.limit(0), ["g"], "x", "y").count() == 0


def test_nearest_earlier_in_blocks(spark):
    pick = np.random.default_rng(1)
    values = [int(x) for x in pick.integers(0, 2**40, 60)]
    df = spark.createDataFrame(list(enumerate(values)), "k long, h long")
    got = {r.k: (r.near, r.d) for r in similarity.nearest_earlier(df, "k", "h", block=16).collect()}
    for k in range(1, 60):
        best = min((bin(values[k] ^ values[j]).count("1"), j) for j in range(k))
        assert got[k] == (best[1], float(best[0]))


def test_blocks_are_shuffled_to_those_before_them_and_each_pair_is_a_task(spark):
    """Hashes near others, far ones and repeats over ranges of keys that are not even, against all pairs; no exchange joins small blocks in one task."""
    pick = np.random.default_rng(12)
    values = pick.integers(-(2**63), 2**63 - 1, 300)
    values[200:] = values[:100] ^ (np.int64(1) << pick.integers(0, 60, 100))
    keys = np.sort(pick.choice(10**12, 300, replace=False) // np.arange(1, 301))
    rows = [(int(k), int(v)) for k, v in zip(keys, values)]
    found = similarity.nearest_earlier(spark.createDataFrame(rows, "k long, h long").repartition(3), "k", "h", block=30, radii=())
    got = {r.k: (r.near, r.d) for r in found.collect()}
    for k, v in rows:
        want = min(((bin((v ^ w) & (2**64 - 1)).count("1"), o) for o, w in rows if o < k), default=None)
        assert got.get(k) == (want and (want[1], float(want[0])))
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().toString()


def test_epsilon_components(spark):
    df = spark.createDataFrame([(1, 1, [1.0, 0.0]), (1, 2, [0.9, 0.1]), (1, 3, [0.0, 1.0]), (2, 4, [1.0, 1.0])], "m long, k long, v array<double>")
    got = {r.k: r.cluster_id for r in similarity.epsilon_components(df, "m", "k", "v", 0.3).collect()}
    assert got[1] == got[2] != got[3] and got[4] == 0


def test_mean_vector_and_unit(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 4.0])], "g string, v array<double>")
    row = summaries.mean_vector(df, ["g"], "v").first()
    assert row["mean"] == [2.0, 3.0] and row["n"] == 2
    assert spark.range(1).select(summaries.normalised(F.array(F.lit(3.0), F.lit(4.0)))).first()[0] == [0.6, 0.8]


def test_document_counts_in_topics(spark):
    from tessera.operators import topics

    docs = [(i, ("cat dog pet fur paw " if i % 2 else "car road fuel tyre door ").split() * 3) for i in range(40)]
    lists = spark.createDataFrame(docs, "doc_id long, lemmas array<string>")
    rows, names = topics.vectors(lists)
    model = topics.fit(rows, 2)
    found = topics.document_topics(model, rows, "doc_id").select("doc_id", "dominant").collect()
    assert len({r.dominant for r in found if r.doc_id % 2}) == 1
    good, bad = [["cat", "dog", "pet"], ["car", "road", "fuel"]], [["cat", "road", "pet"], ["car", "dog", "fuel"]]
    counts = topics.window_counts(lists, good + bad)
    assert topics.coherence(counts, good) > topics.coherence(counts, bad)


def test_topic_vectors_are_dealt_out(spark):
    """A table of one partition becomes vectors on all cores, once, with the counts of its lemmas."""
    from tessera.operators import topics

    docs = [(i, ["a"] * (i % 3 + 1) + ["b", "c", f"x{i % 4}"] * 2) for i in range(40)] + [(40, None), (41, ["b"])]
    rows, names = topics.vectors(spark.createDataFrame(docs, "doc_id long, lemmas array<string>").coalesce(1), no_above=1)
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and rows.columns == ["doc_id", "features"]
    assert sorted(names.vocabulary) == ["a", "b", "c", "x0", "x1", "x2", "x3"]
    for r in rows.collect():
        assert {names.vocabulary[i]: n for i, n in zip(r.features.indices, r.features.values)} == Counter(docs[r.doc_id][1])
    assert rows.count() == 40


def test_windows_are_counted_as_if_they_were_made(spark):
    from tessera.operators import topics

    pick = np.random.default_rng(8)
    docs = [[["a", "b", "c", "d", "e"][i] for i in pick.choice(5, int(n), p=[0.05, 0.05, 0.1, 0.3, 0.5])] for n in pick.integers(0, 60, 40)]
    lists = spark.createDataFrame([(i, x) for i, x in enumerate(docs)] + [(99, None)], "doc_id long, lemmas array<string>").repartition(3)
    total, counts = topics.window_counts(lists, [["a", "b", "c"], ["c", "e"]], 7)
    made = [set(x[i : i + 7]) for x in docs for i in range(max(len(x) - 6, 1))]
    assert total == len(made)
    for a, b in [("a", "a"), ("b", "b"), ("c", "c"), ("e", "e"), ("a", "b"), ("a", "c"), ("b", "c"), ("c", "e")]:
        assert counts.get((a, b), 0) == sum({a, b} <= w for w in made)
    assert ("a", "e") not in counts


def test_planted_topics_are_found_again(spark):
    """Documents of three vocabularies: three topics are chosen, each with the words of one, and every document is given its own."""
    from tessera.operators import topics

    pick = np.random.default_rng(9)
    planted = [[f"{x}{i}" for i in range(12)] for x in ("cat", "car", "sea")]
    docs = [(i, [*pick.choice(planted[i % 3], 40), *pick.choice(["the", "of", "and"], 10)]) for i in range(60)]
    found = topics.choose(spark.createDataFrame([(i, [str(w) for w in x]) for i, x in docs], "doc_id long, lemmas array<string>"), ks=range(3, 6), words=8)
    assert [k for k, _, _ in found.scores] == [3, 4, 5] and max(found.scores, key=lambda x: x[1])[0] == found.k == 3
    kinds = [{w[:3] for w, _ in own} for own in found.words]
    assert sorted(x for k in kinds for x in k) == ["car", "cat", "sea"]
    of = {r.doc_id: r.dominant for r in topics.document_topics(found.model, found.rows, "doc_id").collect()}
    assert all(kinds[of[i]] == {("cat", "car", "sea")[i % 3]} for i, _ in docs)
    assert topics.choose(spark.createDataFrame([(1, ["a"] * 9)], "doc_id long, lemmas array<string>")) is None


def test_running_sum_and_ranks_over_the_whole_table(spark):
    from tessera.operators.ordering import running_sum

    data = [(i % 7, i, float(i // 3)) for i in range(200)]
    df = spark.createDataFrame(data, "w long, k long, v double").repartition(5)
    upto, want = {r.k: r.upto for r in running_sum(df, ["k"], "w").collect()}, 0
    for w, k, _ in data:
        want += w
        assert upto[k] == want
    ranks = {r.k: r.r for r in statistics.ranked(df, "v").collect()}
    assert all(ranks[i] == 3 * (i // 3) + (2 if i < 198 else 1.5) for i in range(200))
    assert running_sum(df.limit(0), ["k"]).count() == 0


def test_student_p():
    assert statistics.beta_share(2.5, 0.5, 5 / (5 + 2.570581835636314**2)) == pytest.approx(0.05, abs=1e-12)
    assert statistics.beta_share(50_000, 0.5, 100_000 / (100_000 + 1.959987713**2)) == pytest.approx(0.05, abs=1e-7)
    assert statistics.beta_share(0.5, 0.5, 0.5) == pytest.approx(0.5, abs=1e-14) and statistics.beta_share(1, 1, 0.3) == pytest.approx(0.3, abs=1e-14)
    assert [statistics.beta_share(2, 3, x) for x in (0, 1)] == [0, 1]


def test_p_values_beside_their_statistics(spark):
    rows = [("a", 1.0, 2.0), ("a", 2.0, 1.0), ("a", 3.0, 4.0), ("a", 4.0, 3.0), ("a", 5.0, 6.0), ("b", 6.0, 5.0), ("c", 7.0, 8.0), ("d", 8.0, 7.0), ("d", 9.0, None)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    (r,) = statistics.spearman(df, "x", "y").collect()
    assert (r.n, r.rho, r.stars) == (8, 0.9048, "**") and r.p == pytest.approx(0.002008, abs=2e-6)
    (k,) = statistics.kruskal(df, "x", "g").collect()
    assert (k.k, k.df) == (4, 3) and k.p == pytest.approx(statistics.upper_gamma(1.5, k.h / 2), abs=1e-4)
    same = spark.createDataFrame([(float(i), float(i)) for i in range(5)], "x double, y double")
    assert [(r.rho, r.p, r.stars) for r in statistics.spearman(same, "x", "y").collect()] == [(1.0, 0.0, "***")]
