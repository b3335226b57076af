"""Files, connectors and streams."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import enrich
from tessera.sources import channel, files
from tessera.streaming import incremental


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"message_id": 1, "dialogue": "", "album_id": "9007199254740993", "x": 3}\n\n{"message_id": 2}\n')
    df = files.read_jsonl(spark, str(tmp_path / "a.jsonl"))
    assert [(r.message_id, r.dialogue, r.album_id) for r in df.orderBy("message_id").collect()] == [(1, "", "9007199254740993"), (2, None, None)]
    files.write_jsonl(df.select("message_id"), str(tmp_path / "out"), compressed=True)
    files.write_jsonl(df.select("message_id"), str(tmp_path / "out"), mode="append")
    assert spark.read.json(str(tmp_path / "out")).count() == 4
    (tmp_path / "bad.jsonl").write_text("{nope\n")
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path / "bad.jsonl")).collect()


def test_slim_copy(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"message_id": 1, "legende": "x", "ocr_texte": "long"}\n{broken\n')
    good, bad = files.slim_copy(spark, str(tmp_path / "a.jsonl"), ["ocr_texte"])
    assert "ocr_texte" not in good.columns and [r.legende for r in good.collect()] == ["x"]
    assert [r.value for r in bad.collect()] == ["{broken"]


def test_tokens_csv_keeps_odd_words(spark, tmp_path):
    (tmp_path / "t.csv").write_text("message_id,date,period,phase,token,lemma,tag,pos\n1,d,p,P1,NA,null,N,0\n1,d,p,,x,x,N,1\n")
    assert [(r.token, r.lemma) for r in files.read_tokens(spark, str(tmp_path / "t.csv")).collect()] == [("NA", "null")]


def test_append_new(spark, tmp_path):
    path = str(tmp_path / "t")
    files.append_new(spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string"), path, ["k"])
    files.append_new(spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), path, ["k"])
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "b"), (3, "d")]


def test_srt(spark, tmp_path):
    text = "1\n00:00:01,500 --> 00:00:02,000\nhello\nthere\n\n2\nno arrow\nx\n\n3\n00:01:00,000 --> 00:01:01,250\n\n\n4\n00:02:00,001 --> 00:02:03,000\nend"
    (tmp_path / "a.srt").write_text(text)
    (tmp_path / "b.srt").write_text("no blocks")
    rows = {r.path.rsplit("/", 1)[1]: [tuple(s) for s in r.segments] for r in files.read_srt(spark, str(tmp_path)).collect()}
    assert rows["a.srt"] == [(1.5, 2.0, "hello there"), (120.001, 123.0, "end")] and rows["b.srt"] == []
    df = spark.createDataFrame([([(0.0, 1.2346, "a"), (2.0, 3.0, " "), (3600.5, 3601.0, "b")],)], "s array<struct<start:double,end:double,text:string>>")
    shown = df.select(files.format_srt(F.col("s"))).first()[0]
    assert shown == "1\n00:00:00,000 --> 00:00:01,235\na\n\n2\n01:00:00,500 --> 01:00:01,000\nb\n"


def test_vectors_are_checked(spark):
    df = spark.createDataFrame([([1.0],)], "v array<double>")
    with pytest.raises(Exception, match="vector of size 1"):
        files.checked_vectors(df, "v", 2).collect()


def test_media_files_and_graph(spark, tmp_path):
    for name in ("5_kf_01.jpg", "5_kf_02.jpg", "6.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert sorted(r.frame for r in files.media_files(spark, str(tmp_path), "*.jpg").collect()) == [1, 2]
    nodes = spark.createDataFrame([("a&b",), ("c",)], "lemma string")
    edges = spark.createDataFrame([("a&b", "c", 3, 1.5)], "a string, b string, count long, pmi double")
    assert 'id="a&amp;b"' in files.gexf(nodes, edges).first()[0] and 'weight="1.5"' in files.gexf(nodes, edges).first()[0]
    assert files.matrix(edges, ["a&b", "c"]).count() == 2
    assert files.edge_table(edges).columns == ["Source", "Target", "Weight", "RawCount"]


def test_connector_errors_are_nulls(spark):
    class Fragile:
        def __call__(self, items):
            if "bad" in items:
                raise ValueError("bad item")
            return [x + "!" for x in items]

    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "skip")], "k int, t string")
    got = {r.k: (r.out, r.out_error) for r in enrich.enrich(df, "t", Fragile, "string", "out", when=F.col("t") != "skip").collect()}
    assert got == {1: ("a!", None), 2: (None, "bad item"), 3: (None, None)}


def test_translator_and_probe():
    whole = enrich.NumberedTranslator(lambda t: t.upper())
    assert whole(["a", "b"]) == ["A", "B"]
    broken = enrich.NumberedTranslator(lambda t: t.upper() if "\n" not in t else "sorry")
    assert broken(["a", "b"]) == ["A", "B"]
    assert enrich.Probe(command=("cat", "/nowhere"))(["x"]) == [None]
    assert enrich.first_available([("a", lambda: False), ("b", lambda: True)]) == "b"


def test_channel_source(spark, tmp_path):
    rows = [{"message_id": i, "date": f"2022-09-0{i}", "text": f"t{i}"} for i in range(1, 6)]
    (tmp_path / "c.jsonl").write_text("\n".join(json.dumps(r) for r in rows))
    spark.dataSource.register(channel.ChannelSource)
    df = spark.read.format("channel").option("path", str(tmp_path)).option("start", "2022-09-02").option("end", "2022-09-04").option("known", "3").load()
    assert sorted(r.message_id for r in df.collect()) == [2, 4]


def _run(stream, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)


def test_streams_equal_their_batch_twins(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    doubled = events.unionByName(events.limit(50)).withColumn("ts", F.col("ts").cast("timestamp")).withColumn("album", F.col("user_id") % 5)
    doubled.coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(doubled.schema).parquet(str(tmp_path / "in"))
    _run(incremental.ingest(read(), "event_id", "ts", "40 days"), "once")
    assert spark.table("once").count() == events.count()
    _run(incremental.windowed_counts(read(), "ts", "event_type"), "counts", "complete")
    assert spark.table("counts").agg(F.sum("n")).first()[0] == events.count() + 50
    _run(incremental.album_ranks(read(), "album", "event_id"), "ranks")
    ranks = spark.table("ranks").groupBy("album").agg(F.max("rank").alias("m"), F.count("*").alias("n")).collect()
    assert all(r.m == r.n for r in ranks)


def test_a_stream_goes_on_where_it_ended(spark, tmp_path, sf_dir):
    """Three files in three runs give the rows of one run over all; a run without new files changes nothing."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 7).alias("album"), "event_type")
    source = str(tmp_path / "in")
    for part in (0, 1, 2, None):
        if part is not None:
            events.where(F.col("event_id") % 3 == part).coalesce(1).write.mode("append").parquet(source)
        read = incremental.stream_of(spark, source)
        once = incremental.drained(incremental.ingest(read.unionByName(read), "event_id", "ts", "60 days"), folder=str(tmp_path / "once"))
        counts = incremental.drained(incremental.windowed_counts(read, "ts", "event_type", delay="60 days"), ["start", "event_type"], "update", str(tmp_path / "counts"))
        ranks = incremental.drained(incremental.album_ranks(read, "album", "event_id"), folder=str(tmp_path / "ranks"))
    ids = sorted(r.event_id for r in events.select("event_id").collect())
    assert sorted(r.event_id for r in once.collect()) == ids
    plain = events.groupBy(F.window("ts", "1 day").start.alias("start"), "event_type").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, plain.collect()))
    found = ranks.groupBy("album").agg(F.sort_array(F.collect_list("rank")).alias("ranks"), F.count("*").alias("n")).collect()
    assert sum(r.n for r in found) == len(ids) and all(r.ranks == list(range(1, r.n + 1)) for r in found)
    (tmp_path / "none").mkdir()
    assert incremental.drained(spark.readStream.schema(events.schema).parquet(str(tmp_path / "none"))).count() == 0


def test_foreach_batch_merge(spark, tmp_path):
    table = spark.createDataFrame([(1, None, None), (2, "old", None), (3, None, None)], "k int, v string, w int")
    path = str(tmp_path / "t")
    merge = incremental.enrich_into(path, ["k"])
    batches = [[(1, "new", None), (2, "new", 5)], [(1, "later", 7), (2, None, 6)]]
    for number, rows in enumerate(batches):
        for _ in range(2):  # a batch that is run again gives the same
            merge(spark.createDataFrame(rows, "k int, v string, w int"), number)
    got = lambda overwrite: sorted(map(tuple, incremental.current(table, path, ["k"], overwrite).collect()))
    assert got(False) == [(1, "new", 7), (2, "old", 5), (3, None, None)]
    assert got(True) == [(1, "later", 7), (2, None, 6), (3, None, None)]


def test_vector_files(spark, tmp_path):
    rows = spark.createDataFrame([(i, [float(i), 1.0, -2.5]) for i in range(5)], "k long, v array<float>")
    files.write_npz(rows, "k", "v", str(tmp_path / "v"), parts=2)
    back = files.read_npz(spark, str(tmp_path / "v"), "k", "v", 3)
    assert sorted((r.k, list(r.v)) for r in back.collect()) == sorted((r.k, list(r.v)) for r in rows.collect())
    (tmp_path / "one").mkdir()
    np.savez(tmp_path / "one" / "hist.npz", k=np.array([7, 8]), v=np.ones((2, 3), np.float32))
    assert sorted(r.k for r in files.read_npz(spark, str(tmp_path / "one"), "k", "v", 3).collect()) == [7, 8]
    with pytest.raises(Exception, match="size 3"):
        files.read_npz(spark, str(tmp_path / "one"), "k", "v", 4).collect()
    np.save(tmp_path / "ref.npy", np.array([0.5, 0.25]))
    assert files.read_npy(spark, str(tmp_path / "ref.npy")).first().vector == [0.5, 0.25]


def test_document_store(spark, tmp_path):
    path = str(tmp_path / "store")
    assert files.load_documents(spark, path, "k", "k long, body string", [1]).count() == 0
    rows = spark.createDataFrame([(1, "a"), (1500, "b"), (1501, "c")], "k long, body string")
    files.save_documents(rows, path, "k")
    assert sorted((r.k, r.body) for r in files.load_documents(spark, path, "k", "k long, body string", [1, 1501, 9]).collect()) == [(1, "a"), (1501, "c")]
    files.save_documents(spark.createDataFrame([(1500, "new")], "k long, body string"), path, "k")
    found = files.load_documents(spark, path, "k", "k long, body string", [1, 1500, 1501])
    assert sorted((r.k, r.body) for r in found.collect()) == [(1, "a"), (1500, "new"), (1501, "c")]


def test_table_functions(spark):
    from tessera.functions import tables

    tables.register(spark)
    spark.createDataFrame([(1, "Don't stop"), (2, None), (3, "")], "k int, body string").createOrReplaceTempView("texts")
    rows = spark.sql("select k, pos, token, lemma from texts, lateral tokens_of(body)").collect()
    assert sorted(map(tuple, rows)) == [(1, 0, "Don", "don"), (1, 1, "t", "t"), (1, 2, "stop", "stop")]
    srt = "1\n00:00:01,000 --> 00:00:02,500\nOne\ntwo\n\n2\n00:00:03,000 --> 00:00:04,000\nthree"
    found = tables.segments_of(spark.createDataFrame([(1, srt), (2, "bad")], "k int, body string"), F.col("body"), "k")
    assert sorted(map(tuple, found.collect())) == [(1, 1, 1.0, 2.5, "One two"), (1, 2, 3.0, 4.0, "three")]


def test_batches_of_a_model():
    seen = []
    model = enrich.Batched(lambda items: seen.append(list(items)) or [x.upper() for x in items], items=3, size=8)
    assert model(["ab", "cd", "ef", "gh", "long enough", "i"]) == ["AB", "CD", "EF", "GH", "LONG ENOUGH", "I"]
    assert seen == [["ab", "cd", "ef"], ["gh"], ["long enough"], ["i"]] and model([]) == []


def test_append_batch(spark, tmp_path):
    path = str(tmp_path / "t")
    one, two = ([(i, f"v{n}") for i in range(3)] for n in (1, 2))
    files.append_batch(spark.createDataFrame(one, "k int, v string"), path, "a")
    for _ in range(2):
        files.append_batch(spark.createDataFrame(two, "k int, v string"), path, "b")
    (tmp_path / "t" / "_staged-left").mkdir()  # of a run that crashed
    (tmp_path / "t" / "_staged-left" / "part.json").write_text('{"k": 9}')
    assert sorted((r.batch, r.k, r.v) for r in spark.read.schema("k int, v string, batch string").json(path).collect()) == sorted([("a", *r) for r in one] + [("b", *r) for r in two])


def test_command_line(spark, sf_dir, tmp_path, capsys):
    from tessera.__main__ import arguments, main

    main(["--list"])
    assert "A10_lexical_stats" in capsys.readouterr().out.split()
    main(["A5_distinct", "--tables", sf_dir, "--out", str(tmp_path / "out")])
    assert spark.read.parquet(str(tmp_path / "out")).count() > 0
    with pytest.raises(SystemExit):
        arguments(["no_such_query", "--tables", sf_dir])
