from pyspark.sql import functions as F

from ferrule.operators import evaluation, lexical
from ferrule.streaming import index as stream_index
from ferrule.streaming import monitor

SCHEMA = "event_id long, ts timestamp, user_id int, event_type string, value double, props string"


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    edges = evaluation.quantile_edges(events, 5, "value")
    reference = monitor.reference_shares(events, edges)
    assert abs(sum(reference) - 1) < 1e-9
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = (
        monitor.windowed_histograms(stream, edges, window="1 day", late="400 days")
        .writeStream.outputMode("complete").format("memory").queryName("drift").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    key = lambda rows: sorted((r["window"]["start"], r["n"], round(r["psi"], 9), r["band"]) for r in rows)
    got = key(monitor.stability(spark.table("drift"), reference).collect())
    expected = key(monitor.stability(monitor.windowed_histograms(events, edges, window="1 day"), reference).collect())
    assert got == expected and len(got) > 1


def test_live_documents(spark):
    changes = spark.createDataFrame([(1, 1, False, "a"), (1, 2, False, "b"), (2, 1, False, "c"), (2, 3, True, "c")], "doc_id long, version long, deleted boolean, text string")
    assert [tuple(r) for r in monitor.live_documents(changes).collect()] == [(1, 2, "b")]


def test_index_follows_a_stream(spark, tmp_path):
    kind = "doc_id long, version long, deleted boolean, text string"
    first = [(i, 1, False, f"alpha {'beta ' * (i % 3)}") for i in range(12)]
    second = [(3, 2, False, "gamma gamma"), (3, 3, False, "gamma delta"), (4, 2, True, None), (20, 1, False, "beta beta beta"), (21, 1, False, None)]
    for rows in (first, second):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    folder = str(tmp_path / "index")
    stream_index.follow(stream, folder, str(tmp_path / "state")).awaitTermination(180)
    assert stream_index.versions(spark, folder) == [1, 2]
    now = lexical.load_index(spark, f"{folder}/v2")
    live = {i: t for i, _, _, t in first if i not in (3, 4)} | {3: "gamma delta", 20: "beta beta beta", 21: None}
    whole = lexical.build_index(spark.createDataFrame(list(live.items()), "doc_id long, text string"))
    for name in ("postings", "docs", "terms", "stats"):
        a, b = getattr(now, name), getattr(whole, name)
        assert sorted(map(tuple, a.select(b.columns).collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr), name
    assert stream_index.versions(spark, str(tmp_path / "none")) == []
