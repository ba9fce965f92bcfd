"""Streams against the same work in batch, and the append-only log."""

from gridloom import oplog
from gridloom.operators import relational as rel
from gridloom.operators import windows
from gridloom.retrieval import split_at_breaks
from gridloom.streaming import jobs
from pyspark.sql import functions as F


def test_drain_resumes_where_it_ended(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(3).selectExpr("id as k", "'a' as v").write.parquet(source)
    stream = spark.readStream.schema("k long, v string").parquet(source)
    write = jobs.replace_by_key(out, "k")
    jobs.drain(stream, write, str(tmp_path / "state")).awaitTermination()
    spark.createDataFrame([(1, "b"), (9, "c")], "k long, v string").write.mode("append").parquet(source)
    jobs.drain(stream, write, str(tmp_path / "state")).awaitTermination()
    assert {(r.k, r.v) for r in spark.read.parquet(out).collect()} == {(0, "a"), (1, "b"), (2, "a"), (9, "c")}


def test_late_and_repeated_events(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.sql("select * from values (1, timestamp'2024-01-01 00:10:00', 1.0), (1, timestamp'2024-01-01 00:10:00', 1.0), (2, timestamp'2024-01-01 05:00:00', 2.0) as t(k, ts, value)").write.parquet(source)
    stream = jobs.event_stream(spark, source, "k int, ts timestamp, value double")
    once = jobs.first_of_each(stream, "k", "ts")
    jobs.append_json(once, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_files_arrive(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("x")
    seen = []
    jobs.drain(jobs.file_arrivals(spark, str(tmp_path / "in")), lambda df, _: seen.extend(df.select("content_key").collect()), str(tmp_path / "s")).awaitTermination()
    assert seen[0].content_key == "2d711642b726b044"


def test_log(spark, tmp_path):
    path = str(tmp_path / "log")
    a = oplog.record("ingestion", file_id="f", content_hash="1", success=True)
    b = oplog.record("ingestion", file_id="f", content_hash="2", success=True, latency_sec=1.234)
    turn = oplog.record("interaction", prompt="p", response="r", intent="qa", success=True)
    oplog.append(spark, [a, b, turn, oplog.record("feedback", interaction_id=turn["id"], rating="bad")], path)
    log = oplog.read(spark, path)
    assert oplog.collisions(log).count() == 2 and [r.id for r in oplog.failures(log).collect()] == [turn["id"]]
    states = spark.createDataFrame([oplog.job_event("j", s) | {"updated_at": float(i)} for i, s in enumerate(("pending", "running", "done"))], "job_id string, status string, result string, error string, updated_at double")
    assert oplog.latest(states, "job_id", ["updated_at"]).first().status == "done"


def test_null_keys_match_only_if_asked(spark):
    df = spark.createDataFrame([(None, 1), (1, 2)], "k int, v int")
    assert rel.merge(df, df, ["k"]).count() == 1
    both = rel.merge(df, df, ["k"], null_keys_match=True)
    assert both.count() == 2 and both.columns == ["k", "v_x", "v_y"]


def test_places_and_ewm(spark):
    df = spark.range(500).withColumn("v", (F.col("id") * 7919 % 500).cast("double"))
    placed = rel.with_place(df, ["v"], "place").collect()
    assert all(r.place == r.v for r in placed)
    out = [r.ewm for r in windows.exponential_mean(spark.createDataFrame([("a", 1, 1.0), ("a", 2, None), ("a", 3, 4.0)], "k string, t int, v double"), "k", "t", "v", 0.5).orderBy("t").collect()]
    assert out == [1.0, 1.0, (1.0 * 0.25 + 4.0) / 1.25]


def test_chunks_end_at_words():
    text = "word " * 1000
    parts = split_at_breaks(text)
    assert all(len(p) <= 1500 for p in parts) and all(p.startswith("word") or p.startswith("ord") or p for p in parts) and "".join(parts).count("word") >= 1000
    assert split_at_breaks("") == [] and split_at_breaks("  ") == []
