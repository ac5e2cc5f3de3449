"""Streaming jobs over event time: windows, sessions and timeouts close when the watermark has passed them."""

from pyspark.sql import functions as F

from lectern.streaming import jobs

SCHEMA = "who string, status string, at timestamp"


def _run(spark, tmp_path, name, batches, make):
    for k, rows in enumerate(batches):
        df = spark.createDataFrame([(w, s, m * 60) for w, s, m in rows], "who string, status string, m long").select("who", "status", F.timestamp_seconds(F.col("m") + 10**9).alias("at"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = make(jobs.stream_of(spark, str(tmp_path / "in"), SCHEMA, 1)).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return spark.table(name)


def test_rates(spark, tmp_path):
    got = _run(spark, tmp_path, "rates", [[("a", "", 0), ("a", "", 0), ("b", "", 1)], [("z", "", 500)], [("z", "", 501)]], lambda s: jobs.request_rates(s, "who", "at"))
    assert {(r.who, r.n) for r in got.where("who <> 'z'").collect()} == {("a", 2), ("b", 1)}


def test_sessions(spark, tmp_path):
    got = _run(spark, tmp_path, "sessions", [[("a", "", 0), ("a", "", 20), ("a", "", 70)], [("z", "", 900)], [("z", "", 901)]], lambda s: jobs.activity_sessions(s, "who", "at"))
    assert sorted(r.n_events for r in got.where("who = 'a'").collect()) == [1, 2]


def test_stale(spark, tmp_path):
    batches = [[("a", "pending", 0), ("b", "pending", 0)], [("b", "completed", 5)], [("z", "pending", 3000)], [("z", "pending", 3001)]]
    got = _run(spark, tmp_path, "stale", batches, lambda s: jobs.stale_tasks(s.select(F.col("who").alias("task_id"), "status", "at")))
    assert [r.task_id for r in got.collect()] == ["a"]
