"""Sources, sinks and streaming jobs on small inputs; streaming results equal their batch twins."""

import json

import pytest
from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.operators import state
from lectern.plans.pipeline import Pipeline, model_annotator
from lectern.sources import readers, writers
from lectern.streaming import jobs


def test_files_and_schemas(spark, tmp_path):
    (tmp_path / "a.txt").write_text("héllo")
    (tmp_path / "b.exe").write_text("x")
    (tmp_path / "c.md").write_bytes(b"\xff\xfe")
    (tmp_path / "d.txt").write_text("x" * 200)
    got = {r.path.rsplit("/", 1)[1]: (r.problem, r.text) for r in readers.text_files(spark, str(tmp_path), max_bytes=100).collect()}
    assert got == {"a.txt": (None, "héllo"), "b.exe": ("type", None), "c.md": ("encoding", None), "d.txt": ("too large", None)}
    s = tmp_path / "schemas"
    s.mkdir()
    (s / "own.json").write_text(json.dumps({"title": "Own", "annotation_strategy": "mixed"}))
    (s / "bad.json").write_text("{")
    rows = readers.schema_files(spark, str(s)).collect()
    assert [(r.domain, r.title) for r in rows] == [("own", "Own")]
    assert readers.schema_problems({"domain": "x", "annotation_strategy": "odd"}) == ["Invalid annotation strategy: odd"] and len(readers.schema_problems({})) == 2
    (s / "p.json").write_text(json.dumps({"domain": "sport", "max_models": 9}))
    table = {p["domain"]: p for p in readers.settings(str(s), fixed.PIPELINES)}
    assert table["sport"]["max_models"] == 9 and table["sport"]["min_f1_score"] == 0.75
    assert readers.healthy(spark)


def test_service_retries(spark):
    def make():
        seen = []

        def ask(t):
            seen.append(t)
            if len(seen) == 1:
                raise ConnectionError("down")
            if t == "never":
                raise ValueError(t)
            return t.upper()

        return ask

    rows = readers.service(spark.createDataFrame([("a",), ("never",), (None,)], "t string").coalesce(1), "t", make, base_seconds=0.01).collect()
    # a lost connection is tried again, an error of the request is not
    assert [(r.result, r.problem) for r in rows] == [("A", None), (None, "ValueError: never"), (None, None)]


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([("k", 1, "a"), ("l", 1, "b")], "key string, seq int, v string")
    new = spark.createDataFrame([("k", 2, "c")], "key string, seq int, v string")
    assert sorted((r.key, r.v) for r in writers.upserted(old, new, ["key"], "seq").collect()) == [("k", "c"), ("l", "b")]
    assert [r.key for r in writers.without_keys(old, "key", "k*").collect()] == ["l"]
    writers.rewrite(old, str(tmp_path / "t"), F.col("v") != "a")
    writers.swap(spark, "swapped", str(tmp_path / "t"))
    assert spark.table("swapped").count() == 1
    m = spark.createDataFrame([("n", {"b": "2", "a": "1"}, 3.0)], "name string, labels map<string,string>, value double")
    assert writers.exposition(m).first().line == 'n{a="1",b="2"} 3.0'


@pytest.mark.parametrize("files", [1, 4])
def test_streaming_breaker_equals_batch(spark, tmp_path, files):
    rows = [(s, float(i * 20), i, (i * (7 if s == "a" else 3)) % 4 == 0) for i in range(40) for s in "ab"]
    df = spark.createDataFrame(rows, "service string, at double, seq long, ok boolean")
    for k in range(files):
        df.where((F.col("seq") >= k * 40 // files) & (F.col("seq") < (k + 1) * 40 // files)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.breaker_states(jobs.stream_of(spark, str(tmp_path / "in"), "service string, at double, seq long, ok boolean", 1 if files > 1 else 16), threshold=3)
    q = stream.writeStream.format("memory").queryName(f"breaker{files}").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    assert q.exception() is None
    batch = state.breaker(df.select("service", F.timestamp_micros((F.col("at") * 1e6).cast("long")).alias("ts"), "seq", "ok"), threshold=3)
    key = lambda d: sorted((r.service, r.seq, r.allowed, r.state) for r in d.collect())
    assert key(spark.table(f"breaker{files}")) == key(batch)


def test_streaming_sync(spark, tmp_path):
    spark.createDataFrame([("k", 1, "a"), ("k", 3, "c"), ("l", 2, "b")], "key string, seq int, v string").coalesce(1).write.parquet(str(tmp_path / "in"))
    q = jobs.sync(jobs.stream_of(spark, str(tmp_path / "in"), "key string, seq int, v string"), str(tmp_path / "out"), str(tmp_path / "c"), ["key"], "seq")
    q.awaitTermination(120)
    assert sorted((r.key, r.v) for r in jobs.synced(spark, str(tmp_path / "out")).collect()) == [("k", "c"), ("l", "b")]
    for k in (2, 4):
        spark.createDataFrame([("k", k, f"new{k}")], "key string, seq int, v string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = jobs.sync(jobs.stream_of(spark, str(tmp_path / "in"), "key string, seq int, v string"), str(tmp_path / "out"), str(tmp_path / "c"), ["key"], "seq", str(tmp_path / "status"))
        q.awaitTermination(120)
    assert sorted((r.key, r.v) for r in jobs.synced(spark, str(tmp_path / "out")).collect()) == [("k", "new4"), ("l", "b")]
    assert len(jobs.versions(spark, str(tmp_path / "out"))) == 2
    assert sorted((r.rows, r.last_success) for r in spark.read.parquet(str(tmp_path / "status")).collect()) == [(1, 2), (1, 4)]


def test_pipeline(spark):
    docs = spark.createDataFrame([(1, "Ann took 5 mg bid"), (2, None), (3, "nothing")], "doc_id long, text string")
    ann = model_annotator(lambda: lambda t: [("Ann", "PERSON", 0, 3, 0.9)] if "Ann" in t else [])
    kb = spark.createDataFrame([("k", "E1", "ann", "PERSON", None)], "kb_id string, entity_id string, text string, entity_type string, synonyms array<string>")
    p = Pipeline("medical", kb=kb, chain=spark.createDataFrame([("k", 0)], "kb_id string, rank int")).add_model("a", ann).add_model("b", ann)
    got = {r.doc_id: ([e.type for e in r.entities], r.kb_hit_rate) for r in p.documents(docs).collect()}
    assert got == {1: (["PERSON", "DOSAGE", "FREQUENCY"], round(1 / 3, 6)), 2: ([], 0.0), 3: ([], 0.0)}
    assert [e.type for e in p.remove_model("a").remove_model("b").documents(docs).where("doc_id = 1").first().entities] == ["DOSAGE", "FREQUENCY"]
