"""Tables too large to be broadcast are refused, not cut."""

import pytest
from pyspark.sql import functions as F

from lectern.operators import knowledge, tei
from lectern.plans.registry import QUERIES


def test_bounds_raise(spark, tmp_path):
    many = spark.range(10_001)
    name = F.col("id").cast("string")
    kb = spark.createDataFrame([("1", "A1", "Aspirin", "DRUG", None)], "kb_id string, entity_id string, text string, entity_type string, synonyms array<string>")
    text = spark.createDataFrame([(1, "aspirin", "default")], "id long, text string, domain string")
    with pytest.raises(ValueError, match="more than 10000"):
        knowledge.lookup(text, kb, many.select(name.alias("kb_id"), F.col("id").cast("int").alias("rank")))
    with pytest.raises(ValueError, match="more than 10000"):
        tei.with_schema(text, many.select(name.alias("domain")))
    with pytest.raises(ValueError, match="more than 100000"):
        knowledge.incremental(kb, spark.range(100_001).select(name.alias("kb_id"), F.current_timestamp().alias("last_success")))
    many.select(F.col("id").cast("int").alias("catalog_ord"), F.lit("general").alias("domain"), F.struct(F.lit(1.0).alias("f1_score")).alias("performance")).write.parquet(f"{tmp_path}/model_catalog.parquet")
    with pytest.raises(ValueError, match="more than 10000"):
        QUERIES["ensemble_majority"](spark, str(tmp_path))


def test_no_folder_of_this_machine_on_a_cluster(monkeypatch):
    """Where the session names no shared folder, only a local one gets a folder of its own."""
    from types import SimpleNamespace

    from lectern.session import shared_folder

    unset = SimpleNamespace(isEmpty=lambda: True)
    sc = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: unset)))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda *_: None)))
