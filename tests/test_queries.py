"""Registered queries over small tables of their own: that no row is left out."""

import json

from pyspark.sql import functions as F

from lectern.plans.registry import QUERIES

CATALOG = "catalog_ord int, model_id string, domain string, performance struct<f1_score:double>"
REPORTS = "doc_id long, model_ord int, ent_ord int, text string, entity_type string, start_char int, end_char int, confidence double, model_id string"


def _stored(df, folder, name):
    df.coalesce(1).write.parquet(f"{folder}/{name}.parquet")


def test_votes_keep_reports_without_confidence(spark, tmp_path):
    _stored(spark.createDataFrame([(k, f"m{k}", "general", (0.5,)) for k in range(3)], CATALOG), tmp_path, "model_catalog")
    _stored(spark.createDataFrame([(1, "general", None)], "id long, domain string, text string"), tmp_path, "processed_texts")
    rows = [(1, 0, 0, "John", "PERSON", 0, 4, 0.5, "m0"), (1, 1, 0, "John", "ORG", 0, 4, None, "m1"), (1, 2, 0, "John", "ORG", 0, 4, None, None), (1, 2, 1, "Acme", "ORG", 9, 13, None, "m2")]
    _stored(spark.createDataFrame(rows, REPORTS), tmp_path, "model_entities")
    got = {n: {r.start: (r.type, round(r.confidence, 6)) for r in QUERIES[f"ensemble_{n}"](spark, str(tmp_path)).collect()} for n in ("majority", "weighted", "union", "intersection")}
    assert got["majority"] == {0: ("ORG", round(0.5 + 0.5 * 2 / 3, 6)), 9: ("ORG", 0.7)}
    assert got["weighted"] == {0: ("ORG", round(2 / 3, 6)), 9: ("ORG", round(1 / 3, 6))}
    assert got["union"] == {0: ("ORG", 1.0), 9: ("ORG", 1.0)}
    assert got["intersection"] == {0: ("ORG", 1.0)}
    assert [r.agreement for r in QUERIES["ensemble_agreement"](spark, str(tmp_path)).collect()] == [round((2 / 3 + 1 / 3 * 0.5) / 2, 6)]
    kept = QUERIES["ensemble_by_strategy"](spark, str(tmp_path)).groupBy("strategy").agg(F.sum("n").alias("n")).collect()
    assert {r.strategy: r.n for r in kept} == {"majority_vote": 2, "weighted_vote": 2, "union": 2, "intersection": 1}


def test_models_that_found_nothing_count(spark, tmp_path):
    """Two models run on each text of the domain: in the first one finds nothing, in the second both do."""
    _stored(spark.createDataFrame([(k, f"m{k}", "general", (0.9 - 0.6 * k,)) for k in range(2)], CATALOG), tmp_path, "model_catalog")
    _stored(spark.createDataFrame([(1, "general", None), (2, "general", None)], "id long, domain string, text string"), tmp_path, "processed_texts")
    _stored(spark.createDataFrame([(1, 0, 0, "John", "PERSON", 0, 4, 0.9, "m0")], REPORTS), tmp_path, "model_entities")
    got = {n: [(r.doc_id, round(r.confidence, 6)) for r in QUERIES[f"ensemble_{n}"](spark, str(tmp_path)).collect()] for n in ("majority", "weighted", "union", "intersection")}
    assert got == {"majority": [(1, 0.63)], "weighted": [(1, 0.675)], "union": [(1, 0.9)], "intersection": []}
    assert {r.doc_id: r.agreement for r in QUERIES["ensemble_agreement"](spark, str(tmp_path)).collect()} == {1: 0.25, 2: 1.0}


def test_pipeline_counts_annotators_that_found_nothing(spark):
    from lectern.plans.pipeline import Pipeline, model_annotator

    docs = spark.createDataFrame([(1, "John")], "doc_id long, text string")
    p = Pipeline("general", use_patterns=False)
    p.add_model("a", model_annotator(lambda: lambda t: [(t, "PERSON", 0, 4, 0.9)])).add_model("b", model_annotator(lambda: lambda t: []))
    assert round(p.found(docs).first().confidence, 6) == 0.63
    assert p.agreement(docs).first().agreement == 0.25
    p.strategy = "intersection"
    assert p.found(docs).count() == 0


def test_hops_over_relationships_of_both_tables(spark, tmp_path):
    kept = lambda a, b: json.dumps({"entities": [{"text": a, "kb_entity": {"entity_id": a, "relationships": [{"source_id": a, "target_id": b}]}}]})
    _stored(spark.createDataFrame([(1, kept("a", "b"))], "id long, nlp_results string"), tmp_path, "processed_texts")
    _stored(spark.createDataFrame([(1, kept("b", "c")), (2, None)], "id long, result string"), tmp_path, "background_tasks")
    got = {(r.source_id, r.target_id): r.hops for r in QUERIES["kb_relationship_hops"](spark, str(tmp_path)).collect()}
    assert got == {("a", "b"): 1, ("b", "c"): 1, ("a", "c"): 2}


def test_pipeline_of_every_domain(spark, tmp_path):
    _stored(spark.createDataFrame([(0, "m0", "medical", (0.9,)), (1, "m1", "legal", (0.9,)), (2, "m2", "legal", (0.1,))], CATALOG), tmp_path, "model_catalog")
    texts = [(1, "medical", "take 500 mg"), (2, "legal", "under 18 U.S.C. § 1001, John"), (3, "poetry", "mail a@b.example"), (4, None, "mail a@b.example"), (5, "historical", "nothing")]
    _stored(spark.createDataFrame(texts, "id long, domain string, text string"), tmp_path, "processed_texts")
    reports = [(d, m, 0, "John", t, 24, 28, 0.5, None) for d in (1, 2, 3, 4) for m, t in ((0, "DRUG"), (1, "PERSON"), (2, "ORG"))]
    _stored(spark.createDataFrame(reports, REPORTS), tmp_path, "model_entities")
    _stored(spark.createDataFrame([("personfile", "P1", "john", "PERSON", None)], "kb_id string, entity_id string, text string, entity_type string, synonyms array<string>"), tmp_path, "kb_entities")
    got = {r.doc_id: (r.n_entities, r.kb_hit_rate) for r in QUERIES["pipeline_documents"](spark, str(tmp_path)).collect()}
    # a model's report and a rule's; a merged span of two models and a citation; rules only; nothing
    assert got == {1: (2, 0.5), 2: (2, 0.5), 3: (1, 0.0), 4: (1, 0.0), 5: (0, 0.0)}
