"""Operators of the annotation and relational sides, against literal cases and plain versions."""

import re

from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.functions import text as T
from lectern.operators import annotate, catalog, ensemble, knowledge, state, storage, tei
from lectern.operators.patterns import Rule, candidates, extract, groups, normalised_entity, resolved, rules_of, spans, valid_entity

TEXTS = ["Rx 500 mg bid for E11.9, x500 mg", "18 U.S.C. § 1001 and 29 C.F.R. § 1910.134", "mail a.b@c.example or see https://x.example/a?b=1 on 2020-01-02", "é500 mg 😀 500 mg", "", "A12.3 A12.34 (555) 123-4567", "IBM stock"]


def test_spans_match_finditer(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id long, t string")
    for d, name, pattern, prio, ci, v in fixed.RULES:
        rows = df.select("id", spans(F.col("t"), Rule(name, pattern, prio, ci, v)).alias("s")).collect()
        for r in rows:
            want = [(m.start(), m.end()) for m in re.finditer(pattern, TEXTS[r.id], re.I if ci else 0) if m[0]]
            assert [(x.start, x.end) for x in r.s] == want, (name, TEXTS[r.id])


def test_greedy_resolution_and_confidence(spark):
    df = spark.createDataFrame([(1, "call 2020-01-02 or a@b.example"), (2, None)], "id long, text string")
    got = extract(df, rules_of("general"), "id", "text").collect()
    assert [(r.entity_type, r.start, r.end, r.confidence) for r in got] == [("DATE_ISO", 5, 15, 0.8), ("EMAIL", 19, 30, 1.0)]
    own = [Rule("whole", r"a@b\.example", "high"), Rule("part", r"@b", "high")]
    one = spark.createDataFrame([("a@b.example",)], "t string").select(resolved(candidates(F.col("t"), own)).alias("r")).first().r
    assert [x.rule for x in one] == ["whole"]


def test_rules_order_and_custom():
    names = [r.name for r in rules_of("medical", [Rule("dosage", "x", "low"), Rule("own", "y", "high")])]
    assert names[0] == "icd10_code" and "own" in names and names.index("dosage") > names.index("frequency")
    assert [r.name for r in rules_of("general")] == ["email", "phone_us", "url", "date_iso"]


def test_validate_normalise_groups(spark):
    rules = {r.name: r for r in rules_of("medical")}
    df = spark.createDataFrame([("E11.9",), ("INVALID",)], "t string")
    assert [r.ok for r in df.select(valid_entity(F.col("t"), rules["icd10_code"]).alias("ok")).collect()] == [True, False]
    n = lambda d, k, t: normalised_entity(F.lit(d), F.lit(k), F.lit(t))
    row = df.select(n("medical", "DOSAGE", "5 mcg units").alias("a"), n("medical", "ROUTE", "po").alias("b"), n("legal", "USC_CITATION", "18 USC section 1").alias("c"), n("financial", "CURRENCY_AMOUNT", "$ 1 M").alias("d"), groups(F.lit("500 mg"), rules["dosage"], 2).alias("g")).first()
    assert (row.a, row.b, row.c, row.d, row.g) == ("5 µg Us", "PO", "18 U.S.C. § 1", "$1M", {"group_1": "500", "group_2": "mg"})


ENT = "doc_id long, model_ord int, ent_ord int, text string, type string, start int, end int, confidence double, weight double"


def _e(spark, rows):
    return spark.createDataFrame([(1, m, 0, "John", t, s, e, c, w) for m, t, s, e, c, w in rows], ENT)


def test_votes(spark):
    e = _e(spark, [(0, "PERSON", 0, 4, 0.90, 1.0), (1, "PERSON", 0, 4, 0.85, 1.0), (2, "ORG", 0, 4, 0.70, 1.0)])
    m = ensemble.majority(e).first()
    assert m.type == "PERSON" and abs(m.confidence - 0.875 * (0.5 + 0.5 * 2 / 3)) < 1e-9
    w = ensemble.weighted(_e(spark, [(0, "PERSON", 0, 4, 0.9, 0.3), (1, "ORG", 0, 4, 0.8, 0.7)])).first()
    assert w.type == "ORG" and abs(w.confidence - 0.56) < 1e-9
    u = ensemble.union(_e(spark, [(0, "PERSON", 0, 4, 0.9, 1.0), (1, "ORG", 10, 13, 0.85, 1.0), (1, "ORG", 3, 6, 0.95, 1.0)]))
    assert sorted((r.start, r.end) for r in u.collect()) == [(3, 6), (10, 13)]
    i = ensemble.intersection(_e(spark, [(0, "PERSON", 0, 4, 0.9, 1.0), (0, "ORG", 10, 13, 0.85, 1.0), (1, "PERSON", 0, 4, 0.8, 1.0)])).collect()
    assert [(r.start, round(r.confidence, 6)) for r in i] == [(0, 1.0)]
    assert ensemble.agreement(_e(spark, [(k, "A", 0, 4, 0.9, 1.0) for k in range(3)])).first().agreement == 1.0
    three = ensemble.agreement(_e(spark, [(k, "ABC"[k], 0, 4, 0.9, 1.0) for k in range(3)])).first().agreement
    assert abs(three - 1 / 3) < 1e-9
    alone = ensemble.merge(_e(spark, [(0, "PERSON", 0, 4, 0.9, 1.0)]), "unknown").first()
    assert alone.confidence == 0.9


def test_catalog_golden_ranks(spark):
    known = catalog.known_models(spark)
    tops = {p["domain"]: [(r.model_id.split("/")[1], r.score) for r in catalog.ranked(known, p["domain"], p["min_f1_score"], p["max_latency_ms"], p["preferred_providers"], p["entity_types"]).where(F.col("position") <= p["max_models"]).orderBy("position").collect()] for p in fixed.PIPELINES}
    assert tops["medical"] == [("en_ner_bc5cdr_md", 85.25), ("BiomedNLP-PubMedBERT-base-uncased-abstract-fulltext", 76.75), ("biobert-v1.1", 75.75)]
    assert tops["general"] == [("en_core_web_sm", 87.5), ("en_core_web_md", 85.0)]
    assert tops["legal"] == [("legal-bert-base-uncased", 81.1)]


def test_lookup_chain_and_hops(spark):
    kb = spark.createDataFrame([("a", "A1", "Aspirin", "DRUG", None), ("b", "B1", "aspirin ", "DRUG", ["ASA"])], "kb_id string, entity_id string, text string, entity_type string, synonyms array<string>")
    chain = spark.createDataFrame([("b", 0), ("a", 1)], "kb_id string, rank int")
    e = spark.createDataFrame([(1, "ASPIRIN"), (2, "asa"), (3, "none"), (4, None)], "id long, text string")
    got = {r.id: r.found_id for r in knowledge.lookup(e, kb, chain).collect()}
    assert got == {1: "B1", 2: "B1", 3: None, 4: None}
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "source_id string, target_id string")
    h = {(r.source_id, r.target_id): r.hops for r in knowledge.hops(edges, edges, 2).collect()}
    assert h[("a", "b")] == 1 and h[("a", "c")] == 2


def test_breaker_and_running(spark):
    rows = [("s", i, ok) for i, ok in enumerate([False, False, False, True, True])] + [("s", 70, False), ("s", 71, True), ("s", 131, True)]
    calls = spark.createDataFrame(rows, "service string, at long, ok boolean").select("service", F.timestamp_seconds("at").alias("ts"), F.col("at").alias("seq"), "ok")
    got = [(r.seq, r.allowed, r.state) for r in state.breaker(calls, threshold=3).orderBy("seq").collect()]
    assert got == [(0, True, "closed"), (1, True, "closed"), (2, True, "open"), (3, False, "open"), (4, False, "open"), (70, True, "open"), (71, False, "open"), (131, True, "closed")]
    m = spark.range(500).select(F.lit("k").alias("k"), F.timestamp_seconds(F.col("id") * 40000).alias("t"), "id", (F.col("id") % 7).cast("double").alias("v"))
    small = {r.id: (r.recent, r.degraded) for r in state.degraded(m, "k", ["t", "id"], "v", chunk=16).collect()}
    whole = {r.id: (r.recent, r.degraded) for r in state.degraded(m, "k", ["t", "id"], "v").collect()}
    assert small == whole and len(small) == 500
    assert state.last_rows(m, "k", ["t", "id"], 10).agg(F.min("id")).first()[0] == 490


def test_storage(spark):
    tasks = spark.sql("SELECT 't' AS task_id, 'pending' AS status, CAST(NULL AS timestamp_ntz) AS started_at, CAST(NULL AS timestamp_ntz) AS completed_at, CAST(NULL AS string) AS result, CAST(NULL AS string) AS error")
    changes = spark.sql("SELECT 't' AS task_id, 1 AS seq, 'processing' AS status, timestamp_ntz'2020-01-01 00:00:00' AS at, CAST(NULL AS string) AS result, CAST(NULL AS string) AS error UNION ALL SELECT 't', 2, 'failed', timestamp_ntz'2020-01-01 00:01:00', NULL, repeat('x', 2000)")
    r = storage.task_views(storage.transition(tasks, changes)).first()
    assert (r.status, len(r.error), r.duration_s) == ("failed", 1000, 60.0)
    entries = spark.range(25).select("id", F.timestamp_seconds("id").alias("used"))
    assert sorted(x.id for x in storage.evicted(entries, "used", "id").collect()) == [0, 1]


def test_text_functions(spark):
    r = spark.range(1).select(T.xml_escaped(F.lit("<a href='x'>&\"")).alias("a"), T.error_message(F.lit("Connection refused")).alias("b"), T.error_message(F.lit(None).cast("string")).alias("c"), T.provider_label(F.lit("gpe")).alias("d"), T.display_class(F.lit("CUSIP")).alias("e"), T.frequency_seconds(F.lit("weekly")).alias("f"), T.sanitised(F.lit("a\x01<b>c</b>\n")).alias("g"), T.certainty(F.lit(None).cast("double")).alias("h")).first()
    assert tuple(r) == ("&lt;a href=&apos;x&apos;&gt;&amp;&quot;", "A connection error occurred", "An unknown error occurred", "LOC", "entity-code", 604800, "ac\n", "unknown")


def test_tei_inline_and_standoff(spark):
    import xml.etree.ElementTree as ET

    docs = spark.createDataFrame([(1, "default", "Write a.b@c.example now. <Done> & gone!"), (2, "literary", "On 2020-01-02 it ended."), (3, "none", "")], "id long, domain string, text string")
    a = annotate.annotated(docs, "id", "text", rules_of("general")).join(docs.select("id", "domain"), "id").withColumn("language", F.lit("en"))
    a = a.withColumn("dependencies", F.expr("array(named_struct('from', 0, 'to', 1, 'dep', 'x', 'from_text', 'a', 'to_text', 'b'))"))
    out = {r.id: r.tei for r in tei.converted(tei.with_schema(a, tei.schemas(spark)), F.lit("2020-01-01T00:00:00")).collect()}
    ns = "{http://www.tei-c.org/ns/1.0}"
    one = ET.fromstring(out[1].encode())
    name = next(e for e in one.iter(ns + "name") if e.get("cert"))
    assert "".join(x.text for x in name) == "a." and [e.text for e in one.iter(ns + "w")][-1] == "gone"
    two = ET.fromstring(out[2].encode())
    assert next(two.iter(ns + "annotation")).get("target") == "#char_3_13" and next(two.iter(ns + "link")).get("target") == "#w1 #w2"
    assert ET.fromstring(out[3].encode()) is not None
    bad = spark.range(1).select(tei.fallback(F.lit("a<b"), F.lit("no")).alias("x")).first().x
    assert "a&lt;b" in bad and ET.fromstring(bad.encode()) is not None
