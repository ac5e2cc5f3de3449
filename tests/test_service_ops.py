"""Requests, providers, schemas, catalogs and array scans, against literal cases and plain versions."""

import json
import random

from pyspark.sql import functions as F

from lectern.functions.arrays import ranks, runs, scan
from lectern.operators import annotate, catalog, knowledge, patterns, providers, requests, schemas, state, storage, tei
from lectern.plans.pipeline import Pipeline, model_annotator
from lectern.sources import readers, writers


def test_scans_match_plain(spark):
    r = random.Random(1)
    rows = [(i, [r.randint(0, 9) for _ in range(n)]) for i, n in enumerate([0, 1, 5, 127, 128, 129, 400])] + [(99, None)]
    df = spark.createDataFrame(rows, "id int, a array<int>")
    summed = scan(F.col("a"), F.lit(0), "int", lambda s, x: ((s + x), (s + x)))
    got = {x.id: (x.s, x.r, x.c) for x in df.select("id", summed.alias("s"), ranks(F.array_sort("a"), F.array_sort(F.transform("a", lambda x: x + 2))).alias("r"), runs(F.col("a"), F.transform("a", lambda x: x == 0)).alias("c")).collect()}
    for i, a in rows:
        if a is None:
            assert got[i][0] is None
            continue
        assert got[i][0] == [sum(a[: k + 1]) for k in range(len(a))]
        assert got[i][1] == [sum(y + 2 < x for y in a) for x in sorted(a)]
        cut = []
        for k, x in enumerate(a):
            if k == 0 or x == 0:
                cut.append([])
            cut[-1].append(x)
        assert got[i][2] == cut


def test_long_texts_take_time_in_proportion(spark):
    import time

    def took(n, size):
        texts = [(i, "write to a@b.example on 2020-01-02. " * (size // 36)) for i in range(n)]
        df = spark.createDataFrame(texts, "id long, text string").coalesce(1).cache()
        df.count()
        start = time.time()
        annotate.annotated(df, "id", "text", patterns.rules_of("general")).write.format("noop").mode("overwrite").save()
        return time.time() - start

    took(1, 10_000)
    assert took(1, 400_000) < 3 * took(8, 50_000) + 2


def test_options(spark):
    df = spark.createDataFrame([('{"include_pos": false, "language": "de", "include_tokens": "x"}',), ("broken",), (None,)], "j string")
    o = [r.o for r in df.select(requests.parsed_options(F.col("j")).alias("o")).collect()]
    assert (o[0].include_pos, o[0].include_tokens, o[0].language, o[0].include_sentiment) == (False, True, "de", False)
    assert o[1] == o[2] and o[1].include_pos and o[1].language == "en"
    keys = spark.createDataFrame([(["include_pos", "zz", "aa"],), (None,), ([f"o{i}" for i in range(21)],)], "k array<string>")
    bad = [r.b for r in keys.select(requests.invalid_options(F.col("k")).alias("b")).collect()]
    assert bad[0] == ["aa", "zz"] and bad[1] == [] and bad[2][-1] == "too many options"


def test_chain_and_read_through(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, ""), (3, None), (4, "abcdef")], "id long, text string")
    short = lambda d: d.select(d.columns[0], F.when(F.length("text") < 5, F.upper("text")).alias("result"))
    p = providers.Providers(fallbacks=["b"]).register(providers.Provider("a", short)).register(providers.Provider("b", lambda d: d.select("id", F.when(F.col("text") != "", F.lit("B")).alias("result"))))
    got = {r.id: (r.result, r.provider, r.attempted, r.fallback_used) for r in p.annotate(docs, "id").collect()}
    assert got[1] == ("ABC", "a", [], False) and got[4] == ("B", "b", ["a"], True) and got[3] == (None, None, ["a", "b"], False)
    assert [x.name for x in p.switch("b").chain()] == ["b"] and providers.first_healthy(p.chain()).name == "b"
    keyed = docs.unionByName(spark.createDataFrame([(5, "abc")], docs.schema)).withColumn("cache_key", F.col("text"))
    cached = spark.createDataFrame([("abcdef", "old")], "cache_key string, value string")
    out, new = providers.read_through(keyed, "id", cached, lambda d: d.select("cache_key", F.upper("text").alias("result")), 100)
    assert {r.id: (r.result, r.origin) for r in out.collect()} == {1: ("ABC", "provider"), 5: ("ABC", "provider"), 4: ("old", "cache"), 2: (None, "rejected"), 3: (None, "rejected")}
    assert [tuple(r) for r in new.collect()] == [("abc", "ABC")]


def test_schemas(spark, tmp_path):
    own = schemas.updated([], "court", {"title": "Court", "entity_mappings": {"JUDGE": "persName"}})
    t = tei.schemas(spark, own)
    i = {r.domain: r for r in schemas.info(t).collect()}
    assert i["court"].is_custom and i["court"].entity_types == ["JUDGE"] and not i["legal"].is_custom and i["literary"].features.morphology
    assert schemas.domains(t).first().domains == sorted(i)
    assert json.loads(open(schemas.saved(own[0], str(tmp_path / "own"))).read())["title"] == "Court"
    schemas.exported(spark, str(tmp_path / "all"), own)
    assert spark.read.json(str(tmp_path / "all")).select("domain").distinct().count() == len(i)


def test_catalog_changes(spark):
    known = catalog.known_models(spark)
    assert known.where("size_mb = 100.0").count() == 0 and known.where("source_url LIKE '%explosion%'").count() == 3
    assert catalog.merged(known, known).count() == known.count()
    extra = known.limit(1).withColumn("model_id", F.lit("own/x"))
    assert catalog.merged(known, extra.unionByName(extra)).count() == known.count() + 1
    assert catalog.without(known, "spacy").where("provider = 'spacy'").count() == 0


def test_knowledge_base(spark):
    kb = spark.sql("SELECT 'k' AS kb_id, 'E1' AS entity_id, 'Aspirin' AS text, 'DRUG' AS entity_type, array('ASA') AS synonyms, map('rev', '1') AS metadata, 0.9D AS confidence, timestamp'2020-01-01' AS last_updated")
    rel = spark.createDataFrame([("E1", "E2")], "source_id string, target_id string")
    b = knowledge.KnowledgeBase("k", kb, rel)
    assert b.search("asa").first().entity_id == "E1" and b.by_id("E1").count() == 1 and b.healthy()
    assert b.relationships("E1").count() == 1 and b.metadata("E1").first().value == "1" and b.entities("DRUG", "2021-01-01").count() == 0
    assert b.types().first().entity_type == "DRUG" and b.lookup(spark.createDataFrame([("aspirin ",)], "text string")).first().found_id == "E1"
    row = knowledge.restored(knowledge.cached_rows(kb, F.current_timestamp())).first()
    assert (row.entity_id, row.confidence, row.synonyms) == ("E1", 0.9, [])
    at = lambda n: F.timestamp_seconds(F.lit(n))
    rows = writers.kept_until(spark.createDataFrame([("a", "1")], "key string, value string"), at(0), 60).unionByName(writers.kept_until(spark.createDataFrame([("a", "2"), ("b", "3")], "key string, value string"), at(30), 60))
    assert sorted((r.key, r.value) for r in writers.living(rows, at(70)).collect()) == [("a", "2"), ("b", "3")] and writers.living(rows, at(90)).count() == 0


def test_health_gauge_registry_eviction(spark):
    s = spark.createDataFrame([("a", "healthy"), ("b", "memory-only")], "service string, status string")
    assert requests.rolled_up(s).first().overall == "degraded"
    assert requests.rolled_up(s.unionByName(spark.createDataFrame([("c", "error")], s.schema))).first().overall == "unhealthy"
    spans = spark.createDataFrame([(1, 5), (2, None), (5, 9), (None, 3)], "a int, b int").select(F.timestamp_seconds("a").alias("a"), F.timestamp_seconds("b").alias("b"))
    assert [r.active for r in state.gauge(spans, "a", "b").orderBy("at").collect()] == [1, 2, 2, 1]
    r = random.Random(4)
    rows = [(i, None if r.random() < 0.1 else r.choice([5, 5, 5, 86_400 * 3, 86_400 * 3 + 1, i * 3600])) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, t long").select("id", F.timestamp_seconds("t").alias("used"))
    for share in (2, 7, 10, 1000):
        want = [i for i, _ in sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[0]))][: max(1, 300 // share)]
        assert sorted(x.id for x in storage.evicted(df, "used", "id", share).collect()) == sorted(want)
    assert storage.evicted(df.limit(0), "used", "id").count() == 0


def test_well_formed_xml(spark):
    df = spark.createDataFrame([("<a><b/></a>",), ("<a><b></a>",), ("plain",), (None,), ("<!DOCTYPE x><a/>",)], "x string")
    assert [r.w for r in df.select(requests.well_formed(F.col("x")).alias("w")).collect()] == [True, False, False, None, False]


def test_models_in_batches_and_settings(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None)], "doc_id long, text string").coalesce(1)

    def load():
        def model(texts):
            return [[(t, "X", 0, 1, 1.0)] for t in texts]

        return model

    p = Pipeline("general", use_patterns=False).add_model("m", model_annotator(load, batched=True))
    assert sorted(r.doc_id for r in p.found(docs).collect()) == [1, 2]
    assert p.statistics()["active_models"] == 1 and p.statistics()["ensemble_strategy"] == "majority_vote"
    got = readers.Settings.from_environment({"LECTERN_CACHE_TTL": "5", "LECTERN_MAX_TEXT_LENGTH": "x"})
    assert (got.cache_ttl, got.max_text_length, got.get("none", 1)) == (5, 100_000, 1)


def test_stored_annotation_to_xml(spark):
    import xml.etree.ElementTree as ET

    token = lambda i, t, h: {"text": t, "lemma": t.lower(), "pos": "X", "i": i, "idx": 4 * i, "is_punct": False, "is_space": False, "dep": "nsubj", "head": h, "morph": "A=b"}
    doc = {"language": "de", "sentences": [{"text": "Ann saw Bob", "tokens": [token(0, "Ann", 1), token(1, "saw", 1), token(2, "Bob", 1)]}, {"text": "So"}], "entities": [{"text": "Ann", "label": "PERSON", "start": 0, "end": 1, "start_char": 0, "end_char": 3, "confidence": 0.95, "kb_id": "K1"}], "dependencies": [{"from": 1, "to": 0, "dep": "nsubj", "from_text": "saw", "to_text": "Ann"}], "noun_chunks": [{"text": "Ann"}, {"text": "Bob"}]}
    rows = [(1, json.dumps(doc), "linguistic"), (2, json.dumps({"sentences": [], "entities": [{"text": "x"}]}), "default"), (3, None, "default"), (4, json.dumps(doc), "default")]
    t = annotate.stored(spark.createDataFrame([(*r, "Ann & co") for r in rows], "id long, j string, domain string, text string"), "id", "j", "domain", "text")
    assert {r.id: r.valid for r in t.collect()} == {1: True, 2: False, 3: False, 4: True}
    own = [{"domain": "linguistic", "annotation_strategy": "mixed", "include_morph": True, "include_dep": True, "include_analysis": True, "author": "A. B.", "schema_ref": "x.rng", "entity_mappings": {"PERSON": "persName"}}]
    out = {r.id: r.tei for r in tei.converted(tei.with_schema(t, tei.schemas(spark, own)), F.lit("2020-01-01")).collect()}
    ns = "{http://www.tei-c.org/ns/1.0}"
    one = ET.fromstring(out[1].encode())
    assert one.get("schemaRef") == "x.rng" and next(one.iter(ns + "author")).text == "A. B." and next(one.iter(ns + "language")).get("ident") == "de"
    name = next(e for e in one.iter(ns + "persName"))
    assert (name.get("cert"), name.get("ref"), name[0].text, name[0].get("msd"), name[0].get("function")) == ("high", "K1", "Ann", "A=b", "nsubj")
    assert next(one.iter(ns + "link")).get("target") == "#w2 #w1" and next(one.iter(ns + "link"))[0].text == "saw --nsubj--> Ann"
    assert ["".join(i.itertext()).split() for i in one.iter(ns + "item")] == [["2", "Sentences"], ["3", "Tokens"], ["1", "Entities"], ["1", "Dependencies"], ["2", "Noun", "Phrases"]]
    assert "Processing Error" in out[2] and "Ann &amp; co" in out[3]
    four = ET.fromstring(out[4].encode())
    assert [w.text for w in four.iter(ns + "w")] == ["Ann", "saw", "Bob"] and len(list(four.iter(ns + "s"))) == 2


def test_financial_rules_match_plain(spark):
    import re

    texts = ["IBM stock fell, AAPL $5 and XY shares", "NYSE: FY'21 Q3 '22 EPS 5.5 % of $1,000.50 million", "é EBITDA 12 %"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    rules = patterns.rules_of("financial")
    for i, t in enumerate(texts):
        kept = []
        for k, r in enumerate(rules):
            for m in re.finditer(r.pattern, t, re.I if r.ignore_case else 0):
                if not any(a < m.end() and m.start() < b for _, a, b in kept):
                    kept.append((r.type, m.start(), m.end()))
        got = [(x.entity_type, x.start, x.end) for x in patterns.extract(df.where(f"id = {i}"), rules, "id", "text").collect()]
        assert sorted(got, key=lambda x: x[1]) == sorted(kept, key=lambda x: x[1])


def test_breaker_in_stretches_matches_whole(spark):
    from lectern.operators.state import Breaker

    r = random.Random(6)
    rows, at = [], {"a": 0.0, "b": 0.0}
    for i in range(900):
        s = "a" if r.random() < 0.8 else "b"
        at[s] += r.choice([0, 1, 5, 20, 59.5, 60, 200])
        rows.append((s, at[s], i, r.random() < 0.55))
    want = {}
    for s in at:
        b = Breaker(3, 60.0)
        for _, t, i, ok in [x for x in rows if x[0] == s]:
            want[i] = b.call(t, ok)
    df = spark.createDataFrame(rows, "service string, at double, seq long, ok boolean").select("service", F.timestamp_micros((F.col("at") * 1e6).cast("long")).alias("ts"), "seq", "ok")
    for chunk in (7, 64, 10_000):
        got = {x.seq: (x.allowed, x.state) for x in state.breaker(df.repartition(3), threshold=3, chunk=chunk).collect()}
        assert got == want
    assert state.breaker(df.limit(0)).count() == 0
