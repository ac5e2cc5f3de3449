"""Sessions and nested records, against plain versions on small tables."""

import json
import random
from datetime import datetime, timedelta

import pytest

from lectern.operators.flatten import LEVELS, flatten_tables
from lectern.operators.sessions import sessionize

AUDIT = "user_id string, ts timestamp_ntz, id long, action string, session_no int"
T0 = datetime(2020, 1, 1)


def plain_sessions(rows, gap=1800):
    by = {}
    for u, ts, i in {(r[0], r[1], r[2]) for r in rows if r[0] is not None and r[1] is not None}:
        by.setdefault(u, []).append((ts, i))
    out = []
    for u, v in by.items():
        v.sort()
        runs = [[v[0]]]
        for a, b in zip(v, v[1:]):
            if (b[0] - a[0]).total_seconds() > gap:
                runs.append([])
            runs[-1].append(b)
        for r in runs:
            out.append((u, min(i for t, i in r if t == r[0][0]), max(i for t, i in r if t == r[-1][0]), len(r)))
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_sessions_match_plain_version(spark, seed):
    r = random.Random(seed)
    rows = []
    for i in range(900):
        u = r.choice(["hot"] * 5 + ["a", "b", None])
        ts = None if r.random() < 0.03 else T0 + timedelta(seconds=r.choice([0, 1, 1799, 1800, 1801]) * r.randint(0, 200) + r.randint(0, 4) * 21600)
        rows.append((u, ts, i, "x", 1))
    rows += r.sample(rows, 60)
    df = spark.createDataFrame(rows, AUDIT).repartition(5)
    for bucket in (3600, 21600):
        got = sorted((x.user_id, x.first_id, x.last_id, x.n_events) for x in sessionize(df, bucket_seconds=bucket).collect())
        assert got == plain_sessions(rows)


def test_sessions_edges(spark):
    at = [T0, T0 + timedelta(minutes=30), T0 + timedelta(minutes=60, microseconds=1)]
    got = sessionize(spark.createDataFrame([("u", t, i, None, 0) for i, t in enumerate(at)], AUDIT)).orderBy("start_ts").collect()
    assert [(x.first_id, x.last_id, x.duration_s) for x in got] == [(0, 1, 1800.0), (2, 2, 0.0)]
    assert sessionize(spark.createDataFrame([], AUDIT)).count() == 0
    both_null = sessionize(spark.createDataFrame([("u", T0, None, "", 0), ("u", T0, 4, "", 0)], AUDIT)).collect()
    assert [(x.first_id, x.last_id, x.n_events) for x in both_null] == [(4, 4, 2)]


def plain_cases(text):
    def js(v):
        while isinstance(v, str):
            try:
                v = json.loads(v)
            except ValueError:
                return None
        return v

    def arr(v):
        v = js(v)
        return v if isinstance(v, list) else [v] if isinstance(v, dict) else []

    def obj(v):
        v = js(v)
        return v if isinstance(v, dict) else {}

    o = obj(text)
    chunks = arr(o.get("chunks"))
    for cn, c in list(enumerate(chunks)) if chunks else [(0, o)]:
        c = obj(c)
        n = obj(c.get("nlp_results"))
        for en, e in enumerate(arr(n["entities"] if "entities" in n else c.get("entities"))):
            e = js(e)
            if isinstance(e, dict):
                rels = [k for k, r in enumerate(arr(obj(e.get("kb_entity")).get("relationships"))) if isinstance(js(r), dict)]
                yield from ((cn, en, k) for k in rels or [-1])


DOCS = [
    {"entities": [{"text": "a", "kb_entity": {"relationships": [{"source_id": "1"}, None, {"source_id": "2"}]}}, None, {"text": "b", "kb_entity": None}]},
    {"entities": {"text": "alone", "kb_entity": {"relationships": {"source_id": "1"}}}},
    {"nlp_results": {"entities": [{"text": "x"}]}},
    {"nlp_results": json.dumps({"entities": [{"text": "x", "kb_entity": json.dumps({"relationships": []})}]})},
    {"chunks": [None, {"nlp_results": {"entities": [{"text": "c"}, {"text": "d"}]}}, {"entities": json.dumps([{"text": "e"}])}]},
    {"entities": None},
    {"entities": []},
    {},
    [],
    "plain",
    7,
]
BROKEN = ['{"entities": [{"text": "a"}', '{"entities": [{"text": "a"}]} x', "", "  ", "{'entities': []}", '{"entities": [{"text": NaN}]}']


def test_flatten_matches_plain_version(spark):
    texts = [json.dumps(d) for d in DOCS] + [json.dumps(json.dumps(d)) for d in DOCS] + BROKEN[:5] + [None, json.dumps({"entities": [{"text": "long " * 50_000}]})]
    rows = [(i, t, "extra") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, result string, row_id string")
    got = sorted((r.row_id, r.chunk_no, r.ent_no, r.rel_no) for r in flatten_tables("entity_relationships", (df, "id", "result", "t")).collect())
    want = sorted((i, *c) for i, t in enumerate(texts) if t is not None for c in plain_cases(t))
    assert got == want


def test_flatten_levels(spark):
    doc = {"sentences": [{"text": "s", "tokens": [{"text": "t", "i": 0}, None]}], "entities": [{"text": "a", "kb_entity": {"kb_id": "k", "entity_id": "e", "synonyms": ["x", "y"]}}]}
    df = spark.createDataFrame([(1, json.dumps(doc)), (2, BROKEN[5])], "id long, r string")
    n = {level: flatten_tables(level, (df, "id", "r", "t")).count() for level in LEVELS}
    assert n == {"entities": 1, "kb_links": 1, "synonyms": 2, "relationships": 0, "entity_relationships": 1, "sentences": 1, "tokens": 1}
    empty = spark.createDataFrame([], "id long, r string")
    assert flatten_tables("tokens", (empty, "id", "r", "t")).count() == 0
