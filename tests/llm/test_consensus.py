"""Mentions cut from chains of spans, and the fit's objective."""

import numpy as np
import pytest

from lectern.llm import consensus
from lectern.session import cut

REPORT = "doc_id long, model_ord int, ent_ord int, text string, entity_type string, start_char int, end_char int, confidence double"


def test_every_disjoint_mention_of_a_chain_is_kept(spark):
    text = "Alpha Beta Iota and, Zeta too"
    spans = [(m, a, b) for m in (0, 1) for a, b in [(0, 5), (6, 10), (11, 15), (21, 25)]] + [(2, 4, 12), (3, 10, 22)]
    rows = [(1, m, k, text[a:b], "ORG", a, b, 0.9) for k, (m, a, b) in enumerate(spans)]
    found, _ = consensus.consensus(spark.createDataFrame(rows, REPORT))
    assert sorted((r.start_char, r.end_char) for r in found.collect() if r.n_models >= 2) == [(0, 5), (6, 10), (11, 15), (21, 25)]


@pytest.mark.parametrize("stretch", [3, 50, 4096])
def test_islands_do_not_depend_on_stretches(spark, monkeypatch, stretch):
    monkeypatch.setattr(consensus, "STRETCH", stretch)
    r = np.random.default_rng(3)
    spans = [(int(d), int(a), int(a + n)) for d, a, n in zip(r.integers(0, 3, 200), r.integers(0, 150, 200), r.integers(1, 9, 200))]
    want = {}
    for d in range(3):
        reach, opened = -1, 0
        for _, a, b in sorted(x for x in spans if x[0] == d):
            opened = a if a >= reach else opened
            reach = max(reach, b)
            want[d, a, b] = opened
    got = {(x.doc_id, x.start, x.end): x.island for x in consensus._islands(spark.createDataFrame([(*x, 0) for x in spans], "doc_id long, start int, end int, model int")).collect()}
    assert got == want


def test_the_objective_never_falls(spark):
    r = np.random.default_rng(1)
    rows = []
    for _ in range(400):
        truth = r.integers(1, 6)
        rows.append(("".join(str(truth if r.random() < p else r.integers(0, 6)) if r.random() < 0.9 else "-" for p in (0.9, 0.8, 0.6, 0.4)), 1 + int(r.integers(0, 3))))
    model, values = consensus.fit(cut(spark.createDataFrame(rows, "pattern string, n int")), 4)
    assert len(values) > 2 and all(b >= a - 1e-6 * abs(a) for a, b in zip(values, values[1:]))
    right = consensus.reliability(model)
    assert right[0] > right[1] > right[2] > right[3]


def test_without_wording_the_model_alone_decides(spark):
    rows = [(d, m, 0, "Ann Lee", "PERSON" if m < 2 else "ORG", 0, 7, 0.9) for d in range(20) for m in range(3)]
    found, _ = consensus.consensus(spark.createDataFrame(rows, REPORT), wording=False)
    assert {r.entity_type for r in found.collect()} == {"PERSON"}
