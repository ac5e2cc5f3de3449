"""Copies in many lots, against a plain version."""

import random

from lectern.llm import format_dups


def _plain(text):
    return tuple(format_dups.canonical(b) if isinstance(b, str) else tuple(sorted((format_dups.canonical(k), format_dups.canonical(v)) for k, v in b)) for b in format_dups.blocks(text))


def test_lots_agree_with_plain_tuples(spark, monkeypatch):
    r = random.Random(7)
    values = ["a", "B", "c d", "3.5", "x-y", "Straße"]

    def form():
        fields = [(r.choice(["Site", "Ref", "Dose"]), r.choice(values)) for _ in range(r.randint(2, 3))]
        r.shuffle(fields)
        return r.choice(["\n", " | "]).join(f"{k.upper() if r.random() < 0.3 else k}: {v}" for k, v in fields)

    texts = [form() if r.random() < 0.7 else r.choice(["One two.", "one  TWO", "Other thing"]) for _ in range(600)] + ["Site: a\nRef: b"] * 300
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    monkeypatch.setattr(format_dups, "LOT_VALUES", 5)
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(_plain(t), i)
    want = sorted((first[_plain(t)], i) for i, t in enumerate(texts) if first[_plain(t)] != i)
    assert sorted((x.id_first, x.id_copy) for x in format_dups.copies(df).collect()) == want
    n = {x.id_first: x.n_copies for x in format_dups.groups(df).collect()}
    assert sum(n.values()) == len(texts) and len(n) == len(first)
