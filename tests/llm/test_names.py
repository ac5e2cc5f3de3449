"""Names that are in no table, clusters of spellings, keys and components."""

import random

from lectern.llm import names

KB = [("P1", "Thandiwe Oduya-Brandt", None), ("P2", "Bartholomew Quistgaard", ["B. Quistgaard"]), ("P3", "Philippa Rasmunder", None), ("P4", "Petronella Rasmunder", None), ("O1", "Gesellschaft of Alpine Glaciology Tormann GmbH", ["G.A.G.T."]), ("O2", "Wexford & Lanyon Brewing Company", None)]
SPELT = {
    "thandi oduya brandt": "P1",
    "Oduya-Brandt, T.": "P1",
    "Bart Quistgaard": "P2",
    "Quistgard Bartolomew": "P2",
    "B Quistgaard": "P2",
    "Philipa Rasmunder": "P3",
    "P. Rasmunder": None,
    "Paula Rasmunder": None,
    "Nella Rasmunder": "P4",
    "Ges. of Alpine Glac. Tormann": "O1",
    "Tormann Alpine Glaciology Gesellschaft": "O1",
    "GAGT": "O1",
    "Wexford and Lanyon Brewing Co.": "O2",
    "Wexford & Lanyon": None,
    "Rasmunder": None,
    "Q97/963": None,
}


def test_names_outside_any_table(spark):
    df = spark.createDataFrame([(s,) for s in SPELT], "spelling string")
    got = {r.spelling: r.entity_id for r in names.resolve(df, spark.createDataFrame(KB, "entity_id string, text string, synonyms array<string>")).collect()}
    assert got == {s: e for s, e in SPELT.items() if e}


def test_blocks_joined_or_looked_up_give_the_same(spark, monkeypatch):
    df = spark.createDataFrame([(s,) for s in SPELT], "spelling string")
    kb = spark.createDataFrame([(e, t, s) for e, t, s in KB], "entity_id string, text string, synonyms array<string>")
    monkeypatch.setattr(names, "BROADCAST_KEYS", 0)
    got = {r.spelling: r.entity_id for r in names.resolve(df, kb).collect()}
    assert got == {s: e for s, e in SPELT.items() if e}


def test_a_spelling_reached_through_another_one(spark):
    kb = spark.createDataFrame([("P1", "Johannes Vanterpool", None)], "entity_id string, text string, synonyms array<string>")
    chain = ["Johanes Vanterpol", "Jhoanes Vantterpol", "Unrelated Persona", "Unrelatet Persona"]
    got = {r.spelling: r for r in names.clusters(spark.createDataFrame([(s,) for s in chain], "spelling string"), kb).collect()}
    assert got["Johanes Vanterpol"].entity_id == "P1"
    assert got["Unrelated Persona"].component == got["Unrelatet Persona"].component and got["Unrelated Persona"].entity_id is None


def test_connected_matches_plain(spark):
    r = random.Random(2)
    edges = [(f"n{r.randint(0, 60):02d}", f"n{r.randint(0, 60):02d}") for _ in range(45)] + [(f"m{i:03d}", f"m{i + 1:03d}") for i in range(100)] + [("hub", f"x{i}") for i in range(50)]
    label = {n: n for e in edges for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    got = {x.node: x.component for x in names.connected(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {n: m for n, m in label.items() if any(n in e and e[0] != e[1] for e in edges)}


def test_one_slip_keeps_a_key():
    r = random.Random(9)
    families = ["Korerithorpe", "Quistgaard", "Vanterpool", "Brandtmeyer", "Oduyaholm"]
    kept = 0
    for _ in range(300):
        f = r.choice(families).lower()
        i = r.randint(1, len(f) - 2)
        slip = r.choice([f[:i] + f[i + 1 :], f[:i] + r.choice("aeiobdklmnrst") + f[i:], f[:i] + r.choice("aeiobdklmnrst") + f[i + 1 :], f[:i] + f[i + 1] + f[i] + f[i + 2 :]])
        kept += bool(names.keys(("maria", slip)) & names.keys(("maria", f), record=True))
    assert kept >= 297


def test_edges_of_the_tables(spark):
    kb = "entity_id string, text string, synonyms array<string>, spelling string"
    none = names.clusters(spark.createDataFrame([("Ann Lee",)], "spelling string"), spark.createDataFrame([], kb))
    assert none.count() == 0
    odd = spark.createDataFrame([("P1", None, None, "x"), (None, "Ann Lee", None, "x"), ("P2", "Ann Lee", [None, "", "Ann Lee"], "x")], kb)
    rows = spark.createDataFrame([("Ann Lee", "a"), (None, "b"), (" ", "c"), ("Ann Lee", "d")], "spelling string, entity_id string")
    assert [(r.spelling, r.entity_id) for r in names.resolve(rows, odd).collect()] == [("Ann Lee", "P2")]


def slipped(r, words):
    out = []
    for w in words:
        i, c = r.randrange(len(w)), r.choice("aeirnclmdkt")
        out.append(r.choice([w, w, w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w[:i] + w[i + 1 : i + 2] + w[i] + w[i + 2 :], w[: max(3, i)], w.replace("m", "rn"), w.title()]) or w)
    return " ".join(r.sample(out, len(out)))


def test_peers_connect_all_pairs_of_the_threshold(spark, monkeypatch):
    r = random.Random(5)
    base = [("katherine", "thompson"), ("kate", "thompson"), ("anna-maria", "quistgaard"), ("william", "o-neil", "j"), ("bill", "oneil"), ("wexford", "lanyon", "brewing", "company"), ("zsuzsanna", "ma"), ("johannesvanterpool",), ("johannes", "vanterpool"), ("maria", "vanterpool"), ("gmbh", "sons")]
    texts = sorted({slipped(r, r.choice(base)) for _ in range(260)} | {"GAGT", "G.A.G.T.", "Anna--Maria Quistgaard", "J Sons GmbH", "Sons GmbH"})
    scores = {}
    for i, a in enumerate(texts):
        for b in texts[:i]:
            s = max(names.compare(names.tokens(a), names.tokens(b)), names.compare(names.tokens(b), names.tokens(a)))
            if s >= names.PEERS:
                scores[frozenset((a, b))] = s
    label = {t: t for t in texts}
    changed = True
    while changed:
        changed = False
        for a, b in scores:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    tied = {t for pair in scores for t in pair}
    for share in (50_000, 70):
        monkeypatch.setattr(names, "SHARE", share)
        found = names.peers(spark.createDataFrame([(t,) for t in texts], "spelling string"))
        assert all(abs(scores[frozenset((x.spelling, x.other))] - x.score) < 1e-9 for x in found.collect())
        got = {x.node: x.component for x in names.connected(found.selectExpr("spelling AS a", "other AS b")).collect()}
        assert got == {t: label[t] for t in tied}


def test_a_peer_that_is_neither_next_nor_first_nor_in_the_block(spark):
    kb = spark.createDataFrame([("P1", "Somebody Otherwise", None)], "entity_id string, text string, synonyms array<string>")
    # Bill and William do not sound alike; the others do, and stand in one row where the ones that are alike are apart
    spelt = ["Norbert Lampart", "Norbert Lembarto", "Norbert Lamparti", "Bill Quorrington", "William Quorrington", "Robert Lamprt", "Norbert Lembart"]
    got = {r.spelling: r.component for r in names.clusters(spark.createDataFrame([(s,) for s in spelt], "spelling string"), kb).collect()}
    assert got["Bill Quorrington"] == got["William Quorrington"]
    assert got["Norbert Lembarto"] == got["Norbert Lembart"] and got["Norbert Lampart"] == got["Norbert Lamparti"]


def test_two_hyphens():
    assert names.compare(names.tokens("Anna--Maria Lee"), names.tokens("Johannes Vanterpool")) == 0.0
    assert names.compare(names.tokens("Anna--Maria Lee"), names.tokens("Anna Maria Lee")) > names.PEERS


def test_links_are_all_pairs_that_are_accepted(spark):
    texts = ["Amina Zelele", "Ae Wexfordlanyon", "GAGT", "petronellarasmunder", "Petra Rsmdr"]
    kb = [("P1", "Amina S. Zelondoro-Zelastile", 0), ("O2", "Wexfordlanyon", 0), ("O1", "Gesellschaft Alpine Glaciology Tormann", 0), ("P3", "Petronella Rasmunder", 0), ("P4", "Petra Rasmunder", 1)]
    scores = {(s, e): names.compare(names.tokens(s), names.tokens(n)) * (0.98 if y else 1.0) for s in texts for e, n, y in kb}
    want = {k: v for k, v in scores.items() if v >= names.ACCEPT}
    # these two share no key
    assert ("Ae Wexfordlanyon", "O2") in want and not names.keys(names.tokens("Ae Wexfordlanyon")) & names.keys(names.tokens("Wexfordlanyon"), record=True)
    found = names.links(spark.createDataFrame([(s,) for s in texts], "spelling string"), spark.createDataFrame([(n, e, y) for e, n, y in kb], "name string, entity_id string, synonym int"))
    assert {(r.spelling, r.entity_id): round(r.score, 9) for r in found.collect()} == {k: round(v, 9) for k, v in want.items()}
