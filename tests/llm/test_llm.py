"""Operators of the llm subpackage, against plain versions, round trips and literal cases."""

import random

import numpy as np
import pytest

from lectern.llm import consensus, format_dups, names, packing, sentences, splitting, subjects, tokenize

# --- encoding


@pytest.fixture(scope="module")
def small_leaves():
    return tokenize.Encoder(*tokenize.vocabulary_path(), leaf_chars=61)


def test_encoding_tree_matches_whole(small_leaves):
    r = random.Random(1)
    for _ in range(800):
        t = "".join(r.choice("ab'llts  \n\t\r,.é日 1é 　\x1c\U0001f600") for _ in range(r.randint(0, 700)))
        ids = small_leaves.encode(t)
        assert ids == small_leaves._leaf(t)
        assert small_leaves.decode(ids) == t
    for t in ("a" * 3000, " " * 3000, "\n" * 999, "日" * 2000, "ab " * 1000):
        assert small_leaves.encode(t) == small_leaves._leaf(t)


def test_encoding_table(spark):
    rows = [(1, "Hello world", "x"), (2, "", "x"), (3, None, "x"), (4, "<|endoftext|>", "x"), (5, "w " * 200_000, "x")]
    got = {r.doc_id: r.ids for r in tokenize.encode_column(spark.createDataFrame(rows, "doc_id long, text string, ids string"), "doc_id", "text").collect()}
    assert got[2] == [] and got[3] == [] and got[1] == [15496, 995] and 50256 not in got[4]
    e = tokenize.encoder(*tokenize.vocabulary_path())
    assert e.decode(got[5]) == "w " * 200_000
    assert tokenize.encode_column(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0


# --- packing


@pytest.mark.parametrize("seed", range(3))
def test_plan_is_whole_and_fits(seed):
    r = np.random.default_rng(seed)
    for _ in range(150):
        cap = int(r.integers(2, 60))
        x = r.integers(1, cap + 1, int(r.integers(1, 90)))
        u, c = np.unique(x, return_counts=True)
        p = packing.plan(u, c, cap, groups=int(r.integers(1, 8)))
        load = np.zeros(p.containers, "int64")
        for a, b in zip(u, c):
            np.add.at(load, p.place(np.full(b, a), np.arange(b)), a)
        assert load.max() <= cap and load.min() > 0 and load.sum() == x.sum()


def test_plan_is_close_to_the_bound():
    x = np.clip(np.random.default_rng(0).lognormal(5, 1, 20_000).astype(int), 1, 2048)
    u, c = np.unique(x, return_counts=True)
    assert packing.plan(u, c, 2048).containers <= 1.02 * x.sum() / 2048


@pytest.mark.parametrize("rows_per_lot", [1_000_000, 7])
def test_packing_table(spark, monkeypatch, rows_per_lot):
    monkeypatch.setattr(packing, "ROWS_PER_LOT", rows_per_lot)
    sizes = [(i, n, 0) for i, n in enumerate([0, None, 3, 10, 10, 25, 30, 7, 7, 7] + [4] * 32 + [0] * 8)]
    specs = spark.createDataFrame([(1, 10), (2, 16), (3, None), (4, 0)], "spec_id int, capacity_tokens int")
    rows = packing.pack(spark.createDataFrame(sizes, "doc_id long, n_tokens int, spec_id int"), specs).collect()
    for s, cap in ((1, 10), (2, 16)):
        mine = [r for r in rows if r.spec_id == s]
        load, by = {}, {}
        for r in mine:
            load[r.container] = load.get(r.container, 0) + r.n_tokens
            by.setdefault(r.doc_id, []).append(r)
        assert max(load.values()) <= cap and sorted(by) == list(range(50))
        for i, n, _ in sizes:
            v = sorted(by[i], key=lambda r: r.piece_no)
            assert sum(r.n_tokens for r in v) == (n or 0) and (len(v) == 1 or n > cap)
            assert [r.start_token for r in v] == [k * cap for k in range(len(v))]
    assert {r.spec_id for r in rows} == {1, 2}
    assert packing.pack(spark.createDataFrame([], "doc_id long, n_tokens int"), specs).count() == 0


# --- copies


def test_copies(spark):
    rows = [
        (1, "Site: A\nRef: 12\nDose: 3.5"),
        (2, "dose: 3.5 \n ref: 12\nSITE: a"),
        (3, "Site: 12\nRef: A\nDose: 3.5"),
        (4, '{"site": "A", "ref": "12", "dose": "3,5"}'),
        (5, "One two. Three four."),
        (6, "ONE\ttwo, three FOUR"),
        (7, "Three four. One two."),
        (8, None),
        (9, "  "),
        (10, " "),
        (11, "Straße"),
        (12, "STRASSE"),
        (13, '{"dose":\t"3.5", "ref": "12",\n "site": "A\t"}'),
        (14, "Ref=12 | Site=A | Dose=3.5"),
        (15, "x" * 200_000),
        (16, "X " * 200_000),
        (17, "One two. Three four."),
    ]
    df = spark.createDataFrame([(*r, "k") for r in rows], "id long, text string, k1 string")
    got = sorted((r.id_first, r.id_copy) for r in format_dups.copies(df).collect())
    assert got == [(1, 2), (1, 4), (1, 13), (1, 14), (5, 6), (5, 17), (11, 12), (15, 16)]
    n = {r.id_first: r.n_copies for r in format_dups.groups(df).collect()}
    assert n[1] == 5 and n[5] == 3 and n[3] == 1 and 8 not in n
    assert format_dups.copies(spark.createDataFrame([], "id long, text string")).count() == 0


# --- sentences

CASES = [
    ("Dr. A. Smith paid approx. 5.3 kg. No one knew.", ["Dr. A. Smith paid approx. 5.3 kg.", "No one knew."]),
    ('He asked: "Why? Who?" but left. "Stop!" said Xavier. She wrote: "One. Two." Then it ended.', ['He asked: "Why? Who?" but left.', '"Stop!" said Xavier.', 'She wrote: "One. Two."', "Then it ended."]),
    ("(All is lost.) It (all of it!) ended at 5 p.m. Rain fell.", ["(All is lost.)", "It (all of it!) ended at 5 p.m.", "Rain fell."]),
    ("他说：“走。快走。”真的？！档案编号为5。", ["他说：“走。快走。”", "真的？！", "档案编号为5。"]),
    ("「待て！もう遅い。」と彼は言った。返事はない！", ["「待て！もう遅い。」と彼は言った。", "返事はない！"]),
    ("अब क्या होगा? यह सूची पुरानी है। डॉ. राम आए।", ["अब क्या होगा?", "यह सूची पुरानी है।", "डॉ. राम आए।"]),
    ("Der 24. Versuch, z. B. am 5. Mai, misslang. Er wohnt in der Str. 15. Und dann?", ["Der 24. Versuch, z. B. am 5. Mai, misslang.", "Er wohnt in der Str. 15.", "Und dann?"]),
    ("— Куда? — спросил он. Это 5 тыс. руб., т. е. дорого. Соль и т. д. См. рис. 2.", ["— Куда? — спросил он.", "Это 5 тыс. руб., т. е. дорого.", "Соль и т. д.", "См. рис. 2."]),
    ("ฝนตกหนักมาก เรือออกจาก Karbury เวลา 5.30 น. คุณ Ann มาแล้ว", ["ฝนตกหนักมาก", "เรือออกจาก Karbury เวลา 5.30 น.", "คุณ Ann มาแล้ว"]),
    ("It ended.\n\nSummary of findings\nNo one\nknew it. Name: X\n* first thing\n- second", None),
    ('{"a": "One. Two."}', ['{"a": "One. Two."}']),
    ("no end mark", ["no end mark"]),
    ("Wait... is it? هل وقع؟ لا أحد يعرف!", ["Wait... is it?", "هل وقع؟", "لا أحد يعرف!"]),
]


@pytest.mark.parametrize("text,want", CASES)
def test_sentence_units(text, want):
    got = [text[a:b] for a, b in sentences.units(text)]
    assert "".join("".join(got).split()) == "".join(text.split())
    if want is not None:
        assert got == want


def test_units_cover_any_text():
    r = random.Random(3)
    for _ in range(500):
        t = "".join(r.choice("aB1.?! \n\r\t\"'()“”«»。！…:-—ก日एא é") for _ in range(r.randint(0, 120)))
        at = 0
        for a, b in sentences.units(t):
            assert at <= a < b and not t[at:a].strip() and not t[a].isspace() and not t[b - 1].isspace()
            at = b
        assert not t[at:].strip()


def test_units_table(spark):
    df = spark.createDataFrame([(1, "One. Two."), (2, None), (3, " \n"), (4, "x" * 150_000)], "id long, text string")
    assert sorted(map(tuple, sentences.sentence_units(df).collect())) == [(1, 0, 0, 4), (1, 1, 5, 9), (4, 0, 0, 150_000)]
    assert sentences.sentence_units(spark.createDataFrame([], "id long, text string")).count() == 0


# --- splitting

MODELS = "domain string, model_id string, max_sequence_length int, chunk_overlap int"


@pytest.mark.parametrize("range_chars", [400, 1500, 1 << 20])
def test_pieces(spark, range_chars):
    r = random.Random(2)
    texts = [(i, "d", "".join(r.choice(["word ", "Ende. ", "完了。", "x" * 90, "\n\n", "é"]) for _ in range(r.randint(0, 900)))) for i in range(12)] + [(50, None, "a" * 9000), (51, "d", None), (52, "d", "z" * 5000), (53, "other", "z" * 5000)]
    models = [("d", "m", 120, 20), ("d", "n", 1000, None), ("d", "o", None, 5), ("d", "p", 64, 640), (None, "q", 10, 1), ("d", "m", 120, 20)]
    split = splitting.split_texts(spark.createDataFrame(texts, "id long, domain string, text string"), spark.createDataFrame(models, MODELS), range_chars=range_chars)
    got = {}
    for p in splitting.numbered(split).collect():
        got.setdefault((p.id, p.model_id), []).append((p.piece_no, p.start_char, p.end_char))
    limits = {"m": (120, 20), "n": (1000, 0), "p": (64, 63)}
    want = {(i, m) for i, d, t in texts for m, (most, _) in limits.items() if d == "d" and t and len(t) > most}
    assert set(got) == want
    for (i, m), v in got.items():
        v.sort()
        most, share = limits[m]
        n = len(dict((a, c) for a, _, c in texts)[i])
        assert v[0][1] == 0 and v[-1][2] == n and all(0 < b - a <= most for _, a, b in v)
        assert all(x[2] - y[1] == share for x, y in zip(v, v[1:]))


def test_pieces_end_at_boundaries_and_files(spark, tmp_path):
    t = "One sentence here. " * 40
    assert all(t[:b].endswith(". ") or b == len(t) for _, b in splitting.pieces(t, 100, 0))
    s = "Hello wörld. Ünïcode 日本。「待て」 " * 3000
    (tmp_path / "a.txt").write_text(s)
    (tmp_path / "b.txt").write_text("")
    rows = sorted(map(tuple, splitting.split_files(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")], 500, 30, range_bytes=20_000).collect()))
    v = [r[2:] for r in rows]
    assert v[0][0] == 0 and v[-1][1] == len(s) and all(b - a <= 500 for a, b in v) and all(x[1] - y[0] == 30 for x, y in zip(v, v[1:]))


# --- consensus

REPORT = "doc_id long, model_ord int, ent_ord int, text string, entity_type string, start_char int, end_char int, confidence double, model_id string"


def test_consensus_finds_truth_and_repeaters(spark):
    r = random.Random(5)
    types = ["PERSON", "ORG", "DRUG", "GPE", "CODE"]
    spelt = {0: str.lower, 1: lambda t: "B-" + t, 2: str.title, 3: lambda t: f" {t} ", 4: str.lower, 5: str.upper}
    good = {0: 0.95, 1: 0.9, 2: 0.85, 3: 0.5}
    rows, truth = [], {}
    for doc in range(500):
        for k in range(3):
            t, start = r.choice(types), k * 40
            word = f"w{r.randint(0, 10**9)}"
            end = start + len(word)
            truth[doc, start, end] = t
            wrong = r.choice([x for x in types if x != t])
            for m, p in good.items():
                if r.random() < 0.85:
                    cut = r.random() < 0.05
                    rows.append((doc, m, k, word[: -1 if cut else None], spelt[m](t if r.random() < p else r.choice([x for x in types if x != t])), start, end - cut, 0.9, None))
            copied = t if r.random() < 0.55 else wrong
            for m in (4, 5):
                rows.append((doc, m, k, word, spelt[m](copied), start, end, 0.99, "c"))
    rows += rows[:50]
    rows += [(1, 0, 99, "?", None, None, 3, None, None), (None, 0, 9, "a", "ORG", 0, 1, 0.5, None), (1, 1, 98, "q", "ORG", 900, 900, 0.5, None)]
    found, table = consensus.consensus(spark.createDataFrame(rows, REPORT))
    got = {(x.doc_id, x.start_char, x.end_char): x.entity_type for x in found.collect() if x.n_models >= 2}
    assert sum(got.get(k) == t for k, t in truth.items()) / len(truth) > 0.93
    right = {m: a for m, a, _, _ in table}
    assert right[0] > right[2] > right[3] and abs(right[3] - 0.5) < 0.1 and abs(right[4] - 0.55) < 0.1
    assert [m for m, _, _, rep in table if rep > 0.5] == [4, 5]


def test_consensus_empty(spark):
    found, table = consensus.consensus(spark.createDataFrame([], REPORT))
    assert found.count() == 0 and table == []


# --- names

KB = [("P1", "Chukwudi Nesenuberg", ["C. Nesenuberg"]), ("P2", "Katherine L. Moraysemont", None), ("P3", "Katherine Yarilund", []), ("O1", "Laboratory of Tidal Chemistry Falobernik Incorporated", ["LTCFI"]), ("O2", "Balulkaberg & Rovorbilund Centre S.A.", None), ("P4", "Gabriella Pranaworth", None), ("P5", "Gunter Pranaworth", None)]
SPELT = {
    "NESENUBERG, Chudi": "P1",
    "Dr. C. Nesenuberg": "P1",
    "ChukwudiNesenuberg": "P1",
    "Chukwudi Nesenubrg": "P1",
    "Kate Moraysemont": "P2",
    "Moraysemont, K.": "P2",
    "katherine yarilund": "P3",
    "Lab of Tidal Chem. Falobernik Inc.": "O1",
    "Tidal Chemistry Falobernik, Laboratory": "O1",
    "LTCFI": "O1",
    "Balulkaberg und Rovorbilund Center": "O2",
    "G. Pranaworth": None,
    "Robert Nesenuberg": None,
    "Katherine Somebody": None,
    "Paris": None,
    "": None,
    "...": None,
    "x" * 5000: None,
}


def test_names(spark):
    records = spark.createDataFrame(KB, "entity_id string, text string, synonyms array<string>")
    rows = [(s, 1) for s in SPELT] + [(None, 2), ("katherine yarilund", 3)]
    got = {r.spelling: r.entity_id for r in names.resolve(spark.createDataFrame(rows, "spelling string, entity_id int"), records).collect()}
    assert got == {s: e for s, e in SPELT.items() if e}
    assert names.resolve(spark.createDataFrame([], "spelling string"), records).count() == 0


def test_components(spark):
    e = spark.createDataFrame([("s1", "b", 1.0), ("s1", "c", 1.0), ("s2", "c", 1.0), ("s2", "d", 1.0), ("s3", "e", 1.0)], "spelling string, entity_id string, score double")
    assert {(r.entity_id, r.component) for r in names.components(e).collect()} == {("b", "b"), ("c", "b"), ("d", "b"), ("e", "e")}


def test_distances_match_plain():
    assert names.distance("abcd", "abdc") == 1 and names.distance("kitten", "sitting") == 3 and names.distance("a", "abcdef") == 4
    assert abs(names.jaro_winkler("martha", "marhta") - 0.961111) < 1e-5 and names.jaro_winkler("abc", "xyz") == 0.0


# --- subjects


def _commit(path, words, message="fix", style=0):
    body = "\n".join(f"+    {w}.get({i})" for i, w in enumerate(words))
    head = [f"commit {'a' * 40}\nAuthor: Bond Ledger <b@x.example>\nDate:   2020\n\n    {message}\n", f"From {'b' * 40} Mon Sep 17\nFrom: X\nSubject: [PATCH] {message}\n---", f"changeset:   1:abcdef\nuser:        Y\nsummary:     {message}\n", f"* abcdef12 {message} (Z, 2020-01-01)"][style]
    return f"{head}\ndiff --git a/src/{path}.py b/src/{path}.py\n--- a/src/{path}.py\n+++ b/src/{path}.py\n@@ -1,2 +1,3 @@\n{body}\n"


def test_subjects_on_held_out_documents(spark):
    r = random.Random(4)
    topic = {"law": ["verdict", "statute", "tort", "bailiff", "docket"], "music": ["chord", "tempo", "sonata", "melody", "violin"], "software": ["cache", "queue", "parser", "config", "socket"]}

    def doc():
        kinds = r.choices(list(topic), k=r.choice([1, 1, 2]))
        return "\n".join(_commit(r.choice(topic[k]) + "_io", r.choices(topic[k] + topic["software"][:2], k=8) + (topic[k][:2]), style=r.randint(0, 3)) for k in kinds), set(kinds)

    docs = [(i, *doc()) for i in range(400)]
    rows = [(i, t, "x") for i, t, _ in docs] + [(900, None, "x"), (901, "  ", "x"), (902, "free text", "x"), (903, "y" * 200_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, subject string")
    labels = spark.createDataFrame([(i, s, "a") for i, _, k in docs[:200] for s in k], "doc_id long, subject string, labelled_by string")
    m = subjects.fit(df, labels, spark.createDataFrame([(s,) for s in topic], "subject string"))
    got = {}
    for x in subjects.assign(df, m).collect():
        got.setdefault(x.doc_id, set()).add(x.subject)
    assert sum(got[i] == k for i, _, k in docs[200:]) >= 185
    assert 900 not in got and 901 not in got and got[902] == {"software"} and 903 in got
    none = subjects.fit(df, labels.limit(0), spark.createDataFrame([("law",)], "subject string"))
    assert {x.subject for x in subjects.assign(df.where("doc_id = 902"), none).collect()} <= {"software", "law"}


def test_commits_are_found():
    text = "\n".join(_commit("a_io", ["x"], style=k) for k in range(4))
    assert len(subjects.commits(text)) == 4 and subjects.commits("plain") == ["plain"]
    assert "bond" not in {f.split(":")[1] for f in subjects.describe(_commit("a_io", ["x"]))}
    assert {"cloud", "cover", "io", "cloud_cover"} <= subjects.file_words(_commit("cloud_cover_io", []))
