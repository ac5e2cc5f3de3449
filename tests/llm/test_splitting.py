"""Pieces are the same however a text or a file is cut into ranges."""

import random

import pytest

from lectern.llm import splitting

MODELS = "domain string, model_id string, max_sequence_length int, chunk_overlap int"
PARTS = ["word ", "Ende. ", "完了。", "「待て！」", "x" * 90, "\n\n", "é", "é", "Dr. ", "फिर। ", "\r\n", " " * 70, "Is it? ", "\U0001f600", "क्षि"]


def _text(seed, n=900):
    r = random.Random(seed)
    return "".join(r.choice(PARTS) for _ in range(n))


@pytest.mark.parametrize("seed", range(3))
def test_boundaries_of_ranges_add_up(seed):
    t = _text(seed)
    whole = splitting.boundaries(t)
    for size in (7, 100, 1000):
        parts = [splitting.boundaries(t[max(0, a - splitting.CONTEXT) : a + size + 1], min(a, splitting.CONTEXT), min(a, splitting.CONTEXT) + min(size, len(t) - a)) for a in range(0, len(t), size)]
        starts = [max(0, a - splitting.CONTEXT) for a in range(0, len(t), size)]
        for k in range(4):
            assert [int(x) + s for p, s in zip(parts, starts) for x in p[k]] == whole[k].tolist()


def test_pieces_do_not_depend_on_the_range_size(spark):
    texts = [(i, "d", _text(i)) for i in range(6)] + [(7, "d", "z" * 5000), (8, "d", "́" * 700)]
    df = spark.createDataFrame(texts, "id long, domain string, text string")
    models = spark.createDataFrame([("d", "m", 120, 20), ("d", "n", 1000, None), ("d", "p", 64, 640)], MODELS)
    results = [sorted(map(tuple, splitting.split_texts(df, models, range_chars=size).collect())) for size in (50, 333, 1500, 1 << 20)]
    assert results[0] == results[1] == results[2] == results[3]
    for i, _, t in texts:
        for model, most, share in (("m", 120, 20), ("n", 1000, 0), ("p", 64, 63)):
            assert [r[3:] for r in results[0] if r[:2] == (i, model)] == (splitting.pieces(t, most, share) if len(t) > most else [])


def test_a_combining_mark_stays_with_its_letter():
    t = "x" * 99 + "é" + "y" * 50
    assert splitting.pieces(t, 100, 0)[0] == (0, 99)


def test_files_in_parallel_ranges(spark, tmp_path):
    t = "".join(_text(s, 3000) for s in range(3))
    raw = t.encode()
    broken = raw[:5000] + b"\xff\xe4\xbd" + raw[5000:9000] + b"\x80" * 9 + raw[9000:]
    (tmp_path / "a.txt").write_bytes(raw)
    (tmp_path / "b.txt").write_bytes(broken)
    (tmp_path / "c.txt").write_bytes(b"")
    for size in (1000, 4097, 1 << 20):
        got = {}
        for r in splitting.split_files(spark, [str(tmp_path)], 400, 30, range_bytes=size).collect():
            got.setdefault(r.path.rsplit("/", 1)[1], []).append((r.piece_no, r.start_char, r.end_char))
        assert set(got) == {"a.txt", "b.txt"}
        for name, data in (("a.txt", raw), ("b.txt", broken)):
            assert [x[1:] for x in sorted(got[name])] == splitting.pieces(data.decode("utf-8", "replace"), 400, 30)
