"""Subject areas of documents made of commits.

A document is cut into its commits; each is described by hashed word n-grams of its paths, message and changed lines, kept apart by field
and without people's names. One-versus-rest linear classifiers are trained on commits with weak labels: the words of file names are
matched with subjects by the labelled documents they occur in, and a commit takes the subjects of its paths' words. Thresholds are
calibrated on the given labels, held out from the training fold. A commit above no threshold is about the default subject; a document has
the subjects of its commits.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_SUBJECT = "software"
#: Feature space, and the most labelled documents and commits that the classifiers are fitted on (smallest hashes first).
DIMENSIONS = 1 << 17
MAX_LABELLED = 20_000
MAX_COMMITS = 60_000
MAX_SUBJECTS = 10_000
EPOCHS = 12

_COMMIT = regex.compile(r"^(?=﻿?(?:commit [0-9a-f]{7,40}\b|From [0-9a-f]{40} |changeset:\s+\d+:|\* [0-9a-f]{7,12} |r\d+ \| ))", regex.M)
_HEADER = regex.compile(r"\s*(?:Author|AuthorDate|Commit|CommitDate|Date|From|user|date|branch|tag|parent|changeset|Merge|Signed-off-by|Co-authored-by|Reviewed-by|Acked-by|Tested-by|Cc|Reported-by)\s*:", regex.I)
_PATH = regex.compile(r"(?:diff --git|---|\+\+\+|Index:|rename (?:from|to)|copy (?:from|to)|Binary files) (\S+)")
_WORD = regex.compile(r"\p{Lu}?[\p{Ll}\p{M}]+|\p{Lu}+(?!\p{Ll})|\p{Han}+|[\p{Hiragana}\p{Katakana}]+|\p{Lo}[\p{Lo}\p{M}]*")
_HAN = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
_ONELINE = regex.compile(r"﻿?\* [0-9a-f]{7,12} (.*?)(?: \([^()]*, \d{4}-\d\d-\d\d\))?\s*$")
_SUBJECT_MARK = regex.compile(r"^\s*(?:Subject:\s*(?:\[[^\]]*\])?|summary:)")
_PATH_STARTS = ("di", "--", "++", "In", "re", "co", "Bi")
_COMMENT_MARKS = ("#", "//", "--", "/*", "<!")
_SKIPPED = regex.compile(r"@@|index |new file|deleted file|similarity|GIT binary|literal |delta |old mode|new mode|[A-Za-z][0-9A-Za-z!#$%&()*+;<=>?@^_`{|}~-]{30,}$")


def commits(text: str) -> list[str]:
    """The commits of a document; the whole text if it shows none. Blank parts are left out."""
    return [p for p in _COMMIT.split(text) if p.strip()] or [text]


def _words(s: str) -> list[str]:
    out = []
    for w in _WORD.findall(s):
        if _HAN.match(w):
            out += [w[i : i + 2] for i in range(len(w) - 1)] or [w]
        else:
            out.append(w.lower())
    return out


def file_words(commit: str) -> set[str]:
    """Words of the names of a commit's files, without directories and endings."""
    out = set()
    for line in commit.splitlines():
        if (m := _PATH.match(line)) and m[1] != "/dev/null":
            stem = m[1].rsplit("/", 1)[-1].rsplit(".", 1)[0].lower()
            out |= {w for w in regex.split(r"[^\p{L}]+", stem) if len(w) > 1}
            out.add(stem.rsplit("_", 1)[0])
    return out


def _counted(kind: str, lines: list[str], out: Counter) -> None:
    """Adds the words of lines; each distinct one is split and lowered once."""
    if lines:
        for w, n in Counter(_WORD.findall("\n".join(lines))).items():
            if w[0] > "\u2fff" and _HAN.match(w):
                for x in _words(w):
                    out[kind + x] += n
            else:
                out[kind + w.lower()] += n


def describe(commit: str) -> Counter:
    """Named features of a commit: p: path words, m: message words and pairs, c: changed and n: unchanged code, a: comments."""
    out: Counter = Counter()
    in_hunks = False
    message: list[str] = []
    parts: dict[str, list[str]] = {"p:": [], "c:": [], "n:": [], "a:": []}
    for k, line in enumerate(commit.splitlines()):
        if line[:2] in _PATH_STARTS and (m := _PATH.match(line)):
            in_hunks = True
            parts["p:"].append(m[1].rsplit("/", 1)[-1])
        elif in_hunks:
            sign = line[:1]
            body = line[1:] if sign in "+- " else line
            if body.lstrip()[:2].startswith(_COMMENT_MARKS):
                parts["a:"].append(body)
            elif sign in "+-":
                parts["c:"].append(body)
            elif sign == " ":
                parts["n:"].append(body)
            elif not _SKIPPED.match(line):
                parts["n:"].append(body)
        elif k == 0:
            if m := _ONELINE.match(line):
                message += _words(m[1])
        elif not _HEADER.match(line):
            message += _words(_SUBJECT_MARK.sub("", line))
    for kind, lines in parts.items():
        _counted(kind, lines, out)
    out.update("m:" + w for w in message)
    out.update(f"m:{x} {y}" for x, y in zip(message, message[1:]))
    return out


_slots: dict[str, int] = {}


def _slot(feature: str) -> int:
    s = _slots.get(feature)
    if s is None:
        if len(_slots) > 400_000:
            _slots.clear()
        s = _slots[feature] = zlib.crc32(feature.encode()) % DIMENSIONS
    return s


def vector(commit: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features with damped counts, of length one."""
    f = describe(commit)
    if not f:
        return np.zeros(0, "int32"), np.zeros(0, "float32")
    at = np.fromiter((_slot(k) for k in f), "int32", len(f))
    v = 1 + np.log(np.fromiter(f.values(), "float32", len(f)))
    return at, (v / np.sqrt((v * v).sum())).astype("float32")


@dataclass
class Classifier:
    subjects: list[str]
    weights: np.ndarray = field(repr=False)  # feature, subject
    bias: np.ndarray
    thresholds: np.ndarray

    def scores(self, at: np.ndarray, v: np.ndarray) -> np.ndarray:
        return v @ self.weights[at] + self.bias if len(at) else self.bias.copy()

    def of_document(self, text: str) -> list[str]:
        found = set()
        for c in commits(text):
            s = self.scores(*vector(c)) if self.subjects else self.bias
            above = [x for x, y, t in zip(self.subjects, s, self.thresholds) if y >= t]
            found |= set(above or [DEFAULT_SUBJECT])
        return sorted(found)


def _lexicon(documents: list[tuple[list[set[str]], set[str]]], subjects: list[str]) -> dict[str, str]:
    """Subject of each file-name word: the one whose labelled documents have it most, beyond chance; the default for words of all fields."""
    seen: dict[str, Counter] = defaultdict(Counter)
    base: Counter = Counter()
    for words, labels in documents:
        for s in labels:
            base[s] += 1 / len(labels)
        for w in set().union(*words):
            for s in labels:
                seen[w][s] += 1 / len(labels)
    total = sum(base.values()) or 1
    out = {}
    for w, n in seen.items():
        size = sum(n.values())
        best, much = max(((s, n[s] / size) for s in subjects if n[s]), key=lambda x: (x[1], x[0]), default=("", 0))
        if size >= 2 and much >= 0.5 and much > 2.5 * base[best] / total:
            out[w] = best
        elif size >= 4:
            out[w] = DEFAULT_SUBJECT
    return out


def _train(rows: list[tuple[np.ndarray, np.ndarray]], targets: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """One-versus-rest logistic regression by adaptive gradient steps over small batches."""
    n, k = targets.shape
    w, b = np.zeros((DIMENSIONS, k), "float32"), np.full(k, -2.0, "float32")
    g, gb = np.full((DIMENSIONS, 1), 1e-6, "float32"), np.full(k, 1e-6, "float32")
    order = np.random.default_rng(7)
    sizes = np.array([len(r[0]) for r in rows])
    starts = np.concatenate(([0], np.cumsum(sizes)))
    at = np.concatenate([r[0] for r in rows]) if rows else np.zeros(0, "int32")
    val = np.concatenate([r[1] for r in rows]) if rows else np.zeros(0, "float32")
    for _ in range(epochs):
        perm = order.permutation(n)
        for lo in range(0, n, 64):
            ids = perm[lo : lo + 64]
            ids = ids[sizes[ids] > 0]
            if not len(ids):
                continue
            span = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in ids])
            row = np.repeat(np.arange(len(ids)), sizes[ids])
            a, v = at[span], val[span]
            z = np.zeros((len(ids), k), "float32")
            np.add.at(z, row, w[a] * v[:, None])
            e = 1 / (1 + np.exp(-(z + b))) - targets[ids]
            slots, inverse = np.unique(a, return_inverse=True)
            grad = np.zeros((len(slots), k), "float32")
            np.add.at(grad, inverse, e[row] * v[:, None])
            g[slots] += (grad * grad).sum(axis=1, keepdims=True)
            w[slots] -= 0.4 * grad / np.sqrt(g[slots])
            gb += (e.sum(axis=0)) ** 2
            b -= 0.2 * e.sum(axis=0) / np.sqrt(gb)
    return w, b


def fit(documents: DataFrame, labels: DataFrame, subjects: DataFrame, key: str = "doc_id", text: str = "text") -> Classifier:
    """The classifiers, from at most MAX_LABELLED labelled documents and MAX_COMMITS of their commits; their features go to the driver."""
    spark = documents.sparkSession
    listed = subjects.select("subject").where("subject IS NOT NULL").distinct().limit(MAX_SUBJECTS + 1).collect()
    if len(listed) > MAX_SUBJECTS:
        raise ValueError(f"more than {MAX_SUBJECTS} subjects")
    names = sorted(r[0] for r in listed if r[0] != DEFAULT_SUBJECT)
    if not names:
        return Classifier([], np.zeros((0, 0), "float32"), np.zeros(0), np.zeros(0))
    given = labels.where(f"`{key}` IS NOT NULL AND subject IS NOT NULL").groupBy(F.col(key).alias("doc")).agg(F.sort_array(F.collect_set("subject")).alias("subjects"))
    # at most MAX_LABELLED rows, so the texts need not move to meet them
    given = given.orderBy(F.xxhash64("doc"), "doc").limit(MAX_LABELLED)
    chosen = documents.select(F.col(key).alias("doc"), F.col(text).alias("text")).where("text IS NOT NULL").join(F.broadcast(given), "doc")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {"doc": [], "subjects": [], "words": [], "at": [], "v": []}
            for doc, t, s in zip(b.column("doc").to_pylist(), b.column("text").to_pylist(), b.column("subjects").to_pylist()):
                for c in commits(t) if t.strip() else []:
                    at, v = vector(c)
                    for name, x in (("doc", doc), ("subjects", s), ("words", sorted(file_words(c))), ("at", at.tolist()), ("v", v.tolist())):
                        out[name].append(x)
            types = (pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], names=list(out))

    # one row for each commit, in an order that does not depend on the partitions
    table = chosen.mapInArrow(features, "doc long, subjects array<string>, words array<string>, at array<int>, v array<float>").orderBy(F.xxhash64("doc"), "doc").limit(MAX_COMMITS).toArrow()
    docs, first = table.column("doc").to_pylist(), {}
    said, words = table.column("subjects").to_pylist(), [set(w) for w in table.column("words").to_pylist()]
    at, v = (table.column(c).combine_chunks() for c in ("at", "v"))
    ends = at.offsets.to_numpy()
    rows = [(at.values.to_numpy()[a:b], v.values.to_numpy()[a:b]) for a, b in zip(ends, ends[1:])]
    for i, d in enumerate(docs):
        first.setdefault(d, []).append(i)
    groups = list(first.values())

    def weak(part: list[list[int]]) -> tuple[list[int], np.ndarray]:
        """Commits with weak labels: the subjects of their paths' words; without any, the one their code is full of; none of either."""
        lexicon = _lexicon([([words[i] for i in g], set(said[g[0]])) for g in part], names)
        # a word of the message tells as much as three of the code
        slots = {_slot(kind + x): (names.index(s), weight) for w, s in lexicon.items() if s != DEFAULT_SUBJECT for x in w.split("_") for kind, weight in (("c:", 1), ("n:", 1), ("a:", 1), ("m:", 3))}
        ids, target = [], []
        for g in part:
            for i in g:
                about = {names.index(lexicon[w]) for w in words[i] if lexicon.get(w, DEFAULT_SUBJECT) != DEFAULT_SUBJECT}
                if not about:
                    inside: Counter = Counter()
                    for a in rows[i][0].tolist():
                        if a in slots:
                            inside[slots[a][0]] += slots[a][1]
                    if inside:
                        top, much = inside.most_common(1)[0]
                        if much >= 3 and much >= 0.7 * sum(inside.values()):
                            about = {top}
                        elif sum(inside.values()) > 1:
                            continue
                ids.append(i)
                target.append([float(n in about) for n in range(len(names))])
        return ids, np.array(target, "float32").reshape(len(ids), len(names))

    # thresholds: each half of the labelled documents scored by classifiers of the other half
    halves = [groups[0::2], groups[1::2]]
    scored: list[tuple[np.ndarray, set[str]]] = []
    for a, b in ((0, 1), (1, 0)):
        ids, target = weak(halves[a])
        w, bias = _train([rows[i] for i in ids], target)
        m = Classifier(names, w, bias, np.zeros(len(names)))
        scored += [(np.array([m.scores(*rows[i]) for i in g]).max(axis=0), set(said[g[0]])) for g in halves[b]]
    thresholds = np.array([_threshold([(s[k], n in t) for s, t in scored]) for k, n in enumerate(names)])
    ids, target = weak(groups)
    w, bias = _train([rows[i] for i in ids], target)
    # a commit without a telling feature scores the bias, which has to stay below
    return Classifier(names, w, bias, np.maximum(thresholds, bias + 0.25))


def _threshold(scored: list[tuple[float, bool]]) -> float:
    """Where F1 against the labels is best, in the middle of the gap; 0 without labels of the subject."""
    order = sorted(scored, key=lambda x: -x[0])
    total = sum(y for _, y in order)
    best, at, hits = 0.0, 0.0, 0
    for i, (s, y) in enumerate(order):
        hits += y
        f = 2 * hits / (i + 1 + total) if total else 0.0
        if f > best:
            best, at = f, (s + order[i + 1][0]) / 2 if i + 1 < len(order) else s
    return at if total >= 5 else 0.0


def assign(documents: DataFrame, classifier: Classifier, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, subject): at least one row for each document with a non-blank text, over whole texts.

    Defined cases: null and blank texts have no rows; a text that shows no commit counts as one; a commit above no threshold, or without
    any feature, is about DEFAULT_SUBJECT; without labels all documents are.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            ids, out = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                t = t.as_py()
                if t and not t.isspace():
                    found = m.of_document(t)
                    ids += [i] * len(found)
                    out += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], names=["doc_id", "subject"])

    return documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).where("text IS NOT NULL").mapInArrow(run, "doc_id long, subject string")
