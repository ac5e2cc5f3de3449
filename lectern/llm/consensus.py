"""Consensus of several annotators' labelled spans: minimax conditional entropy over label patterns.

Mentions are built from overlapping spans: of each run of overlapping spans the one with most votes is a mention, together with all that
overlap it; what lies wholly left or right of it is cut in the same way, until nothing is left. Each mention gives a pattern: for every
annotator the type it gave, nothing (it worked on the text but passed the mention over), or no opinion. Mentions with the same pattern are
the same item, so the model is fitted on distinct patterns with counts.

Annotator w labels an item i of class c as k with probability proportional to exp(tau_i(c, k) + sigma_w(c, k)). The dual of the minimax
conditional entropy problem, with its regularisation, is maximised block by block: the posteriors of the classes, the items' tilting
parameters and the annotators' ones in turn, the others held fixed. Steps are gradients over curvatures, and a step that would lower the
objective is halved, so it never falls; rounds go on until it rises by less than a share TOLERANCE of itself. The driver holds annotator
parameters only.

Annotators that repeat each other are found by pairwise agreement beyond what their accuracies allow, and share one vote where they agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.arrays import let
from lectern.session import cut, lanes

CLASSES = ("NONE", "PERSON", "ORG", "DRUG", "GPE", "CODE")
# Ways in which annotators write the types.
TYPE_NAMES = {
    "PERSON": ("PERSON", "PER", "PERSON NAME", "PERSONNAME", "HUMAN", "NAME"),
    "ORG": ("ORG", "ORGANIZATION", "ORGANISATION", "COMPANY", "INSTITUTION", "CORP"),
    "DRUG": ("DRUG", "CHEM", "CHEMICAL", "MEDICATION", "MEDICINE", "MED"),
    "GPE": ("GPE", "LOC", "LOCATION", "PLACE", "CITY", "GEO"),
    "CODE": ("CODE", "ID", "IDENTIFIER", "NUMBER", "REF", "REFERENCE"),
}
#: Annotators up to which their list is held by the driver; more raise an error.
MAX_MODELS = 10_000
ITEM_PENALTY = 4.0
ANNOTATOR_PENALTY = 2.0
#: The fit ends when a round raises the objective by less than this share of it; the bound on rounds raises an error if it is ever met.
TOLERANCE, MAX_ROUNDS = 1e-3, 200
#: Steps of the items' parameters within a round.
ITEM_STEPS = 3
#: Distinct patterns for each task of the fit.
PATTERNS_PER_TASK = 20_000
#: Characters of a stretch of text in which reports are put in order by one task.
STRETCH = 4096
#: Votes that a span loses for each end within a word, or on white space or a mark that belongs to no name.
BAD_END = 1.5
#: How far the same wording elsewhere, and the same first or last word elsewhere, count towards a mention's type.
WHOLE_WEIGHT, WORD_WEIGHT = 0.7, 0.4


def type_index(raw: Column) -> Column:
    """Index into CLASSES of a type as an annotator writes it; null if it is none of them."""
    t = F.regexp_replace(F.upper(F.trim(raw)), "^[BI]-", "")
    t = F.regexp_replace(t, r"[\s_-]+", " ")
    out = F.when(F.lit(False), F.lit(0))
    for i, name in enumerate(CLASSES):
        if name in TYPE_NAMES:
            out = out.when(t.isin(*TYPE_NAMES[name]), F.lit(i))
    return out


def _islands(r: DataFrame) -> DataFrame:
    """r (doc_id, start, end, model, ...) with island, the first start of the run of overlapping spans that a row belongs to, and active, a
    digit for each annotator: 1 if it reported anything in the document.

    In two levels, so that no task orders all reports of a document: within stretches of its text, then over one row for each stretch.
    """
    r = r.withColumn("stretch", F.floor(F.col("start") / STRETCH))
    # frames by value: reports that begin at the same place are alike, in whatever order they come
    w = Window.partitionBy("doc_id", "stretch").orderBy("start")
    # read for both levels; without the cut each reading orders all reports again
    r = cut(r.withColumn("reach", F.max("end").over(w.rangeBetween(Window.unboundedPreceding, -1))))
    doc = Window.partitionBy("doc_id")
    v = doc.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    ends = r.groupBy("doc_id", "stretch").agg(F.max("end").alias("end"), F.collect_set("model").alias("models"))
    there = F.array_distinct(F.flatten(F.collect_list("models").over(doc)))
    digits = F.array_join(F.transform(F.sequence(F.lit(0), F.array_max(there)), lambda m: F.when(F.array_contains(there, m), "1").otherwise("0")), "")
    ends = ends.select("doc_id", "stretch", F.max("end").over(v).alias("reach_0"), digits.alias("active"))
    r = r.join(ends, ["doc_id", "stretch"])
    opens = F.coalesce(F.col("start") >= F.greatest("reach", "reach_0"), F.lit(True))
    r = r.withColumn("opened", F.when(opens, F.col("start")))
    last = r.groupBy("doc_id", "stretch").agg(F.max("opened").alias("opened")).select("doc_id", "stretch", F.max("opened").over(v).alias("own_0"))
    own = F.max("opened").over(w.rangeBetween(Window.unboundedPreceding, 0))
    return r.withColumn("own", own).join(last, ["doc_id", "stretch"]).withColumn("island", F.coalesce("own", "own_0")).drop("stretch", "reach", "reach_0", "opened", "own", "own_0")


def _split(said: Column) -> Column:
    """The mentions of an island, each as an array of reports: those that overlap the span with most votes (the longer one, the earlier one
    of equals), then the same for what is left on either side, which meets no report of the other side."""
    spans = F.array_distinct(F.transform(said, lambda x: F.struct(x["start"].alias("s"), x["end"].alias("e"))))
    votes = lambda p: F.size(F.array_distinct(F.transform(F.filter(said, lambda x: (x["start"] == p["s"]) & (x["end"] == p["e"])), lambda x: F.struct(x["model"], x["label"]))))
    ranked = F.array_sort(F.transform(spans, lambda p: F.struct((-votes(p)).alias("v"), (p["s"] - p["e"]).alias("l"), p["s"].alias("s"), p["e"].alias("e"))))
    none = F.expr("cast(array() as array<struct<v:int,l:int,s:int,e:int>>)")
    meets = lambda p, a, b: (p["s"] < b) & (a < p["e"])
    chosen = F.aggregate(ranked, none, lambda acc, p: F.when(F.exists(acc, lambda q: meets(q, p["s"], p["e"])), acc).otherwise(F.concat(acc, F.array(p))))
    first = lambda all_, x: F.get(F.filter(all_, lambda q: meets(q, x["start"], x["end"])), F.lit(0))
    cut = let(chosen, lambda all_: F.transform(all_, lambda p: F.filter(said, lambda x: first(all_, x) == p)))
    return F.when(F.size(spans) == 1, F.array(said)).otherwise(cut)


def mentions(df: DataFrame) -> tuple[DataFrame, list[int]]:
    """(doc_id, pattern, said) of each mention, and the annotators in the order of the pattern's places.

    said lists what each annotator reported: model (its place), label, confidence, start, end, text. Repeated reports count once; rows with
    null document, model or span, or an empty span, are left out; a type that is none of the known ones is a report without a type.
    """
    rows = df.where("doc_id IS NOT NULL AND model_ord IS NOT NULL AND start_char < end_char")
    models = [r[0] for r in rows.select("model_ord").distinct().limit(MAX_MODELS + 1).collect()]
    if len(models) > MAX_MODELS:
        raise ValueError(f"more than {MAX_MODELS} annotators")
    models.sort()
    places = F.array(*map(F.lit, models)) if models else F.array(F.lit(0))
    place = (F.array_position(places, F.col("model_ord")) - 1).cast("int")
    r = rows.select(F.col("doc_id").cast("long").alias("doc_id"), place.alias("model"), type_index(F.col("entity_type")).alias("label"), F.coalesce("confidence", F.lit(0.5)).alias("confidence"), F.col("start_char").alias("start"), F.col("end_char").alias("end"), "text")
    # all but one copy of a report go before the shuffle
    r = r.groupBy("doc_id", "model", "start", "end", "label", "text").agg(F.max("confidence").alias("confidence"))
    said = F.array_sort(F.collect_list(F.struct("model", "label", "confidence", "start", "end", "text")))
    islands = _islands(r).repartition(lanes(df.sparkSession), "doc_id", "island").groupBy("doc_id", "island").agg(said.alias("said"), F.first("active").alias("active"))
    items = islands.select("doc_id", "active", F.explode(_split(F.col("said"))).alias("said"))

    def label(m: Column) -> Column:
        """What annotator m says: its surest type, - without a type or an opinion, 0 if it passed the mention over."""
        own = F.filter("said", lambda s: s["model"] == m)
        typed = F.transform(F.filter(own, lambda s: s["label"].isNotNull()), lambda s: F.struct(s["confidence"], s["label"]))
        surest = F.get(F.sort_array(typed, asc=False), F.lit(0))["label"].cast("string")
        return F.coalesce(surest, F.when((F.size(own) == 0) & (F.substring(F.col("active"), m + 1, F.lit(1)) == "1"), "0"), F.lit("-"))

    spoken = F.transform(F.sequence(F.lit(0), F.lit(max(len(models) - 1, 0))), label)
    return items.select("doc_id", F.array_join(spoken, "").alias("pattern"), "said"), models


def _matrix(patterns: list[str], n: int) -> np.ndarray:
    """Labels by pattern and annotator; -1 where there is no opinion."""
    raw = np.frombuffer("".join(patterns).encode("ascii"), "uint8").reshape(len(patterns), n).astype("int16")
    return np.where(raw == ord("-"), -1, raw - ord("0"))


@dataclass
class Model:
    sigma: np.ndarray  # annotator, true class, label
    prior: np.ndarray
    repeats: np.ndarray  # how far annotator v only repeats annotator w


def _weights(z: np.ndarray, repeats: np.ndarray) -> np.ndarray:
    """Share of a vote of each annotator on each item: those that repeat each other share one where they agree."""
    n, k = z.shape
    crowd = np.ones((n, k))
    for w, v in np.argwhere(repeats > 0):
        crowd[:, w] += repeats[w, v] * ((z[:, w] == z[:, v]) & (z[:, w] >= 0))
    return np.where(z >= 0, 1 / crowd, 0.0)


def _factors(tau: np.ndarray, sigma: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """exp(tau), exp(sigma) and the normalisers (item, annotator, class): exponentials of sums are products, so no array over all four is made."""
    et, es = np.exp(tau), np.exp(sigma)
    z = np.stack([et[:, c] @ es[:, c].T for c in range(tau.shape[1])], axis=2)
    return et, es, z


def _chosen(z: np.ndarray, tau: np.ndarray, sigma: np.ndarray, norm: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Log-likelihood of each item's labels under each class, each annotator by its share."""
    i = np.arange(len(z))[:, None]
    label = np.maximum(z, 0)
    t = tau[i, :, label]  # item, annotator, class
    s = sigma[np.arange(z.shape[1])[None], :, label]
    return ((t + s - np.log(norm)) * share[:, :, None]).sum(axis=1)


def _said_sums(z: np.ndarray, weight: np.ndarray, c: int) -> np.ndarray:
    """Sum of the annotators' weights for each item and label."""
    out = np.zeros((len(z), c))
    i, w = np.nonzero(z >= 0)
    np.add.at(out, (i, z[i, w]), weight[i, w])
    return out


def posteriors(z: np.ndarray, model: Model, steps: int = ITEM_STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of the classes, the items' tilting parameters, the annotators' shares of a vote, and each item's part of the objective.

    Posteriors and item parameters are raised in turn; the curvature of a softmax is at most half its weight in each direction.
    """
    n, c = len(z), len(CLASSES)
    share = _weights(z, model.repeats)
    tau = np.zeros((n, c, c))
    said = _said_sums(z, share, c)
    weight = share.sum(axis=1)
    log_prior = np.log(model.prior)
    for r in range(steps + 1):
        et, es, norm = _factors(tau, model.sigma)
        score = log_prior[None] + _chosen(z, tau, model.sigma, norm, share)
        top = score.max(axis=1, keepdims=True)
        q = np.exp(score - top)
        total = q.sum(axis=1, keepdims=True)
        q /= total
        if r == steps:
            break
        ratio = share[:, :, None] / norm
        want = np.stack([et[:, k] * (ratio[:, :, k] @ es[:, k]) for k in range(c)], axis=1)
        slope = q[:, :, None] * (said[:, None, :] - want) - ITEM_PENALTY * tau
        tau += slope / (0.5 * q * weight[:, None] + ITEM_PENALTY)[:, :, None]
    # the posteriors are the best for these parameters, so likelihood and entropy together are the logarithm of the sum
    value = (top + np.log(total))[:, 0] - 0.5 * ITEM_PENALTY * (tau**2).sum(axis=(1, 2))
    return q, tau, share, value


def _start(agree: np.ndarray, both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Accuracies and repetition from how often pairs agree: independent annotators agree about as the product of their skills."""
    k = len(agree)
    base = 1 / (len(CLASSES) - 1)
    rate = np.where(both > 0, agree / np.maximum(both, 1), np.nan)
    skill_pair = np.clip((rate - base) / (1 - base), 0.02, 0.999)
    log = np.log(skill_pair)
    use = (both > 0) & ~np.eye(k, dtype=bool)
    # two others u, v that work alone give w's skill: agreement with each, over that of the two; the median passes over those that repeat
    t = np.full(k, np.log(0.8))
    for w in range(k):
        others = [u for u in range(k) if use[w, u]]
        seen = [(log[w, u] + log[w, v] - log[u, v]) / 2 for i, u in enumerate(others) for v in others[i + 1 :] if use[u, v]]
        if seen:
            t[w] = min(np.log(0.98), np.median(seen))
    expected = base + (1 - base) * np.exp(np.minimum(t[:, None] + t[None, :], 0))
    chance = np.sqrt(expected * (1 - expected) / np.maximum(both, 1))
    drop = use & (rate - expected > 0.05 + 3 * chance)
    together = np.exp(np.minimum(t[:, None] + t[None, :], 0))
    repeats = np.where(drop, np.clip((skill_pair - together) / (1 - together), 0, 1), 0)
    repeats[repeats < 0.25] = 0
    skill = np.exp(t)
    return np.clip(skill * (1 - base) + base, 0.3, 0.99), repeats


def _first_model(accuracy: np.ndarray, repeats: np.ndarray, miss: np.ndarray) -> Model:
    k, c = len(accuracy), len(CLASSES)
    p = np.zeros((k, c, c))
    for w in range(k):
        p[w] = (1 - accuracy[w]) * (1 - miss[w]) / (c - 2)
        for t in range(1, c):
            p[w, t, t] = accuracy[w] * (1 - miss[w])
        p[w, :, 0] = miss[w]
        p[w, 0, :] = 0.05 / (c - 1)
        p[w, 0, 0] = 0.95
    prior = np.array([0.15] + [0.85 / (c - 1)] * (c - 1))
    return Model(np.log(p + 1e-6), prior, repeats)


_STATS = "kind string, values array<double>"


def _sum(patterns: DataFrame, fn) -> dict[str, np.ndarray]:
    """Sums of arrays over all patterns: each task gives one row for each array; the driver adds as many rows as there are tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                s = b.slice(lo, 4096)
                for kind, v in fn(s.column("pattern").to_pylist(), s.column("n").to_numpy().astype(float)).items():
                    total[kind] = total.get(kind, 0) + v
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([v.ravel().tolist() for v in total.values()], pa.list_(pa.float64()))], names=["kind", "values"])

    out: dict[str, np.ndarray] = {}
    for r in patterns.mapInArrow(run, _STATS).collect():
        out[r["kind"]] = out.get(r["kind"], 0) + np.array(r["values"])
    return out


def fit(patterns: DataFrame, k: int) -> tuple[Model, list[float]]:
    """The model of all patterns (pattern, n), k annotators; and the objective after each round, which never falls."""
    c = len(CLASSES)

    def pairs(p: list[str], n: np.ndarray) -> dict[str, np.ndarray]:
        z = _matrix(p, k)
        agree, both = np.zeros((k, k)), np.zeros((k, k))
        for w in range(k):
            typed = (z[:, w : w + 1] > 0) & (z > 0)
            both[w] = (typed * n[:, None]).sum(axis=0)
            agree[w] = ((typed & (z == z[:, w : w + 1])) * n[:, None]).sum(axis=0)
        seen = (z > 0).sum(axis=1) > 1
        return {"agree": agree, "both": both, "missed": ((z == 0) & seen[:, None]).T @ n, "active": ((z >= 0) & seen[:, None]).T @ n}

    s = _sum(patterns, pairs)
    if not s:
        return Model(np.zeros((k, c, c)), np.full(c, 1 / c), np.zeros((k, k))), []
    accuracy, repeats = _start(s["agree"].reshape(k, k), s["both"].reshape(k, k))
    model = _first_model(accuracy, repeats, np.clip(s["missed"] / np.maximum(s["active"], 1), 0.02, 0.6))
    values: list[float] = []
    best, size, tried = (model, np.zeros_like(model.sigma), model.prior), 1.0, 0
    while True:

        def expected(p: list[str], n: np.ndarray, model: Model = model) -> dict[str, np.ndarray]:
            z = _matrix(p, k)
            q, tau, share, value = posteriors(z, model)
            mass = n[:, None, None] * share[:, :, None] * q[:, None, :]
            et, es, norm = _factors(tau, model.sigma)
            got = np.zeros((k, c, c))
            i, w = np.nonzero(z >= 0)
            for cls in range(c):
                np.add.at(got[:, cls], (w, z[i, w]), mass[i, w, cls])
            want = np.stack([es[:, cls] * ((mass[:, :, cls] / norm[:, :, cls]).T @ et[:, cls]) for cls in range(c)], axis=1)
            square = np.stack([es[:, cls] ** 2 * ((mass[:, :, cls] / norm[:, :, cls] ** 2).T @ et[:, cls] ** 2) for cls in range(c)], axis=1)
            return {"got": got, "want": want, "curve": want - square, "prior": (q * n[:, None]).sum(axis=0), "value": np.array([value @ n])}

        t = _sum(patterns, expected)
        got, want, curve = (t[x].reshape(k, c, c) for x in ("got", "want", "curve"))
        value = float(t["value"][0] - 0.5 * ANNOTATOR_PENALTY * (model.sigma**2).sum() + np.log(model.prior).sum())
        tried += 1
        if tried > MAX_ROUNDS:
            raise RuntimeError(f"the fit did not settle in {MAX_ROUNDS} rounds")
        if values and value < values[-1]:
            # too far: half the way, from where it stood
            size /= 2
            if size < 1 / 64:
                return best[0], values
            model = Model(best[0].sigma + size * best[1], best[0].prior + size * (best[2] - best[0].prior), repeats)
            continue
        values.append(value)
        if len(values) > 1 and values[-1] - values[-2] <= TOLERANCE * abs(values[-2]):
            return model, values
        step = (got - want - ANNOTATOR_PENALTY * model.sigma) / (curve + ANNOTATOR_PENALTY)
        prior = t["prior"] + 1
        best, size = (model, np.clip(step, -2, 2), prior / prior.sum()), 1.0
        model = Model(model.sigma + best[1], best[2], repeats)


def _span(said: list[tuple[int, int, int, str | None]], share: dict[int, float], skill: np.ndarray) -> tuple[int, int]:
    """The span of the reports (model, start, end, text) with most votes, after votes for bad ends are taken off."""
    votes: dict[tuple[int, int], float] = {}
    texts: dict[tuple[int, int], str] = {}
    voted: set[tuple[int, int, int]] = set()
    for model, start, end, text in said:
        at = (start, end)
        if (model, start, end) not in voted:
            voted.add((model, start, end))
            votes[at] = votes.get(at, 0.0) + share.get(model, 1.0) * skill[model]
        texts[at] = text or ""
    if len(votes) == 1:
        return next(iter(votes))
    chars: dict[int, str] = {}
    for (a, _), t in texts.items():
        for i, ch in enumerate(t):
            chars[a + i] = ch
    for (a, b), t in texts.items():
        bad = 0.0
        first, last = t[:1], t[-1:]
        bad += BAD_END * (not first.isalnum() and first not in "(\"'“«")
        bad += BAD_END * (last.isspace() or last in ",;:!?…。，、")
        bad += BAD_END * (chars.get(a - 1, " ").isalnum() and first.isalnum() and chars.get(a - 1, " ").isascii() == first.isascii())
        bad += BAD_END * (chars.get(b, " ").isalnum() and last.isalnum() and chars.get(b, " ").isascii() and last.isascii())
        votes[(a, b)] -= bad
    return max(votes, key=lambda x: (votes[x], x[1] - x[0], -x[0]))


def resolve(items: DataFrame, model: Model, k: int) -> DataFrame:
    """(doc_id, start_char, end_char, text, n_models, typed, q) of each mention: its span, votes by class, and the classes' posterior."""
    skill = reliability(model)
    schema = "doc_id long, start_char int, end_char int, text string, n_models int, typed array<int>, q array<double>"
    spans = F.size(F.array_distinct(F.transform("said", lambda x: F.struct(x["start"], x["end"]))))
    # where all give the same span there is nothing to choose, and the reports stay in the JVM
    d = items.select(
        "doc_id",
        "pattern",
        F.size(F.array_distinct(F.transform("said", lambda x: x["model"]))).alias("n_models"),
        F.get("said", F.lit(0))["start"].alias("start"),
        F.get("said", F.lit(0))["end"].alias("end"),
        F.get("said", F.lit(0))["text"].alias("text"),
        F.when(spans > 1, F.transform("said", lambda x: F.struct(x["model"], x["start"], x["end"], x["text"]))).alias("said"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            coded = b.column("pattern").dictionary_encode()
            distinct, of = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
            q, share, typed = [], [], []
            for lo in range(0, len(distinct), 4096):
                z = _matrix(distinct[lo : lo + 4096], k)
                a, _, s, _ = posteriors(z, model)
                q.append(a)
                share.append(s)
                typed.append((z[:, :, None] == np.arange(len(CLASSES))).sum(axis=1))
            qs, shares, counts = np.concatenate(q)[of], np.concatenate(share), np.concatenate(typed)[of]
            start, end = b.column("start").to_numpy().copy(), b.column("end").to_numpy().copy()
            text = b.column("text").to_pylist()
            said = b.column("said")
            for i in np.flatnonzero(said.is_valid().to_numpy(zero_copy_only=False)):
                reports = [tuple(x.values()) for x in said[int(i)].as_py()]
                row = shares[of[i]]
                start[i], end[i] = _span(reports, {m: float(row[m]) or 1.0 for m, *_ in reports}, skill)
                text[i] = next(t for _, s, e, t in reports if (s, e) == (start[i], end[i]))
            offsets = pa.array(np.arange(b.num_rows + 1) * len(CLASSES), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(text, pa.string()), b.column("n_models"), pa.ListArray.from_arrays(offsets, pa.array(counts.ravel().astype("int32"))), pa.ListArray.from_arrays(offsets, pa.array(qs.ravel()))],
                names=["doc_id", "start_char", "end_char", "text", "n_models", "typed", "q"],
            )

    return d.mapInArrow(run, schema)


def pooled(resolved: DataFrame, model: Model) -> DataFrame:
    """(doc_id, start_char, end_char, entity_type, n_models, agreement, certainty) of each mention; entity_type NONE where it is none.

    The prior of a mention's class comes from all other mentions with the same wording, first word or last word (digits alike, initials
    alike), whose posteriors are summed by wording before anything is joined.
    """
    c = len(CLASSES)
    prior = [float(x) for x in model.prior]
    word = F.regexp_replace(F.lower(F.trim(F.coalesce("text", F.lit("")))), r"\p{N}", "9")
    words = F.transform(F.split(word, r"[\s,]+"), lambda x: F.when(F.length(F.regexp_replace(x, r"\.", "")) <= 1, F.lit("#")).otherwise(x))
    keys = F.array(
        F.struct(F.concat(F.lit("w:"), word).alias("key"), F.lit(WHOLE_WEIGHT).alias("weight")),
        F.struct(F.concat(F.lit("a:"), F.element_at(words, 1)).alias("key"), F.lit(WORD_WEIGHT).alias("weight")),
        F.struct(F.concat(F.lit("z:"), F.element_at(words, -1)).alias("key"), F.lit(WORD_WEIGHT).alias("weight")),
    )
    lines = resolved.select("doc_id", "start_char", "end_char", "q", F.explode(keys).alias("k")).select("doc_id", "start_char", "end_char", "q", "k.key", "k.weight")
    sums = lines.groupBy("key").agg(*(F.sum(F.col("q")[i]).alias(f"s{i}") for i in range(c)))
    own = [F.greatest(F.col(f"s{i}") - F.col("q")[i], F.lit(0.0)) for i in range(c)]
    n = sum(own[1:], own[0])
    tilt = [F.col("weight") * F.log((own[i] + F.lit(prior[i])) / (n + 1) / F.lit(prior[i])) for i in range(c)]
    tilted = lines.join(sums, "key").groupBy("doc_id", "start_char", "end_char").agg(*(F.sum(tilt[i]).alias(f"t{i}") for i in range(c)))
    all_ = resolved.join(tilted, ["doc_id", "start_char", "end_char"])
    return decided(all_, [F.log(F.greatest(F.col("q")[i], F.lit(1e-12))) + F.col(f"t{i}") for i in range(c)])


def decided(mentions_: DataFrame, score: list[Column]) -> DataFrame:
    """The class with the highest score of each mention, its certainty, and the share of typed reports that agree with it."""
    c = len(CLASSES)
    top = F.greatest(*score)
    chance = [F.exp(x - top) for x in score]
    best = F.when(F.lit(False), F.lit(0))
    for i in range(c):
        best = best.when(score[i] == top, F.lit(i))
    said = F.aggregate(F.slice("typed", 2, c - 1), F.lit(0), lambda x, y: x + y)
    return mentions_.select(
        "doc_id",
        "start_char",
        "end_char",
        F.element_at(F.array(*(F.lit(x) for x in CLASSES)), best + 1).alias("entity_type"),
        "n_models",
        F.when(said > 0, F.when(best > 0, F.element_at("typed", best + 1) / said).otherwise(F.lit(0.0))).otherwise(F.lit(0.0)).alias("agreement"),
        (F.lit(1.0) / sum(chance[1:], chance[0])).alias("certainty"),
    )


def reliability(model: Model) -> np.ndarray:
    """Chance of each annotator to give a mention its true type when it reports the mention."""
    p = np.exp(model.sigma - model.sigma.max(axis=2, keepdims=True))
    p /= p.sum(axis=2, keepdims=True)
    typed = p[:, 1:, 1:]
    right = np.einsum("kcc->kc", typed) / np.maximum(typed.sum(axis=2), 1e-9)
    share = model.prior[1:] / model.prior[1:].sum()
    return right @ share


def consensus(df: DataFrame, wording: bool = True) -> tuple[DataFrame, list[tuple[int, float, float, float]]]:
    """Mentions with consensus types, and for each annotator (model_ord, chance to be right, share of mentions found, largest repetition).

    With wording, a mention's class is weighed with what other mentions of the same wording are, an addition to the fitted model; without,
    the model alone decides. An empty table gives no rows. Other columns are ignored.
    """
    items, models = mentions(df)
    if not models:
        return df.sparkSession.createDataFrame([], "doc_id long, start_char int, end_char int, entity_type string, n_models int, agreement double, certainty double"), []
    items = cut(items)
    patterns = items.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    # every round is a pass over the patterns: a few tasks with much to do each
    patterns = cut(patterns.repartition(min(lanes(df.sparkSession), 1 + items.select("pattern").agg(F.approx_count_distinct("pattern")).first()[0] // PATTERNS_PER_TASK)))
    model, _ = fit(patterns, len(models))
    p = np.exp(model.sigma - model.sigma.max(axis=2, keepdims=True))
    p /= p.sum(axis=2, keepdims=True)
    found = ((1 - p[:, 1:, 0]) * (model.prior[1:] / model.prior[1:].sum())).sum(axis=1)
    right = reliability(model)
    table = [(m, float(right[i]), float(found[i]), float(model.repeats[i].max())) for i, m in enumerate(models)]
    resolved = resolve(items, model, len(models))
    return (pooled(cut(resolved), model) if wording else decided(resolved, [F.log(F.greatest(F.col("q")[i], F.lit(1e-12))) for i in range(len(CLASSES))])), table
