"""Filling containers of fixed capacity with items, by linear grouping on a histogram of sizes.

The driver sees only how many items of each size there are, which the capacity bounds, and plans in runs ("items of size s with ranks
a..b go one, two, ... at a time to the containers from c on"); the items look their container up by size and rank. Nothing that the
driver holds grows with the number of items.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

GROUPS = 48
#: Items above this share of the capacity are large.
LARGE_SHARE = 1 / 8
#: Items of one size that one task numbers; a size of more is cut into lots of about so many.
ROWS_PER_LOT = 1_000_000
MAX_SPECS = 1000
_SHIFT = 40


@dataclass
class Plan:
    """Runs sorted by (size, rank): the item with rank r of a run goes to container first + (r - rank) // per."""

    size: np.ndarray
    rank: np.ndarray
    first: np.ndarray
    per: np.ndarray
    containers: int

    def place(self, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
        if not self.containers:
            return np.zeros(len(size), "int64")
        key = (self.size.astype("int64") << _SHIFT) + self.rank
        at = np.clip(np.searchsorted(key, (size.astype("int64") << _SHIFT) + rank, side="right") - 1, 0, None)
        planned = self.first[at] + (rank - self.rank[at]) // self.per[at]
        return np.where(size > 0, planned, rank % self.containers)


def plan(sizes: np.ndarray, counts: np.ndarray, capacity: int, groups: int = GROUPS, large_share: float = LARGE_SHARE) -> Plan:
    """A plan for counts[i] items of size sizes[i] (1..capacity each)."""
    keep = (sizes > 0) & (counts > 0)
    order = np.argsort(-sizes[keep], kind="stable")
    sizes, counts = sizes[keep][order].astype("int64"), counts[keep][order].astype("int64")
    runs: list[tuple[int, int, int, int]] = []
    free: dict[int, list[tuple[int, int]]] = {}
    opened = 0
    left: list[tuple[int, int, int]] = []
    big = sizes > capacity * large_share
    if big.any():
        members = _groups(sizes[big], counts[big], groups)
        weight = np.array([g[0][0] for g in members])
        demand = np.array([sum(hi - lo for _, lo, hi in g) for g in members])
        taken = [0] * len(members)
        for config, m in _configurations(weight, demand, capacity):
            cuts, slots = {0, m}, []
            for g, k in enumerate(config):
                if not k:
                    continue
                start = taken[g]
                taken[g] += k * m
                slots.append((g, k, start))
                at = 0
                for s, lo, hi in members[g]:
                    a, b = max(at, start), min(at + hi - lo, start + k * m)
                    if a < b:
                        cuts |= {(a - start) // k, (a - start + k - 1) // k, (b - start) // k, (b - start + k - 1) // k}
                        runs += _run(s, lo + a - at, b - a, a - start, k, opened)
                    at += hi - lo
            edges = sorted(c for c in cuts if c <= m)
            for a, b in zip(edges, edges[1:]):
                load = sum(_load(members[g], start + a * k, k) for g, k, start in slots)
                free.setdefault(capacity - load, []).append((opened + a, opened + b))
            opened += m
        for g, t in zip(members, taken):
            at = 0
            for s, lo, hi in g:
                skip = min(max(t - at, 0), hi - lo)
                if lo + skip < hi:
                    left.append((s, lo + skip, hi))
                at += hi - lo
    left += [(int(s), 0, int(c)) for s, c in zip(sizes[~big], counts[~big])]
    opened = _best_fit(sorted(left, key=lambda x: -x[0]), free, opened, capacity, runs)
    runs.sort()
    r = np.array(runs, "int64").reshape(-1, 4)
    return Plan(r[:, 0], r[:, 1], r[:, 2], r[:, 3], opened)


def _run(size: int, rank: int, n: int, offset: int, k: int, first: int) -> list[tuple[int, int, int, int]]:
    """Runs for n items of one size that begin at an offset of a sequence put k at a time into containers from first on."""
    out = []
    head = min(n, -offset % k)
    if head:
        out.append((size, rank, first + offset // k, n + k))
    if n > head:
        out.append((size, rank + head, first + (offset + head) // k, k))
    return out


def _load(group: list[tuple[int, int, int]], start: int, k: int) -> int:
    """Total size of k items of a group from a position on."""
    at = total = 0
    for s, lo, hi in group:
        total += s * max(0, min(at + hi - lo, start + k) - max(at, start))
        at += hi - lo
    return total


def _groups(sizes: np.ndarray, counts: np.ndarray, n: int) -> list[list[tuple[int, int, int]]]:
    """Large items, largest first, in n groups of equal number; each a list of (size, rank from, rank to)."""
    total = int(counts.sum())
    edges = [total * i // n for i in range(1, n + 1)]
    out: list[list[tuple[int, int, int]]] = []
    now: list[tuple[int, int, int]] = []
    at = e = 0
    for s, c in zip(sizes.tolist(), counts.tolist()):
        lo = 0
        while lo < c:
            while e < n - 1 and edges[e] <= at:
                e += 1
                if now:
                    out.append(now)
                    now = []
            hi = min(c, lo + edges[e] - at)
            now.append((s, lo, hi))
            at += hi - lo
            lo = hi
    if now:
        out.append(now)
    return out


def _configurations(weight: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[list[int], int]]:
    """Configurations of few sizes and how often each is used: column generation for the configuration LP, rounded down."""
    n = len(weight)
    basis = np.diag([float(capacity // w) for w in weight])
    for _ in range(rounds):
        price = np.linalg.solve(basis.T, np.ones(n))
        column, worth = _knapsack(weight, price, capacity)
        if worth <= 1 + 1e-9:
            break
        x, d = np.linalg.solve(basis, demand.astype(float)), np.linalg.solve(basis, column)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(d > 1e-9, x / d, np.inf)
        basis[:, int(np.argmin(ratio))] = column
    x = np.linalg.solve(basis, demand.astype(float))
    return [(basis[:, i].round().astype(int).tolist(), int(v)) for i, v in enumerate(np.floor(x + 1e-9)) if v >= 1]


def _knapsack(weight: np.ndarray, price: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """The configuration worth most at these prices: dynamic programming over capacity, an item a layer."""
    most = int(capacity // weight.min())
    best = np.zeros(capacity + 1)
    choice = []
    for _ in range(most):
        layer, pick = best.copy(), np.full(capacity + 1, -1, "int32")
        for i, (w, p) in enumerate(zip(weight, price)):
            if p > 0:
                cand = best[: capacity + 1 - w] + p
                better = cand > layer[w:] + 1e-12
                layer[w:][better] = cand[better]
                pick[w:][better] = i
        choice.append(pick)
        if (pick < 0).all():
            break
        best = layer
    column, c = np.zeros(len(weight)), capacity
    for pick in reversed(choice):
        i = int(pick[c])
        if i >= 0:
            column[i] += 1
            c -= int(weight[i])
    return column, float(column @ price)


def _best_fit(items: list[tuple[int, int, int]], free: dict[int, list[tuple[int, int]]], opened: int, capacity: int, runs: list[tuple[int, int, int, int]]) -> int:
    """Best fit for whole runs at a time, largest items first; gives the number of containers then open."""
    levels = sorted(free)

    def give(space: int, a: int, b: int) -> None:
        if space > 0 and a < b:
            if space not in free:
                free[space] = []
                bisect.insort(levels, space)
            free[space].append((a, b))

    for s, lo, hi in items:
        while lo < hi:
            i = bisect.bisect_left(levels, s)
            if i == len(levels):
                per = capacity // s
                whole, rest = divmod(hi - lo, per)
                runs.append((s, lo, opened, per))
                give(capacity - per * s, opened, opened + whole)
                if rest:
                    give(capacity - rest * s, opened + whole, opened + whole + 1)
                opened += whole + bool(rest)
                break
            space = levels[i]
            a, b = free[space].pop()
            if not free[space]:
                del free[space]
                levels.pop(i)
            per = min(space // s, hi - lo)
            m = min(b - a, (hi - lo) // per)
            runs.append((s, lo, a, per))
            give(space - per * s, a, a + m)
            if a + m < b:
                give(space, a + m, b)
            lo += per * m
    return opened


def pack(sizes: DataFrame, specs: DataFrame, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """(spec_id, container, doc_id, piece_no, start_token, n_tokens): where each piece of each item goes, for each spec.

    specs has spec_id and capacity_tokens; at most MAX_SPECS rows. An item is split only if it alone exceeds the capacity: into pieces
    that fill a container each (container d<doc>.<piece>) and the rest, which is packed like any other item (container c<number>).
    Defined cases: items of size 0 or null are piece 0 with no tokens, spread over the containers; a spec with a null or non-positive
    capacity has no rows; an empty table gives no rows; ties go by hash and key, so that a second run gives the same result.
    sizes is read twice (counts, then places; a third time where a size has more items than one task is to number) and should be a stored table.
    """
    spark = sizes.sparkSession
    listed = [(r[0], r[1]) for r in specs.select("spec_id", "capacity_tokens").where("capacity_tokens > 0").limit(MAX_SPECS + 1).collect()]
    if len(listed) > MAX_SPECS:
        raise ValueError(f"more than {MAX_SPECS} specs")
    schema = f"spec_id int, container string, `{key}` {sizes.schema[key].dataType.simpleString()}, piece_no int, start_token int, n_tokens int"
    if not listed:
        return spark.createDataFrame([], schema)

    n = F.coalesce(F.col(size), F.lit(0))
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("spec_id"), F.lit(c).alias("capacity")) for i, c in listed))).alias("spec")
    items = sizes.select(F.col(key), n.cast("int").alias("n"), each).select(key, "n", "spec.spec_id", "spec.capacity")
    items = items.withColumn("rest", F.when(F.col("n") <= F.col("capacity"), F.col("n")).otherwise(F.col("n") % F.col("capacity")))

    histogram: dict[int, dict[int, int]] = {i: {} for i, _ in listed}
    for r in items.where("n = 0 OR rest > 0").groupBy("spec_id", "rest").count().collect():  # at most specs x (capacity + 1) rows
        histogram[r["spec_id"]][r["rest"]] = r["count"]
    hot = [(i, s, -(-c // ROWS_PER_LOT)) for i, h in histogram.items() for s, c in h.items() if c > ROWS_PER_LOT]
    hashed = F.xxhash64(key)
    # items that fill containers of their own have no place to be numbered for
    whole = F.when((F.col("n") > 0) & (F.col("rest") == 0), F.pmod(hashed, F.lit(1024)))
    offsets: dict[int, dict[int, np.ndarray]] = {i: {} for i, _ in listed}
    if hot:
        lots = F.broadcast(spark.createDataFrame(hot, "spec_id int, rest int, lots int"))  # a row for each million items at most
        items = items.join(lots, ["spec_id", "rest"], "left").withColumn("salt", F.coalesce(whole, F.pmod(hashed, F.col("lots")), F.lit(0)).cast("int"))
        counts = items.where("lots IS NOT NULL AND (n = 0 OR rest > 0)").groupBy("spec_id", "rest", "lots", "salt").count().collect()
        items = items.drop("lots")
        for r in counts:
            offsets[r["spec_id"]].setdefault(r["rest"], np.zeros(r["lots"], "int64"))[r["salt"]] = r["count"]
        offsets = {i: {s: np.cumsum(c) - c for s, c in of.items()} for i, of in offsets.items()}
    else:
        items = items.withColumn("salt", F.coalesce(whole, F.lit(0)).cast("int"))
    plans, starts = {}, {}
    for i, capacity in listed:
        h = histogram[i]
        plans[i] = plan(np.array(list(h), "int64"), np.array(list(h.values()), "int64"), capacity)
        starts[i] = offsets[i]
    shared = spark.sparkContext.broadcast((plans, starts))

    w = Window.partitionBy("spec_id", "rest", "salt", F.col("n") == 0).orderBy(key)
    ranked = items.withColumn("rn", F.row_number().over(w) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans, starts = shared.value
        for b in batches:
            spec, rest, salt, rn = (b.column(c).to_numpy(zero_copy_only=False).astype("int64") for c in ("spec_id", "rest", "salt", "rn"))
            place = np.zeros(b.num_rows, "int64")
            for i in np.unique(spec):
                m = spec == i
                rank = rn.copy()
                for size_, before in starts[int(i)].items():
                    hot_here = m & (rest == size_) & (salt < len(before))
                    rank[hot_here] += before[salt[hot_here]]
                place[m] = plans[int(i)].place(rest[m], rank[m])
            yield b.append_column("place", pa.array(place))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema)
    placed = ranked.mapInArrow(run, fields + ", place long")
    full = F.when(F.col("n") > F.col("capacity"), F.floor(F.col("n") / F.col("capacity"))).otherwise(F.lit(0)).cast("int")
    placed = placed.withColumn("full", full)
    last = F.when((F.col("rest") > 0) | (F.col("n") == 0), F.col("full")).otherwise(F.col("full") - 1)
    placed = placed.withColumn("piece_no", F.explode(F.sequence(F.lit(0), last)))
    solo = F.col("piece_no") < F.col("full")
    return placed.select(
        "spec_id",
        F.when(solo, F.concat(F.lit("d"), F.col(key), F.lit("."), F.col("piece_no"))).otherwise(F.concat(F.lit("c"), F.col("place"))).alias("container"),
        key,
        "piece_no",
        (F.col("piece_no") * F.col("capacity")).alias("start_token"),
        F.when(solo, F.col("capacity")).otherwise(F.col("rest")).alias("n_tokens"),
    )
