"""Operators whose result depends on the rows before: running and moving means, breakers, bounded histories.

A group's rows are numbered by prefix sums over buckets of time; windows then run over chunks of numbered rows with a halo, so that no
task holds a whole group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.session import cut

CHUNK = 100_000


def numbered(df: DataFrame, key: str, order: list[str], values: list[str], bucket: str = "day") -> DataFrame:
    """df with n (position in its group from 1) and, for each value, its running sum sum_<value>; nulls count as 0."""
    d = df.withColumn("_b", F.date_trunc(bucket, F.col(order[0]).cast("timestamp")))
    w = Window.partitionBy(key, "_b").orderBy(*order)
    d = d.withColumn("_n", F.row_number().over(w))
    for v in values:
        d = d.withColumn(f"_s_{v}", F.sum(F.coalesce(F.col(v), F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    totals = d.groupBy(key, "_b").agg(F.count(F.lit(1)).alias("_c"), *(F.sum(F.coalesce(F.col(v), F.lit(0.0))).alias(f"_t_{v}") for v in values))
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(key, "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_n0"), *(F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0.0)).alias(f"_s0_{v}") for v in values))
    d = d.join(totals, [key, "_b"])
    return d.select(*df.columns, (F.col("_n") + F.col("_n0")).alias("n"), *((F.col(f"_s_{v}") + F.col(f"_s0_{v}")).alias(f"sum_{v}") for v in values))


def running_means(df: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """df with n and avg_<value>, the mean of the group so far."""
    d = numbered(df, key, order, values)
    return d.select(*df.columns, "n", *((F.col(f"sum_{v}") / F.col("n")).alias(f"avg_{v}") for v in values))


def degraded(df: DataFrame, key: str, order: list[str], value: str, last: int = 10, factor: float = 1.5, least: int = 100, chunk: int = CHUNK) -> DataFrame:
    """df with n, avg (so far), recent (mean of the last rows) and degraded: recent above factor times avg, from the least-th row on."""
    d = numbered(df, key, order, [value]).withColumn("avg", F.col(f"sum_{value}") / F.col("n")).drop(f"sum_{value}")
    home = F.floor((F.col("n") - 1) / chunk)
    d = d.withColumn("_home", home).withColumn("_chunk", F.explode(F.array_distinct(F.array(home, F.floor((F.col("n") + last - 2) / chunk)))))
    w = Window.partitionBy(key, "_chunk").orderBy("n").rowsBetween(-(last - 1), 0)
    d = d.withColumn("recent", F.avg(F.coalesce(F.col(value), F.lit(0.0))).over(w)).where("_home = _chunk").drop("_home", "_chunk")
    return d.withColumn("degraded", (F.col("n") >= least) & (F.col("recent") > F.col("avg") * factor))


def last_rows(df: DataFrame, key: str, order: list[str], most: int = 1000, lots: int = 64) -> DataFrame:
    """The last rows of each group; nulls of the order come first. Of each lot of a group at most so many go on to be compared with the others."""
    lot = F.pmod(F.xxhash64(*order), F.lit(lots))
    last = [F.desc_nulls_last(c) for c in order]
    d = df.withColumn("_lot", lot)
    d = d.withColumn("_k", F.row_number().over(Window.partitionBy(key, "_lot").orderBy(*last))).where(F.col("_k") <= most)
    return d.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*last))).where(F.col("_k") <= most).drop("_lot", "_k")


def recent_mean(df: DataFrame, key: str, order: list[str], value: str, most: int = 1000) -> DataFrame:
    """(key, mean) over the last rows of each group, nulls left out; 0 where there is none."""
    return last_rows(df, key, order, most).groupBy(key).agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"))


def gauge(spans: DataFrame, start: str, end: str) -> DataFrame:
    """(at, active): how many of spans are open after each moment at which one begins or ends; one without an end stays open, one without a
    start never was."""
    s = spans.where(F.col(start).isNotNull())
    moves = s.select(F.col(start).alias("at"), F.lit(1.0).alias("step")).unionByName(s.where(F.col(end).isNotNull()).select(F.greatest(start, end).alias("at"), F.lit(-1.0).alias("step")))
    per = moves.groupBy("at").agg(F.sum("step").alias("step")).withColumn("all", F.lit(1))
    return numbered(per, "all", ["at"], ["step"]).select("at", F.col("sum_step").cast("long").alias("active"))


class Breaker:
    """Closed until so many failures in a row, then open for a time, then half open for one trial."""

    def __init__(self, threshold: int, timeout: float) -> None:
        self.threshold, self.timeout = threshold, timeout
        self.state, self.failures, self.opened = "closed", 0, 0.0

    def call(self, at: float, ok: bool) -> tuple[bool, str]:
        """Whether the call is let through, and the state after it."""
        if self.state == "open":
            if at - self.opened < self.timeout:
                return False, self.state
            self.state = "half_open"
        if ok:
            self.state, self.failures = "closed", 0
        else:
            self.failures += 1
            if self.state == "half_open" or self.failures >= self.threshold:
                self.state, self.opened = "open", at
        return True, self.state


class _Tail:
    """Where an automaton that enters a stretch of calls comes out, for every state it may enter in.

    States are numbers of failures while closed, and threshold for open, with the time at which it opened. It is worked out from the last
    call to the first: what an open automaton does depends only on the first call that comes late enough to be its trial.
    """

    def __init__(self, at: np.ndarray, ok: np.ndarray, threshold: int, timeout: float) -> None:
        m = len(at)
        self.threshold, self.timeout, self.at = threshold, timeout, at
        closed = [(f, 0.0) for f in range(threshold)]
        trial: list[tuple[int, float]] = [(0, 0.0)] * m
        for j in range(m - 1, -1, -1):
            after_ok = closed[0]
            k = self._trial(float(at[j]), j)
            opened = (threshold, float(at[j])) if k == m else trial[k]
            if ok[j]:
                trial[j], closed = after_ok, [after_ok] * threshold
            else:
                trial[j], closed = opened, [*closed[1:], opened]
        self.closed, self.trials = closed, trial

    def _trial(self, opened: float, j: int = -1) -> int:
        k = int(np.searchsorted(self.at, opened + self.timeout))
        # by the very comparison that the automaton makes
        while k < len(self.at) and self.at[k] - opened < self.timeout:
            k += 1
        while k - 1 > j and self.at[k - 1] - opened >= self.timeout:
            k -= 1
        return k

    def runs(self) -> tuple[list[float], list[int], list[float]]:
        """The last time of each run of trials that come out alike, and where they come out."""
        last = [j for j in range(len(self.trials)) if j + 1 == len(self.trials) or self.trials[j] != self.trials[j + 1]]
        return [float(self.at[j]) for j in last], [self.trials[j][0] for j in last], [self.trials[j][1] for j in last]


def breaker(calls: DataFrame, service: str = "service", ts: str = "ts", seq: str = "seq", ok: str = "ok", threshold: int = 5, timeout_seconds: float = 60.0, chunk: int = CHUNK) -> DataFrame:
    """calls (service, ts, seq, ok) with allowed and state after each. Calls without service, time or outcome are left out.

    The state depends on every call before, but a stretch of calls only on the state it begins in. So stretches of a service find, apart
    from each other, where every state comes out; one pass over one row for each stretch gives the states they begin in; then the stretches
    are gone through, again apart. No task sees more than a stretch of a service's calls.
    """
    d = calls.select(F.col(service).cast("string").alias("service"), F.col(ts).cast("timestamp").alias("ts"), F.col(seq).cast("long").alias("seq"), F.col(ok).cast("boolean").alias("ok"))
    d = d.where("service IS NOT NULL AND ts IS NOT NULL AND ok IS NOT NULL")
    n = numbered(d, "service", ["ts", "seq"], []).select("service", F.floor((F.col("n") - 1) / chunk).alias("chunk"), "n", (F.unix_micros("ts") / 1e6).alias("at"), "seq", "ok")
    n = cut(n)
    keys = ["service", "chunk"]

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Rows of each stretch, whole, as they come in order."""
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            names = np.array(b.column("service").to_pylist(), dtype=object)
            chunks = b.column("chunk").to_numpy()
            starts = [0, *(np.flatnonzero((names[1:] != names[:-1]) | (chunks[1:] != chunks[:-1])) + 1).tolist(), b.num_rows]
            for lo, hi in zip(starts, starts[1:]):
                part = b.slice(lo, hi - lo)
                if held and (held[-1].column("service")[0], held[-1].column("chunk")[0]) != (part.column("service")[0], part.column("chunk")[0]):
                    yield pa.Table.from_batches(held).combine_chunks()
                    held = []
                held.append(part)
        if held:
            yield pa.Table.from_batches(held).combine_chunks()

    def outcomes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in stretches(batches):
            tail = _Tail(t.column("at").to_numpy(), t.column("ok").to_numpy(zero_copy_only=False), threshold, timeout_seconds)
            ends, kinds, times = tail.runs()
            row = {"service": t.column("service")[0].as_py(), "chunk": t.column("chunk")[0].as_py(), "closed": [c[0] for c in tail.closed], "closed_at": [c[1] for c in tail.closed], "ends": ends, "kinds": kinds, "times": times}
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("service", pa.string()), ("chunk", pa.int64()), ("closed", pa.list_(pa.int32())), ("closed_at", pa.list_(pa.float64())), ("ends", pa.list_(pa.float64())), ("kinds", pa.list_(pa.int32())), ("times", pa.list_(pa.float64()))]))

    table = n.repartition(*keys).sortWithinPartitions(*keys, "n").mapInArrow(outcomes, "service string, chunk long, closed array<int>, closed_at array<double>, ends array<double>, kinds array<int>, times array<double>")

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, (0, 0.0)
        for b in batches:
            out = []
            for r in b.to_pylist():
                if r["service"] != now:
                    now, state = r["service"], (0, 0.0)
                out.append((r["service"], r["chunk"], *state))
                if state[0] < threshold:
                    state = (r["closed"][state[0]], r["closed_at"][state[0]])
                else:
                    # the run of the first call that is late enough
                    k = int(np.searchsorted(r["ends"], state[1] + timeout_seconds))
                    while k < len(r["ends"]) and r["ends"][k] - state[1] < timeout_seconds:
                        k += 1
                    state = (r["kinds"][k], r["times"][k]) if k < len(r["ends"]) else state
            columns = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.float64()))], names=["service", "chunk", "entry", "entry_at"])

    begins = table.repartition("service").sortWithinPartitions(*keys).mapInArrow(entries, "service string, chunk long, entry int, entry_at double")
    begins = begins.select(F.col("service").alias("_s"), F.col("chunk").alias("_c"), "entry", "entry_at")
    placed = n.join(begins, (F.col("service") == F.col("_s")) & (F.col("chunk") == F.col("_c"))).drop("_s", "_c").repartition(*keys).sortWithinPartitions(*keys, "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in stretches(batches):
            b, entry = Breaker(threshold, timeout_seconds), t.column("entry")[0].as_py()
            if entry < threshold:
                b.failures = entry
            else:
                b.state, b.failures, b.opened = "open", threshold, t.column("entry_at")[0].as_py()
            done = [b.call(at, good) for at, good in zip(t.column("at").to_pylist(), t.column("ok").to_pylist())]
            columns = [t.column(c).combine_chunks() for c in ("service", "seq", "ok")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([a for a, _ in done], pa.bool_()), pa.array([x for _, x in done], pa.string())], names=["service", "seq", "ok", "allowed", "state"])

    return placed.mapInArrow(run, "service string, seq long, ok boolean, allowed boolean, state string")
