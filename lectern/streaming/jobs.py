"""Streaming versions of the operators that follow events over time. Each gives what its batch twin gives on the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lectern.operators.state import Breaker


def stream_of(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    """A folder of parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def request_rates(requests: DataFrame, key: str, ts: str, seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """Requests of each key in each window of time; windows close once the watermark has passed them."""
    return requests.withWatermark(ts, late).groupBy(F.window(ts, f"{seconds} seconds"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")


def activity_sessions(events: DataFrame, user: str, ts: str, gap_seconds: int = 1800, late: str = "1 hour") -> DataFrame:
    """Sessions of each user as they end: start, end of the last event plus the gap, number of events."""
    w = F.session_window(ts, f"{gap_seconds} seconds")
    return events.withWatermark(ts, late).groupBy(user, w).agg(F.count(F.lit(1)).alias("n_events")).select(user, F.col("session_window.start").alias("start_ts"), F.col("session_window.end").alias("closes_at"), "n_events")


def breaker_states(calls: DataFrame, threshold: int = 5, timeout_seconds: float = 60.0) -> DataFrame:
    """calls (service, at: seconds, seq, ok) with allowed and state. A service's automaton is its state between batches."""
    out = "service string, seq long, ok boolean, allowed boolean, state string"

    def run(key: tuple[str], frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        b = Breaker(threshold, timeout_seconds)
        if kept.exists:
            b.state, b.failures, b.opened = kept.get
        rows = pd.concat(list(frames)).sort_values(["at", "seq"])
        done = [b.call(at, ok) for at, ok in zip(rows["at"], rows["ok"])]
        kept.update((b.state, b.failures, b.opened))
        yield pd.DataFrame({"service": rows["service"], "seq": rows["seq"], "ok": rows["ok"], "allowed": [a for a, _ in done], "state": [s for _, s in done]})

    return calls.groupBy("service").applyInPandasWithState(run, out, "state string, failures int, opened double", "append", GroupStateTimeout.NoTimeout)


def stale_tasks(changes: DataFrame, hours: int = 24, late: str = "1 hour") -> DataFrame:
    """changes (task_id, status, at) of tasks: a row with status failed for each task still open so many hours of event time later."""
    out = "task_id string, status string"

    def run(key: tuple[str], frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        if kept.hasTimedOut:
            kept.remove()
            yield pd.DataFrame({"task_id": [key[0]], "status": ["failed"]})
            return
        rows = pd.concat(list(frames)).sort_values("at")
        if rows["status"].iloc[-1] in ("completed", "failed", "cancelled"):
            if kept.exists:
                kept.remove()
        else:
            first = kept.get[0] if kept.exists else int(rows["at"].iloc[0].timestamp() * 1000)
            kept.update((first,))
            kept.setTimeoutTimestamp(max(first + hours * 3_600_000, kept.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"task_id": [], "status": []})

    return changes.withWatermark("at", late).groupBy("task_id").applyInPandasWithState(run, out, "first long", "append", GroupStateTimeout.EventTimeTimeout)


def sync(source: DataFrame, path: str, checkpoint: str, keys: list[str], order: str, status_path: str | None = None) -> StreamingQuery:
    """Keeps the latest version of each key of a stream of records in the table at path, under a new name for each version of the table.

    Each batch is merged with the version before it into path/version=n, so the table holds each key once; versions before the last two go,
    as no reader needs them. status_path gets a row for each batch: version, rows, ok, and the latest order seen. A batch that is delivered
    again after a failure writes the same version anew.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c not in keys]
        before = [v for v in versions(spark, path) if v < number]
        both = spark.read.schema(batch.schema).parquet(f"{path}/version={before[-1]}").unionByName(batch) if before else batch
        both.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("v")).select(*keys, "v.*").write.mode("overwrite").parquet(f"{path}/version={number}")
        if status_path:
            batch.agg(F.lit(number).alias("version"), F.count(F.lit(1)).alias("rows"), F.lit(True).alias("ok"), F.max(order).alias("last_success")).write.mode("overwrite").parquet(f"{status_path}/version={number}")
        for v in before[:-1]:
            _folder(spark, f"{path}/version={v}", remove=True)

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _folder(spark: SparkSession, path: str, remove: bool = False) -> list[str]:
    """Names in a folder of any storage; with remove, none after the folder is gone."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if remove:
        fs.delete(p, True)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    """Finished versions of a table that sync keeps, in order."""
    names = [n for n in _folder(spark, path) if n.startswith("version=")]
    return sorted(int(n.split("=")[1]) for n in names if "_SUCCESS" in _folder(spark, f"{path}/{n}"))


def synced(spark: SparkSession, path: str) -> DataFrame:
    """The last finished version of a table that sync keeps."""
    return spark.read.parquet(f"{path}/version={versions(spark, path)[-1]}")
