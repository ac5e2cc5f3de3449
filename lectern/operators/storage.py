"""The relational side: history, tasks, retention, audit, statistics. Writes are appends or rewrites of filtered tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.text import all_of, preview

FINAL = ("completed", "failed", "cancelled")
OPEN = ("pending", "processing")


def history(texts: DataFrame, domain: str | None = None, user: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of the newest texts, with previews; ties by id."""
    f = texts.where(all_of(F.col("domain") == domain if domain else None, F.col("user_id") == user if user else None))
    page = f.select("id", "domain", "created_at", "text").orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(limit)
    return page.select("id", "domain", "created_at", preview(F.col("text")).alias("preview"))


def audit(log: DataFrame, user: str | None = None, action: str | None = None, start: str | None = None, end: str | None = None, limit: int | None = 100) -> DataFrame:
    """Audit rows that meet the conditions given, newest first; both ends of the time range count."""
    ts = lambda x: F.lit(x).cast("timestamp_ntz")
    f = log.where(all_of(F.col("user_id") == user if user else None, F.col("action") == action if action else None, F.col("ts") >= ts(start) if start else None, F.col("ts") <= ts(end) if end else None))
    return f.orderBy(F.desc("ts"), F.desc("id")).limit(limit) if limit is not None else f


def task_views(tasks: DataFrame) -> DataFrame:
    """Tasks with the seconds they took, null while either time is."""
    seconds = F.expr("timestampdiff(MICROSECOND, started_at, completed_at)") / 1e6
    return tasks.withColumn("duration_s", seconds)


def stale(tasks: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Open tasks made more than so many hours ago, as failed."""
    return tasks.where(F.col("status").isin(*OPEN) & (F.col("created_at") < as_of - F.expr(f"INTERVAL {hours} HOURS"))).withColumn("status", F.lit("failed"))


def recovered(tasks: DataFrame) -> DataFrame:
    """Tasks that were being worked on when the system stopped, as failed."""
    return tasks.where("status = 'processing'").withColumn("status", F.lit("failed")).withColumn("error", F.lit("interrupted by system restart"))


def transition(tasks: DataFrame, changes: DataFrame) -> DataFrame:
    """tasks after their latest change (task_id, seq, status, at, result, error): start and end times are set, errors cut to 1000 characters."""
    last = changes.groupBy("task_id").agg(F.max_by(F.struct("status", "at", "result", "error"), "seq").alias("c"), F.max(F.when(F.col("status") == "processing", F.col("at"))).alias("begun"))
    t = tasks.join(last, "task_id", "left")
    done = F.col("c.status").isin(*FINAL)
    return t.select(
        *[c for c in tasks.columns if c not in ("status", "started_at", "completed_at", "result", "error")],
        F.coalesce("c.status", "status").alias("status"),
        F.coalesce("begun", "started_at").alias("started_at"),
        F.when(done, F.col("c.at")).otherwise(F.col("completed_at")).alias("completed_at"),
        F.when(done, F.coalesce("c.result", "result")).otherwise(F.col("result")).alias("result"),
        F.when(done, F.substring(F.coalesce("c.error", "error"), 1, 1000)).otherwise(F.col("error")).alias("error"),
    )


def retention(texts: DataFrame, log: DataFrame, tasks: DataFrame, as_of: Column, days: int = 90) -> dict[str, Column]:
    """For each table the condition of the rows that have expired: logs stay twice as long, finished tasks half as long."""
    old = lambda c, d: F.col(c) < as_of - F.expr(f"INTERVAL {d} DAYS")
    return {"texts": old("created_at", days), "audit": old("ts", 2 * days), "tasks": F.col("status").isin("completed", "failed") & old("completed_at", days // 2)}


def expired_tasks(tasks: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    return tasks.where(F.col("status").isin(*FINAL) & (F.col("completed_at") < as_of - F.expr(f"INTERVAL {days} DAYS")))


def bounded_registry(tasks: DataFrame, as_of: Column, most: int = 1000, hours: int = 24) -> DataFrame:
    """tasks, without those made more than so many hours ago if there are more than so many in all."""
    n = tasks.agg(F.count(F.lit(1)).alias("_n"))
    return tasks.crossJoin(F.broadcast(n)).where(~F.coalesce((F.col("_n") > most) & (F.col("created_at") < as_of - F.expr(f"INTERVAL {hours} HOURS")), F.lit(False))).drop("_n")


def kept(df: DataFrame, condition: Column) -> DataFrame:
    """A delete: the rows for which the condition is not true."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def fetch(requests: DataFrame, texts: DataFrame, check_owner: bool = True) -> DataFrame:
    """requests (text_id, user_id) with the status they get: 404 for a missing text, 403 for another's, else 200."""
    t = texts.select(F.col("id").alias("text_id"), F.col("user_id").alias("owner"), F.lit(True).alias("there"))
    status = F.when(F.col("there").isNull(), 404).when(F.lit(check_owner) & ~F.coalesce(F.col("owner") == F.col("user_id"), F.lit(False)), 403).otherwise(200)
    return requests.join(t, "text_id", "left").select("text_id", "user_id", status.alias("status"))


def statistics(texts: DataFrame, tasks: DataFrame) -> DataFrame:
    """One row of totals."""
    a = texts.agg(F.count(F.lit(1)).alias("total_texts"), F.count_distinct("user_id").alias("users"))
    b = tasks.agg(F.count(F.lit(1)).alias("total_tasks"), F.count_if(F.col("status") == "processing").alias("active_tasks"))
    return a.crossJoin(b)


def rate_limited(requests: DataFrame, key: str, ts: str, order: str, limit: int, seconds: int = 60) -> DataFrame:
    """requests with allowed: the first so many of a key in each fixed window of time."""
    slot = F.window(F.col(ts).cast("timestamp"), f"{seconds} seconds")["start"]
    d = requests.withColumn("slot", slot)
    return d.withColumn("allowed", F.row_number().over(Window.partitionBy(key, "slot").orderBy(ts, order)) <= limit)


def cache_state(entries: DataFrame, at: str, as_of: Column, ttl_seconds: int) -> DataFrame:
    """entries with valid: whether they live at as_of."""
    return entries.withColumn("valid", F.col(at) + F.expr(f"INTERVAL {ttl_seconds} SECONDS") > as_of)


def evicted(entries: DataFrame, used: str, key: str, share: int = 10) -> DataFrame:
    """The tenth of the entries used longest ago (at least one): what is dropped when a cache is full. Null times come first; ties go by key.

    Counts by day find the day in which the cut falls, counts by microsecond the instant in it; only entries of that very instant are
    numbered, by key. No entry of any other instant is sorted or moved.
    """
    at = F.coalesce(F.unix_micros(F.col(used).cast("timestamp")), F.lit(-(1 << 62)))
    d = entries.withColumn("_at", at).withColumn("_day", F.floor(F.col("_at") / 86_400_000_000))
    days = d.groupBy("_day").agg(F.count(F.lit(1)).alias("n"))
    most = F.greatest(F.lit(1), F.floor(F.sum("n").over(Window.partitionBy()) / share))
    # one row for each day: a window over them is small whatever the table holds
    days = days.select("_day", "n", F.sum("n").over(Window.orderBy("_day")).alias("upto"), most.alias("most"))
    border = days.where("upto - n < most AND upto >= most").select("_day", (F.col("most") - F.col("upto") + F.col("n")).alias("rest"))
    ticks = d.join(F.broadcast(border), "_day").groupBy("_at", "rest").agg(F.count(F.lit(1)).alias("n"))
    ticks = ticks.withColumn("_slice", F.floor(F.col("_at") / 1_000_000))
    upto = _running(ticks, "_slice", "_at", "n")
    edge = upto.where("upto - n < rest AND upto >= rest").select(F.col("_at").alias("_edge"), (F.col("rest") - F.col("upto") + F.col("n")).alias("left"))
    d = d.drop("_day").crossJoin(F.broadcast(edge)).where("_at <= _edge")
    sure = d.where("_at < _edge")
    last = _first_by(d.where("_at = _edge"), key, "left")
    return sure.select(*entries.columns).unionByName(last.select(*entries.columns))


def _running(df: DataFrame, part: str, order: str, n: str) -> DataFrame:
    """df with upto, the running sum of n by order, in two levels: over parts, then within each."""
    totals = df.groupBy(part).agg(F.sum(n).alias("_t"))
    totals = totals.select(part, (F.sum("_t").over(Window.orderBy(part)) - F.col("_t")).alias("_before"))
    return df.join(totals, part).withColumn("upto", F.sum(n).over(Window.partitionBy(part).orderBy(order)) + F.col("_before")).drop("_before")


def _first_by(df: DataFrame, key: str, n: str, lots: int = 64) -> DataFrame:
    """The first n rows by key, of rows that all have the same n: found in lots, each of which keeps at most n before the last cut."""
    lot = F.pmod(F.hash(key), F.lit(lots))
    own = df.withColumn("_k", F.row_number().over(Window.partitionBy(lot).orderBy(key))).where(F.col("_k") <= F.col(n))
    return own.withColumn("_k", F.row_number().over(Window.orderBy(key))).where(F.col("_k") <= F.col(n)).drop("_k")
