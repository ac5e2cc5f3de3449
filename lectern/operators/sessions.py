"""Sessions: a user's events cut wherever the user was inactive for longer than a threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def sessionize(
    events: DataFrame,
    user: str = "user_id",
    ts: str = "ts",
    event_id: str = "id",
    gap_seconds: int = 1800,
    bucket_seconds: int = 21600,
) -> DataFrame:
    """One row for each session: user_id, session_key, start_ts, end_ts, duration_s, n_events, first_id, last_id.

    Lagged time per user flags the gaps, the running sum of the flags numbers the sessions, an aggregate closes them. It runs in two
    levels, so that no task ever holds all events of one user: first within (user, bucket of time), where the events are; then per user
    over the first and last part of each bucket only, which is all that can join. The second level sees at most two rows for each bucket
    of a user, whatever the number of events.

    Defined cases: rows with a null user or time are left out; events exactly gap_seconds apart stay together; a row delivered twice
    (same user, time and id) counts once; a null id is never a repeat and is taken as first_id or last_id only if the session has no
    other at that time; an empty table gives no rows; extra columns are ignored.
    """
    gap_us = gap_seconds * 1_000_000
    us = F.unix_micros(F.col(ts).cast("timestamp")) if dict(events.dtypes)[ts] == "timestamp" else F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{ts}`)")
    e = events.where(F.col(user).isNotNull() & F.col(ts).isNotNull()).select(F.col(user).alias("user_id"), us.alias("us"), F.col(event_id).alias("eid"))
    e = e.withColumn("bucket", F.floor(F.col("us") / F.lit(bucket_seconds * 1_000_000)))

    w = Window.partitionBy("user_id", "bucket").orderBy("us", "eid")
    before = F.lag("us").over(w)
    e = e.select(
        "user_id",
        "bucket",
        "us",
        "eid",
        (before.isNull() | (F.col("us") - before > gap_us)).cast("int").alias("opens"),
        F.coalesce((before == F.col("us")) & (F.lag("eid").over(w) == F.col("eid")), F.lit(False)).alias("again"),
        before.isNull().alias("at_start"),
        F.lead("us").over(w).isNull().alias("at_end"),
    ).withColumn("part", F.sum("opens").over(w))

    parts = e.groupBy("user_id", "bucket", "part").agg(
        F.min("us").alias("lo"),
        F.max("us").alias("hi"),
        F.count_if(~F.col("again")).alias("n"),
        _first_id().alias("first"),
        _last_id().alias("last"),
        (F.bool_or("at_start") | F.bool_or("at_end")).alias("edge"),
    )

    # parts in the middle of a bucket are whole sessions; they stay in their bucket's group, apart from the user's edges
    parts = parts.withColumn("lane", F.when(F.col("edge"), F.lit(None)).otherwise(F.col("bucket")))
    v = Window.partitionBy("user_id", "lane").orderBy("lo")
    parts = parts.withColumn("opens", F.coalesce((F.col("lo") - F.lag("hi").over(v) > gap_us), F.lit(True)).cast("int")).withColumn("no", F.sum("opens").over(v))
    whole = parts.groupBy("user_id", "lane", "no").agg(
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
        F.sum("n").alias("n_events"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
    )
    return whole.select(
        "user_id",
        F.xxhash64("user_id", "lo").alias("session_key"),
        F.timestamp_micros("lo").alias("start_ts"),
        F.timestamp_micros("hi").alias("end_ts"),
        ((F.col("hi") - F.col("lo")) / 1e6).alias("duration_s"),
        "n_events",
        F.col("first.eid").alias("first_id"),
        F.col("last.eid").alias("last_id"),
    )


def _first_id() -> Column:
    return F.min(F.struct(F.col("us"), F.col("eid").isNull().alias("none"), F.col("eid")))


def _last_id() -> Column:
    return F.max(F.struct(F.col("us"), F.col("eid").isNotNull().alias("some"), F.col("eid")))
