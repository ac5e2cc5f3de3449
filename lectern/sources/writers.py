"""Sinks: appends, latest-wins writes, filtered rewrites, swaps, XML files, metrics text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import preview


def append(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("append").partitionBy(*by).parquet(path)


def saved_texts(df: DataFrame) -> DataFrame:
    """Rows as they are stored: results as JSON, a user for each, the hash of the text."""
    kind = dict(df.dtypes)["nlp_results"]
    return df.withColumn("nlp_results", F.col("nlp_results") if kind == "string" else F.to_json("nlp_results")).withColumn("user_id", F.coalesce("user_id", F.lit("anonymous"))).withColumn("text_hash", F.sha2("text", 256))


def audit_rows(requests: DataFrame) -> DataFrame:
    """One audit row for each request (method, path, status, ip, agent, params)."""
    return requests.select(F.concat_ws(" ", "method", "path").alias("action"), F.col("status").alias("status_code"), F.col("ip").alias("ip_address"), F.col("agent").alias("user_agent"), F.to_json(F.struct("params")).alias("metadata"))


def audit_by_month(log: DataFrame, path: str) -> None:
    """The log in folders by month, so that a time range reads its months only."""
    log.withColumn("month", F.date_format("ts", "yyyy-MM")).write.mode("append").partitionBy("month").parquet(path)


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """old with new over it: of each key the row with the last order."""
    both = old.unionByName(new)
    rest = [c for c in both.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("v")).select(*keys, "v.*")


def kept_until(rows: DataFrame, at: Column, ttl_seconds: int) -> DataFrame:
    """rows (key, value) as a cache keeps them: with the time at which they expire."""
    return rows.select("key", "value", (at + F.make_dt_interval(secs=F.lit(ttl_seconds))).alias("expires_at"))


def living(rows: DataFrame, at: Column) -> DataFrame:
    """Rows of a cache that have not expired; of a key written several times the one that expires last."""
    return rows.where(F.col("expires_at") > at).groupBy("key").agg(F.max_by("value", F.struct("expires_at", "value")).alias("value"), F.max("expires_at").alias("expires_at"))


def with_ids(df: DataFrame, last_id: int = 0) -> DataFrame:
    """df with ids above the last one that is taken, by which the rows inserted are known: unique, not without gaps."""
    return df.withColumn("id", F.monotonically_increasing_id() + F.lit(last_id + 1))


def without_keys(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """A delete by pattern: rows whose key has the pattern, its stars left out, in it."""
    return df.where(~F.coalesce(F.col(column).contains(pattern.replace("*", "")), F.lit(False)))


def rewrite(df: DataFrame, path: str, keep: Column) -> None:
    """A delete: a new version of the table beside the old one, which the caller swaps in."""
    df.where(keep).write.mode("overwrite").parquet(path)


def swap(spark: SparkSession, view: str, path: str) -> None:
    """Readers of the view see the table at path from now on."""
    spark.read.parquet(path).createOrReplaceTempView(view)


def xml_files(docs: DataFrame, path: str, key: str = "id", xml: str = "tei") -> None:
    """JSON lines of key and XML, in as many files as the table has partitions: a document each would be too many to list."""
    docs.select(F.col(key).alias("id"), F.col(xml).alias("tei")).write.mode("overwrite").json(path)


def xml_of(spark: SparkSession, path: str, key: str) -> str | None:
    """The XML of one document from xml_files, for download; null if there is none."""
    row = spark.read.schema("id string, tei string").json(path).where(F.col("id") == key).first()
    return row.tei if row else None


def exposition(metrics: DataFrame) -> DataFrame:
    """Lines of metrics (name, labels map, value) in the text format of monitoring systems."""
    inner = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"'))), ",")
    return metrics.select(F.concat("name", F.lit("{"), inner, F.lit("} "), F.col("value").cast("string")).alias("line"))


def history_view(texts: DataFrame) -> DataFrame:
    return texts.select("id", "domain", "created_at", preview(F.col("text")).alias("preview"))
