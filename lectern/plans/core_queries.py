"""Queries over the core operators for general record problems (sessions and nested records)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.flatten import flatten_tables
from lectern.operators.sessions import sessionize
from lectern.plans import json_sql
from lectern.session import read_table, spread

GAP_SECONDS = 1800


def json_tables(spark: SparkSession, d: str) -> list[tuple[DataFrame, str, str, str]]:
    return [(spread(read_table(spark, d, "processed_texts").select("id", "nlp_results")), "id", "nlp_results", "processed_texts"), (read_table(spark, d, "background_tasks").select("id", "result"), "id", "result", "background_tasks")]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return flatten_tables("entity_relationships", *json_tables(spark, d))


def _p2(level: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return flatten_tables(level, *json_tables(spark, d))

    return run


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    return sessionize(read_table(spark, d, "audit_log").select("user_id", "ts", "id"), gap_seconds=GAP_SECONDS)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _sessions(spark, d).select("user_id", "first_id", "last_id")


def p7_sessions(spark: SparkSession, d: str) -> DataFrame:
    return _sessions(spark, d).select("user_id", F.col("start_ts").cast("timestamp_ntz").alias("start_ts"), F.col("end_ts").cast("timestamp_ntz").alias("end_ts"), F.round("duration_s", 6).alias("duration_s"), F.col("n_events").cast("long").alias("n_events"), "first_id", "last_id")


QUERIES = {"p2_found": p2_found, "p7_found": p7_found, "p7_sessions": p7_sessions} | {f"p2_{n}": _p2(n) for n in ("entities", "kb_links", "synonyms", "relationships", "sentences", "tokens")}

_RUNS = """
  WITH e AS (SELECT DISTINCT id, user_id, ts FROM audit_log WHERE user_id IS NOT NULL AND ts IS NOT NULL),
  f AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM e),
  g AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, id) AS no FROM f),
  s AS (SELECT user_id, no, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n_events FROM g GROUP BY ALL),
  t AS (SELECT s.user_id, s.start_ts, s.end_ts, s.n_events, min(g.id) FILTER (g.ts = s.start_ts) AS first_id, max(g.id) FILTER (g.ts = s.end_ts) AS last_id
        FROM g JOIN s ON g.user_id = s.user_id AND g.no = s.no GROUP BY ALL)
"""

ORACLES = {f"p2_{level}": sql for level, sql in json_sql.LEVELS.items()} | {
    "p7_found": _RUNS + "SELECT user_id, first_id, last_id FROM t",
    "p7_sessions": _RUNS + "SELECT user_id, start_ts, end_ts, round(epoch_us(end_ts - start_ts) / 1e6, 6) AS duration_s, CAST(n_events AS BIGINT) AS n_events, first_id, last_id FROM t",
}
