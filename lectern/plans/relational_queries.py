"""Queries over the relational tables: history, tasks, audit, retention, caches, rates, running means."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import knowledge, state, storage
from lectern.session import read_table

AS_OF = "2017-03-31 00:00:00"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def _texts(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "processed_texts")


def _tasks(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "background_tasks")


def _log(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "audit_log")


_HTML = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query("SELECT id, domain, created_at, " + _HTML.format("CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END") + " AS preview FROM processed_texts WHERE domain = 'general' ORDER BY created_at DESC NULLS LAST, id DESC LIMIT 50 OFFSET 10")
def history_page(s: SparkSession, d: str) -> DataFrame:
    return storage.history(_texts(s, d), domain="general", limit=50, offset=10)


@query("SELECT user_id, count(*) AS n_texts FROM processed_texts WHERE user_id IS NOT NULL GROUP BY user_id")
def history_count(s: SparkSession, d: str) -> DataFrame:
    return _texts(s, d).where("user_id IS NOT NULL").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_texts"))


@query("SELECT domain, count(*) AS n, CAST(ceil(count(*) / 50.0) AS BIGINT) AS pages FROM processed_texts GROUP BY domain")
def domain_distribution(s: SparkSession, d: str) -> DataFrame:
    return _texts(s, d).groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.count(F.lit(1)) / 50.0).cast("long").alias("pages"))


@query("SELECT (SELECT count(*) FROM processed_texts) AS total_texts, (SELECT count(DISTINCT user_id) FROM processed_texts) AS users, (SELECT count(*) FROM background_tasks) AS total_tasks, (SELECT count(*) FROM background_tasks WHERE status = 'processing') AS active_tasks")
def service_statistics(s: SparkSession, d: str) -> DataFrame:
    return storage.statistics(_texts(s, d), _tasks(s, d))


@query("SELECT id, ts, user_id, action, status_code FROM audit_log WHERE action = 'process_text' AND ts >= TIMESTAMP '2017-03-05 00:00:00' AND ts <= TIMESTAMP '2017-03-20 00:00:00' ORDER BY ts DESC, id DESC LIMIT 100")
def audit_latest(s: SparkSession, d: str) -> DataFrame:
    return storage.audit(_log(s, d).select("id", "ts", "user_id", "action", "status_code"), action="process_text", start="2017-03-05 00:00:00", end="2017-03-20 00:00:00")


@query("SELECT id, ts, user_id, action FROM audit_log WHERE action = 'error' AND ts >= TIMESTAMP '2017-03-05 00:00:00'")
def audit_filter(s: SparkSession, d: str) -> DataFrame:
    return storage.audit(_log(s, d).select("id", "ts", "user_id", "action"), action="error", start="2017-03-05 00:00:00", limit=None)


@query(f"SELECT id, task_id, 'failed' AS status, created_at FROM background_tasks WHERE status IN ('pending', 'processing') AND created_at < TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR")
def stale_tasks(s: SparkSession, d: str) -> DataFrame:
    return storage.stale(_tasks(s, d), _as_of()).select("id", "task_id", "status", "created_at")


@query("SELECT id, 'failed' AS status, 'interrupted by system restart' AS error FROM background_tasks WHERE status = 'processing'")
def recovered_tasks(s: SparkSession, d: str) -> DataFrame:
    return storage.recovered(_tasks(s, d)).select("id", "status", "error")


@query(f"SELECT id FROM background_tasks WHERE status IN ('completed', 'failed', 'cancelled') AND completed_at < TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY")
def expired_tasks(s: SparkSession, d: str) -> DataFrame:
    return storage.expired_tasks(_tasks(s, d), _as_of()).select("id")


@query(
    f"SELECT 'texts' AS what, count(*) AS n FROM processed_texts WHERE created_at < TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY UNION ALL SELECT 'audit', count(*) FROM audit_log WHERE ts < TIMESTAMP '{AS_OF}' - INTERVAL 28 DAY"
    f" UNION ALL SELECT 'tasks', count(*) FROM background_tasks WHERE status IN ('completed', 'failed') AND completed_at < TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY"
)
def retention_counts(s: SparkSession, d: str) -> DataFrame:
    tables = {"texts": _texts(s, d), "audit": _log(s, d), "tasks": _tasks(s, d)}
    gone = storage.retention(*tables.values(), _as_of(), days=14)
    out = [t.agg(F.lit(k).alias("what"), F.count_if(gone[k]).alias("n")) for k, t in tables.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(f"SELECT id, domain FROM processed_texts WHERE NOT coalesce(created_at < TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY, false)")
def retention_rest(s: SparkSession, d: str) -> DataFrame:
    t = _texts(s, d)
    return storage.kept(t, storage.retention(t, _log(s, d), _tasks(s, d), _as_of(), days=14)["texts"]).select("id", "domain")


@query("SELECT id, status, round(date_diff('microsecond', started_at, completed_at) / 1e6, 6) AS duration_s FROM background_tasks")
def task_durations(s: SparkSession, d: str) -> DataFrame:
    return storage.task_views(_tasks(s, d)).select("id", "status", F.round("duration_s", 6).alias("duration_s"))


@query("SELECT status, count(*) AS n, count(error) AS with_error, count(result) AS with_result FROM background_tasks GROUP BY status")
def tasks_by_status(s: SparkSession, d: str) -> DataFrame:
    return _tasks(s, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count("error").alias("with_error"), F.count("result").alias("with_result"))


@query(
    "SELECT id, CASE WHEN error_message IS NULL OR error_message = '' THEN 'An unknown error occurred' WHEN contains(lower(error_message), 'database') THEN 'A database error occurred' WHEN contains(lower(error_message), 'connection') THEN 'A connection error occurred'"
    " WHEN contains(lower(error_message), 'timeout') THEN 'The operation timed out' WHEN contains(lower(error_message), 'nlp') THEN 'Text processing service error' WHEN contains(lower(error_message), 'memory') THEN 'Insufficient resources to process request'"
    " WHEN contains(lower(error_message), 'permission') THEN 'Permission denied' WHEN contains(lower(error_message), 'validation') THEN 'Invalid input provided' WHEN contains(lower(error_message), 'circuit') THEN 'Service temporarily unavailable' ELSE 'An error occurred during processing' END AS message FROM audit_log WHERE status_code >= 400"
)
def error_category(s: SparkSession, d: str) -> DataFrame:
    return _log(s, d).where("status_code >= 400").select("id", T.error_message(F.col("error_message")).alias("message"))


@query("SELECT CASE WHEN length(text) > 5000 THEN 'background' ELSE 'direct' END AS route, count(*) AS n FROM processed_texts WHERE text IS NOT NULL GROUP BY ALL")
def route_large_text(s: SparkSession, d: str) -> DataFrame:
    return _texts(s, d).where("text IS NOT NULL").groupBy(T.route(F.col("text")).alias("route")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id, sha256(text) AS text_hash, coalesce(text_hash = sha256(text), false) AS as_stored FROM processed_texts WHERE text IS NOT NULL")
def text_hash(s: SparkSession, d: str) -> DataFrame:
    h = F.sha2("text", 256)
    return _texts(s, d).where("text IS NOT NULL").select("id", h.alias("text_hash"), F.coalesce(F.col("text_hash") == h, F.lit(False)).alias("as_stored"))


@query("SELECT id, 'processed:' || sha256(text || ':' || domain) AS cache_key FROM processed_texts WHERE text IS NOT NULL AND domain IS NOT NULL")
def cache_keys(s: SparkSession, d: str) -> DataFrame:
    return _texts(s, d).where("text IS NOT NULL AND domain IS NOT NULL").select("id", T.cache_key("processed", F.col("text"), F.col("domain")).alias("cache_key"))


@query(r"SELECT id, CASE WHEN length(tei_xml) <= 100000 THEN regexp_replace(regexp_replace(tei_xml, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '<[^>]*>', '', 'g') END AS clean FROM processed_texts")
def sanitize_text(s: SparkSession, d: str) -> DataFrame:
    return _texts(s, d).select("id", T.sanitised(F.col("tei_xml")).alias("clean"))


@query("SELECT id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') AS xml FROM processed_texts")
def xml_escape(s: SparkSession, d: str) -> DataFrame:
    return _texts(s, d).select("id", T.xml_escaped(F.col("text")).alias("xml"))


@query("SELECT id, domain, text_hash FROM processed_texts WHERE id = 7")
def point_lookup(s: SparkSession, d: str) -> DataFrame:
    return _texts(s, d).where("id = 7").select("id", "domain", "text_hash").limit(1)


@query(
    "WITH r AS (SELECT TRY_CAST(resource_id AS BIGINT) AS text_id, user_id FROM audit_log WHERE resource_type = 'text') SELECT CASE WHEN t.id IS NULL THEN 404 WHEN coalesce(t.user_id = r.user_id, false) THEN 200 ELSE 403 END AS status, count(*) AS n"
    " FROM r LEFT JOIN processed_texts t ON t.id = r.text_id GROUP BY ALL"
)
def owned_fetch(s: SparkSession, d: str) -> DataFrame:
    r = _log(s, d).where("resource_type = 'text'").select(F.expr("try_cast(resource_id AS BIGINT)").alias("text_id"), "user_id")
    return storage.fetch(r, _texts(s, d).select("id", "user_id")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "SELECT id, list_filter([CASE WHEN NOT coalesce(length(text) > 0, false) THEN 'text is empty' END, CASE WHEN NOT coalesce(length(text) <= 5000, false) THEN 'text is too long' END, CASE WHEN NOT coalesce(regexp_matches(domain, '^[a-zA-Z0-9_-]+$') AND length(domain) <= 50, false) THEN 'domain is not valid' END], lambda x: x IS NOT NULL) AS violations FROM processed_texts"
)
def request_validation(s: SparkSession, d: str) -> DataFrame:
    t, dom = F.col("text"), F.col("domain")
    return _texts(s, d).select("id", T.violations((F.char_length(t) > 0, "text is empty"), (F.char_length(t) <= 5000, "text is too long"), (dom.rlike("^[a-zA-Z0-9_-]+$") & (F.char_length(dom) <= 50), "domain is not valid")).alias("violations"))


@query("SELECT action, status_code, count(*) AS n FROM audit_log GROUP BY ALL")
def request_counts(s: SparkSession, d: str) -> DataFrame:
    return _log(s, d).groupBy("action", "status_code").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT domain, count(processing_time) AS n, round(sum(processing_time), 4) AS total, count(*) FILTER (processing_time <= 0.1) AS le_0_1, count(*) FILTER (processing_time <= 0.5) AS le_0_5, count(*) FILTER (processing_time <= 1.0) AS le_1, count(*) FILTER (processing_time <= 5.0) AS le_5 FROM processed_texts GROUP BY domain")
def duration_histogram(s: SparkSession, d: str) -> DataFrame:
    p = F.col("processing_time")
    return _texts(s, d).groupBy("domain").agg(F.count(p).alias("n"), F.round(F.sum(p), 4).alias("total"), F.count_if(p <= 0.1).alias("le_0_1"), F.count_if(p <= 0.5).alias("le_0_5"), F.count_if(p <= 1.0).alias("le_1"), F.count_if(p <= 5.0).alias("le_5"))


@query("SELECT id, row_number() OVER (PARTITION BY ip_address, date_trunc('minute', ts) ORDER BY ts, id) <= 10 AS allowed FROM (SELECT DISTINCT id, ip_address, ts FROM audit_log WHERE ts IS NOT NULL AND ip_address IS NOT NULL)")
def rate_limit_window(s: SparkSession, d: str) -> DataFrame:
    r = _log(s, d).where("ts IS NOT NULL AND ip_address IS NOT NULL").select("id", "ip_address", "ts").distinct()
    return storage.rate_limited(r, "ip_address", "ts", "id", 10).select("id", "allowed")


@query("SELECT id, coalesce(cached_at + INTERVAL 1 DAY > TIMESTAMP '2017-03-20 00:00:00', false) AS valid FROM kb_entity_cache")
def cache_ttl(s: SparkSession, d: str) -> DataFrame:
    c = storage.cache_state(read_table(s, d, "kb_entity_cache"), "cached_at", F.lit("2017-03-20 00:00:00").cast("timestamp_ntz"), 86400)
    return c.select("id", F.coalesce("valid", F.lit(False)).alias("valid"))


@query("SELECT id FROM kb_entity_cache ORDER BY coalesce(last_hit, cached_at) NULLS FIRST, id LIMIT (SELECT greatest(1, count(*) // 10) FROM kb_entity_cache)")
def cache_evict(s: SparkSession, d: str) -> DataFrame:
    c = read_table(s, d, "kb_entity_cache").withColumn("used", F.coalesce("last_hit", "cached_at"))
    return storage.evicted(c, "used", "id").select("id")


@query("SELECT kb_id, count(*) AS entries, CAST(coalesce(sum(hit_count), 0) AS BIGINT) AS hits, count(*) FILTER (kb_entity_id IS NULL) AS misses, round(coalesce(sum(hit_count), 0) / greatest(coalesce(sum(hit_count), 0) + count(*), 1), 6) AS hit_rate FROM kb_entity_cache GROUP BY kb_id")
def cache_hit_stats(s: SparkSession, d: str) -> DataFrame:
    hits = F.coalesce(F.sum("hit_count"), F.lit(0))
    return read_table(s, d, "kb_entity_cache").groupBy("kb_id").agg(F.count(F.lit(1)).alias("entries"), hits.alias("hits"), F.count_if(F.col("kb_entity_id").isNull()).alias("misses"), F.round(hits / F.greatest(hits + F.count(F.lit(1)), F.lit(1)), 6).alias("hit_rate"))


@query("SELECT DISTINCT text FROM enriched_entities WHERE text NOT IN (SELECT entity_text FROM kb_entity_cache WHERE entity_text IS NOT NULL)")
def cache_missing(s: SparkSession, d: str) -> DataFrame:
    c = read_table(s, d, "kb_entity_cache").select(F.col("entity_text").alias("text")).where("text IS NOT NULL")
    return read_table(s, d, "enriched_entities").select("text").where("text IS NOT NULL").distinct().join(c, "text", "left_anti")


@query(
    "WITH k AS (SELECT DISTINCT lower(trim(text)) AS key FROM enriched_entities WHERE text IS NOT NULL), a AS (SELECT lower(trim(entity_text)) AS key, max(id) AS value FROM kb_entity_cache GROUP BY 1), b AS (SELECT lower(trim(text)) AS key, min(entity_id) AS value FROM kb_entities GROUP BY 1)"
    " SELECT tier, count(*) AS n FROM (SELECT CASE WHEN a.value IS NOT NULL THEN 'cache' WHEN b.value IS NOT NULL THEN 'records' ELSE 'miss' END AS tier FROM k LEFT JOIN a ON a.key = k.key LEFT JOIN b ON b.key = k.key) GROUP BY tier"
)
def cache_tiers(s: SparkSession, d: str) -> DataFrame:
    key = lambda c: F.lower(F.trim(F.col(c))).alias("key")
    keys = read_table(s, d, "enriched_entities").where("text IS NOT NULL").select(key("text")).distinct()
    a = read_table(s, d, "kb_entity_cache").groupBy(key("entity_text")).agg(F.max("id").cast("string").alias("value"))
    b = read_table(s, d, "kb_entities").groupBy(key("text")).agg(F.min("entity_id").alias("value"))
    return knowledge.tiers(keys, ("cache", a), ("records", b)).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT kb_id, entity_text, arg_max(id, (cached_at, id)) AS id, arg_max(coalesce(hit_count, 0), (cached_at, id)) AS hit_count FROM kb_entity_cache WHERE cached_at IS NOT NULL GROUP BY ALL")
def kb_sync_latest(s: SparkSession, d: str) -> DataFrame:
    c = read_table(s, d, "kb_entity_cache").where("cached_at IS NOT NULL").select("kb_id", "entity_text", "id", F.coalesce("hit_count", F.lit(0)).alias("hit_count"), "cached_at")
    return knowledge.latest(c, ["kb_id", "entity_text"], ["cached_at", "id"]).select("kb_id", "entity_text", "id", "hit_count")


@query(
    "SELECT id, round(avg(coalesce(processing_time, 0)) OVER (PARTITION BY domain ORDER BY created_at, id ROWS UNBOUNDED PRECEDING), 10) AS avg_processing_time, row_number() OVER (PARTITION BY domain ORDER BY created_at, id) AS n FROM processed_texts WHERE domain IS NOT NULL AND created_at IS NOT NULL"
)
def running_metrics(s: SparkSession, d: str) -> DataFrame:
    t = _texts(s, d).where("domain IS NOT NULL AND created_at IS NOT NULL").select("id", "domain", "created_at", "processing_time")
    return state.running_means(t, "domain", ["created_at", "id"], ["processing_time"]).select("id", F.round("avg_processing_time", 10).alias("avg_processing_time"), F.col("n").cast("long").alias("n"))


@query(
    "WITH w AS (SELECT id, row_number() OVER (PARTITION BY domain ORDER BY created_at, id) AS n, avg(coalesce(processing_time, 0)) OVER (PARTITION BY domain ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS a, avg(coalesce(processing_time, 0)) OVER (PARTITION BY domain ORDER BY created_at, id ROWS 9 PRECEDING) AS r"
    " FROM processed_texts WHERE domain IS NOT NULL AND created_at IS NOT NULL) SELECT id, n >= 100 AND r > a * 1.5 AS degraded, round(r, 10) AS recent FROM w"
)
def degradation_flag(s: SparkSession, d: str) -> DataFrame:
    t = _texts(s, d).where("domain IS NOT NULL AND created_at IS NOT NULL").select("id", "domain", "created_at", "processing_time")
    return state.degraded(t, "domain", ["created_at", "id"], "processing_time").select("id", "degraded", F.round("recent", 10).alias("recent"))


@query("SELECT id, domain FROM (SELECT id, domain, row_number() OVER (PARTITION BY domain ORDER BY created_at DESC, id DESC) AS k FROM processed_texts WHERE domain IS NOT NULL AND created_at IS NOT NULL) WHERE k <= 1000")
def bounded_history(s: SparkSession, d: str) -> DataFrame:
    t = _texts(s, d).where("domain IS NOT NULL AND created_at IS NOT NULL").select("id", "domain", "created_at")
    return state.last_rows(t, "domain", ["created_at", "id"]).select("id", "domain")


_OFF = "(acc.st = 1 AND x.a - acc.o < 60.0)"
_TRIPS = "(NOT x.ok AND (acc.st = 1 OR acc.f + 1 >= 5))"
_NEXT = f"CASE WHEN {_OFF} THEN 1 WHEN x.ok THEN 0 WHEN {_TRIPS} THEN 1 ELSE 0 END"


@query(
    "WITH c AS (SELECT DISTINCT coalesce(resource_type, 'service') AS service, ts, id, status_code < 500 AS ok FROM audit_log WHERE ts IS NOT NULL AND status_code IS NOT NULL AND id IS NOT NULL),"
    " l AS (SELECT service, list({'st': 0, 'f': 0, 'o': 0.0::DOUBLE, 'a': epoch_us(ts) / 1e6, 'ok': ok, 'n0': 0, 'n1': 0, 'n2': 0} ORDER BY ts, id) AS l FROM c GROUP BY service),"
    " r AS (SELECT service, list_reduce(list_prepend({'st': 0, 'f': 0, 'o': 0.0::DOUBLE, 'a': 0.0::DOUBLE, 'ok': true, 'n0': 0, 'n1': 0, 'n2': 0}, l), lambda acc, x: {"
    f"'st': {_NEXT}, 'f': CASE WHEN {_OFF} THEN acc.f WHEN x.ok THEN 0 ELSE acc.f + 1 END, 'o': CASE WHEN NOT {_OFF} AND {_TRIPS} THEN x.a ELSE acc.o END, 'a': x.a, 'ok': x.ok,"
    f" 'n0': acc.n0 + CASE WHEN NOT {_OFF} AND ({_NEXT}) = 0 THEN 1 ELSE 0 END, 'n1': acc.n1 + CASE WHEN NOT {_OFF} AND ({_NEXT}) = 1 THEN 1 ELSE 0 END, 'n2': acc.n2 + CASE WHEN {_OFF} THEN 1 ELSE 0 END}}) AS z FROM l),"
    " u AS (SELECT service, 'closed' AS state, true AS allowed, CAST(z.n0 AS BIGINT) AS n FROM r UNION ALL SELECT service, 'open', true, z.n1 FROM r UNION ALL SELECT service, 'open', false, z.n2 FROM r) SELECT * FROM u WHERE n > 0"
)
def circuit_breaker(s: SparkSession, d: str) -> DataFrame:
    calls = _log(s, d).where("id IS NOT NULL").select(F.coalesce("resource_type", F.lit("service")).alias("service"), "ts", F.col("id").alias("seq"), (F.col("status_code") < 500).alias("ok")).distinct()
    return state.breaker(calls).groupBy("service", "state", "allowed").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT resource_type AS provider, arg_max(CASE WHEN status_code >= 500 THEN 'unhealthy' ELSE 'healthy' END, (ts, id)) AS status FROM audit_log WHERE resource_type IS NOT NULL AND ts IS NOT NULL GROUP BY 1")
def provider_health(s: SparkSession, d: str) -> DataFrame:
    h = _log(s, d).where("resource_type IS NOT NULL AND ts IS NOT NULL").select(F.col("resource_type").alias("provider"), F.when(F.col("status_code") >= 500, "unhealthy").otherwise("healthy").alias("status"), "ts", "id")
    return knowledge.latest(h, ["provider"], ["ts", "id"]).select("provider", "status")


@query(
    "WITH m AS (SELECT created_at AS \"at\", 1 AS step FROM background_tasks WHERE created_at IS NOT NULL UNION ALL SELECT greatest(created_at, completed_at), -1 FROM background_tasks WHERE created_at IS NOT NULL AND completed_at IS NOT NULL AND status IN ('completed', 'failed', 'cancelled')),"
    " g AS (SELECT \"at\", sum(step) AS step FROM m GROUP BY \"at\") SELECT \"at\", CAST(sum(step) OVER (ORDER BY \"at\") AS BIGINT) AS active FROM g"
)
def active_gauge(s: SparkSession, d: str) -> DataFrame:
    """Tasks at work after each moment at which one begins or comes to its end."""
    ended = F.when(F.col("status").isin(*storage.FINAL), F.col("completed_at"))
    return state.gauge(_tasks(s, d).select("created_at", ended.alias("ended_at")), "created_at", "ended_at").select("at", "active")


@query("SELECT domain, coalesce(round(avg(processing_time), 8), 0.0) AS mean FROM (SELECT domain, processing_time, row_number() OVER (PARTITION BY domain ORDER BY created_at DESC, id DESC) AS k FROM processed_texts WHERE domain IS NOT NULL AND created_at IS NOT NULL) WHERE k <= 1000 GROUP BY domain")
def latency_recent(s: SparkSession, d: str) -> DataFrame:
    t = _texts(s, d).where("domain IS NOT NULL AND created_at IS NOT NULL").select("id", "domain", "created_at", "processing_time")
    return state.recent_mean(t, "domain", ["created_at", "id"], "processing_time").select("domain", F.round("mean", 8).alias("mean"))


@query(f"SELECT id FROM background_tasks WHERE NOT coalesce((SELECT count(*) FROM background_tasks) > 1000 AND created_at < TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR, false)")
def task_registry(s: SparkSession, d: str) -> DataFrame:
    return storage.bounded_registry(_tasks(s, d), _as_of()).select("id")


@query("SELECT strftime(ts, '%Y-%m') AS month, count(*) AS n, min(id) AS first_id FROM audit_log WHERE ts IS NOT NULL GROUP BY 1")
def audit_by_month(s: SparkSession, d: str) -> DataFrame:
    return _log(s, d).where("ts IS NOT NULL").groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
