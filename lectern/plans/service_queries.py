"""Queries over requests, providers, schemas, catalogs and health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.functions import text as T
from lectern.operators import annotate, catalog, knowledge, patterns, providers, requests, schemas, tei
from lectern.plans.annotation_queries import STORED_SQL
from lectern.session import read_table, spread

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _values(rows: list[tuple], names: str) -> str:
    """A constant table as SQL."""
    def one(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, (list, tuple)):
            return "CAST([" + ", ".join(map(one, v)) + "] AS VARCHAR[])"
        return str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"

    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") AS v({names})"


# --- requests ----------------------------------------------------------------------------------------------------------------------

_FLAGS = {n: f"coalesce(TRY_CAST(json_extract_string(input_data, '$.options.{n}') AS BOOLEAN), {str(v).lower()})" for n, v in fixed.OPTIONS.items()}


def _options() -> Column:
    return requests.parsed_options(F.get_json_object("input_data", "$.options"))


@query("SELECT id, " + ", ".join(f"{x} AS {n}" for n, x in _FLAGS.items()) + ", coalesce(json_extract_string(input_data, '$.options.language'), 'en') AS language FROM background_tasks")
def options_parsed(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "background_tasks").select("id", _options().alias("o")).select("id", "o.*")


@query("SELECT id, " + ", ".join(f"{x} AND {str(c in ('entities', 'sentences', 'tokens', 'pos_tags', 'lemmas')).lower()} AS {n}" for (n, x), c in zip(_FLAGS.items(), fixed.CAPABILITY_OF.values())) + " FROM background_tasks")
def options_masked(s: SparkSession, d: str) -> DataFrame:
    """What the rule annotator can meet of the options of each task."""
    can = F.struct(*(F.lit(c in annotate.CAPABILITIES).alias(c) for c in fixed.CAPABILITY_OF.values()))
    t = read_table(s, d, "background_tasks").select("id", _options().alias("o"))
    return t.select("id", requests.masked_options(F.col("o"), can).alias("o")).select("id", "o.*").drop("language")


@query("SELECT id, list_sort(list_filter(json_keys(metadata), lambda k: k NOT IN (" + ", ".join(f"'{n}'" for n in fixed.OPTIONS) + "))) AS unknown FROM (SELECT DISTINCT id, metadata FROM audit_log WHERE json_valid(metadata) AND metadata <> '{}')")
def options_unknown(s: SparkSession, d: str) -> DataFrame:
    """Names in the stored parameters of requests that are no options."""
    log = read_table(s, d, "audit_log").where("metadata IS NOT NULL AND metadata <> '{}'").select("id", "metadata").distinct()
    return log.select("id", requests.invalid_options(F.json_object_keys("metadata")).alias("unknown"))


@query(
    STORED_SQL + " SELECT ok.id, CAST(CASE WHEN t.domain <> 'legal' THEN json_array_length(ss) ELSE 0 END AS INTEGER) AS n_sentences, CAST(CASE WHEN t.domain <> 'medical' THEN json_array_length(es) ELSE 0 END AS INTEGER) AS n_entities FROM ok JOIN processed_texts t ON t.id = ok.id"
)
def result_gated(s: SparkSession, d: str) -> DataFrame:
    """Stored results with the sections left out that a domain's requests do not want."""
    t = annotate.stored(spread(read_table(s, d, "processed_texts").select("id", "domain", "nlp_results")), "id", "nlp_results", "domain").where("valid")
    wish = F.struct(*((F.col("domain") != ("legal" if n == "include_sentences" else "medical" if n == "include_entities" else "")).alias(n) for n in fixed.OPTIONS))
    r = t.select("id", requests.gated(F.col("sentences"), F.col("entities"), F.col("dependencies"), F.col("noun_chunks"), wish).alias("r"))
    return r.select("id", F.size("r.sentences").alias("n_sentences"), F.size("r.entities").alias("n_entities"))


@query("SELECT id, CASE WHEN length(text) <= 5000 THEN 'direct' WHEN (SELECT count(*) FROM background_tasks WHERE status = 'processing') >= 10 THEN 'refused' ELSE 'background' END AS route FROM processed_texts WHERE text IS NOT NULL")
def request_admission(s: SparkSession, d: str) -> DataFrame:
    active = read_table(s, d, "background_tasks").agg(F.count_if(F.col("status") == "processing").alias("active"))
    t = read_table(s, d, "processed_texts").where("text IS NOT NULL").select("id", F.char_length("text").alias("n"))
    return t.crossJoin(F.broadcast(active)).select("id", requests.admitted(F.col("n"), F.col("active")).alias("route"))


@query(
    "SELECT kind, CAST(CASE WHEN kind = 'ValueError' THEN 400 WHEN kind = 'circuit' THEN 503 ELSE 500 END AS INTEGER) AS status, CASE WHEN kind = 'ValueError' THEN 'Invalid input provided' WHEN kind = 'circuit' THEN 'Service temporarily unavailable. Please try again later.' ELSE 'An unexpected error occurred' END AS detail, count(*) AS n"
    " FROM (SELECT CASE WHEN contains(lower(error_message), 'invalid') THEN 'ValueError' WHEN contains(lower(error_message), 'circuit') THEN 'circuit' ELSE 'other' END AS kind FROM audit_log WHERE status_code >= 400) GROUP BY ALL"
)
def error_answers(s: SparkSession, d: str) -> DataFrame:
    low = F.lower("error_message")
    kind = F.when(low.contains("invalid"), "ValueError").when(low.contains("circuit"), "circuit").otherwise("other")
    log = read_table(s, d, "audit_log").where("status_code >= 400").select(kind.alias("kind"), "error_message")
    a = log.select("kind", requests.answer(F.col("kind"), F.col("error_message")).alias("a"))
    return a.groupBy("kind", "a.status", "a.detail").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id, request_id IS NOT NULL AS given, true AS tagged, round(date_diff('microsecond', started_at, completed_at) / 1e6, 6) AS elapsed_s FROM background_tasks")
def request_tags(s: SparkSession, d: str) -> DataFrame:
    t = read_table(s, d, "background_tasks").select("id", F.col("request_id").alias("header"), "started_at", "completed_at")
    r = requests.tagged(t, "header", "started_at", "completed_at")
    return r.select("id", F.col("header").isNotNull().alias("given"), (F.length("request_id") > 0).alias("tagged"), F.round("elapsed_s", 6).alias("elapsed_s"))


_SETTINGS = [("production", "sqlite:///x", "short", "spacy"), ("production", "postgresql://x", "CHANGE_THIS" + "x" * 30, "remote"), ("staging", "", None, "other"), ("development", "sqlite:///x", "", "spacy"), (None, None, None, None)]
_PROBLEMS = ["Secret key must be at least 32 characters in production", "Default or weak secret key detected in production", "Invalid environment: staging; Database URL is required; Invalid NLP provider: other. Valid options: ['spacy', 'remote']", "", "Invalid environment: None; Database URL is required; Invalid NLP provider: None. Valid options: ['spacy', 'remote']"]


@query("SELECT environment, problem FROM " + _values([(x[0], p) for x, p in zip(_SETTINGS, _PROBLEMS)], "environment, problem"))
def settings_checked(s: SparkSession, d: str) -> DataFrame:
    return requests.settings_problems(s.createDataFrame(_SETTINGS, "environment string, database_url string, secret_key string, nlp_provider string")).select("environment", "problem")


# --- providers ---------------------------------------------------------------------------------------------------------------------


def _chain() -> providers.Providers:
    """Three providers: one that knows texts in ASCII only, one that is down, and one that takes any text that is not empty."""
    made = lambda name, ok: lambda docs: docs.select(docs.columns[0], F.when(ok, F.concat(F.lit(name + ":"), F.char_length("text").cast("string"))).alias("result"))
    p = providers.Providers(fallbacks=["down", "any"])
    p.register(providers.Provider("ascii", made("ascii", ~F.col("text").rlike("[^\\x00-\\x7f]"))))
    p.register(providers.Provider("down", made("down", F.lit(True)), healthy=lambda: False))
    return p.register(providers.Provider("any", made("any", F.col("text") != "")))


@query(
    "SELECT id, CASE WHEN ascii THEN 'ascii' WHEN text <> '' THEN 'any' END AS provider, CASE WHEN ascii THEN 'ascii:' || length(text) WHEN text <> '' THEN 'any:' || length(text) END AS result, CASE WHEN ascii THEN '' WHEN text <> '' THEN 'ascii,down' ELSE 'ascii,down,any' END AS attempted, NOT ascii AND text <> '' AS fallback_used"
    " FROM (SELECT id, text, NOT regexp_matches(text, '[^\\x00-\\x7F]') AS ascii FROM processed_texts WHERE text IS NOT NULL)"
)
def provider_chain(s: SparkSession, d: str) -> DataFrame:
    out = _chain().annotate(read_table(s, d, "processed_texts").where("text IS NOT NULL").select("id", "text"), "id")
    return out.select("id", "provider", "result", F.array_join("attempted", ",").alias("attempted"), "fallback_used")


@query("SELECT provider, role, status FROM " + _values([("ascii", "primary", "healthy"), ("down", "fallback", "unavailable"), ("any", "fallback", "healthy")], "provider, role, status"))
def provider_status(s: SparkSession, d: str) -> DataFrame:
    return _chain().status(s).select("provider", "role", "status")


@query(
    "WITH k AS (SELECT id, text, sha256(text) AS cache_key, coalesce(length(text) > 0 AND length(text) <= 5000, false) AS fit FROM processed_texts), c AS (SELECT DISTINCT text_hash FROM processed_texts WHERE text_hash IS NOT NULL AND domain = 'medical')"
    " SELECT k.id, CASE WHEN NOT fit THEN 'rejected' WHEN c.text_hash IS NOT NULL THEN 'cache' ELSE 'provider' END AS origin, CASE WHEN NOT fit THEN NULL WHEN c.text_hash IS NOT NULL THEN 'stored' ELSE 'made:' || length(k.text) END AS result FROM k LEFT JOIN c ON c.text_hash = k.cache_key AND k.fit"
)
def read_through(s: SparkSession, d: str) -> DataFrame:
    """Texts by way of a cache that has those of one domain."""
    t = read_table(s, d, "processed_texts")
    cached = t.where("text_hash IS NOT NULL AND domain = 'medical'").select(F.col("text_hash").alias("cache_key"), F.lit("stored").alias("value")).distinct()
    made = lambda docs: docs.select("cache_key", F.concat(F.lit("made:"), F.char_length("text").cast("string")).alias("result"))
    out, _ = providers.read_through(t.select("id", "text", F.sha2("text", 256).alias("cache_key")), "id", cached, made, 5000)
    return out


_LATEST = "WITH l AS (SELECT coalesce(resource_type, 'service') AS service, arg_max(status_code, (ts, id)) AS code FROM audit_log WHERE ts IS NOT NULL GROUP BY 1), s AS (SELECT service, CASE WHEN code >= 500 THEN 'unhealthy' WHEN code >= 400 THEN 'memory-only' ELSE 'healthy' END AS status FROM l)"


@query(_LATEST + " SELECT CASE WHEN bool_or(status = 'unhealthy') THEN 'unhealthy' WHEN bool_or(status = 'memory-only') THEN 'degraded' ELSE 'healthy' END AS overall, count(*) AS services FROM s")
def health_rollup(s: SparkSession, d: str) -> DataFrame:
    log = read_table(s, d, "audit_log").where("ts IS NOT NULL").select(F.coalesce("resource_type", F.lit("service")).alias("service"), "status_code", "ts", "id")
    latest = knowledge.latest(log, ["service"], ["ts", "id"])
    status = F.when(F.col("status_code") >= 500, "unhealthy").when(F.col("status_code") >= 400, "memory-only").otherwise("healthy")
    services = latest.select("service", status.alias("status"))
    return requests.rolled_up(services).crossJoin(services.agg(F.count(F.lit(1)).alias("services")))


@query(
    "SELECT CAST((SELECT count(*) FROM processed_texts) AS BIGINT) AS total_texts, CAST((SELECT count(*) FROM processed_texts WHERE user_id = 'anonymous') AS BIGINT) AS user_texts, CAST((SELECT count(*) FROM background_tasks WHERE status IN ('pending', 'processing')) AS BIGINT) AS active_tasks,"
    " CAST((SELECT coalesce(sum(hit_count), 0) FROM kb_entity_cache) AS BIGINT) AS cache_hits, CAST((SELECT count(*) FROM model_catalog) AS BIGINT) AS models, CAST((SELECT count(DISTINCT kb_id) FROM kb_entities) AS BIGINT) AS knowledge_bases"
)
def statistics_document(s: SparkSession, d: str) -> DataFrame:
    """One row of what the service tells about itself."""
    t, k, c = (read_table(s, d, n) for n in ("processed_texts", "background_tasks", "kb_entity_cache"))
    rows = [
        t.agg(F.count(F.lit(1)).alias("total_texts"), F.count_if(F.col("user_id") == "anonymous").alias("user_texts")),
        k.agg(F.count_if(F.col("status").isin("pending", "processing")).alias("active_tasks")),
        c.agg(F.coalesce(F.sum("hit_count"), F.lit(0)).cast("long").alias("cache_hits")),
        read_table(s, d, "model_catalog").agg(F.count(F.lit(1)).alias("models")),
        read_table(s, d, "kb_entities").agg(F.count_distinct("kb_id").alias("knowledge_bases")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.crossJoin(F.broadcast(r))
    return out


# --- schemas and settings of pipelines -------------------------------------------------------------------------------------------------


@query(
    "SELECT * FROM "
    + _values(
        [(x["domain"], x["title"], x["description"], x["annotation_strategy"], len(x["entity_mappings"]), x.get("additional_tags", []), x.get("include_pos", False), x.get("include_morph", False), x.get("include_analysis", False), False) for x in fixed.SCHEMAS],
        "domain, title, description, annotation_strategy, n_types, additional_tags, pos_tags, morphology, analysis, is_custom",
    )
)
def schema_info(s: SparkSession, d: str) -> DataFrame:
    i = schemas.info(tei.schemas(s))
    return i.select("domain", "title", "description", "annotation_strategy", F.size("entity_types").alias("n_types"), "additional_tags", "features.pos_tags", "features.morphology", "features.analysis", "is_custom")


@query("SELECT list_sort(list(DISTINCT domain)) AS domains FROM " + _values([(x["domain"],) for x in fixed.SCHEMAS] + [("court",)], "domain"))
def schema_domains(s: SparkSession, d: str) -> DataFrame:
    return schemas.domains(tei.schemas(s, schemas.updated([], "court", {"title": "Court"})))


@query("SELECT t.domain, v.element, count(*) AS n FROM (SELECT coalesce(p.domain, 'default') AS domain, upper(e.entity_type) AS entity_type FROM enriched_entities e JOIN processed_texts p ON p.id = e.doc_id) t LEFT JOIN " + _values([(x["domain"], k, v) for x in fixed.SCHEMAS for k, v in x["entity_mappings"].items()], "domain, entity_type, element") + " ON v.domain = t.domain AND v.entity_type = t.entity_type GROUP BY ALL")
def element_counts(s: SparkSession, d: str) -> DataFrame:
    """Entities by domain and the element that the domain's schema names for their type; null where it names none."""
    docs = read_table(s, d, "processed_texts").select(F.col("id").alias("doc_id"), F.coalesce("domain", F.lit("default")).alias("domain"))
    e = read_table(s, d, "enriched_entities").select("doc_id", F.upper("entity_type").alias("entity_type")).join(docs, "doc_id")
    per = e.groupBy("domain", "entity_type").agg(F.count(F.lit(1)).alias("n"))
    return per.join(F.broadcast(schemas.mappings(tei.schemas(s))), ["domain", "entity_type"], "left").groupBy("domain", "element").agg(F.sum("n").alias("n"))


# --- catalogs --------------------------------------------------------------------------------------------------------------------------


def _known_sql() -> str:
    return _values([(i, m[0], m[1], m[2], m[3], fixed.MODEL_SIZES[i]) for i, m in enumerate(fixed.MODELS)], "catalog_ord, model_id, provider, domain, f1, size_mb")


@query("SELECT model_id, provider, domain, size_mb FROM " + _known_sql() + " UNION ALL SELECT model_id, provider, domain, size_mb FROM model_catalog WHERE performance.f1_score >= 0.7 AND trusted")
def catalog_merged(s: SparkSession, d: str) -> DataFrame:
    """The built-in catalog with the table's models that are to be trusted, each once."""
    known = catalog.known_models(s)
    found = read_table(s, d, "model_catalog").select(*known.drop("performance").columns, F.struct(F.col("performance.f1_score").alias("f1_score"), F.col("performance.latency_ms").alias("latency_ms")).alias("performance")).select(*known.columns)
    return catalog.merged(known, catalog.discovered(found.unionByName(found))).select("model_id", "provider", "domain", "size_mb")


@query(
    "WITH h AS (SELECT source AS model_id, count(*) AS downloads, unnest(['legal', 'law', 'other']) AS tag FROM documents WHERE source IS NOT NULL GROUP BY source), t AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY downloads DESC, model_id) AS k FROM h WHERE tag IN ('legal', 'law'))"
    " SELECT DISTINCT model_id, downloads > 100 AS trusted, 0.8::DOUBLE AS f1_score FROM t WHERE k <= 10"
)
def hub_discovery(s: SparkSession, d: str) -> DataFrame:
    """Repositories of the corpus in the place of a hub's models, their documents in the place of downloads."""
    hub = read_table(s, d, "documents").where("source IS NOT NULL").groupBy(F.col("source").alias("model_id")).agg(F.count(F.lit(1)).alias("downloads"))
    hub = hub.select("model_id", "downloads", F.array(F.lit("legal"), F.lit("law"), F.lit("other")).alias("tags"), F.lit(None).cast("string").alias("description"))
    return catalog.from_hub(hub, catalog.known_models(s), "legal", popular=100).select("model_id", "trusted", "f1_score")


@query("SELECT id, provider, short FROM (SELECT model_id AS id, provider, replace(replace(model_id, 'spacy/', ''), 'scispacy/', '') AS short FROM " + _known_sql() + ") WHERE provider <> 'huggingface'")
def catalog_without_provider(s: SparkSession, d: str) -> DataFrame:
    c = catalog.without(catalog.known_models(s), "huggingface")
    return c.select(F.col("model_id").alias("id"), "provider", catalog.short_id(F.col("model_id")).alias("short"))


_KB_DOMAINS = [("pillbook", "medical", True), ("orgbook", "financial", True), ("personfile", "general", False), ("gridnames", "general", True)]


def _bases(s: SparkSession, d: str) -> DataFrame:
    return knowledge.bases(read_table(s, d, "kb_entities"), s.createDataFrame(_KB_DOMAINS, "kb_id string, domain string, trusted boolean"))


_BASES = "WITH b AS (SELECT k.kb_id, v.domain, v.trusted, list_sort(list(DISTINCT k.entity_type)) AS entity_types, count(*) AS n_entities FROM kb_entities k LEFT JOIN " + _values(_KB_DOMAINS, "kb_id, domain, trusted") + " ON v.kb_id = k.kb_id GROUP BY ALL)"


@query(_BASES + " SELECT 'domain' AS asked, kb_id FROM b WHERE domain = 'general' UNION ALL SELECT 'type', kb_id FROM b WHERE list_contains(entity_types, 'PERSON') UNION ALL SELECT 'trusted', kb_id FROM b WHERE trusted UNION ALL SELECT 'all', kb_id FROM b")
def kb_catalog_query(s: SparkSession, d: str) -> DataFrame:
    """The catalog of knowledge bases asked by domain (which goes before a type), by type, for trusted ones, and for all."""
    b = _bases(s, d)
    asked = {"domain": {"domain": "general", "entity_type": "DRUG"}, "type": {"entity_type": "PERSON"}, "trusted": {"trusted_only": True}, "all": {}}
    out = None
    for name, how in asked.items():
        one = knowledge.query_bases(b, **how).select(F.lit(name).alias("asked"), "kb_id")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT kb_id, kb_id IN ('pillbook', 'gazette') AS found, CASE kb_id WHEN 'pillbook' THEN 'weekly' ELSE 'daily' END AS frequency, CAST(CASE kb_id WHEN 'pillbook' THEN 604800 ELSE 86400 END AS INTEGER) AS seconds FROM (SELECT DISTINCT kb_id FROM kb_entities)")
def kb_sync_config(s: SparkSession, d: str) -> DataFrame:
    known = s.createDataFrame([("pillbook", "weekly"), ("gazette", None)], "kb_id string, frequency string")
    c = knowledge.config_of(known, read_table(s, d, "kb_entities").select("kb_id").distinct())
    return c.select("kb_id", "found", "frequency", T.frequency_seconds(F.col("frequency")).cast("int").alias("seconds"))


@query("SELECT id, completed_at + to_seconds(CASE WHEN status = 'completed' THEN 86400 ELSE 3600 END) AS next_run FROM background_tasks WHERE completed_at IS NOT NULL")
def sync_schedule(s: SparkSession, d: str) -> DataFrame:
    """When tasks that are repeated daily run again; an hour after a failure."""
    t = read_table(s, d, "background_tasks").where("completed_at IS NOT NULL").select("id", F.col("completed_at").alias("last_run"), (F.col("status") == "completed").alias("ok"))
    return requests.next_runs(t, T.frequency_seconds(F.lit("daily"))).select("id", "next_run")


@query("WITH n AS (SELECT DISTINCT entity_id, lower(trim(name)) AS key FROM (SELECT entity_id, unnest(list_append(coalesce(synonyms, []), text)) AS name FROM kb_entities WHERE kb_id = 'orgbook')) SELECT e.text, n.entity_id AS found_id FROM (SELECT DISTINCT text FROM kb_entities WHERE kb_id = 'orgbook') e JOIN (SELECT key, min(entity_id) AS entity_id FROM n WHERE key <> '' GROUP BY key) n ON n.key = lower(trim(e.text))")
def kb_provider_lookup(s: SparkSession, d: str) -> DataFrame:
    kb = knowledge.KnowledgeBase("orgbook", read_table(s, d, "kb_entities"))
    return kb.lookup(kb.records.select("text").distinct()).select("text", "found_id").where("found_id IS NOT NULL")


@query("SELECT md5(kb_id || ':' || coalesce(entity_type, 'any') || ':' || lower(trim(text))) AS key, kb_id, entity_id, text, coalesce(confidence, 1.0) AS confidence, TIMESTAMP '2017-04-01 00:00:00' + INTERVAL 1 HOUR AS expires_at FROM kb_entities WHERE kb_id IS NOT NULL AND text IS NOT NULL")
def kb_cache_rows(s: SparkSession, d: str) -> DataFrame:
    """Records written to a cache and read back from it."""
    rows = knowledge.cached_rows(read_table(s, d, "kb_entities").where("kb_id IS NOT NULL AND text IS NOT NULL"), F.lit("2017-04-01 00:00:00").cast("timestamp_ntz"))
    r = F.from_json("value", "kb_id string, entity_id string, text string, confidence double").alias("r")
    return rows.select("key", "expires_at", r).select("key", "r.kb_id", "r.entity_id", "r.text", F.coalesce("r.confidence", F.lit(1.0)).alias("confidence"), "expires_at")


# --- rules and reports -----------------------------------------------------------------------------------------------------------------


def _rules(domain: str) -> list[patterns.Rule]:
    return patterns.without_rule(patterns.rules_of(domain), "url")


_RULE_ROWS = [(d, r[1], r[1].upper(), r[3], bool(r[4]), r[5] is not None) for d in ("medical", "legal", "financial") for r in fixed.RULES if r[0] in (d, "general") and r[1] != "url"]


@query("SELECT domain, name, entity_type, priority, case_insensitive AND NOT general AS case_insensitive, has_validation FROM (SELECT *, name IN ('email', 'phone_us', 'date_iso') AS general FROM " + _values(_RULE_ROWS, "domain, name, entity_type, priority, case_insensitive, has_validation") + ")")
def pattern_info(s: SparkSession, d: str) -> DataFrame:
    """The rules of each domain after one has been taken out."""
    out = None
    for dom in ("medical", "legal", "financial"):
        one = patterns.rule_info(s, _rules(dom)).drop("rule_ord").withColumn("domain", F.lit(dom))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT DISTINCT entity_type FROM " + _values(_RULE_ROWS, "domain, name, entity_type, priority, case_insensitive, has_validation") + " WHERE domain = 'legal'")
def supported_types(s: SparkSession, d: str) -> DataFrame:
    return patterns.supported_types(s, _rules("legal"))


@query("SELECT doc_id, count(*) AS n_enriched, min(id) AS first_id FROM enriched_entities WHERE kb_entity_id IS NOT NULL GROUP BY doc_id")
def enriched_only(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "enriched_entities").where("kb_entity_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_enriched"), F.min("id").alias("first_id"))


@query(
    "WITH k AS (SELECT doc_id, id, row_number() OVER (PARTITION BY doc_id ORDER BY start_char, id) AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM enriched_entities) SELECT doc_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY k) AS first_ids, CASE WHEN max(n) > 5 THEN '... and ' || (max(n) - 5) || ' more' ELSE '' END AS more FROM k WHERE k <= 5 GROUP BY doc_id"
)
def first_entities(s: SparkSession, d: str) -> DataFrame:
    """The first five entities of each document and how many more there are."""
    e = read_table(s, d, "enriched_entities").groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("start_char", "id"))), lambda x: x["id"].cast("string")).alias("ids"))
    shown, more = requests.first_of(F.col("ids"), 5)
    return e.select("doc_id", F.array_join(shown, ",").alias("first_ids"), more.alias("more"))


@query()
def xml_validity(s: SparkSession, d: str) -> DataFrame:
    t = read_table(s, d, "processed_texts").select("id", requests.well_formed(F.col("tei_xml")).alias("well_formed"))
    return t.groupBy("well_formed").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS rows, count(*) AS kept FROM kb_entities")
def records_round_trip(s: SparkSession, d: str) -> DataFrame:
    """Records as JSON and back: how many come back as they were."""
    k = read_table(s, d, "kb_entities").select("entity_id", "kb_id", "text", "synonyms", "metadata", "confidence", "last_updated")
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in k.schema)
    back = k.select(F.struct(*k.columns).alias("a"), F.from_json(F.to_json(F.struct(*k.columns)), kind).alias("b"))
    same = F.to_json("a") == F.to_json("b")
    return back.agg(F.count(F.lit(1)).alias("rows"), F.count_if(same).alias("kept"))
