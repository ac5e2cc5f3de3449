"""Requests as rows: their options, gates, tags and answers; settings; health. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import fixed

OPTION_TYPE = "struct<" + ",".join(f"{n}:boolean" for n in fixed.OPTIONS) + ",language:string>"


def parsed_options(json: Column) -> Column:
    """Options of a request with the defaults of those left out; an option that is no boolean counts as left out, as do broken JSON and null."""
    raw = F.from_json(json, "map<string,string>")
    flag = lambda n, d: F.coalesce(F.try_element_at(raw, F.lit(n)).try_cast("boolean"), F.lit(d))
    return F.struct(*(flag(n, d).alias(n) for n, d in fixed.OPTIONS.items()), F.coalesce(F.try_element_at(raw, F.lit("language")), F.lit("en")).alias("language"))


def masked_options(options: Column, capabilities: Column) -> Column:
    """Options that the provider is able to meet: each and its capability; the language stays."""
    return F.struct(*((options[n] & F.coalesce(capabilities[c], F.lit(False))).alias(n) for n, c in fixed.CAPABILITY_OF.items()), options["language"].alias("language"))


def invalid_options(keys: Column, most: int = 20) -> Column:
    """What is wrong with the names of a request's options: those not known, in order, and a note if there are too many."""
    unknown = F.array_sort(F.array_except(F.coalesce(keys, F.array().cast("array<string>")), F.array(*map(F.lit, fixed.OPTIONS))))
    return F.concat(unknown, F.when(F.size(keys) > most, F.array(F.lit("too many options"))).otherwise(F.array().cast("array<string>")))


def gated(sentences: Column, entities: Column, dependencies: Column, noun_chunks: Column, options: Column) -> Column:
    """A result with the sections that are not wanted empty; sentences without tokens where those are not wanted, tokens without the fields
    of lemmas and parts of speech where these are not."""
    none = lambda c: F.slice(c, 1, 0)

    def token(t: Column) -> Column:
        for name in ("pos", "dep", "head", "morph"):
            t = t.withField(name, F.when(options["include_pos"], t[name]))
        return t.withField("lemma", F.when(options["include_lemmas"], t["lemma"]))

    kept = F.transform(sentences, lambda s: s.withField("tokens", F.when(options["include_tokens"], F.transform(s["tokens"], token)).otherwise(none(s["tokens"]))))
    pick = lambda flag, c: F.when(options[flag], c).otherwise(none(c))
    return F.struct(pick("include_sentences", kept).alias("sentences"), pick("include_entities", entities).alias("entities"), pick("include_dependencies", dependencies).alias("dependencies"), pick("include_noun_chunks", noun_chunks).alias("noun_chunks"))


def admitted(length: Column, active: Column, longest: int = 5000, most_active: int = 10) -> Column:
    """Where a request goes: longer ones to the background, and they are refused while too many are active there."""
    return F.when(length <= longest, "direct").when(active >= most_active, "refused").otherwise("background")


def status_of_error(kind: Column) -> Column:
    """The status that answers an error of this kind."""
    return F.when(kind == "ValueError", 400).when(kind.isin("CircuitBreakerError", "circuit"), 503).otherwise(500)


def answer(kind: Column, message: Column, debug: bool = False) -> Column:
    """struct<status, detail>: a stock phrase for the status; the message itself only when debugging, and never while a breaker is open."""
    status = status_of_error(kind)
    stock = F.when(status == 400, fixed.ERROR_ANSWERS[400]).when(status == 503, fixed.ERROR_ANSWERS[503]).otherwise(fixed.ERROR_ANSWERS[500])
    return F.struct(status.alias("status"), F.when(F.lit(debug) & (status != 503), message).otherwise(stock).alias("detail"))


def tagged(requests: DataFrame, given: str, start: str, end: str) -> DataFrame:
    """requests with request_id, a new one where none is given, and elapsed_s, null while either time is."""
    return requests.withColumn("request_id", F.coalesce(F.col(given), F.uuid())).withColumn("elapsed_s", F.expr(f"timestampdiff(MICROSECOND, `{start}`, `{end}`)") / 1e6)


def settings_problems(settings: DataFrame) -> DataFrame:
    """settings (environment, database_url, secret_key, nlp_provider) with problem: what is wrong with them, joined; empty if nothing is."""
    live = F.coalesce(F.col("environment") == "production", F.lit(False))
    valid = ", ".join(f"'{p}'" for p in fixed.NLP_PROVIDERS)
    found = F.array(
        F.when(~F.coalesce(F.col("environment").isin(fixed.ENVIRONMENTS), F.lit(False)), F.concat(F.lit("Invalid environment: "), F.coalesce("environment", F.lit("None")))),
        F.when(F.coalesce(F.col("database_url") == "", F.lit(True)), "Database URL is required"),
        F.when(live & (F.length(F.coalesce("secret_key", F.lit(""))) < 32), "Secret key must be at least 32 characters in production"),
        F.when(live & (F.col("secret_key").startswith("CHANGE_THIS") | (F.col("secret_key") == "default")), "Default or weak secret key detected in production"),
        F.when(~F.coalesce(F.col("nlp_provider").isin(fixed.NLP_PROVIDERS), F.lit(False)), F.concat(F.lit("Invalid NLP provider: "), F.coalesce("nlp_provider", F.lit("None")), F.lit(f". Valid options: [{valid}]"))),
    )
    return settings.withColumn("problem", F.array_join(found, "; "))


def rolled_up(services: DataFrame, *by: str) -> DataFrame:
    """(by, status) of services (service, status): unhealthy if any is unhealthy or in error, degraded if one lives in memory only, else healthy."""
    bad, memory = F.bool_or(F.col("status").isin("unhealthy", "error")), F.bool_or(F.col("status") == "memory-only")
    return services.groupBy(*by).agg(F.when(bad, "unhealthy").when(memory, "degraded").otherwise("healthy").alias("overall"))


def first_of(items: Column, k: int) -> tuple[Column, Column]:
    """The first k items, and a note of how many more there are (empty if none)."""
    more = F.greatest(F.size(items) - k, F.lit(0))
    return F.slice(items, 1, k), F.when(more > 0, F.concat(F.lit("... and "), more.cast("string"), F.lit(" more"))).otherwise("")


def next_runs(syncs: DataFrame, frequency_seconds: Column) -> DataFrame:
    """syncs (last_run, ok) with next_run: a period after the last one, an hour after one that failed, at once (null) if there was none."""
    wait = F.when(F.col("ok"), frequency_seconds).otherwise(F.lit(3600))
    return syncs.withColumn("next_run", F.col("last_run") + F.make_dt_interval(secs=wait))


def well_formed(xml: Column) -> Column:
    """Whether a text is one well-formed XML document; null for null. Text with a document type is taken for malformed, for it may name others."""
    broken = F.from_xml(xml, "_corrupt STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})["_corrupt"].isNotNull()
    return F.when(xml.isNotNull(), ~broken & ~xml.contains("<!DOCTYPE") & F.ltrim(xml).startswith("<"))
