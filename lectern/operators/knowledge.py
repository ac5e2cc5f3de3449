"""Knowledge bases: lookup by ordered fallback, hit rates, hops over relationships, latest versions, cache tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import normalised
from lectern.session import bounded

MAX_CHAIN = 10_000
MAX_STATES = 100_000


def lookup_keys(kb: DataFrame) -> DataFrame:
    """(key, kb_id, entity_id, entity_type): every name and synonym of every record, normalised, once."""
    names = kb.select(F.explode(F.array_union(F.array("text"), F.coalesce("synonyms", F.array().cast("array<string>")))).alias("name"), "kb_id", "entity_id", "entity_type")
    return names.select(normalised(F.col("name")).alias("key"), "kb_id", "entity_id", "entity_type").where("key <> ''").distinct()


def lookup(entities: DataFrame, kb: DataFrame, chain: DataFrame, text: str = "text") -> DataFrame:
    """entities with found_kb, found_id: from the first knowledge base of the chain (kb_id, rank) that has the text; null if none has.

    One row is found for each distinct text before it meets the entities, so a text that many rows share costs one lookup.
    """
    names = lookup_keys(kb).join(F.broadcast(bounded(chain, MAX_CHAIN, "knowledge bases in the chain")), "kb_id")
    first = names.groupBy("key").agg(F.min(F.struct("rank", "kb_id", "entity_id")).alias("f")).select("key", F.col("f.kb_id").alias("found_kb"), F.col("f.entity_id").alias("found_id"))
    return entities.withColumn("key", normalised(F.col(text))).join(first, "key", "left").drop("key")


def hit_rate(looked_up: DataFrame, *by: str) -> DataFrame:
    """Share of the rows for which something was found."""
    return looked_up.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("found_id").isNotNull().cast("int")), 6).alias("kb_hit_rate"))


def latest(versions: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last version of each key, by the order columns."""
    others = [c for c in versions.columns if c not in keys]
    return versions.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("v")).select(*keys, "v.*")


def incremental(source: DataFrame, state: DataFrame, kb: str = "kb_id", changed: str = "last_updated") -> DataFrame:
    """Rows changed since their knowledge base's last success; all rows of one without."""
    s = state.select(F.col(kb), F.col("last_success"))
    return source.join(F.broadcast(bounded(s, MAX_STATES, "states of knowledge bases")), kb, "left").where(F.col("last_success").isNull() | (F.col(changed) > F.col("last_success"))).drop("last_success")


def hops(edges: DataFrame, start: DataFrame, n: int) -> DataFrame:
    """(source_id, target_id, hops) reached from start ids over 1..n relationships, by the fewest."""
    step = start.select("source_id").distinct().join(edges.select("source_id", "target_id").distinct(), "source_id").withColumn("hops", F.lit(1))
    all_ = step
    e = edges.select(F.col("source_id").alias("target_id"), F.col("target_id").alias("next")).distinct()
    for k in range(2, n + 1):
        step = step.join(e, "target_id").select("source_id", F.col("next").alias("target_id")).distinct().withColumn("hops", F.lit(k))
        all_ = all_.unionByName(step)
    return all_.where("source_id <> target_id").groupBy("source_id", "target_id").agg(F.min("hops").alias("hops"))


def tiers(keys: DataFrame, *levels: tuple[str, DataFrame]) -> DataFrame:
    """keys (key) with value and tier: from the first level (name, table of key and value) that has the key."""
    out = keys
    for name, t in levels:
        out = out.join(t.select("key", F.col("value").alias(f"value_{name}")), "key", "left")
    found = [F.when(F.col(f"value_{n}").isNotNull(), F.lit(n)) for n, _ in levels]
    return out.select("key", F.coalesce(*(F.col(f"value_{n}") for n, _ in levels)).alias("value"), F.coalesce(*found, F.lit("miss")).alias("tier"))


def bases(kb: DataFrame, domain_of: DataFrame | None = None) -> DataFrame:
    """The catalog of knowledge bases: kb_id, domain, entity_types, n_entities, trusted. domain_of gives kb_id, domain and trusted."""
    out = kb.groupBy("kb_id").agg(F.array_sort(F.collect_set("entity_type")).alias("entity_types"), F.count(F.lit(1)).alias("n_entities"))
    if domain_of is None:
        return out.withColumn("domain", F.lit(None).cast("string")).withColumn("trusted", F.lit(True))
    return out.join(domain_of.select("kb_id", "domain", "trusted"), "kb_id", "left")


def query_bases(catalog: DataFrame, domain: str | None = None, entity_type: str | None = None, trusted_only: bool = False) -> DataFrame:
    """Knowledge bases of the domain; without one, of the entity type; without either, all; then only trusted ones where that is wanted."""
    d = catalog.where(F.col("domain") == domain) if domain else catalog.where(F.array_contains("entity_types", entity_type)) if entity_type else catalog
    return d.where(F.coalesce("trusted", F.lit(False))) if trusted_only else d


def config_of(catalog: DataFrame, wanted: DataFrame, default_frequency: str = "daily") -> DataFrame:
    """wanted (kb_id) with found and frequency: the knowledge base's own where it is known and has one, else the default."""
    c = catalog.select("kb_id", "frequency", F.lit(True).alias("known"))
    return wanted.join(c, "kb_id", "left").select("kb_id", F.coalesce("known", F.lit(False)).alias("found"), F.coalesce("frequency", F.lit(default_frequency)).alias("frequency"))


class KnowledgeBase:
    """A table of records with the operations that every knowledge base has; relationships is (source_id, target_id, ...)."""

    def __init__(self, kb_id: str, records: DataFrame, relationships: DataFrame | None = None) -> None:
        self.kb_id, self.records, self._relationships = kb_id, records.where(F.col("kb_id") == kb_id), relationships

    def entities(self, entity_type: str | None = None, since: str | None = None) -> DataFrame:
        """Records of a type, changed after a time."""
        d = self.records.where(F.col("entity_type") == entity_type) if entity_type else self.records
        return d.where(F.col("last_updated") > F.lit(since).cast("timestamp")) if since else d

    def lookup(self, texts: DataFrame, entity_type: str | None = None) -> DataFrame:
        """texts (text) with found_id, by name or synonym."""
        chain = texts.sparkSession.createDataFrame([(self.kb_id, 0)], "kb_id string, rank int")
        return lookup(texts, self.entities(entity_type), chain).drop("found_kb")

    def search(self, text: str, entity_type: str | None = None, limit: int = 10) -> DataFrame:
        """Records with the text as name or synonym: a lookup, for there is no other index."""
        names = lookup_keys(self.entities(entity_type)).where(F.col("key") == normalised(F.lit(text)))
        return names.select("entity_id").distinct().orderBy("entity_id").limit(limit)

    def by_id(self, entity_id: str) -> DataFrame:
        return self.records.where(F.col("entity_id") == entity_id)

    def relationships(self, entity_id: str) -> DataFrame:
        if self._relationships is None:
            return self.records.select(F.col("entity_id").alias("source_id"), F.col("entity_id").alias("target_id")).limit(0)
        return self._relationships.where(F.col("source_id") == entity_id)

    def metadata(self, entity_id: str) -> DataFrame:
        return self.by_id(entity_id).select("entity_id", F.explode("metadata").alias("name", "value"))

    def types(self) -> DataFrame:
        return self.records.select("entity_type").distinct()

    def healthy(self) -> bool:
        return not self.records.isEmpty()


def cached_rows(entities: DataFrame, at: Column, ttl_seconds: int = 3600) -> DataFrame:
    """(key, value, expires_at) of records as a cache keeps them: the key from knowledge base, type and normalised name, the value as JSON."""
    key = F.md5(F.concat_ws(":", "kb_id", F.coalesce("entity_type", F.lit("any")), normalised(F.col("text"))))
    value = F.to_json(F.struct("kb_id", "entity_id", "text", "entity_type", "confidence"))
    return entities.select(key.alias("key"), value.alias("value"), (at + F.make_dt_interval(secs=F.lit(ttl_seconds))).alias("expires_at"))


def restored(rows: DataFrame) -> DataFrame:
    """The records in a cache's values; fields left out have their defaults."""
    r = F.from_json("value", "kb_id string, entity_id string, text string, entity_type string, confidence double, synonyms array<string>")
    return rows.select(r.alias("r")).select("r.kb_id", "r.entity_id", "r.text", "r.entity_type", F.coalesce("r.confidence", F.lit(1.0)).alias("confidence"), F.coalesce("r.synonyms", F.array().cast("array<string>")).alias("synonyms"))
