"""Providers of annotation: a chain of them with fallback, and reading through a cache."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import fixed

Annotate = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Provider:
    """name, what it can do, and a function from (key, text) to (key, result); a null result is a failure for that text."""

    name: str
    annotate: Annotate
    capabilities: frozenset[str] = frozenset(fixed.CAPABILITY_OF.values())
    healthy: Callable[[], bool] = lambda: True


@dataclass
class Providers:
    """The known providers by name, the primary one and the fallbacks in order."""

    table: dict[str, Provider] = field(default_factory=dict)
    primary: str | None = None
    fallbacks: list[str] = field(default_factory=list)

    def register(self, p: Provider) -> Providers:
        self.table[p.name] = p
        self.primary = self.primary or p.name
        return self

    def unregister(self, name: str) -> Providers:
        self.table.pop(name, None)
        return self

    def switch(self, name: str) -> Providers:
        if name not in self.table:
            raise ValueError(f"Provider {name} not available")
        self.primary = name
        return self

    def chain(self) -> list[Provider]:
        return [self.table[n] for n in dict.fromkeys([self.primary, *self.fallbacks]) if n in self.table]

    def status(self, spark) -> DataFrame:
        """(provider, role, status) of all providers; a check that fails counts as unavailable."""
        rows = []
        for n, p in self.table.items():
            try:
                up = p.healthy()
            except Exception:  # noqa: BLE001 - a check may fail in any way
                up = False
            role = "primary" if n == self.primary else "fallback" if n in self.fallbacks else "other"
            rows.append((n, role, "healthy" if up else "unavailable", sorted(p.capabilities)))
        return spark.createDataFrame(rows, "provider string, role string, status string, capabilities array<string>")

    def annotate(self, docs: DataFrame, key: str) -> DataFrame:
        """docs (key, text) with result, provider, attempted and fallback_used: each text by the first provider of the chain that has a result.

        A provider that is not healthy is attempted by none. Each one sees only the texts that those before it failed on. Where all fail,
        result and provider are null and attempted names all.
        """
        todo = docs.select(key, "text").withColumn("attempted", F.array().cast("array<string>"))
        done = None
        for i, p in enumerate(self.chain()):
            if not p.healthy():
                todo = todo.withColumn("attempted", F.concat("attempted", F.array(F.lit(p.name))))
                continue
            tried = todo.join(p.annotate(todo.select(key, "text")).select(key, "result"), key, "left")
            good = tried.where("result IS NOT NULL").select(key, "result", F.lit(p.name).alias("provider"), "attempted", F.lit(i > 0).alias("fallback_used"))
            done = good if done is None else done.unionByName(good)
            todo = tried.where("result IS NULL").select(key, "text", F.concat("attempted", F.array(F.lit(p.name))).alias("attempted"))
        none = todo.select(key, F.lit(None).cast("string").alias("result"), F.lit(None).cast("string").alias("provider"), "attempted", F.lit(False).alias("fallback_used"))
        return none if done is None else done.unionByName(none)


def read_through(docs: DataFrame, key: str, cached: DataFrame, annotate: Annotate, longest: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """docs (key, text, cache_key) with result and origin, and the rows (cache_key, value) to add to the cache.

    Texts that are empty or too long are rejected and never looked up. cached is (cache_key, value), the latest value of a key counts once.
    Texts that share a cache key are annotated once. A null result is no result: its origin is failed, and it is not cached.
    """
    fit = F.coalesce((F.char_length("text") > 0) & (F.char_length("text") <= longest), F.lit(False))
    d = docs.withColumn("fit", fit)
    have = d.where("fit").join(cached.select("cache_key", "value").dropDuplicates(["cache_key"]), "cache_key", "left")
    missing = have.where("value IS NULL").groupBy("cache_key").agg(F.min_by("text", key).alias("text"))
    made = annotate(missing).select("cache_key", "result")
    out = have.join(made, "cache_key", "left").select(key, F.coalesce("value", "result").alias("result"), F.when(F.col("value").isNotNull(), "cache").when(F.col("result").isNotNull(), "provider").otherwise("failed").alias("origin"))
    rejected = d.where("NOT fit").select(key, F.lit(None).cast("string").alias("result"), F.lit("rejected").alias("origin"))
    return out.unionByName(rejected), made.where("result IS NOT NULL").select("cache_key", F.col("result").alias("value"))


def first_healthy(providers: Iterable[Provider]) -> Provider | None:
    """The provider to begin with."""
    return next((p for p in providers if p.healthy()), None)
