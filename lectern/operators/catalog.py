"""The catalog of models: trust, criteria with fallback, scores, ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import fixed


def trusted(c: DataFrame) -> Column:
    """From a trusted source, accurate enough, and with entity types."""
    source = F.lit(False)
    for s in fixed.TRUSTED_SOURCES:
        source = source | F.col("source_url").contains(s) | F.col("model_id").contains(s)
    return (F.coalesce("trusted", F.lit(False)) | F.coalesce(source, F.lit(False))) & (F.coalesce(F.col("performance.f1_score"), F.lit(0.0)) >= 0.70) & (F.size("entity_types") > 0)


def matches(min_f1: float = 0.70, max_latency: float = 500.0, types: Sequence[str] = (), max_memory: float = 8000.0, prefer_trusted: bool = True) -> Column:
    """The criteria of a selection as a condition on catalog rows."""
    ok = (F.col("performance.f1_score") >= min_f1) & (F.col("performance.latency_ms") <= max_latency) & (F.coalesce("size_mb", F.lit(0.0)) <= max_memory)
    if prefer_trusted:
        ok = ok & F.col("trusted")
    if types:
        ok = ok & (F.size(F.array_except(F.array(*map(F.lit, types)), "entity_types")) == 0)
    return F.coalesce(ok, F.lit(False))


def score(max_latency: float, preferred: Sequence[str], types: Sequence[str]) -> Column:
    """Accuracy up to 50 points, speed up to 30, trust 10, a preferred provider 5, coverage of the types wanted up to 5."""
    speed = F.greatest(F.lit(0.0), 30 * (1 - F.col("performance.latency_ms") / max_latency)) if max_latency else F.lit(0.0)
    wanted = F.array(*map(F.lit, types)) if types else None
    cover = F.size(F.array_intersect("entity_types", wanted)) / len(set(types)) * 5 if types else F.lit(0.0)
    return F.col("performance.f1_score") * 50 + speed + F.when(F.col("trusted"), 10.0).otherwise(0.0) + F.when(F.col("provider").isin(list(preferred)), 5.0).otherwise(0.0) + cover


def ranked(catalog: DataFrame, domain: str, min_f1: float, max_latency: float, preferred: Sequence[str], types: Sequence[str]) -> DataFrame:
    """Models of a domain within the limits of accuracy and latency that meet the other criteria too, or all within the limits if none does,
    best first; ties go by catalog order. Adds score and position."""
    d = query(catalog, domain=domain, min_f1=min_f1, max_latency=max_latency).withColumn("meets", matches(min_f1, max_latency, types))
    d = d.withColumn("any_meets", F.max("meets").over(Window.partitionBy("domain"))).where("meets OR NOT any_meets")
    d = d.withColumn("score", F.round(score(max_latency, preferred, types), 6))
    return d.withColumn("position", F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("score"), "catalog_ord"))).drop("any_meets")


def query(catalog: DataFrame, provider: str | None = None, domain: str | None = None, min_f1: float | None = None, max_latency: float | None = None, types: Sequence[str] = ()) -> DataFrame:
    """Rows of the provider and domain given, that keep the limits given."""
    d = catalog
    if provider:
        d = d.where(F.col("provider") == provider)
    if domain:
        d = d.where(F.col("domain") == domain)
    if min_f1 is not None:
        d = d.where(F.col("performance.f1_score") >= min_f1)
    if max_latency is not None:
        d = d.where(F.col("performance.latency_ms") <= max_latency)
    return d.where(F.size(F.array_except(F.array(*map(F.lit, types)), "entity_types")) == 0) if types else d


MODEL_TYPE = "catalog_ord int, model_id string, provider string, domain string, performance struct<f1_score:double,latency_ms:double>, entity_types array<string>, trusted boolean, size_mb double, source_url string, requires_kb array<string>"


def known_models(spark) -> DataFrame:
    """The built-in catalog."""
    rows = [(i, m, p, d, {"f1_score": f, "latency_ms": lat}, t, True, fixed.MODEL_SIZES[i], fixed.MODEL_SOURCES[i], fixed.MODEL_KBS.get(m, [])) for i, (m, p, d, f, lat, t) in enumerate(fixed.MODELS)]
    return spark.createDataFrame(rows, MODEL_TYPE)


def by_type(catalog: DataFrame) -> DataFrame:
    """The catalog's index by entity type."""
    return catalog.select(F.explode("entity_types").alias("entity_type"), "model_id")


def short_id(model_id: Column) -> Column:
    """A model's name without the prefix of its family."""
    out = model_id
    for prefix in ("spacy/", "scispacy/"):
        out = F.replace(out, F.lit(prefix), F.lit(""))
    return out


def discovered(listings: DataFrame) -> DataFrame:
    """Models of all providers' listings that are to be trusted. A provider whose listing fails has an empty one."""
    return listings.where(trusted(listings))


def merged(catalog: DataFrame, found: DataFrame) -> DataFrame:
    """catalog with the models found that it does not have; of a model found twice the first in order. Columns are those of the catalog."""
    new = found.groupBy("model_id").agg(F.min_by(F.struct(*[c for c in catalog.columns if c != "model_id"]), "catalog_ord").alias("m")).select("model_id", "m.*")
    return catalog.unionByName(new.join(catalog.select("model_id"), "model_id", "left_anti").select(*catalog.columns))


def without(catalog: DataFrame, provider: str) -> DataFrame:
    """The catalog after a provider has been taken out."""
    return catalog.where(~F.coalesce(F.col("provider") == provider, F.lit(False)))


def from_hub(hub: DataFrame, known: DataFrame, domain: str, most: int = 10, popular: int = 1000) -> DataFrame:
    """Models of a hub (model_id, tags, downloads, description) for a domain that are not known: the most loaded of each of the domain's tags.

    Their accuracy is an estimate; trusted are those loaded often enough.
    """
    tags = fixed.HUB_TAGS.get(domain, [domain])
    each = hub.select("model_id", "downloads", "description", F.explode("tags").alias("tag")).where(F.col("tag").isin(tags))
    top = each.withColumn("k", F.row_number().over(Window.partitionBy("tag").orderBy(F.desc("downloads"), "model_id"))).where(F.col("k") <= most)
    one = top.groupBy("model_id").agg(F.max("downloads").alias("downloads"), F.max("description").alias("description")).join(known.select("model_id"), "model_id", "left_anti")
    return one.select("model_id", F.lit(domain).alias("domain"), F.lit(0.80).alias("f1_score"), F.lit(100.0).alias("latency_ms"), (F.col("downloads") > popular).alias("trusted"), F.coalesce("description", F.lit("")).alias("description"))
