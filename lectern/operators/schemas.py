"""The table of document schemas: information, changes, export."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.operators import tei

_BUILT_IN = frozenset(s["domain"] for s in fixed.SCHEMAS)


def domains(table: DataFrame) -> DataFrame:
    """One row with the sorted list of domains."""
    return table.agg(F.array_sort(F.collect_set("domain")).alias("domains"))


def info(table: DataFrame) -> DataFrame:
    """What a schema is for and can do, one row for each domain; absent flags are false, absent texts have a stock phrase."""
    features = {"pos_tags": "include_pos", "lemmas": "include_lemma", "dependencies": "include_dependencies", "morphology": "include_morph", "analysis": "include_analysis"}
    return table.select(
        "domain",
        F.coalesce("title", F.lit("Unknown")).alias("title"),
        F.coalesce("description", F.lit("No description available")).alias("description"),
        F.coalesce("annotation_strategy", F.lit("inline")).alias("annotation_strategy"),
        F.coalesce(F.array_sort(F.map_keys("entity_mappings")), F.array().cast("array<string>")).alias("entity_types"),
        F.coalesce("additional_tags", F.array().cast("array<string>")).alias("additional_tags"),
        F.struct(*(F.coalesce(c, F.lit(False)).alias(n) for n, c in features.items())).alias("features"),
        (~F.col("domain").isin(*sorted(_BUILT_IN))).alias("is_custom"),
    )


def mappings(table: DataFrame) -> DataFrame:
    """(domain, entity_type, element) of every schema."""
    return table.select("domain", F.explode("entity_mappings").alias("entity_type", "element"))


def updated(own: list[dict], domain: str, updates: dict) -> list[dict]:
    """own schemas with that of the domain changed field by field; a built-in one becomes an own one of the same name, an unknown one grows
    from the default."""
    table = {s["domain"]: s for s in fixed.SCHEMAS} | {s["domain"]: s for s in own}
    new = {**table.get(domain, table["default"]), **updates, "domain": domain}
    return [s for s in own if s["domain"] != domain] + [new]


def saved(schema: dict, folder: str) -> str:
    """Writes one own schema as a JSON file of its domain's name; schemas are small and are kept by the driver."""
    path = Path(folder, f"{schema['domain']}.json")
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(schema, indent=2, ensure_ascii=False))
    return str(path)


def exported(spark: SparkSession, path: str, own: list[dict] | None = None) -> None:
    """Writes all schemas as JSON lines, one file for each domain."""
    t = tei.schemas(spark, own)
    t.withColumn("of", F.col("domain")).write.mode("overwrite").partitionBy("of").json(path)
