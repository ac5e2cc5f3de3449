"""Sources: text files, schema files, tables, databases, services. Everything returns a DataFrame; nothing is read on the driver but settings."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, fields
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

@dataclass(frozen=True)
class Settings:
    """Settings of a run, from the environment where it names them."""

    environment: str = "development"
    database_url: str = "sqlite:///lectern.db"
    secret_key: str = ""
    nlp_provider: str = "spacy"
    max_text_length: int = 100_000
    cache_ttl: int = 3600
    request_timeout: int = 300

    @classmethod
    def from_environment(cls, env: Mapping[str, str], prefix: str = "LECTERN_") -> Settings:
        """Values of other types than text are converted; one that cannot be is left at its default."""
        out = {}
        for f in fields(cls):
            raw = env.get(prefix + f.name.upper())
            if raw is not None:
                try:
                    out[f.name] = type(f.default)(raw)
                except ValueError:
                    continue
        return cls(**out)

    def get(self, name: str, default: object = None) -> object:
        return getattr(self, name, default)


TEXT_ENDINGS = (".txt", ".text", ".md", ".markdown")
MAX_UPLOAD_BYTES = 102_400


def text_files(spark: SparkSession, path: str, max_bytes: int = MAX_UPLOAD_BYTES) -> DataFrame:
    """(path, size, text, problem) of the files of a folder: text is null where there is a problem (ending, size, encoding)."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ending = F.lit(False)
    for e in TEXT_ENDINGS:
        ending = ending | F.lower("path").endswith(e)
    problem = F.when(~ending, "type").when(F.col("length") > max_bytes, "too large").when(~F.is_valid_utf8(F.col("content").cast("string")), "encoding")
    return f.select("path", F.col("length").alias("size"), problem.alias("problem"), F.when(problem.isNull(), F.col("content").cast("string")).alias("text"))


SCHEMA_FIELDS = "domain string, title string, annotation_strategy string, include_pos boolean, include_lemma boolean, include_dependencies boolean, include_analysis boolean, use_paragraphs boolean, entity_mappings map<string,string>, classification boolean, text_class string"


def schema_files(spark: SparkSession, path: str) -> DataFrame:
    """Schemas of a folder of JSON files; the file's name is the domain where none is given; files that are no JSON are left out."""
    f = spark.read.schema(SCHEMA_FIELDS + ", _corrupt string").option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(f"{path}/*.json")
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"([^/]*)\.json$", 1)
    return f.select("*", stem.alias("_stem")).where("_corrupt IS NULL").withColumn("domain", F.coalesce("domain", "_stem")).drop("_corrupt", "_stem")


def schema_problems(schema: dict, strategies: tuple[str, ...] = ("inline", "standoff", "mixed")) -> list[str]:
    """What is wrong with a schema."""
    missing = [f"Missing required field: {k}" for k in ("domain", "annotation_strategy") if k not in schema]
    wrong = [f"Invalid annotation strategy: {schema['annotation_strategy']}"] if schema.get("annotation_strategy", strategies[0]) not in strategies else []
    mapped = ["entity_mappings must be a dictionary"] if not isinstance(schema.get("entity_mappings", {}), dict) else []
    return missing + wrong + mapped


def settings(path: str | None, defaults: list[dict]) -> list[dict]:
    """Pipeline settings: the files *.json of a folder over the defaults, by domain; a domain unknown to both gets those of general."""
    table = {d["domain"]: dict(d) for d in defaults}
    for f in sorted(Path(path).glob("*.json")) if path else []:
        try:
            own = json.loads(f.read_text())
        except ValueError:
            continue
        if isinstance(own, dict) and own.get("domain"):
            table[own["domain"]] = table.get(own["domain"], {**table.get("general", {}), "domain": own["domain"]}) | own
    return list(table.values())


def jdbc_table(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 16, **options: str) -> DataFrame:
    """A table of a database, read in parts over a numeric key where its bounds are given."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if key and bounds:
        r = r.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return r.load()


def transient(error: Exception) -> bool:
    """Whether a call that failed so is worth another try: no connection, a timeout, or an answer that the service is overloaded."""
    return isinstance(error, (ConnectionError, TimeoutError)) or getattr(error, "status", getattr(error, "code", None)) == 503


def service(df: DataFrame, text: str, make_client: Callable[[], Callable[[str], str]], attempts: int = 3, base_seconds: float = 1.0) -> DataFrame:
    """df with columns result, what a text service says of each text, and problem, the error of a text that it failed on (result is null then).

    A client is made once for each partition. Only transient failures are tried again, after 1, 2, 4 and so on times base_seconds.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()

        def ask(t: str | None) -> tuple[str | None, str | None]:
            if t is None:
                return None, None
            for k in range(attempts):
                try:
                    return client(t), None
                except Exception as e:  # noqa: BLE001 - told in the column problem
                    if not transient(e) or k + 1 == attempts:
                        return None, f"{type(e).__name__}: {e}"
                    time.sleep(base_seconds * 2**k)
            return None, None

        for b in batches:
            said = [ask(t) for t in b[text]]
            yield b.assign(result=[r for r, _ in said], problem=[p for _, p in said])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, columns + ", result string, problem string")


def healthy(spark: SparkSession) -> bool:
    return spark.sql("SELECT 1").first()[0] == 1
