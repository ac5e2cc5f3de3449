"""The pipeline of a domain: choose models, extract, merge, look up, report, all in one lazy plan."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.operators import catalog, ensemble, knowledge
from lectern.operators.patterns import Rule, extract, rules_of

Annotator = Callable[[DataFrame], DataFrame]


Model = Callable[[list[str]], list[list[tuple[str, str, int, int, float]]]]
_loaded: dict[str, Model] = {}


def model_annotator(load: Callable[[], Callable], batched: bool = False, name: str | None = None) -> Annotator:
    """An annotator from a model, which load gives: a function from text to (text, type, start, end, confidence), or, if batched, from a list
    of texts to a list of such lists.

    A worker process loads the model once and keeps it under its name for later tasks; without a name it is kept for this annotator only. A
    batch that the model fails on gives no entities: it has run and found nothing. Null and empty texts are not shown to it.
    """
    key = name or uuid.uuid4().hex

    def annotate(docs: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from lectern.plans import pipeline

            model = pipeline._loaded.get(key) or pipeline._loaded.setdefault(key, load())
            for b in batches:
                b = b[b["text"].notna() & (b["text"] != "")]
                texts = b["text"].tolist()
                try:
                    found = model(texts) if batched else [model(t) for t in texts]
                except Exception:  # noqa: BLE001 - a model may fail in any way
                    found = [[] for _ in texts]
                rows = [(d, i, *e) for d, said in zip(b["doc_id"], found) for i, e in enumerate(said)]
                yield pd.DataFrame(rows, columns=["doc_id", "ent_ord", "text", "type", "start", "end", "confidence"])

        return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, ent_ord int, text string, type string, start int, end int, confidence double")

    return annotate


@dataclass
class Pipeline:
    """domain's settings, annotators in model order with weights, rules of its own, and a knowledge base with its chain."""

    domain: str
    annotators: dict[str, tuple[Annotator, float]] = field(default_factory=dict)
    rules: list[Rule] = field(default_factory=list)
    kb: DataFrame | None = None
    chain: DataFrame | None = None
    use_patterns: bool = True
    use_kb: bool = True
    strategy: str | None = None

    @property
    def settings(self) -> dict:
        table = {p["domain"]: p for p in fixed.PIPELINES}
        return {**table.get(self.domain, table["general"]), "domain": self.domain}

    def models(self, models: DataFrame) -> DataFrame:
        """The best models of a catalog for the domain."""
        p = self.settings
        return catalog.ranked(models, self.domain, p["min_f1_score"], p["max_latency_ms"], p["preferred_providers"], p["entity_types"]).where(F.col("position") <= p["max_models"])

    def add_model(self, name: str, annotator: Annotator, weight: float = 1.0) -> Pipeline:
        self.annotators[name] = (annotator, weight)
        return self

    def remove_model(self, name: str) -> Pipeline:
        self.annotators.pop(name, None)
        return self

    def extracted(self, docs: DataFrame) -> DataFrame | None:
        """What all annotators say, in model order."""
        out = None
        for i, (annotate, weight) in enumerate(self.annotators.values()):
            one = annotate(docs).withColumn("model_ord", F.lit(i)).withColumn("weight", F.lit(float(weight)))
            out = one if out is None else out.unionByName(one)
        return out

    def ran(self, docs: DataFrame) -> DataFrame:
        """(doc_id, model_ord, weight): every annotator runs on every document, whatever it finds."""
        models = F.array(*(F.struct(F.lit(i).alias("model_ord"), F.lit(float(w)).alias("weight")) for i, (_, w) in enumerate(self.annotators.values())))
        return docs.select("doc_id", F.explode(models).alias("m")).select("doc_id", "m.*")

    def agreement(self, docs: DataFrame) -> DataFrame:
        """(doc_id, agreement) of docs; 1 with fewer than two annotators."""
        if len(self.annotators) < 2:
            return docs.select("doc_id", F.lit(1.0).alias("agreement"))
        return ensemble.agreement(self.extracted(docs), self.ran(docs))

    def found(self, docs: DataFrame) -> DataFrame:
        """(doc_id, start, end, type, text, confidence, source) of docs (doc_id, text), before any lookup."""
        said, parts = self.extracted(docs), []
        if said is not None:
            # one annotator has nothing to be merged with
            merged = ensemble.merge(said, self.strategy or self.settings["ensemble_strategy"], self.ran(docs)) if len(self.annotators) > 1 else said
            parts.append(merged.select(*ensemble.KEYS, "type", "text", "confidence").withColumn("source", F.lit("model")))
        if self.use_patterns:
            found = extract(docs.where("text IS NOT NULL"), rules_of(self._rule_domain, self.rules), "doc_id", "text")
            parts.append(found.select("doc_id", "start", "end", F.col("entity_type").alias("type"), "text", "confidence", F.lit("rules").alias("source")))
        if not parts:
            return docs.sparkSession.createDataFrame([], "doc_id long, start int, end int, type string, text string, confidence double, source string")
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def statistics(self) -> dict:
        """What the pipeline is made of."""
        return {
            "domain": self.domain,
            "active_models": len(self.annotators),
            "model_ids": list(self.annotators),
            "model_weights": [w for _, w in self.annotators.values()],
            "ensemble_strategy": self.strategy or self.settings["ensemble_strategy"],
            "pattern_matching_enabled": self.use_patterns,
            "kb_enrichment_enabled": self.kb is not None and self.chain is not None and self.use_kb,
            "pattern_count": len(rules_of(self._rule_domain, self.rules)),
        }

    @property
    def _rule_domain(self) -> str:
        return self.domain if self.domain in ("medical", "legal", "financial") else "general"

    def entities(self, docs: DataFrame) -> DataFrame:
        """(doc_id, start, end, type, text, confidence, source, found_kb, found_id) of docs (doc_id, text)."""
        out = self.found(docs)
        if self.kb is None or self.chain is None or not self.use_kb:
            return out.withColumn("found_kb", F.lit(None).cast("string")).withColumn("found_id", F.lit(None).cast("string"))
        return knowledge.lookup(out, self.kb, self.chain)

    def documents(self, docs: DataFrame) -> DataFrame:
        """One row for each document: its entities as one array in both naming styles, hit rate and counts; empty for one without any."""
        return reported(docs, self.entities(docs))


def reported(docs: DataFrame, entities: DataFrame) -> DataFrame:
    """One row for each document of docs with its looked-up entities."""
    each = F.struct("start", "end", "type", F.col("type").alias("label"), "text", "confidence", "source", "found_id")
    made = entities.groupBy("doc_id").agg(F.array_sort(F.collect_list(each)).alias("entities"), F.round(F.avg(F.col("found_id").isNotNull().cast("int")), 6).alias("kb_hit_rate"))
    empty = F.expr("cast(array() as array<struct<start:int,end:int,type:string,label:string,text:string,confidence:double,source:string,found_id:string>>)")
    out = docs.select("doc_id").join(made, "doc_id", "left")
    return out.select("doc_id", F.coalesce("entities", empty).alias("entities"), F.coalesce("kb_hit_rate", F.lit(0.0)).alias("kb_hit_rate"))
