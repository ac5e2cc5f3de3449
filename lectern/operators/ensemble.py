"""Merging the span lists of several models of a document: votes on equal spans, union, intersection, agreement.

entities: doc_id, model_ord, ent_ord, text, type, start, end, confidence and, where there is one, model_id; a null confidence counts as 1.0.
ran: doc_id, model_ord, weight of every model that ran on a document, those that found nothing or failed included, for an empty list is
a result too. Without ran, the models are those that reported something, with the weights in entities.

Merged rows are doc_id, start, end, type, text, confidence, model_id ("ensemble", or the model's own where its row is kept) and sources, the
models behind the span in model order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["doc_id", "start", "end"]
OUT = [*KEYS, "type", "text", "confidence", "model_id", "sources"]
MERGED = "ensemble"


def _reports(entities: DataFrame) -> DataFrame:
    own = F.col("model_id") if "model_id" in entities.columns else F.lit(None).cast("string")
    return entities.withColumn("model_id", own).withColumn("confidence", F.coalesce("confidence", F.lit(1.0)))


def models_ran(entities: DataFrame, ran: DataFrame | None) -> DataFrame:
    """(doc_id, model_ord, weight), each model of each document once; of repeated rows the largest weight counts."""
    return (entities if ran is None else ran).groupBy("doc_id", "model_ord").agg(F.max(F.coalesce("weight", F.lit(1.0))).alias("weight"))


def _totals(entities: DataFrame, ran: DataFrame | None) -> DataFrame:
    return models_ran(entities, ran).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_models"), F.sum("weight").alias("total"))


_ORDER = ("model_ord", "ent_ord")


def _typed(reports: DataFrame, weight: Column) -> DataFrame:
    """Votes for each type of each span: partial sums on the map side, so a span that everybody reports stays small."""
    said = F.array_sort(F.collect_list(F.struct("model_ord", "ent_ord", F.col("model_id").alias("id"))))
    return reports.groupBy(*KEYS, "type").agg(
        F.count(F.lit(1)).alias("votes"),
        F.min(F.struct(*_ORDER)).alias("first_seen"),
        F.avg("confidence").alias("mean"),
        F.min_by("text", F.struct(*_ORDER)).alias("text"),
        F.sum(weight).alias("weight"),
        F.sum(F.col("confidence") * weight).alias("weighted"),
        said.alias("said"),
    )


def _sources() -> Column:
    said = F.array_sort(F.flatten(F.collect_list("said")))
    return F.filter(F.transform(said, lambda x: x["id"]), lambda x: x.isNotNull())


def _best(measure: str) -> Column:
    """The type with the largest measure; of equals the one seen first in model order."""
    return F.max(F.struct(measure, (-F.col("first_seen.model_ord")).alias("m"), (-F.col("first_seen.ent_ord")).alias("e"), "type", "text", "mean", F.element_at("said", 1)["id"].alias("id"))).alias("best")


def _made(t: DataFrame, confidence: Column, model_id: Column | None = None) -> DataFrame:
    return t.select(*KEYS, F.col("best.type").alias("type"), F.col("best.text").alias("text"), confidence.alias("confidence"), (F.lit(MERGED) if model_id is None else model_id).alias("model_id"), "sources")


def majority(entities: DataFrame, ran: DataFrame | None = None) -> DataFrame:
    """The type with most votes on each span; ties go to the one seen first in model order. A lone report counts 0.7 of its confidence.

    The share of the winner is over the reports of the span, not over the models that ran.
    """
    t = _typed(_reports(entities), F.lit(1.0)).groupBy(*KEYS).agg(F.sum("votes").alias("all_votes"), _best("votes"), _sources().alias("sources"))
    many = F.least(F.col("best.mean") * (0.5 + 0.5 * F.col("best.votes") / F.col("all_votes")), F.lit(1.0))
    alone = F.col("all_votes") == 1
    return _made(t, F.when(alone, F.col("best.mean") * 0.7).otherwise(many), F.when(alone, F.col("best.id")).otherwise(F.lit(MERGED)))


def weighted(entities: DataFrame, ran: DataFrame | None = None) -> DataFrame:
    """The type with the largest sum of weights, which add up to 1 over all models that ran on the document."""
    r, models = _reports(entities), models_ran(entities, ran)
    r = r.drop("weight").join(models, ["doc_id", "model_ord"], "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    t = _typed(r, F.col("weight")).withColumn("mean", F.when(F.col("weight") > 0, F.col("weighted") / F.col("weight")).otherwise(F.lit(0.5)))
    t = t.join(_totals(entities, ran).drop("n_models"), "doc_id").withColumn("part", F.round(F.coalesce(F.col("weight") / F.nullif(F.col("total"), F.lit(0.0)), F.lit(0.0)), 12))
    t = t.groupBy(*KEYS).agg(_best("part"), _sources().alias("sources"))
    return _made(t, F.least(F.col("best.mean") * F.col("best.part"), F.lit(1.0)))


def union(entities: DataFrame, ran: DataFrame | None = None) -> DataFrame:
    """All spans in order of place; one that overlaps a kept one takes its place only with a strictly higher confidence.

    The choice depends on the order, so it is a fold over each document's sorted spans, which a document's length bounds.
    """
    kind = "array<struct<start:int,end:int,type:string,text:string,confidence:double,model_id:string>>"
    item = F.struct(F.col("start"), F.col("end"), F.col("model_ord"), F.col("ent_ord"), F.col("type"), F.col("text"), F.col("confidence"), F.col("model_id"))
    names = ("start", "end", "type", "text", "confidence", "model_id")
    listed = F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(*(x[n].alias(n) for n in names)))
    docs = _reports(entities).groupBy("doc_id").agg(listed.alias("all"))

    def step(acc: Column, x: Column) -> Column:
        hit = F.array_position(F.transform(acc, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])), True).cast("int")
        better = F.transform(acc, lambda y, i: F.when((i + 1 == hit) & (x["confidence"] > y["confidence"]), x).otherwise(y))
        return F.when(hit == 0, F.concat(acc, F.array(x))).otherwise(better)

    kept = F.aggregate("all", F.expr(f"cast(array() as {kind})"), step)
    return docs.select("doc_id", F.explode(kept).alias("e")).select("doc_id", *(f"e.{n}" for n in names), F.filter(F.array("e.model_id"), lambda x: x.isNotNull()).alias("sources"))


def intersection(entities: DataFrame, ran: DataFrame | None = None) -> DataFrame:
    """Spans that every model that ran on the document has: the first entity of each model counts. A model with an empty list leaves none."""
    first = _reports(entities).groupBy(*KEYS, "model_ord").agg(F.min_by(F.struct("type", "text", "confidence", "ent_ord", "model_id"), "ent_ord").alias("f")).select(*KEYS, "model_ord", "f.*")
    # the vote goes to the type seen first; the text is that of the first model
    t = _typed(first, F.lit(1.0)).groupBy(*KEYS).agg(F.sum("votes").alias("have"), _best("votes"), F.min(F.struct("first_seen", "text")).alias("one"), (F.sum(F.col("mean") * F.col("votes")) / F.sum("votes")).alias("all_mean"), _sources().alias("sources"))
    t = t.join(_totals(entities, ran).drop("total"), "doc_id").where("have = n_models")
    return t.select(*KEYS, F.col("best.type").alias("type"), F.col("one.text").alias("text"), F.least(F.col("all_mean") * 1.2, F.lit(1.0)).alias("confidence"), F.lit(MERGED).alias("model_id"), "sources")


def agreement(entities: DataFrame, ran: DataFrame | None = None) -> DataFrame:
    """(doc_id, agreement) of every document on which a model ran.

    Mean over a document's spans: the share of the leading type where there are as many reports as models, else half their share of the
    models; 1 for one model, or without any span.
    """
    spans = _typed(_reports(entities), F.lit(1.0)).groupBy(*KEYS).agg(F.sum("votes").alias("n"), F.max("votes").alias("lead"))
    each = F.when(F.col("n") == F.col("n_models"), F.col("lead") / F.col("n")).otherwise(F.col("n") / F.col("n_models") * 0.5)
    per = _totals(entities, ran).join(spans, "doc_id", "left").withColumn("each", each).groupBy("doc_id").agg(F.max("n_models").alias("n_models"), F.avg("each").alias("mean"))
    return per.select("doc_id", F.when(F.col("n_models") <= 1, F.lit(1.0)).otherwise(F.coalesce("mean", F.lit(1.0))).alias("agreement"))


STRATEGIES = {"majority_vote": majority, "weighted_vote": weighted, "union": union, "intersection": intersection}


def merge(entities: DataFrame, strategy: str, ran: DataFrame | None = None) -> DataFrame:
    """By the named strategy, or by majority for an unknown name; documents on which one model ran keep its entities unchanged."""
    n = _totals(entities, ran).select("doc_id", "n_models")
    tagged = _reports(entities).join(n, "doc_id")
    alone = tagged.where("n_models <= 1").select(*KEYS, "type", "text", "confidence", "model_id", F.filter(F.array("model_id"), lambda x: x.isNotNull()).alias("sources"))
    return STRATEGIES.get(strategy, majority)(tagged.where("n_models > 1").drop("n_models"), ran).select(*OUT).unionByName(alone)
