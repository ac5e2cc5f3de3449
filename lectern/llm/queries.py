"""Queries over the operators of this subpackage, and the SQL that checks those that SQL can express."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import consensus, format_dups, names, packing, sentences, splitting, subjects, tokenize
from lectern.session import cut, read_table, shared_folder

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# --- 8: encoding --------------------------------------------------------------------------------------------------------------------


@query
def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode_column(read_table(spark, d, "documents"), "doc_id", "text")


# --- 9: packing ---------------------------------------------------------------------------------------------------------------------


def _packed(spark: SparkSession, d: str) -> DataFrame:
    sizes = cut(tokenize.count_column(read_table(spark, d, "documents"), "doc_id", "text"))
    return packing.pack(sizes, read_table(spark, d, "pack_specs"))


@query
def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


@query
def p9_report(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers of each spec are, against the least number that could hold the tokens."""
    each = _packed(spark, d).groupBy("spec_id", "container").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("pieces"))
    specs = read_table(spark, d, "pack_specs").select("spec_id", "capacity_tokens")
    per = each.groupBy("spec_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), F.sum("pieces").alias("pieces"), F.max("tokens").alias("fullest"))
    least = F.ceil(F.col("tokens") / F.col("capacity_tokens"))
    return per.join(specs, "spec_id").select("spec_id", "containers", least.alias("least_containers"), "tokens", "pieces", "fullest", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("fill"))


# --- 6: copies hidden by formatting -------------------------------------------------------------------------------------------------


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return format_dups.copies(read_table(spark, d, "processed_texts"))


@query
def p6_records(spark: SparkSession, d: str) -> DataFrame:
    return format_dups.groups(read_table(spark, d, "processed_texts")).select("id_first", "n_copies")


# --- 3: sentence units --------------------------------------------------------------------------------------------------------------


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_units(read_table(spark, d, "processed_texts")).select("id", "start_char", "end_char")


# --- 4: pieces within the models' limits --------------------------------------------------------------------------------------------


def _split(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_texts(read_table(spark, d, "processed_texts"), read_table(spark, d, "model_catalog"))


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d).where("piece_no = 0").select("id", "model_id")


@query
def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.numbered(_split(spark, d))


@query
def p4_file_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The texts written out as files of many texts each, in the shared folder, and those files split by byte ranges: pieces and characters of each."""
    texts = read_table(spark, d, "processed_texts").where("text IS NOT NULL").select("id", "text")
    folder = f"{shared_folder(spark)}/p4-files-{uuid.uuid4().hex}"
    texts.repartitionByRange(8, "id").sortWithinPartitions("id").select("text").write.option("lineSep", "\n\n").text(folder)
    out = splitting.split_files(spark, [f"{folder}/*.txt"], limit=2000, overlap=100, range_bytes=1 << 20)
    file_no = F.regexp_extract("path", r"part-(\d+)", 1).cast("int")
    return out.groupBy(file_no.alias("file_no")).agg(F.count(F.lit(1)).alias("pieces"), F.max("end_char").alias("chars"), F.max(F.col("end_char") - F.col("start_char")).alias("longest"))


ORACLES["p4_found"] = """
  SELECT DISTINCT t.id, m.model_id FROM processed_texts t JOIN model_catalog m ON t.domain = m.domain WHERE length(t.text) > m.max_sequence_length AND m.max_sequence_length > 0
"""


# --- 5: consensus of annotators -----------------------------------------------------------------------------------------------------


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    found, _ = consensus.consensus(read_table(spark, d, "model_entities"))
    return found.where("n_models >= 2 AND entity_type <> 'NONE'").select("doc_id", "start_char", "end_char", "entity_type")


@query
def p5_mentions(spark: SparkSession, d: str) -> DataFrame:
    return consensus.consensus(read_table(spark, d, "model_entities"))[0]


@query
def p5_reliability(spark: SparkSession, d: str) -> DataFrame:
    _, table = consensus.consensus(read_table(spark, d, "model_entities"))
    return spark.createDataFrame(table, "model_ord int, right_when_reported double, share_found double, repeats_another double")


# --- 10: subject areas --------------------------------------------------------------------------------------------------------------


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    documents = read_table(spark, d, "documents")
    classifier = subjects.fit(documents, read_table(spark, d, "subject_labels"), read_table(spark, d, "subjects"))
    return subjects.assign(documents, classifier)


@query
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d)


@query
def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    """The corpus by subject: documents about it, and their share of all documents with a text."""
    found = _subjects(spark, d)
    per = found.groupBy("subject").agg(F.count(F.lit(1)).alias("documents"))
    texts = read_table(spark, d, "documents").where(r"text RLIKE '(?s).*\\S.*'").agg(F.count(F.lit(1)).alias("all"))
    return per.crossJoin(F.broadcast(texts)).select("subject", "documents", F.round(F.col("documents") / F.col("all"), 6).alias("share"))


# --- 1: spellings of names ----------------------------------------------------------------------------------------------------------


def _name_rows(spark: SparkSession, d: str) -> DataFrame:
    cache = read_table(spark, d, "kb_entity_cache").select(F.lit("kb_entity_cache").alias("src"), F.col("id").alias("row_id"), F.col("entity_text").alias("spelling"))
    return cache.unionByName(read_table(spark, d, "enriched_entities").select(F.lit("enriched_entities").alias("src"), F.col("id").alias("row_id"), F.col("text").alias("spelling")))


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    records = read_table(spark, d, "kb_entities").where("entity_type IN ('PERSON', 'ORG')").select("entity_id", "text", "synonyms")
    return names.clusters(_name_rows(spark, d).select("spelling"), records)


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    meant = _clusters(spark, d).where("entity_id IS NOT NULL").select("spelling", "entity_id")
    return _name_rows(spark, d).join(meant, "spelling").select("src", "row_id", "entity_id")


@query
def p1_spellings(spark: SparkSession, d: str) -> DataFrame:
    """The clusters of spellings: each spelling with its component, the record it means, if any, and the score."""
    return _clusters(spark, d).select("component", "entity_id", "spelling", F.round("score", 6).alias("score"))
