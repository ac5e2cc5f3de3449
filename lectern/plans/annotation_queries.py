"""Queries over annotation: rules, annotator, TEI, votes of models, catalog, knowledge bases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.functions import text as T
from lectern.operators import annotate, catalog, ensemble, knowledge, tei
from lectern.operators.flatten import flatten_tables
from lectern.operators.patterns import Rule, candidates, extract, normalised_entity, resolved, rules_of, spans, valid_entity
from lectern.plans import json_sql
from lectern.plans.core_queries import json_tables
from lectern.session import bounded, cut, read_table, spread

MAX_MODELS = 10_000

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _sql(pattern: str) -> str:
    return pattern.replace("'", "''")


_GENERAL = {n: p for d, n, p, *_ in fixed.RULES if d == "general"}


def _texts(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "processed_texts")


# --- structured entities ------------------------------------------------------------------------------------------------------------


@query()
def entity_histogram(s: SparkSession, d: str) -> DataFrame:
    """Structured entities of the corpus by type, by the general rules: the flagship."""
    found = extract(spread(read_table(s, d, "documents").where("text IS NOT NULL").select("doc_id", "text")), rules_of("general"), "doc_id", "text")
    return found.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


@query(" UNION ALL ".join(f"SELECT '{n}' AS rule, CAST(coalesce(sum(len(regexp_extract_all(text, '{_sql(p)}'))), 0) AS BIGINT) AS n FROM documents" for n, p in _GENERAL.items()))
def pattern_counts_general(s: SparkSession, d: str) -> DataFrame:
    docs = spread(read_table(s, d, "documents").select("text"))
    names = list(_GENERAL)
    sums = docs.agg(*(F.coalesce(F.sum(F.size(spans(F.col("text"), Rule(n, _GENERAL[n])))), F.lit(0)).alias(n) for n in names))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).cast("long").alias("n")) for n in names))).alias("r")).select("r.*")


_MARK_OPEN, _MARK_SHUT = "chr(64976)", "chr(64977)"


def _sql_pattern(rule: Rule) -> str:
    """The rule for an engine whose classes are ASCII: digits and white space of all scripts are named."""
    inside, out, skip = False, "", False
    for ch, nxt in zip(rule.pattern, rule.pattern[1:] + " "):
        if skip:
            skip = False
            continue
        if ch == "\\" and nxt in "ds":
            named = {"d": "\\p{Nd}", "s": "\\s\\x0b\\x{85}\\p{Z}"}[nxt]
            out, skip = out + (named if inside else f"[{named}]"), True
            continue
        if ch == "\\":
            out, skip = out + ch + nxt, True
            continue
        inside = ch == "[" or inside and ch != "]"
        out += ch
    return _sql(("(?i)" if rule.ignore_case else "") + out)


# letters, marks and digits beyond ASCII count as parts of words; µ is a letter of the rules themselves
_MASKED = r"regexp_replace(text, '[^\x00-\x7F\p{P}\p{S}\p{Z}\p{C}µ]', '_', 'g')"


def _matches_sql(table: str, key: str, rules: list[Rule]) -> str:
    """CTEs ending in m (key, ro, rule, entity_type, start, end, text, valid, confidence): all matches of all rules."""
    one = []
    for i, r in enumerate(rules):
        p, put = _sql_pattern(r), f"'\\0' || {_MARK_SHUT}"
        if "(?=" in p:
            p, put = p.replace("(?=", "(", 1), f"'\\1' || {_MARK_SHUT} || '\\2'"
        valid = "true" if r.validation is None else f"regexp_matches(hit, '^(?:{_sql(r.validation)})')"
        # a mask may be taken for a letter of a pattern that allows the underscore
        own = " WHERE NOT regexp_matches(hit, '[^\\x00-\\x7F]')" if r.name == "email" else ""
        one.append(
            f"SELECT {key}, {i} AS ro, '{r.name}' AS rule, '{r.type}' AS entity_type, gap AS start, CAST(gap + n AS INTEGER) AS \"end\", hit AS text, {valid} AS valid, CAST(CASE WHEN {valid} THEN 1.0 ELSE 0.7 END * {0.8 if r.priority == 'low' else 1.0} AS DOUBLE) AS confidence"
            f" FROM (SELECT {key}, gap, n, substr(text, gap + 1, n) AS hit FROM (SELECT {key}, text, length(split_part(parts[k], {_MARK_SHUT}, 1)) AS n, CAST(coalesce(list_sum(list_transform(parts[1:k - 1], lambda v: length(replace(v, {_MARK_SHUT}, '')))), 0) AS INTEGER) AS gap"
            f" FROM (SELECT {key}, text, parts, unnest(range(2, len(parts) + 1)) AS k FROM (SELECT {key}, text, string_split(regexp_replace(masked, '{p}', {_MARK_OPEN} || {put}, 'g'), {_MARK_OPEN}) AS parts FROM masks WHERE regexp_matches(masked, '{p}'))))){own}"
        )
    return f"masks AS (SELECT {key}, text, {_MASKED} AS masked FROM {table}), m AS (" + " UNION ALL ".join(one) + ")"


def _greedy_sql(table: str, key: str, rules: list[Rule]) -> str:
    """CTEs ending in kept: matches in order of rule and place, each kept if it overlaps none kept before."""
    fields = {"rule": "rule", "entity_type": "entity_type", "start": "s", "end": "e", "text": "text", "valid": "valid", "confidence": "confidence"}
    packed = ", ".join(f'"{v}": "{k}"' for k, v in fields.items())
    return (
        _matches_sql(table, key, rules)
        + f", l AS (SELECT {key}, list([{{{packed}}}] ORDER BY ro, start) AS l FROM m GROUP BY {key}),"
        + f" g AS (SELECT {key}, unnest(list_reduce(l, lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y.s < x[1].e AND x[1].s < y.e)) = 0 THEN list_concat(acc, x) ELSE acc END)) AS u FROM l),"
        + f" kept AS (SELECT {key}, " + ", ".join(f'u.{v} AS "{k}"' for k, v in fields.items()) + " FROM g)"
    )


def _pattern_query(domain: str):
    def run(s: SparkSession, d: str) -> DataFrame:
        return extract(spread(_texts(s, d).where("text IS NOT NULL").select("id", "text")), rules_of(domain), "id", "text")

    return run


for _d in ("medical", "legal", "financial", "general"):
    QUERIES[f"pattern_spans_{_d}"] = _pattern_query(_d)
    # a rule that looks ahead takes what it sees in the SQL, so it would miss a match that begins there; none does in the given tables
    ORACLES[f"pattern_spans_{_d}"] = "WITH " + _greedy_sql("processed_texts", "id", rules_of(_d)) + " SELECT * FROM kept"

ORACLES["entity_histogram"] = "WITH " + _greedy_sql("documents", "doc_id", rules_of("general")) + " SELECT entity_type, count(*) AS n, round(avg(confidence), 6) AS mean_confidence FROM kept GROUP BY entity_type"


_FILE_CODE = Rule("file_code", r"\b([A-Z]\d{2}[-/.]\d{2,3})\b", "high")


@query("WITH " + _greedy_sql("processed_texts", "id", rules_of("general", [_FILE_CODE])) + " SELECT id, start, \"end\", text FROM kept WHERE rule = 'file_code'")
def pattern_custom(s: SparkSession, d: str) -> DataFrame:
    return extract(_texts(s, d).where("text IS NOT NULL"), rules_of("general", [_FILE_CODE]), "id", "text").where("rule = 'file_code'").select("id", "start", "end", "text")


_NOTE = "'Rx ' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || ' mg po bid for E11.' || CAST(l_linenumber AS VARCHAR) || '; paid $' || CAST(l_orderkey AS VARCHAR) || '.'"


def _notes(s: SparkSession, d: str) -> DataFrame:
    """Notes made of order lines."""
    li = read_table(s, d, "lineitem")
    note = F.concat(F.lit("Rx "), F.col("l_quantity").cast("int").cast("string"), F.lit(" mg po bid for E11."), F.col("l_linenumber").cast("string"), F.lit("; paid $"), F.col("l_orderkey").cast("string"), F.lit("."))
    return li.select("l_orderkey", "l_linenumber", note.alias("note"))


@query(
    f"WITH n AS (SELECT l_orderkey, l_linenumber, {_NOTE} AS note FROM lineitem) SELECT l_orderkey, l_linenumber, regexp_extract(note, '([0-9]+) mg', 0) AS dosage, strpos(note, regexp_extract(note, '([0-9]+) mg', 0)) - 1 AS dosage_start, regexp_extract(note, '[A-Z][0-9]{{2}}\\.[0-9]{{1,4}}', 0) AS code FROM n"
)
def pattern_spans_notes(s: SparkSession, d: str) -> DataFrame:
    rules = {r.name: r for r in rules_of("medical")}
    n = _notes(s, d).withColumn("e", resolved(candidates(F.col("note"), [rules["icd10_code"], rules["dosage"]])))
    pick = lambda kind: F.filter("e", lambda x: x["entity_type"] == kind)[0]
    return n.select("l_orderkey", "l_linenumber", pick("DOSAGE")["text"].alias("dosage"), pick("DOSAGE")["start"].cast("long").alias("dosage_start"), pick("ICD10_CODE")["text"].alias("code"))


@query("SELECT text, count(*) AS n FROM enriched_entities WHERE regexp_full_match(text, '([A-Z][0-9]{2}(?:\\.[0-9]{1,4})?)') GROUP BY text")
def pattern_validate(s: SparkSession, d: str) -> DataFrame:
    rule = {r.name: r for r in rules_of("medical")}["icd10_code"]
    return read_table(s, d, "enriched_entities").where(valid_entity(F.col("text"), rule)).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, l_linenumber, replace(replace(CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || ' mcg units', 'mcg', 'µg'), 'unit', 'U') AS dosage, replace(lower('B.I.D'), '.', '') AS frequency, replace('$ ' || CAST(l_orderkey AS VARCHAR), ' ', '') AS amount FROM lineitem")
def pattern_normalize(s: SparkSession, d: str) -> DataFrame:
    li = read_table(s, d, "lineitem")
    norm = lambda dom, kind, c: normalised_entity(F.lit(dom), F.lit(kind), c)
    return li.select(
        "l_orderkey",
        "l_linenumber",
        norm("medical", "DOSAGE", F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" mcg units"))).alias("dosage"),
        norm("medical", "FREQUENCY", F.lit("B.I.D")).alias("frequency"),
        norm("financial", "CURRENCY_AMOUNT", F.concat(F.lit("$ "), F.col("l_orderkey").cast("string"))).alias("amount"),
    )


# --- annotator ----------------------------------------------------------------------------------------------------------------------

_S, _T = _sql(annotate.SENTENCE), _sql(annotate.TOKEN)


@query(f"SELECT id, CAST(len(list_filter(regexp_extract_all(text, '{_S}'), lambda x: trim(x) <> '')) AS INTEGER) AS n_sentences FROM processed_texts WHERE text IS NOT NULL")
def sentence_counts(s: SparkSession, d: str) -> DataFrame:
    found = annotate.placed(F.col("text"), annotate.SENTENCE)
    return _texts(s, d).where("text IS NOT NULL").select("id", F.size(F.filter(found, lambda x: F.trim(x["text"]) != "")).alias("n_sentences"))


@query(f"SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{_T}')) AS token FROM processed_texts WHERE text IS NOT NULL) GROUP BY token")
def token_counts(s: SparkSession, d: str) -> DataFrame:
    found = F.regexp_extract_all("text", F.lit(f"({annotate.TOKEN})"), F.lit(1))
    return _texts(s, d).where("text IS NOT NULL").select(F.explode(found).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def _annotated(s: SparkSession, d: str, *keep: str) -> DataFrame:
    return annotate.annotated(spread(_texts(s, d).select("id", "text", *keep)), "id", "text", rules_of("general"), *keep)


def _placed_sql(source: str, key: str, text: str, pattern: str, base: str) -> str:
    """All matches of a pattern in a column, with offsets counted on from base."""
    gap = f"coalesce(list_sum(list_transform(parts[1:k - 1], lambda v: length(replace(v, {_MARK_SHUT}, '')))), 0)"
    inner = f"SELECT {key}, {base} AS base, string_split(regexp_replace({text}, '{pattern}', {_MARK_OPEN} || '\\0' || {_MARK_SHUT}, 'g'), {_MARK_OPEN}) AS parts FROM {source}"
    return f"SELECT {key}, split_part(parts[k], {_MARK_SHUT}, 1) AS hit, CAST(base + {gap} AS INTEGER) AS at_ FROM (SELECT {key}, base, parts, unnest(range(2, len(parts) + 1)) AS k FROM ({inner}))"


_TOKENS = (
    "se AS (SELECT id, hit, at_, CAST(row_number() OVER (PARTITION BY id ORDER BY at_) - 1 AS INTEGER) AS sent_no FROM (" + _placed_sql("processed_texts", "id", "text", _S, "0") + ") WHERE trim(hit) <> ''),"
    " tk AS (SELECT id, sent_no, hit AS text, at_ AS idx, CAST(row_number() OVER (PARTITION BY id ORDER BY at_) - 1 AS INTEGER) AS i FROM (" + _placed_sql("se", "id, sent_no", "hit", _T, "at_") + ")),"
    r" tz AS (SELECT *, NOT regexp_matches(text, '[\p{L}\p{M}\p{N}]') AS is_punct, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\p{Lu}', 'X', 'g'), '\p{Ll}', 'x', 'g'), '\p{N}', 'd', 'g'), '(X{4})X+|(x{4})x+|(d{4})d+', '\1\2\3', 'g') AS shape FROM tk)"
)


@query("WITH " + _TOKENS + r" SELECT id, sent_no, i, text, CASE WHEN is_punct THEN 'PUNCT' WHEN regexp_full_match(text, '\p{N}+') THEN 'NUM' ELSE 'X' END AS pos, shape, is_punct, idx FROM tz")
def tokens(s: SparkSession, d: str) -> DataFrame:
    return annotate.token_table(_annotated(s, d), "id").select("id", "sent_no", "i", "text", "pos", "shape", "is_punct", "idx")


@query(
    "WITH " + _TOKENS + ", " + _greedy_sql("processed_texts", "id", rules_of("general"))
    + ", en AS (SELECT kept.id, count(*) AS n FROM kept WHERE EXISTS (SELECT 1 FROM tk WHERE tk.id = kept.id AND tk.idx >= kept.start AND tk.idx < kept.\"end\") GROUP BY kept.id)"
    " SELECT t.id, CAST(coalesce((SELECT count(*) FROM se WHERE se.id = t.id), 0) AS INTEGER) AS n_sentences, CAST(coalesce((SELECT count(*) FROM tk WHERE tk.id = t.id), 0) AS INTEGER) AS n_tokens, CAST(coalesce(en.n, 0) AS INTEGER) AS n_entities, 0 AS n_dependencies, 0 AS n_noun_phrases FROM processed_texts t LEFT JOIN en ON en.id = t.id"
)
def document_statistics(s: SparkSession, d: str) -> DataFrame:
    return annotate.statistics(_annotated(s, d), "id")


@query(
    "WITH x AS (" + json_sql.LEVELS["tokens"] + "), t AS (SELECT row_id, chunk_no, TRY_CAST(i AS INTEGER) AS i, TRY_CAST(head AS INTEGER) AS head, coalesce(dep, CASE WHEN head <> i THEN 'dep' END) AS dep, text, pos FROM x WHERE src = 'processed_texts'),"
    " u AS (SELECT * FROM t WHERE i IS NOT NULL AND head IS NOT NULL)"
    ' SELECT a.row_id, a.chunk_no, a.head AS "from", a.i AS "to", a.dep, min(h.text) AS from_text, min(a.text) AS to_text FROM u a JOIN u h ON h.row_id = a.row_id AND h.chunk_no = a.chunk_no AND h.i = a.head WHERE a.dep IS NOT NULL AND a.dep <> \'ROOT\' AND a.i <> a.head GROUP BY ALL'
)
def dependency_edges(s: SparkSession, d: str) -> DataFrame:
    t = flatten_tables("tokens", (spread(_texts(s, d).select("id", "nlp_results")), "id", "nlp_results", "processed_texts"))
    t = t.select("row_id", "chunk_no", F.expr("try_cast(i AS INT)").alias("i"), F.expr("try_cast(head AS INT)").alias("head"), F.coalesce("dep", F.when(F.col("head") != F.col("i"), "dep")).alias("dep"), "text", "pos")
    return annotate.dependency_edges(t.where("i IS NOT NULL AND head IS NOT NULL"), ["row_id", "chunk_no"]).select("row_id", "chunk_no", "from", "to", "dep", "from_text", "to_text")


# --- TEI ----------------------------------------------------------------------------------------------------------------------------


def _tei(s: SparkSession, d: str, strategy: str | None = None) -> DataFrame:
    docs = _annotated(s, d, "domain").withColumn("language", F.lit(None).cast("string"))
    docs = tei.with_schema(docs, tei.schemas(s))
    if strategy:
        docs = docs.withColumn("schema", F.col("schema").withField("annotation_strategy", F.lit(strategy)))
    return tei.converted(docs, F.lit("2017-04-01T00:00:00"))


@query()
def tei_documents(s: SparkSession, d: str) -> DataFrame:
    return _tei(s, d).select("id", "tei")


_COUNT = lambda tag: F.regexp_count("tei", F.lit(tag)).cast("long")
_W = r"[\p{L}\p{M}\p{N}]+"


@query(f"SELECT id, CAST(coalesce(len(regexp_extract_all(text, '{_W}')), 0) AS BIGINT) AS w, CAST(coalesce(len(regexp_extract_all(text, '{_T}')) - len(regexp_extract_all(text, '{_W}')), 0) AS BIGINT) AS pc FROM processed_texts")
def tei_inline_tags(s: SparkSession, d: str) -> DataFrame:
    """Words and marks of the inline documents, read back from the XML."""
    return _tei(s, d, "inline").select("id", _COUNT("<tei:w ").alias("w"), _COUNT("<tei:pc ").alias("pc"))


@query(f"SELECT id, CAST(coalesce(len(list_filter(regexp_extract_all(text, '{_S}'), lambda x: trim(x) <> '')), 0) AS BIGINT) AS milestones FROM processed_texts")
def tei_standoff_tags(s: SparkSession, d: str) -> DataFrame:
    return _tei(s, d, "standoff").select("id", _COUNT("<tei:milestone ").alias("milestones"))


@query()
def tei_mixed(s: SparkSession, d: str) -> DataFrame:
    return _tei(s, d, "mixed").select("id", F.char_length("tei").alias("chars"), _COUNT("<tei:s |<tei:p ").alias("sentences"))


# the structure that a conversion needs: sentences with texts, whose tokens are an array where there are any; entities with text and label
STORED_SQL = (
    "WITH j1 AS (SELECT id, text, TRY_CAST(nlp_results AS JSON) AS j FROM processed_texts WHERE json_valid(nlp_results)), j2 AS (SELECT id, " + json_sql.obj("j") + " AS o FROM j1), j3 AS (SELECT id, o, " + json_sql.obj("n") + " AS i FROM (SELECT id, o, json_extract(o, '$.nlp_results') AS n FROM j2)),"
    " v AS (SELECT id, coalesce(i, o) AS d FROM j3), s AS (SELECT id, " + json_sql.opened("a") + " AS ss, " + json_sql.opened("b") + " AS es, " + json_sql.opened("c") + " AS ds FROM (SELECT id, json_extract(d, '$.sentences') AS a, json_extract(d, '$.entities') AS b, json_extract(d, '$.dependencies') AS c FROM v)),"
    " ok AS (SELECT id, ds, ss, es FROM s WHERE json_type(ss) = 'ARRAY' AND json_type(es) = 'ARRAY'"
    " AND len(list_filter(CAST(ss AS JSON[]), lambda x: (json_type(x) = 'OBJECT' AND json_type(x, '$.text') <> 'NULL' AND coalesce(json_type(x, '$.tokens') IN ('ARRAY', 'NULL'), true)) IS NOT TRUE)) = 0"
    " AND len(list_filter(CAST(es AS JSON[]), lambda x: (json_type(x) = 'OBJECT' AND json_type(x, '$.text') <> 'NULL' AND json_type(x, '$.label') <> 'NULL') IS NOT TRUE)) = 0)"
)
_BAD = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '\'\'', '&apos;')"


def _stored(s: SparkSession, d: str) -> DataFrame:
    """Texts with the annotation stored with them, and their domain's schema."""
    t = annotate.stored(spread(_texts(s, d).select("id", "text", "domain", "nlp_results")), "id", "nlp_results", "text", "domain")
    return tei.with_schema(t, tei.schemas(s))


@query(
    STORED_SQL + ", k AS (SELECT ok.id, CAST(len(CAST(ss AS JSON[])) AS BIGINT) AS sentences, CASE WHEN json_type(ds) = 'ARRAY' AND t.domain IN ('literary', 'linguistic') THEN len(CAST(ds AS JSON[])) ELSE 0 END AS links, t.domain FROM ok JOIN processed_texts t ON t.id = ok.id)"
    " SELECT t.id, k.id IS NOT NULL AS valid, coalesce(CASE WHEN k.domain IN ('legal', 'historical', 'literary', 'linguistic') THEN k.sentences ELSE 0 END, 0) AS milestones, CAST(coalesce(k.links, 0) AS BIGINT) AS links FROM processed_texts t LEFT JOIN k ON k.id = t.id"
)
def tei_stored(s: SparkSession, d: str) -> DataFrame:
    """Documents of the stored annotation, with its dependencies and noun chunks, read back from the XML."""
    out = tei.converted(_stored(s, d), F.lit("2017-04-01T00:00:00"))
    return out.select("id", "valid", _COUNT("<tei:milestone ").alias("milestones"), _COUNT("<tei:link ").alias("links"))


@query(
    STORED_SQL
    + " SELECT id, '<?xml version=\"1.0\" encoding=\"UTF-8\"?>' || chr(10) || '<TEI xmlns=\"http://www.tei-c.org/ns/1.0\"><teiHeader><fileDesc><titleStmt><title>Processing Error</title></titleStmt></fileDesc></teiHeader><text><body><p>' || "
    + _BAD.format("coalesce(text, '')")
    + " || '</p><note>Invalid NLP results structure</note></body></text></TEI>' AS xml FROM processed_texts WHERE id NOT IN (SELECT id FROM ok)"
)
def tei_fallback(s: SparkSession, d: str) -> DataFrame:
    """The document that stands for a text whose stored annotation does not have the structure that a conversion needs."""
    return tei.converted(_stored(s, d).where("NOT valid"), F.lit("")).select("id", F.col("tei").alias("xml"))


@query("SELECT id, domain, CASE domain WHEN 'legal' THEN 'standoff' WHEN 'historical' THEN 'standoff' WHEN 'literary' THEN 'standoff' WHEN 'linguistic' THEN 'standoff' ELSE 'inline' END AS strategy FROM processed_texts")
def schema_of_domain(s: SparkSession, d: str) -> DataFrame:
    return tei.with_schema(_texts(s, d).select("id", "domain"), tei.schemas(s)).select("id", "domain", F.col("schema.annotation_strategy").alias("strategy"))


# --- labels -------------------------------------------------------------------------------------------------------------------------


@query("SELECT entity_type, CASE upper(entity_type) WHEN 'PERSON' THEN 'PERSON' WHEN 'LOCATION' THEN 'LOC' WHEN 'ORGANIZATION' THEN 'ORG' WHEN 'PER' THEN 'PERSON' WHEN 'GPE' THEN 'LOC' ELSE upper(entity_type) END AS label, count(*) AS n FROM model_entities WHERE entity_type IS NOT NULL GROUP BY ALL")
def label_normalized(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "model_entities").where("entity_type IS NOT NULL").groupBy("entity_type", T.provider_label(F.col("entity_type")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT entity_type, replace(replace(entity_type, 'B-', ''), 'I-', '') AS label, count(*) AS n FROM model_entities WHERE entity_type IS NOT NULL GROUP BY ALL")
def label_cleaned(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "model_entities").where("entity_type IS NOT NULL").groupBy("entity_type", T.tag_cleaned(F.col("entity_type")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE WHEN lower(entity_type) IN ('person', 'per') THEN 'entity-person' WHEN lower(entity_type) IN ('location', 'loc', 'gpe') THEN 'entity-place' WHEN lower(entity_type) IN ('organization', 'org') THEN 'entity-org' WHEN lower(entity_type) IN ('drug', 'chemical', 'medication') THEN 'entity-drug' ELSE 'entity-misc' END AS class, count(*) AS n FROM model_entities GROUP BY ALL")
def ui_entity_class(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "model_entities").groupBy(T.display_class(F.col("entity_type")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE WHEN confidence >= 0.9 THEN 'high' WHEN confidence >= 0.7 THEN 'medium' WHEN confidence >= 0.5 THEN 'low' ELSE 'unknown' END AS certainty, count(*) AS n FROM enriched_entities GROUP BY ALL")
def certainty_buckets(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "enriched_entities").groupBy(T.certainty(F.col("confidence")).alias("certainty")).agg(F.count(F.lit(1)).alias("n"))


# --- votes of models ------------------------------------------------------------------------------------------------------------------


def _model_entities(s: SparkSession, d: str) -> DataFrame:
    """All reports; one without a type has a type of its own (null), one without confidence counts as 1.0."""
    m = read_table(s, d, "model_entities")
    return m.select("doc_id", "model_ord", "ent_ord", "text", F.col("entity_type").alias("type"), F.col("start_char").alias("start"), F.col("end_char").alias("end"), "confidence", "model_id")


def _ran(s: SparkSession, d: str) -> DataFrame:
    """(doc_id, model_ord, weight) of the models that ran on each text: those of the catalog for its domain, and any that reported something.

    A model that runs and finds nothing is an empty list of the merge. Weights are the models' F1 scores, 1.0 where there is none.
    """
    listed = bounded(_catalog(s, d).select(F.col("catalog_ord").alias("model_ord"), "domain", F.coalesce("performance.f1_score", F.lit(1.0)).alias("weight")), MAX_MODELS, "models in the catalog")
    planned = _texts(s, d).select(F.col("id").alias("doc_id"), "domain").join(F.broadcast(listed.select("domain", "model_ord")), "domain").select("doc_id", "model_ord")
    spoke = read_table(s, d, "model_entities").select("doc_id", "model_ord")
    return planned.unionByName(spoke).distinct().join(F.broadcast(listed.select("model_ord", "weight")), "model_ord", "left").select("doc_id", "model_ord", F.coalesce("weight", F.lit(1.0)).alias("weight"))


def _voted(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    ran = _ran(s, d)
    return _model_entities(s, d), ran


def _voted(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    ran = _ran(s, d)
    return _model_entities(s, d), ran


def _rounded(e: DataFrame) -> DataFrame:
    return e.select("doc_id", "start", "end", "type", F.round("confidence", 10).alias("confidence"))


_K = 'doc_id, start, "end"'
# every model that ran, with its weight; all reports
_RAN = (
    "WITH ran AS (SELECT doc_id, model_ord FROM model_entities UNION SELECT t.id, c.catalog_ord FROM processed_texts t JOIN model_catalog c ON c.domain = t.domain),"
    " w AS (SELECT r.doc_id, r.model_ord, coalesce((SELECT c.performance.f1_score FROM model_catalog c WHERE c.catalog_ord = r.model_ord), 1.0) AS weight FROM ran r),"
    " tot AS (SELECT doc_id, count(*) AS n_models, sum(weight) AS total FROM w GROUP BY doc_id),"
    ' e AS (SELECT m.doc_id, m.model_ord, m.ent_ord, m.entity_type AS type, m.start_char AS start, m.end_char AS "end", coalesce(m.confidence, 1.0) AS confidence, w.weight FROM model_entities m JOIN w ON w.doc_id = m.doc_id AND w.model_ord = m.model_ord)'
)
_MAJORITY = (
    f", vt AS (SELECT {_K}, type, count(*) AS votes, min((model_ord, ent_ord)) AS seen, avg(confidence) AS mean FROM e GROUP BY ALL),"
    f" vr AS (SELECT *, sum(votes) OVER (PARTITION BY {_K}) AS n, row_number() OVER (PARTITION BY {_K} ORDER BY votes DESC, seen) AS k FROM vt),"
    f" majority AS (SELECT {_K}, type, CASE WHEN n = 1 THEN mean * 0.7 ELSE least(mean * (0.5 + 0.5 * votes / n), 1.0) END AS confidence FROM vr WHERE k = 1)"
)
_WEIGHTED = (
    f", wt AS (SELECT {_K}, type, sum(e.weight) AS w, sum(confidence * e.weight) AS cw, min((model_ord, ent_ord)) AS seen FROM e GROUP BY ALL),"
    f' wr AS (SELECT wt.*, round(wt.w / tot.total, 12) AS part, row_number() OVER (PARTITION BY wt.doc_id, wt.start, wt."end" ORDER BY round(wt.w / tot.total, 12) DESC, seen) AS k FROM wt JOIN tot ON tot.doc_id = wt.doc_id),'
    f" weighted AS (SELECT {_K}, type, least(cw / w * part, 1.0) AS confidence FROM wr WHERE k = 1)"
)
_UNION = (
    f', ul AS (SELECT doc_id, list([{{"s": start, "e": "end", "t": type, "c": confidence}}] ORDER BY start, "end", model_ord, ent_ord) AS l FROM e GROUP BY doc_id),'
    " ur AS (SELECT doc_id, unnest(list_reduce(l, lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y.s < x[1].e AND x[1].s < y.e)) = 0 THEN list_concat(acc, x)"
    " ELSE list_transform(acc, lambda y, i: CASE WHEN i = list_position(list_transform(acc, lambda z: z.s < x[1].e AND x[1].s < z.e), true) AND x[1].c > y.c THEN x[1] ELSE y END) END)) AS u FROM ul),"
    ' spread AS (SELECT doc_id, u.s AS start, u.e AS "end", u.t AS type, u.c AS confidence FROM ur)'
)
_COMMON = (
    f", f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_K}, model_ord ORDER BY ent_ord) AS k FROM e) WHERE k = 1),"
    f" fa AS (SELECT {_K}, count(*) AS have, avg(confidence) AS mean FROM f GROUP BY ALL),"
    f" ft AS (SELECT {_K}, type, row_number() OVER (PARTITION BY {_K} ORDER BY count(*) DESC, min(model_ord)) AS k FROM f GROUP BY {_K}, type),"
    ' common AS (SELECT fa.doc_id, fa.start, fa."end", ft.type, least(fa.mean * 1.2, 1.0) AS confidence FROM fa JOIN tot ON tot.doc_id = fa.doc_id AND tot.n_models = fa.have JOIN ft ON ft.doc_id = fa.doc_id AND ft.start = fa.start AND ft."end" = fa."end" AND ft.k = 1)'
)
_PICK = " SELECT doc_id, start, \"end\", type, round(confidence, 10) AS confidence FROM "


@query(_RAN + _MAJORITY + _PICK + "majority")
def ensemble_majority(s: SparkSession, d: str) -> DataFrame:
    return _rounded(ensemble.majority(*_voted(s, d)))


@query(_RAN + _WEIGHTED + _PICK + "weighted")
def ensemble_weighted(s: SparkSession, d: str) -> DataFrame:
    return _rounded(ensemble.weighted(*_voted(s, d)))


@query(_RAN + _UNION + _PICK + "spread")
def ensemble_union(s: SparkSession, d: str) -> DataFrame:
    return _rounded(ensemble.union(*_voted(s, d)))


@query(_RAN + _COMMON + _PICK + "common")
def ensemble_intersection(s: SparkSession, d: str) -> DataFrame:
    return _rounded(ensemble.intersection(*_voted(s, d)))


@query(
    _RAN
    + f", st AS (SELECT {_K}, type, count(*) AS votes FROM e GROUP BY ALL), sp AS (SELECT {_K}, sum(votes) AS n, max(votes) AS lead FROM st GROUP BY ALL)"
    " SELECT tot.doc_id, round(CASE WHEN max(n_models) <= 1 THEN 1.0 ELSE coalesce(avg(CASE WHEN n = n_models THEN lead / n ELSE n / n_models * 0.5 END), 1.0) END, 6) AS agreement FROM tot LEFT JOIN sp ON sp.doc_id = tot.doc_id GROUP BY tot.doc_id"
)
def ensemble_agreement(s: SparkSession, d: str) -> DataFrame:
    return ensemble.agreement(*_voted(s, d)).select("doc_id", F.round("agreement", 6).alias("agreement"))


def _by_strategy_sql() -> str:
    named = {"majority_vote": "majority", "weighted_vote": "weighted", "union": "spread", "intersection": "common"}
    one = " UNION ALL ".join(f"SELECT type, '{k}' AS strategy FROM {v} JOIN tot ON tot.doc_id = {v}.doc_id AND n_models > 1 UNION ALL SELECT type, '{k}' FROM e JOIN tot ON tot.doc_id = e.doc_id AND n_models <= 1" for k, v in named.items())
    return _RAN + _MAJORITY + _WEIGHTED + _UNION + _COMMON + f" SELECT strategy, type, count(*) AS n FROM ({one}) GROUP BY ALL"


@query(_by_strategy_sql())
def ensemble_by_strategy(s: SparkSession, d: str) -> DataFrame:
    """Mentions kept by each strategy, by type."""
    e, ran = _model_entities(s, d), cut(_ran(s, d))
    out = None
    for name in ensemble.STRATEGIES:
        one = ensemble.merge(e, name, ran).groupBy("type").agg(F.count(F.lit(1)).alias("n")).withColumn("strategy", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query(_RAN + f" SELECT {_K}, string_agg(model_id, ',' ORDER BY model_ord, ent_ord) AS sources, count(*) AS reports FROM (SELECT m.doc_id, m.start_char AS start, m.end_char AS \"end\", m.model_ord, m.ent_ord, m.model_id FROM model_entities m) GROUP BY ALL")
def ensemble_sources(s: SparkSession, d: str) -> DataFrame:
    """The models behind each merged span, in model order, and how many reports it has."""
    e = _model_entities(s, d)
    n = e.groupBy(*ensemble.KEYS).agg(F.count(F.lit(1)).alias("reports"))
    joined = F.when(F.size("sources") > 0, F.array_join("sources", ","))
    return ensemble.majority(e, None).select(*ensemble.KEYS, joined.alias("sources")).join(n, ensemble.KEYS)


# --- catalog --------------------------------------------------------------------------------------------------------------------------


def _catalog(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "model_catalog")


@query("SELECT model_id, performance.f1_score AS f1_score FROM model_catalog WHERE performance.f1_score >= 0.7 AND performance.latency_ms <= 200 AND list_has_all(entity_types, ['PERSON', 'ORG'])")
def catalog_filter(s: SparkSession, d: str) -> DataFrame:
    return catalog.query(_catalog(s, d), min_f1=0.7, max_latency=200, types=["PERSON", "ORG"]).select("model_id", F.col("performance.f1_score").alias("f1_score"))


@query("SELECT model_id, (coalesce(trusted, false) OR " + " OR ".join(f"coalesce(contains(source_url, '{x}'), false) OR contains(model_id, '{x}')" for x in fixed.TRUSTED_SOURCES) + ") AND coalesce(performance.f1_score, 0) >= 0.7 AND len(entity_types) > 0 AS trusted FROM model_catalog")
def catalog_trust(s: SparkSession, d: str) -> DataFrame:
    c = _catalog(s, d)
    return c.select("model_id", catalog.trusted(c).alias("trusted"))


@query(
    "WITH m AS (SELECT *, coalesce(performance.f1_score >= 0.6 AND performance.latency_ms <= 300 AND coalesce(size_mb, 0) <= 8000 AND trusted AND list_has_all(entity_types, ['PERSON', 'ORG']), false) AS meets FROM model_catalog WHERE domain = 'general' AND performance.f1_score >= 0.6 AND performance.latency_ms <= 300), k AS (SELECT *, max(meets) OVER () AS any_meets FROM m),"
    " s AS (SELECT model_id, catalog_ord, round(performance.f1_score * 50 + greatest(0, 30 * (1 - performance.latency_ms / 300)) + CASE WHEN trusted THEN 10 ELSE 0 END + CASE WHEN provider = 'openquarry' THEN 5 ELSE 0 END + len(list_intersect(entity_types, ['PERSON', 'ORG'])) / 2 * 5, 6) AS score FROM k WHERE meets OR NOT any_meets)"
    " SELECT model_id, score, CAST(row_number() OVER (ORDER BY score DESC, catalog_ord) AS INTEGER) AS position FROM s"
)
def catalog_rank(s: SparkSession, d: str) -> DataFrame:
    return catalog.ranked(_catalog(s, d), "general", 0.6, 300.0, ["openquarry"], ["PERSON", "ORG"]).select("model_id", "score", "position")


def _topn_sql() -> str:
    quoted = lambda xs: "CAST([" + ", ".join(f"'{x}'" for x in xs) + "] AS VARCHAR[])"
    known = ", ".join(f"({i}, '{m}', '{pr}', '{dom}', {f}, {lat}, {quoted(t)}, {fixed.MODEL_SIZES[i]})" for i, (m, pr, dom, f, lat, t) in enumerate(fixed.MODELS))
    wants = ", ".join(f"('{p['domain']}', {p['min_f1_score']}, {p['max_latency_ms']}, {quoted(p['preferred_providers'])}, {quoted(p['entity_types'])}, {p['max_models']})" for p in fixed.PIPELINES)
    return (
        f"WITH m AS (SELECT * FROM (VALUES {known}) AS v(ord, model_id, provider, domain, f1, lat, types, size_mb)), w AS (SELECT * FROM (VALUES {wants}) AS v(domain, least_f1, most_lat, preferred, wanted, most)),"
        " c AS (SELECT m.*, w.*  EXCLUDE (domain), m.size_mb <= 8000 AND list_has_all(m.types, w.wanted) AS meets FROM m JOIN w ON w.domain = m.domain WHERE m.f1 >= w.least_f1 AND m.lat <= w.most_lat),"
        " k AS (SELECT *, bool_or(meets) OVER (PARTITION BY domain) AS some_meet FROM c), s AS (SELECT domain, model_id, ord, most, round(f1 * 50 + greatest(0, 30 * (1 - lat / most_lat)) + 10 + CASE WHEN list_contains(preferred, provider) THEN 5 ELSE 0 END + len(list_intersect(types, wanted)) / len(wanted) * 5, 6) AS score FROM k WHERE meets OR NOT some_meet),"
        " r AS (SELECT *, CAST(row_number() OVER (PARTITION BY domain ORDER BY score DESC, ord) AS INTEGER) AS position FROM s) SELECT domain, model_id, CAST(score AS DOUBLE) AS score, position FROM r WHERE position <= most"
    )


@query(_topn_sql())
def catalog_topn_known(s: SparkSession, d: str) -> DataFrame:
    """The best known models for each pipeline."""
    out = None
    for p in fixed.PIPELINES:
        r = catalog.ranked(catalog.known_models(s), p["domain"], p["min_f1_score"], p["max_latency_ms"], p["preferred_providers"], p["entity_types"]).where(F.col("position") <= p["max_models"]).select("domain", "model_id", "score", "position")
        out = r if out is None else out.unionByName(r)
    return out


@query("SELECT entity_type, count(*) AS n_models, string_agg(model_id, ',' ORDER BY model_id) AS models FROM (SELECT unnest(entity_types) AS entity_type, model_id FROM model_catalog) GROUP BY entity_type")
def catalog_index(s: SparkSession, d: str) -> DataFrame:
    return catalog.by_type(_catalog(s, d)).groupBy("entity_type").agg(F.count(F.lit(1)).alias("n_models"), F.array_join(F.array_sort(F.collect_list("model_id")), ",").alias("models"))


@query("SELECT domain, count(*) AS n_models, count(DISTINCT provider) AS n_providers FROM model_catalog GROUP BY domain")
def catalog_statistics(s: SparkSession, d: str) -> DataFrame:
    return _catalog(s, d).groupBy("domain").agg(F.count(F.lit(1)).alias("n_models"), F.count_distinct("provider").alias("n_providers"))


# --- knowledge bases --------------------------------------------------------------------------------------------------------------------

CHAIN = ("gridnames", "orgbook", "personfile", "authorindex", "gazette", "pillbook")


def _looked_up(s: SparkSession, d: str) -> DataFrame:
    chain = s.createDataFrame([(k, i) for i, k in enumerate(CHAIN)], "kb_id string, rank int")
    e = read_table(s, d, "enriched_entities").select("id", "doc_id", "text")
    return knowledge.lookup(e, read_table(s, d, "kb_entities"), chain)


_LOOKUP = (
    "WITH c AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {i})" for i, k in enumerate(CHAIN)) + ") AS v(kb_id, rank)), n AS (SELECT DISTINCT lower(trim(name)) AS key, kb_id, entity_id FROM (SELECT unnest(list_append(coalesce(synonyms, []), text)) AS name, kb_id, entity_id FROM kb_entities)),"
    " f AS (SELECT key, min((rank, n.kb_id, entity_id)) AS f FROM n JOIN c ON c.kb_id = n.kb_id WHERE key <> '' GROUP BY key), x AS (SELECT e.id, e.doc_id, f.f[2] AS found_kb, f.f[3] AS found_id FROM enriched_entities e LEFT JOIN f ON f.key = lower(regexp_replace(e.text, '^[\\s\\x{00A0}\\x{2009}\\x{3000}]+|[\\s\\x{00A0}\\x{2009}\\x{3000}]+$', '', 'g')))"
)


@query(_LOOKUP + " SELECT id, found_kb, found_id FROM x")
def kb_lookup_fallback(s: SparkSession, d: str) -> DataFrame:
    return _looked_up(s, d).select("id", "found_kb", "found_id")


@query(_LOOKUP + " SELECT doc_id, count(*) AS n, round(avg(CASE WHEN found_id IS NULL THEN 0 ELSE 1 END), 6) AS kb_hit_rate FROM x GROUP BY doc_id")
def kb_hit_rate(s: SparkSession, d: str) -> DataFrame:
    return knowledge.hit_rate(_looked_up(s, d), "doc_id")


@query(
    "WITH r AS (" + json_sql.LEVELS["relationships"] + "), e AS (SELECT DISTINCT source_id, target_id FROM r WHERE source_id IS NOT NULL AND target_id IS NOT NULL), w AS (SELECT source_id, target_id, 1 AS hops FROM e UNION ALL SELECT a.source_id, b.target_id, 2 FROM e a JOIN e b ON b.source_id = a.target_id)"
    " SELECT source_id, target_id, min(hops) AS hops FROM w WHERE source_id <> target_id GROUP BY ALL"
)
def kb_relationship_hops(s: SparkSession, d: str) -> DataFrame:
    r = flatten_tables("relationships", *json_tables(s, d))
    # the walk reads the edges several times; without the cut each reading parses all JSON again
    edges = cut(r.where("source_id IS NOT NULL AND target_id IS NOT NULL").select("source_id", "target_id").distinct())
    return knowledge.hops(edges, edges.select("source_id").distinct(), 2)


@query("SELECT kb_id, count(*) AS n, count(DISTINCT entity_type) AS types, round(avg(confidence), 6) AS confidence FROM kb_entities GROUP BY kb_id")
def kb_catalog(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "kb_entities").groupBy("kb_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("entity_type").alias("types"), F.round(F.avg("confidence"), 6).alias("confidence"))


@query("SELECT entity_id, kb_id FROM kb_entities WHERE kb_id <> 'gazette' OR last_updated > TIMESTAMPTZ '2016-10-01 00:00:00+00'")
def kb_incremental(s: SparkSession, d: str) -> DataFrame:
    st = s.createDataFrame([("gazette", "2016-10-01 00:00:00")], "kb_id string, at string").select("kb_id", F.col("at").cast("timestamp").alias("last_success"))
    return knowledge.incremental(read_table(s, d, "kb_entities"), st).select("entity_id", "kb_id")


@query("SELECT s.entity_id AS source_id, c.c_custkey, 2 AS hops FROM (SELECT r_name AS entity_id, r_regionkey FROM region) s JOIN nation n ON n.n_regionkey = s.r_regionkey JOIN customer c ON c.c_nationkey = n.n_nationkey")
def hops_over_regions(s: SparkSession, d: str) -> DataFrame:
    """Customers two relationships away from each region."""
    r, n, c = (read_table(s, d, t) for t in ("region", "nation", "customer"))
    a = r.join(n, r["r_regionkey"] == n["n_regionkey"]).select(F.concat(F.lit("r:"), "r_name").alias("source_id"), F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")).alias("target_id"))
    b = c.select(F.concat(F.lit("n:"), F.col("c_nationkey").cast("string")).alias("source_id"), F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("target_id"))
    h = knowledge.hops(a.unionByName(b), a.select("source_id"), 2).where("hops = 2")
    return h.select(F.substring("source_id", 3, 1000).alias("source_id"), F.substring("target_id", 3, 1000).cast("long").alias("c_custkey"), "hops")


# --- the whole pipeline -----------------------------------------------------------------------------------------------------------------


def _pipeline_sql() -> str:
    own = ("medical", "legal", "financial")
    part = {d: f"(SELECT id, text FROM processed_texts WHERE text IS NOT NULL AND domain = '{d}')" for d in own}
    part["general"] = f"(SELECT id, text FROM processed_texts WHERE text IS NOT NULL AND coalesce(domain, '') NOT IN {own})"
    ruled = " UNION ALL ".join(f"SELECT id AS doc_id, text FROM (WITH {_greedy_sql(t, 'id', rules_of(d))} SELECT id, text FROM kept)" for d, t in part.items())
    return (
        _LOOKUP.split(", x AS (")[0]
        + ", dm AS (SELECT domain, count(*) AS n_models FROM model_catalog WHERE domain IS NOT NULL GROUP BY domain),"
        " rep AS (SELECT m.doc_id, m.start_char, m.end_char, m.text, m.model_ord, m.ent_ord, dm.n_models FROM model_entities m JOIN processed_texts t ON t.id = m.doc_id JOIN model_catalog c ON c.catalog_ord = m.model_ord AND c.domain = t.domain JOIN dm ON dm.domain = t.domain),"
        " ent AS (SELECT doc_id, arg_min(text, (model_ord, ent_ord)) AS text FROM rep WHERE n_models > 1 GROUP BY doc_id, start_char, end_char UNION ALL SELECT doc_id, text FROM rep WHERE n_models = 1 UNION ALL " + ruled + "),"
        " hit AS (SELECT ent.doc_id, f.key IS NOT NULL AS found FROM ent LEFT JOIN f ON f.key = lower(regexp_replace(ent.text, '^[\\s\\x{00A0}\\x{2009}\\x{3000}]+|[\\s\\x{00A0}\\x{2009}\\x{3000}]+$', '', 'g')))"
        " SELECT t.id AS doc_id, CAST(count(hit.doc_id) AS INTEGER) AS n_entities, round(coalesce(avg(CASE WHEN hit.found THEN 1 ELSE 0 END) FILTER (hit.doc_id IS NOT NULL), 0.0), 6) AS kb_hit_rate FROM processed_texts t LEFT JOIN hit ON hit.doc_id = t.id GROUP BY t.id"
    )


@query(_pipeline_sql())
def pipeline_documents(s: SparkSession, d: str) -> DataFrame:
    """The pipeline of each domain over its texts: the stored reports of the domain's catalog models merged, rules, lookup, one row for each document.

    A text whose domain has no settings, rules or models of its own, or that has no domain, goes through the general settings and rules without models.
    """
    from lectern.plans.pipeline import Pipeline, reported

    chain = s.createDataFrame([(k, i) for i, k in enumerate(CHAIN)], "kb_id string, rank int")
    listed = _catalog(s, d).where("domain IS NOT NULL").select("domain", "catalog_ord", "model_id", F.coalesce("performance.f1_score", F.lit(1.0)).alias("weight")).orderBy("catalog_ord").collect()
    known = sorted({m.domain for m in listed} | {p["domain"] for p in fixed.PIPELINES} | {r[0] for r in fixed.RULES})
    docs = _texts(s, d).select(F.col("id").alias("doc_id"), "domain", "text")
    # each model's annotator reads the reports again; the cut keeps their joins out of every branch of the plan
    stored = cut(_model_entities(s, d).join(docs.select("doc_id", "domain"), "doc_id"))
    shares = [(n, docs.where(F.col("domain") == n)) for n in known] + [("other", docs.where(~F.coalesce(F.col("domain").isin(known), F.lit(False))))]
    found = None
    for name, share in shares:
        p = Pipeline(name)
        for m in listed:
            if m.domain == name:
                p.add_model(m.model_id, lambda _, k=m.catalog_ord, n=name: stored.where((F.col("model_ord") == k) & (F.col("domain") == n)).select("doc_id", "ent_ord", "text", "type", "start", "end", "confidence", "model_id"), m.weight)
        one = p.found(share.select("doc_id", "text"))
        found = one if found is None else found.unionByName(one)
    # all domains share the knowledge bases, so one lookup serves them
    looked_up = knowledge.lookup(found, read_table(s, d, "kb_entities"), chain)
    return reported(docs, looked_up).select("doc_id", F.size("entities").alias("n_entities"), "kb_hit_rate")
