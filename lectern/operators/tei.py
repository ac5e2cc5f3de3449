"""TEI documents from annotated texts: inline, stand-off or mixed, as one string expression over the schema's columns.

Columns used: sentences and entities as made by the annotator, dependencies where there are any, and the schema's fields. Lines come out
indented by two blanks a level; elements carry the prefix tei.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.functions.arrays import let, ranks, scan
from lectern.functions.text import certainty, html_escaped, xml_escaped
from lectern.session import bounded

NAMESPACE = "http://www.tei-c.org/ns/1.0"
MAX_SCHEMAS = 10_000
FLAGS = ("include_pos", "include_lemma", "include_dependencies", "include_analysis", "include_morph", "include_dep", "use_paragraphs", "classification")
_SCHEMA = "domain string, title string, annotation_strategy string, " + ", ".join(f"{f} boolean" for f in FLAGS) + ", entity_mappings map<string,string>, text_class string, description string, author string, schema_ref string, additional_tags array<string>"


def schemas(spark: SparkSession, own: list[dict] | None = None) -> DataFrame:
    """The schemas by domain; own ones replace built-in ones of the same domain."""
    table = {s["domain"]: s for s in fixed.SCHEMAS} | {s["domain"]: s for s in own or []}
    names = [f.split()[0] for f in _SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(s.get(n) for n in names) for s in table.values()], _SCHEMA)


def with_schema(docs: DataFrame, table: DataFrame, domain: str = "domain") -> DataFrame:
    """docs with the fields of their domain's schema as struct schema; of the default one for a domain without."""
    t = F.broadcast(bounded(table, MAX_SCHEMAS, "schemas").select(F.col("domain").alias("_d"), F.struct(*table.columns).alias("_s")))
    default = F.broadcast(table.where("domain = 'default'").limit(1).select(F.struct(*table.columns).alias("_f")))
    return docs.join(t, docs[domain] == t["_d"], "left").crossJoin(default).withColumn("schema", F.coalesce("_s", "_f")).drop("_d", "_s", "_f")


def _on(flag: str, default: bool) -> Column:
    return F.coalesce(F.col(f"schema.{flag}"), F.lit(default))


def _line(level: int, *parts: Column | str) -> Column:
    return F.concat(F.lit("  " * level), *(F.lit(p) if isinstance(p, str) else p for p in parts), F.lit("\n"))


def element_name(label: Column) -> Column:
    m = F.coalesce(F.col("schema.entity_mappings"), F.create_map(*[F.lit(x) for kv in fixed.DEFAULT_MAPPINGS.items() for x in kv]))
    return F.coalesce(F.try_element_at(m, F.upper(label)), F.try_element_at(m, F.lit("DEFAULT")), F.lit("name"))


def _attribute(flag: str, default: bool, name: str, value: Column) -> Column:
    """An attribute where the schema wants it and the token has it."""
    return F.when(_on(flag, default) & value.isNotNull(), F.concat(F.lit(f' {name}="'), xml_escaped(value), F.lit('"'))).otherwise("")


def _token(t: Column, level: int) -> Column:
    wanted = F.concat(_attribute("include_lemma", True, "lemma", t["lemma"]), _attribute("include_pos", True, "pos", t["pos"]), _attribute("include_morph", False, "msd", t["morph"]), _attribute("include_dep", False, "function", t["dep"]))
    ident = F.concat(F.lit(' xml:id="w'), (t["i"] + 1).cast("string"), F.lit('"'))
    word = _line(level, "<tei:w", wanted, ident, ">", xml_escaped(t["text"]), "</tei:w>")
    return F.when(t["is_punct"], _line(level, "<tei:pc", ident, ">", xml_escaped(t["text"]), "</tei:pc>")).when(t["is_space"], "").otherwise(word)


def _opening(e: Column, level: int) -> Column:
    name = element_name(e["label"])
    kind = F.when(name == "name", F.concat(F.lit(' type="'), xml_escaped(F.lower(e["label"])), F.lit('"'))).otherwise("")
    cert = F.when(e["confidence"].isNotNull(), F.concat(F.lit(' cert="'), certainty(e["confidence"]), F.lit('"'))).otherwise("")
    ref = F.when(e["kb_id"].isNotNull(), F.concat(F.lit(' ref="'), xml_escaped(e["kb_id"]), F.lit('"'))).otherwise("")
    return _line(level, "<tei:", name, kind, cert, ref, ">")


def _wrapping() -> Column:
    """The entities that wrap tokens, by place: one that begins within another before it is left out."""
    placed = F.filter("entities", lambda e: e["start"].isNotNull() & (e["end"] > e["start"]))
    listed = F.array_sort(F.transform(placed, lambda e, k: F.struct(e["start"].alias("start"), k.alias("k"), e["end"].alias("end"), e.alias("e"))))
    free = lambda s: scan(s, F.lit(-1), "boolean", lambda reach, x: (F.greatest(reach, x["end"]).cast("int"), x["start"] >= reach))
    return let(listed, lambda s: let(free(s), lambda f: F.filter(F.transform(s, lambda x, i: F.when(F.get(f, i), x["e"])), lambda e: e.isNotNull())))


def inline_body() -> Column:
    """Sentences with their tokens; an entity wraps its tokens as far as its sentence goes, and none begins within another.

    Entities and sentences are both in order of place, so one merge tells which entities begin in which sentence; the stretches between
    them are slices of the sentence's tokens.
    """
    box = F.when(_on("use_paragraphs", False), "tei:p").otherwise("tei:s")
    span = lambda toks, a, b, base, level: F.array_join(F.transform(F.slice(toks, a - base + 1, F.greatest(b - a, F.lit(0))), lambda t: _token(t, level)), "")

    def sentence(s: Column, k: Column, mine: Column) -> Column:
        base = F.coalesce(F.get(s["tokens"], F.lit(0))["i"], F.lit(0))
        end = base + F.size(s["tokens"])
        cut = lambda e: F.least(e["end"], end)

        def wrapped(e: Column, i: Column) -> Column:
            before = F.when(i == 0, base).otherwise(cut(F.get(mine, F.greatest(i - 1, F.lit(0)))))
            return F.concat(span(s["tokens"], before, e["start"], base, 4), _opening(e, 4), span(s["tokens"], e["start"], cut(e), base, 5), _line(4, "</tei:", element_name(e["label"]), ">"))

        rest = F.when(F.size(mine) == 0, base).otherwise(cut(F.get(mine, F.size(mine) - 1)))
        n = (k + 1).cast("string")
        return F.concat(_line(3, "<", box, ' xml:id="s', n, '" n="', n, '">'), F.array_join(F.transform(mine, wrapped), ""), span(s["tokens"], rest, end, base, 4), _line(3, "</", box, ">"))

    def whole(w: Column) -> Column:
        firsts = F.transform("sentences", lambda s: F.get(s["tokens"], F.lit(0))["i"])
        # a sentence without tokens begins where the one before it ends
        bounds = scan(F.transform(F.arrays_zip(firsts.alias("at"), F.transform("sentences", lambda s: F.size(s["tokens"])).alias("n")), lambda z: z), F.lit(0), "int", lambda at, z: (F.coalesce(z["at"] + z["n"], at).cast("int"), F.coalesce(z["at"], at).cast("int")))
        upto = let(bounds, lambda b: ranks(F.concat(b, F.array(F.lit(2147483647))), F.transform(w, lambda e: e["start"])))
        return let(upto, lambda r: F.array_join(F.transform("sentences", lambda s, k: let(F.slice(w, F.get(r, k) + 1, F.greatest(F.get(r, k + 1) - F.get(r, k), F.lit(0))), lambda mine: sentence(s, k, mine))), ""))

    return F.concat(_line(2, '<tei:div type="chapter" n="1">'), let(_wrapping(), whole), _line(2, "</tei:div>"))


def standoff_body() -> Column:
    def sentence(s: Column, k: Column) -> Column:
        n = (k + 1).cast("string")
        return F.concat(_line(3, '<tei:milestone unit="sentence" n="', n, '" xml:id="sent', n, '"/>'), _line(3, '<tei:p xml:id="p', n, '">', xml_escaped(s["text"]), "</tei:p>"))

    return F.concat(_line(2, "<tei:div>"), F.array_join(F.transform("sentences", sentence), ""), _line(2, "</tei:div>"))


def standoff_entities() -> Column:
    def one(e: Column, k: Column) -> Column:
        head = _line(4, '<tei:annotation xml:id="ent', (k + 1).cast("string"), '" type="named-entity" subtype="', xml_escaped(e["label"]), '" target="#char_', e["start_char"].cast("string"), "_", e["end_char"].cast("string"), '">')
        cert = F.when(e["confidence"].isNotNull(), _line(5, '<tei:certainty degree="', e["confidence"].cast("string"), '"/>')).otherwise("")
        return F.concat(head, cert, _line(5, "<tei:note>", xml_escaped(e["text"]), "</tei:note>"), _line(4, "</tei:annotation>"))

    listed = F.concat(_line(3, '<tei:listAnnotation type="entities">'), F.array_join(F.transform("entities", one), ""), _line(3, "</tei:listAnnotation>"))
    return F.when(F.size("entities") > 0, listed).otherwise("")


def standoff_tokens() -> Column:
    def one(t: Column) -> Column:
        head = _line(4, '<tei:annotation xml:id="tok', (t["i"] + 1).cast("string"), '" type="token" target="#char_', t["idx"].cast("string"), "_", (t["idx"] + F.char_length(t["text"])).cast("string"), '">')
        lemma = F.when(_on("include_lemma", True) & t["lemma"].isNotNull(), F.concat(_line(6, '<tei:f name="lemma">'), _line(7, "<tei:string>", xml_escaped(t["lemma"]), "</tei:string>"), _line(6, "</tei:f>"))).otherwise("")
        pos = F.when(_on("include_pos", True) & t["pos"].isNotNull(), F.concat(_line(6, '<tei:f name="pos">'), _line(7, '<tei:symbol value="', xml_escaped(t["pos"]), '"/>'), _line(6, "</tei:f>"))).otherwise("")
        return F.concat(head, _line(5, "<tei:fs>"), lemma, pos, _line(5, "</tei:fs>"), _line(4, "</tei:annotation>"))

    # a feature that a token does not have is left out
    flat = F.filter(F.flatten(F.transform("sentences", lambda s: s["tokens"])), lambda t: ~t["is_space"])
    listed = F.concat(_line(3, '<tei:listAnnotation type="linguistic">'), F.array_join(F.transform(flat, one), ""), _line(3, "</tei:listAnnotation>"))
    return F.when(_on("include_pos", True) | _on("include_lemma", True), listed).otherwise("")


def standoff_links(dependencies: Column) -> Column:
    """Links of array<struct<from, to, dep, from_text, to_text>>; nothing without any or where the schema leaves them out."""

    def one(d: Column, k: Column) -> Column:
        head = _line(4, '<tei:link xml:id="dep', (k + 1).cast("string"), '" type="', xml_escaped(d["dep"]), '" target="#w', (d["from"] + 1).cast("string"), " #w", (d["to"] + 1).cast("string"), '">')
        return F.concat(head, _line(5, "<tei:note>", xml_escaped(F.concat(d["from_text"], F.lit(" --"), d["dep"], F.lit("--> "), d["to_text"])), "</tei:note>"), _line(4, "</tei:link>"))

    listed = F.concat(_line(3, '<tei:linkGrp type="syntactic-dependencies">'), F.array_join(F.transform(dependencies, one), ""), _line(3, "</tei:linkGrp>"))
    return F.when(_on("include_dependencies", True) & (F.size(dependencies) > 0), listed).otherwise("")


def tag_usage() -> Column:
    flat = F.flatten(F.transform("sentences", lambda s: s["tokens"]))
    counts = [("w", F.size(F.filter(flat, lambda t: ~t["is_punct"] & ~t["is_space"]))), ("pc", F.size(F.filter(flat, lambda t: t["is_punct"]))), ("s", F.size("sentences"))]
    fixed_part = F.concat(*(F.when(n > 0, _line(5, f'<tei:tagUsage gi="{tag}" occurs="', n.cast("string"), '"/>')).otherwise("") for tag, n in counts))
    named = F.transform("entities", lambda e: element_name(e["label"]))
    each = let(named, lambda all_: F.array_join(F.transform(F.array_distinct(all_), lambda n: _line(5, '<tei:tagUsage gi="', n, '" occurs="', F.size(F.filter(all_, lambda x: x == n)).cast("string"), '"/>')), ""))
    return F.concat(fixed_part, each)


def _leaf(level: int, tag: str, value: Column | str, attributes: str = "") -> Column:
    return _line(level, f"<tei:{tag}{attributes}>", xml_escaped(value) if isinstance(value, Column) else value, f"</tei:{tag}>")


def _box(level: int, tag: str, *inner: Column, attributes: str = "") -> Column:
    return F.concat(_line(level, f"<tei:{tag}{attributes}>"), *inner, _line(level, f"</tei:{tag}>"))


def header(made_at: Column, encoder: str = "lectern") -> Column:
    """The header; the time is given, so that results can be compared."""
    domain = F.coalesce("schema.domain", F.lit("default"))
    when = F.concat(F.lit('<tei:date when="'), made_at, F.lit('"/>'))
    author = F.when(F.col("schema.author").isNotNull(), _leaf(4, "author", F.col("schema.author"))).otherwise("")
    category = F.concat(_line(6, '<tei:category xml:id="', xml_escaped(domain), '">'), _leaf(7, "catDesc", F.coalesce("schema.description", F.concat(domain, F.lit(fixed.TEI_DOMAIN_TEXTS)))), _line(6, "</tei:category>"))
    classes = F.when(_on("classification", False), _box(3, "classDecl", _box(5, "taxonomy", category, attributes=' xml:id="domain"'))).otherwise("")
    text_class = F.when(F.col("schema.text_class").isNotNull(), _box(3, "textClass", _box(4, "keywords", _leaf(5, "term", domain), attributes=' scheme="#domain"'))).otherwise("")
    return _box(
        1,
        "teiHeader",
        _box(
            2,
            "fileDesc",
            _box(3, "titleStmt", _leaf(4, "title", F.coalesce("schema.title", F.lit(fixed.TEI_TITLE))), author, _box(4, "respStmt", _leaf(5, "resp", fixed.TEI_RESPONSIBILITY), _leaf(5, "name", encoder))),
            _box(3, "editionStmt", _box(4, "edition", _line(5, fixed.TEI_EDITION), _line(5, when))),
            _box(3, "publicationStmt", _leaf(4, "publisher", encoder), _line(4, when), _box(4, "availability", _leaf(5, "p", fixed.TEI_AVAILABILITY), attributes=' status="free"')),
            _box(3, "sourceDesc", _leaf(4, "p", fixed.TEI_SOURCE)),
        ),
        _box(2, "encodingDesc", _box(3, "projectDesc", _leaf(4, "p", F.concat(F.lit(fixed.TEI_PROJECT), domain))), _box(3, "tagsDecl", _box(4, "namespace", tag_usage(), attributes=f' name="{NAMESPACE}"')), classes),
        _box(2, "profileDesc", _box(3, "langUsage", _line(4, '<tei:language ident="', xml_escaped(F.coalesce(F.col("language"), F.lit("en"))), f'">{fixed.TEI_LANGUAGE}</tei:language>')), text_class),
    )


def analysis() -> Column:
    n = F.aggregate(F.transform("sentences", lambda s: F.size(s["tokens"])), F.lit(0), lambda a, x: a + x)
    items = list(zip(fixed.TEI_STATISTICS, (F.size("sentences"), n, F.size("entities"), F.size("dependencies"), F.size("noun_chunks"))))
    lines = F.concat(*(_box(5, "item", _line(6, v.cast("string")), _leaf(6, "label", k)) for k, v in items))
    whole = _box(2, "back", _box(3, "div", _leaf(4, "head", fixed.TEI_ANALYSIS), _box(4, "list", lines, attributes=' type="statistics"'), attributes=' type="analysis"'))
    return F.when(_on("include_analysis", False), whole).otherwise("")


def fallback(text: Column, error: Column) -> Column:
    """The document for a text whose annotation is not usable."""
    return F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8"?>\n<TEI xmlns="{NAMESPACE}"><teiHeader><fileDesc><titleStmt><title>Processing Error</title></titleStmt></fileDesc></teiHeader><text><body><p>'), xml_escaped(F.coalesce(text, F.lit(""))), F.lit("</p><note>"), xml_escaped(error), F.lit("</note></body></text></TEI>"))


def minimal(text: Column, domain: Column, error: Column | None = None) -> Column:
    """The short document for a text that could not be worked on at all; the error stands in it as a comment."""
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<TEI xmlns="{NAMESPACE}">\n  <teiHeader>\n    <fileDesc>\n      <titleStmt>\n        <title>{fixed.TEI_MINIMAL_TITLE}'
    middle = f"</title>\n      </titleStmt>\n      <publicationStmt>\n        <p>{fixed.TEI_MINIMAL_PUBLICATION}</p>\n      </publicationStmt>\n      <sourceDesc>\n        <p>{fixed.TEI_MINIMAL_SOURCE}</p>\n      </sourceDesc>\n    </fileDesc>\n  </teiHeader>\n  <text>\n    <body>\n      "
    note = F.lit("") if error is None else F.when(error.isNotNull() & (error != ""), F.concat(F.lit("<!-- Processing error: "), F.replace(error, F.lit("--"), F.lit("- -")), F.lit(" -->"))).otherwise("")
    return F.concat(F.lit(head), html_escaped(domain), F.lit(middle), note, F.lit("\n      <p>"), html_escaped(F.coalesce(text, F.lit(""))), F.lit("</p>\n    </body>\n  </text>\n</TEI>"))


def usable() -> Column:
    """Whether the annotation has the parts that a document needs."""
    return F.col("sentences").isNotNull() & F.col("entities").isNotNull()


def converted(docs: DataFrame, made_at: Column) -> DataFrame:
    """docs with column tei. Needs text, sentences, entities, language, dependencies, noun_chunks and schema; null sentences or entities give
    the fallback. A null annotation inside a token leaves its attribute out."""
    docs = docs if "noun_chunks" in docs.columns else docs.withColumn("noun_chunks", F.expr("cast(array() as array<string>)"))
    strategy = F.coalesce(F.col("schema.annotation_strategy"), F.lit("inline"))
    deps = F.col("dependencies")
    stand = lambda *parts: F.concat(_line(2, "<tei:standOff>"), *parts, _line(2, "</tei:standOff>"))
    within = lambda inner: F.concat(_line(1, "<tei:text>"), _line(2, "<tei:body>"), inner, _line(2, "</tei:body>"))
    links = standoff_links(deps)
    # inline or, for mixed and any other strategy, inline with the links apart
    inline = F.concat(within(inline_body()), F.when(strategy != "inline", stand(links)).otherwise(""))
    body = F.when(strategy == "standoff", F.concat(within(standoff_body()), stand(standoff_entities(), standoff_tokens(), links))).otherwise(inline)
    ref = F.when(F.col("schema.schema_ref").isNotNull(), F.concat(F.lit(' schemaRef="'), xml_escaped(F.col("schema.schema_ref")), F.lit('"'))).otherwise("")
    root = F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8"?>\n<tei:TEI xmlns:tei="{NAMESPACE}" version="5.0" xml:lang="en"'), ref, F.lit(">\n"))
    whole = F.concat(root, header(made_at), body, analysis(), _line(1, "</tei:text>"), F.lit("</tei:TEI>\n"))
    return docs.withColumn("tei", F.when(usable(), whole).otherwise(fallback(F.col("text"), F.lit("Invalid NLP results structure"))))
