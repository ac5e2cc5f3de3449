"""A rule-based annotator and its parts: sentences, tokens, entities, dependency edges. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.arrays import ranks, scan
from lectern.operators.patterns import Rule, candidates, resolved, spans

SENTENCE = r"[^.!?。！？।؟\n]*[.!?。！？।؟]+|[^.!?。！？।؟\n]+"
TOKEN = r"[\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}\p{Z}\p{C}]"
#: What this annotator can give.
CAPABILITIES = frozenset(("entities", "sentences", "tokens", "pos_tags", "lemmas"))
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "to", "was", "were", "with")


def placed(text: Column, pattern: str, base: Column | int = 0) -> Column:
    """array<struct<start, end, text>> of all matches of a pattern, base added to the offsets."""
    found = spans(text, Rule("x", pattern))
    b = F.lit(base) if isinstance(base, int) else base
    return F.transform(found, lambda m: F.struct((m["start"] + b).cast("int").alias("start"), (m["end"] + b).cast("int").alias("end"), m["text"].alias("text")))


def shape(t: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"\p{Lu}", "X"), r"\p{Ll}", "x"), r"\p{N}", "d")
    return F.regexp_replace(s, r"(X{4})X+|(x{4})x+|(d{4})d+", "$1$2$3")


def tokens(sentence: Column, start: Column) -> Column:
    """Tokens of a sentence, with offsets in the text."""

    def dress(m: Column, i: Column) -> Column:
        t = m["text"]
        punct = ~t.rlike(r"[\p{L}\p{M}\p{N}]")
        return F.struct(
            t.alias("text"),
            F.lower(t).alias("lemma"),
            F.when(punct, "PUNCT").when(t.rlike(r"^\p{N}+$"), "NUM").otherwise("X").alias("pos"),
            m["start"].alias("idx"),
            i.cast("int").alias("i"),
            punct.alias("is_punct"),
            F.lit(False).alias("is_space"),
            t.rlike(r"^\p{L}+$").alias("is_alpha"),
            F.lower(t).isin(*STOP_WORDS).alias("is_stop"),
            shape(t).alias("shape"),
        )

    return F.transform(placed(sentence, TOKEN, start), dress)


TOKEN_TYPE = "struct<text:string,lemma:string,pos:string,idx:int,i:int,is_punct:boolean,is_space:boolean,is_alpha:boolean,is_stop:boolean,shape:string,dep:string,head:int,morph:string>"
SENTENCE_TYPE = f"struct<text:string,start:int,end:int,tokens:array<{TOKEN_TYPE}>>"
ENTITY_TYPE = "struct<text:string,label:string,start:int,end:int,start_char:int,end_char:int,confidence:double,kb_id:string>"
DEPENDENCY_TYPE = "struct<`from`:int,`to`:int,dep:string,from_text:string,to_text:string>"


def made(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are worked out here once: later expressions read them instead of taking them in."""
    one = F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items()))))
    return df.select("*", one.alias("_made")).select(*df.columns, *(F.col(f"_made.{n}").alias(n) for n in columns))


def none_of(kind: str) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


def annotated(df: DataFrame, key: str, text: str, rules: list[Rule], *keep: str) -> DataFrame:
    """(key, text, sentences, entities, dependencies, noun_chunks, *keep): a document as nested sentences with numbered tokens, and entities
    with token and character spans. The rules know no grammar, so dependencies and noun chunks are empty.

    A null text has null sentences and entities; an empty or blank one has empty ones.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    sent = F.filter(placed(t, SENTENCE), lambda s: F.trim(s["text"]) != "")
    raw = F.transform(sent, lambda s: F.struct(F.trim(s["text"]).alias("text"), tokens(s["text"], s["start"]).alias("tokens")))
    d = made(df.select(F.col(key), F.col(text).alias("text"), *keep), raw=raw, found=resolved(candidates(t, rules)))

    def number(n: Column, x: Column) -> tuple[Column, Column]:
        """The next sentence, its tokens numbered on from those before."""
        blank = [F.lit(None).cast(k).alias(v) for v, k in (("dep", "string"), ("head", "int"), ("morph", "string"))]
        toks = F.transform(x["tokens"], lambda t: F.struct(*(((t["i"] + n).cast("int") if f == "i" else t[f]).alias(f) for f in ("text", "lemma", "pos", "idx", "i", "is_punct", "is_space", "is_alpha", "is_stop", "shape")), *blank))
        end = (n + F.size(x["tokens"])).cast("int")
        return end, F.struct(x["text"].alias("text"), n.alias("start"), end.alias("end"), toks.alias("tokens"))

    d = made(d, sentences=scan(F.col("raw"), F.lit(0), SENTENCE_TYPE, number))
    at = F.flatten(F.transform("sentences", lambda s: F.transform(s["tokens"], lambda t: t["idx"])))
    first = ranks(F.transform("found", lambda e: e["start"]), at)
    after = ranks(F.transform("found", lambda e: e["end"]), at)
    # most texts have no entity, and need no merge of places
    d = made(d, first=F.when(F.size("found") > 0, first), after=F.when(F.size("found") > 0, after))

    def entity(e: Column, k: Column) -> Column:
        where = [F.get("first", k).alias("start"), F.get("after", k).alias("end")]
        return F.struct(e["text"].alias("text"), e["entity_type"].alias("label"), *where, e["start"].alias("start_char"), e["end"].alias("end_char"), e["confidence"].alias("confidence"), F.lit(None).cast("string").alias("kb_id"))

    d = made(d, entities=F.filter(F.transform("found", entity), lambda e: e["end"] > e["start"]))
    there = F.col("text").isNotNull()
    return d.select(key, "text", F.when(there, F.col("sentences")).alias("sentences"), F.when(there, F.col("entities")).alias("entities"), none_of(DEPENDENCY_TYPE).alias("dependencies"), none_of("string").alias("noun_chunks"), *keep)


# --- stored annotation ----------------------------------------------------------------------------------------------------------------

_PARTS = ("text", "language", "sentences", "entities", "dependencies", "noun_chunks", "nlp_results")


def stored(df: DataFrame, key: str, json: str, *keep: str) -> DataFrame:
    """(key, sentences, entities, dependencies, noun_chunks, language, valid, *keep) of annotation kept as JSON.

    The document is the value itself or the value of its field nlp_results; JSON kept as a string inside JSON counts as its content. valid
    says whether it has the structure that a conversion needs: sentences is an array of objects with a text, whose tokens, if any, are an
    array; entities is an array of objects with text and label. Where it is not valid, sentences and entities are null. Missing tokens,
    dependencies and noun chunks are empty; a field of another type than expected is null.
    """
    from lectern.operators.flatten import STRICT, _items, _object, _sole

    d = made(df.select(key, F.col(json).alias("_json"), *keep), _o=_object(_sole(F.col("_json")), _PARTS))
    d = made(d, _i=_object(F.col("_o.nlp_results"), _PARTS))
    field = {n: F.when(F.col("_i").isNotNull(), F.col(f"_i.{n}")).otherwise(F.col(f"_o.{n}")) for n in _PARTS if n != "nlp_results"}
    is_list = lambda c: F.ltrim(c).startswith("[")
    listed = lambda c: F.when(is_list(c), _items(c))
    d = made(d, _s=F.transform(listed(field["sentences"]), lambda x: _object(x, ("text", "tokens"))), _e=F.transform(listed(field["entities"]), lambda x: _object(x, ("text", "label"))))
    right = F.coalesce(
        F.forall("_s", lambda x: x.isNotNull() & x["text"].isNotNull() & F.coalesce(is_list(x["tokens"]), F.lit(True))) & F.forall("_e", lambda x: x.isNotNull() & x["text"].isNotNull() & x["label"].isNotNull()), F.lit(False)
    )
    typed = lambda c, kind: F.from_json(c, f"array<{kind}>", STRICT)
    d = made(
        d,
        valid=right,
        sentences=F.when(right, F.transform(typed(field["sentences"], SENTENCE_TYPE), lambda s: s.withField("tokens", F.coalesce(s["tokens"], none_of(TOKEN_TYPE))))),
        entities=F.when(right, typed(field["entities"], ENTITY_TYPE)),
        dependencies=F.coalesce(typed(field["dependencies"], DEPENDENCY_TYPE), none_of(DEPENDENCY_TYPE)),
        noun_chunks=F.coalesce(F.from_json(field["noun_chunks"], "array<string>", STRICT), none_of("string")),
        language=field["language"],
    )
    return d.select(key, "sentences", "entities", "dependencies", "noun_chunks", "language", "valid", *keep)


def token_table(nested: DataFrame, key: str) -> DataFrame:
    return nested.select(key, F.posexplode("sentences").alias("sent_no", "s")).select(key, "sent_no", F.explode("s.tokens").alias("t")).select(key, "sent_no", "t.*")


def dependency_edges(tokens_: DataFrame, doc: list[str]) -> DataFrame:
    """Edges head -> token of tokens with i, head, dep, text, pos: no roots, none to itself, each once.

    Where two tokens of a document share a number, the edge has the smallest texts.
    """
    t = tokens_.where("dep IS NOT NULL AND dep <> 'ROOT' AND i <> head").select(*doc, F.col("head").alias("from"), F.col("i").alias("to"), "dep", F.col("text").alias("to_text"), F.col("pos").alias("to_pos"))
    h = tokens_.select(*doc, F.col("i").alias("from"), F.col("text").alias("from_text"), F.col("pos").alias("from_pos"))
    rest = ["from_text", "from_pos", "to_text", "to_pos"]
    return t.join(h, [*doc, "from"]).groupBy(*doc, "from", "to", "dep").agg(F.min(F.struct(*rest)).alias("v")).select(*doc, "from", "to", "dep", *(F.col(f"v.{c}").alias(c) for c in rest))


def statistics(nested: DataFrame, key: str) -> DataFrame:
    """Numbers of sentences, tokens, entities, dependencies and noun phrases of each document; 0 where a part is missing."""
    n = F.aggregate(F.transform("sentences", lambda s: F.size(s["tokens"])), F.lit(0), lambda a, x: a + x)
    parts = {"n_sentences": F.size("sentences"), "n_tokens": n, "n_entities": F.size("entities"), "n_dependencies": F.size("dependencies"), "n_noun_phrases": F.size("noun_chunks")}
    return nested.select(key, *(F.coalesce(F.greatest(c, F.lit(0)), F.lit(0)).alias(k) for k, c in parts.items()))
