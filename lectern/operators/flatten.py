"""Nested JSON to flat tables, one for each level, with parent keys.

The JVM turns the text into nested arrays; Python sees them only as Arrow buffers. Each level is made from the list offsets: the values
buffer is the child table, the parent-index kernel tells each child's parent, and the keys of the parents are taken by that index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false", "allowComments": "false", "maxNestingDepth": "1000"}

#: Fields of each level. All are read as text: a JSON string gives its content, anything else its JSON text, so that JSON kept as a string reads alike.
ENTITY = ("text", "label", "type", "start_char", "end_char", "start", "end", "confidence", "kb_entity")
KB = ("kb_id", "entity_id", "text", "synonyms", "relationships")
RELATION = ("source_id", "target_id", "relationship_type", "confidence", "metadata")
SENTENCE = ("text", "start", "end", "tokens")
TOKEN = ("text", "lemma", "pos", "tag", "dep", "head", "idx", "i")


def _fields(names: tuple[str, ...]) -> str:
    return "struct<" + ",".join(f"`{n}`:string" for n in names) + ">"


def _sole(text: Column) -> Column:
    """The JSON value in text, as text; a JSON string gives its content. Null unless text is exactly one valid JSON value."""
    a = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>", STRICT)
    return F.when(F.size(a) == 1, F.get(a, 0))


def _items(text: Column) -> Column:
    """The elements of a JSON array, in order, nulls kept; an object counts as an array of one; anything else gives null."""
    t = F.ltrim(text)
    whole = F.when(t.startswith("["), text).when(t.startswith("{"), F.concat(F.lit("["), text, F.lit("]")))
    return F.from_json(whole, "array<string>", STRICT)


def _object(text: Column, names: tuple[str, ...]) -> Column:
    """The fields of a JSON object; null for anything that is no object."""
    return F.when(F.ltrim(text).startswith("{"), F.from_json(text, _fields(names), STRICT))


def _entities(items: Column) -> Column:
    def one(e: Column) -> Column:
        o = _object(e, ENTITY)
        k = _object(o["kb_entity"], KB)
        plain = [o[n].alias(n) for n in ENTITY if n != "kb_entity"]
        rel = F.transform(_items(k["relationships"]), lambda r: _object(r, RELATION))
        kb = F.struct(k["kb_id"].alias("kb_id"), k["entity_id"].alias("entity_id"), k["text"].alias("text"), _items(k["synonyms"]).alias("synonyms"), rel.alias("relationships"))
        return F.when(F.ltrim(e).startswith("{"), F.struct(*plain, F.when(k.isNotNull(), kb).alias("kb_entity")))

    return F.transform(items, one)


def _sentences(items: Column) -> Column:
    def one(s: Column) -> Column:
        o = _object(s, SENTENCE)
        tokens = F.transform(_items(o["tokens"]), lambda t: _object(t, TOKEN))
        return F.when(F.ltrim(s).startswith("{"), F.struct(o["text"].alias("text"), o["start"].alias("start"), o["end"].alias("end"), tokens.alias("tokens")))

    return F.transform(items, one)


def nested_documents(df: DataFrame, row_id: str, json: str, src: str, parts: tuple[str, ...] = ("entities",)) -> DataFrame:
    """The JSON column as src, row_id, chunks: array<struct<entities, sentences>>, entries null where the document has none.

    A document is the value itself, the value of its field nlp_results, or the elements of its field chunks (each again with or without
    nlp_results). Text that is no valid JSON gives no row. Null and empty text give no row.
    """
    top = ("nlp_results", "chunks", *parts)
    doc = df.where(F.col(json).isNotNull()).select(F.lit(src).alias("src"), F.col(row_id).cast("long").alias("row_id"), _sole(F.col(json)).alias("j"))
    # a value that was itself a JSON string is JSON again; its content has to be one valid value too
    doc = doc.withColumn("o", _object(F.col("j"), top)).where(F.col("o").isNotNull())
    inner = _object(F.col("o.nlp_results"), parts)
    doc = doc.select("src", "row_id", "o", inner.alias("inner"), _items(F.col("o.chunks")).alias("pieces"))

    def build(fields: dict[str, Column]) -> Column:
        made = {"entities": _entities, "sentences": _sentences}
        return F.struct(*(made[p](_items(fields[p])).alias(p) for p in parts))

    own = build({p: F.coalesce(F.col(f"inner.{p}"), F.col(f"o.{p}")) for p in parts})

    def piece(c: Column) -> Column:
        o = _object(c, ("nlp_results", *parts))
        i = _object(o["nlp_results"], parts)
        return build({p: F.coalesce(i[p], o[p]) for p in parts})

    chunks = F.when(F.size("pieces") > 0, F.transform("pieces", piece)).otherwise(F.array(own))
    return doc.select("src", "row_id", chunks.alias("chunks"))


# --- Arrow side -------------------------------------------------------------------------------------------------------------------


def _children(lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Values of a list array, the index of each value's parent, and its position in the parent, from the offsets alone."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    parent = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    values = lists.flatten()
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    first = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else np.zeros(0, "int64")
    return values, parent, np.arange(len(values)) - first[parent]


def _kept(values: pa.Array, *along: np.ndarray) -> tuple:
    """Drops null values, whose positions stay counted, and what goes with them."""
    keep = values.is_valid().to_numpy(zero_copy_only=False)
    return values.filter(pa.array(keep)), *(a[keep] for a in along)


def _field(values: pa.Array, name: str) -> pa.Array:
    return pc.struct_field(values, name)


def _levels(batch: pa.RecordBatch) -> dict[str, dict[str, pa.Array]]:
    """All flat tables of a batch, as columns."""
    src, row_id = batch.column("src"), batch.column("row_id")
    chunk, doc_of, chunk_no = _children(batch.column("chunks"))
    chunk, doc_of, chunk_no = _kept(chunk, doc_of, chunk_no)
    keys = {"src": src.take(pa.array(doc_of)), "row_id": row_id.take(pa.array(doc_of)), "chunk_no": pa.array(chunk_no.astype("int32"))}
    out: dict[str, dict[str, pa.Array]] = {}

    def below(parent_keys: dict[str, pa.Array], lists: pa.Array, no: str) -> tuple[dict[str, pa.Array], pa.Array]:
        values, parent, at = _kept(*_children(lists))
        index = pa.array(parent)
        return {k: v.take(index) for k, v in parent_keys.items()} | {no: pa.array(at.astype("int32"))}, values

    names = {f.name for f in chunk.type}
    if "entities" in names:
        ek, ent = below(keys, _field(chunk, "entities"), "ent_no")
        kb = _field(ent, "kb_entity")
        out["entities"] = ek | {n: _field(ent, n) for n in ENTITY if n != "kb_entity"}
        has = kb.is_valid()
        kk, kb_only = {k: v.filter(has) for k, v in ek.items()}, kb.filter(has)
        out["kb_links"] = kk | {n: _field(kb_only, n) for n in ("kb_id", "entity_id", "text")}
        sk, syn = below(kk, _field(kb_only, "synonyms"), "syn_no")
        out["synonyms"] = sk | {"synonym": syn}
        rk, rel = below(kk, _field(kb_only, "relationships"), "rel_no")
        out["relationships"] = rk | {n: _field(rel, n) for n in RELATION}
        # entities and their relationships in one table: -1 where an entity has none
        position = np.full(len(ent), -1)
        of, at = _relation_parents(has, kb_only)
        bare = np.setdiff1d(np.arange(len(ent)), of)
        index = pa.array(np.concatenate([of, bare]))
        out["entity_relationships"] = {k: v.take(index) for k, v in ek.items()} | {"rel_no": pa.array(np.concatenate([at, position[bare]]).astype("int32"))}
    if "sentences" in names:
        sk, sent = below(keys, _field(chunk, "sentences"), "sent_no")
        out["sentences"] = sk | {n: _field(sent, n) for n in ("text", "start", "end")}
        tk, tok = below(sk, _field(sent, "tokens"), "tok_no")
        out["tokens"] = tk | {n: _field(tok, n) for n in TOKEN}
    return out


def _relation_parents(has: pa.Array, kb_only: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    _, parent, at = _kept(*_children(_field(kb_only, "relationships")))
    return np.flatnonzero(has.to_numpy(zero_copy_only=False))[parent], at


_KEY = "src string, row_id long, chunk_no int"
LEVELS = {
    "entities": (_KEY + ", ent_no int, " + ", ".join(f"`{n}` string" for n in ENTITY if n != "kb_entity"), ("entities",)),
    "kb_links": (_KEY + ", ent_no int, kb_id string, entity_id string, text string", ("entities",)),
    "synonyms": (_KEY + ", ent_no int, syn_no int, synonym string", ("entities",)),
    "relationships": (_KEY + ", ent_no int, rel_no int, " + ", ".join(f"{n} string" for n in RELATION), ("entities",)),
    "entity_relationships": (_KEY + ", ent_no int, rel_no int", ("entities",)),
    "sentences": (_KEY + ", sent_no int, text string, `start` string, `end` string", ("sentences",)),
    "tokens": (_KEY + ", sent_no int, tok_no int, " + ", ".join(f"`{n}` string" for n in TOKEN), ("sentences",)),
}


def flatten_level(nested: DataFrame, level: str) -> DataFrame:
    """One flat table (a key of LEVELS) of the nested documents. Positions count null elements, which give no row."""
    schema, _ = LEVELS[level]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                columns = _levels(b)[level]
                yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns.values()], names=list(columns))

    return nested.mapInArrow(run, schema)


def flatten_tables(level: str, *tables: tuple[DataFrame, str, str, str]) -> DataFrame:
    """A level over several tables, each given as (table, id column, JSON column, name)."""
    parts = LEVELS[level][1]
    out = [flatten_level(nested_documents(df, key, json, src, parts), level) for df, key, json, src in tables]
    first = out[0]
    for o in out[1:]:
        first = first.unionByName(o)
    return first
