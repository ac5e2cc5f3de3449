"""SQL over the JSON columns, for the queries that flatten them. It says in the terms of another engine what flatten does in this one."""

from __future__ import annotations


def opened(x: str) -> str:
    """A JSON value; a JSON string gives the JSON in it, or null if there is none."""
    return f"(CASE WHEN json_type({x}) = 'VARCHAR' THEN TRY_CAST(({x} ->> '$') AS JSON) ELSE {x} END)"


def obj(x: str) -> str:
    """The JSON object that x is or holds as a string, else null."""
    return f"(CASE WHEN json_type({opened(x)}) = 'OBJECT' THEN {opened(x)} END)"


def arr(x: str) -> str:
    """The elements of an array; an object is an array of one; anything else has none."""
    o = opened(x)
    return f"(CASE json_type({o}) WHEN 'ARRAY' THEN CAST({o} AS JSON[]) WHEN 'OBJECT' THEN [{o}] ELSE CAST([] AS JSON[]) END)"


def some(*xs: str) -> str:
    """The first that is there and not the JSON null."""
    return "coalesce(" + ", ".join(f"(CASE WHEN json_type({x}) <> 'NULL' THEN {x} END)" for x in xs) + ")"


def text(x: str) -> str:
    """A field as text: a string's content, or the JSON of anything else; null for the JSON null."""
    return f"(CASE json_type({x}) WHEN 'NULL' THEN NULL WHEN 'VARCHAR' THEN {x} ->> '$' ELSE CAST({x} AS VARCHAR) END)"


def _field(o: str, *names: str) -> str:
    return ", ".join(f"{text(f'json_extract({o}, {chr(39)}$.{n}{chr(39)})')} AS \"{n}\"" for n in names)


_TABLES = "SELECT 'processed_texts' AS src, id AS row_id, nlp_results AS t FROM processed_texts UNION ALL SELECT 'background_tasks', id, result FROM background_tasks"


def documents(tables: str = _TABLES, parts: tuple[str, ...] = ("entities", "sentences")) -> str:
    """CTEs ending in p (src, row_id, chunk_no, and each part as JSON): the documents of each row."""
    picked = ", ".join(f"{some(f'json_extract(i, {chr(39)}$.{n}{chr(39)})', f'json_extract(c, {chr(39)}$.{n}{chr(39)})')} AS {n}" for n in parts)
    return (
        f"j0 AS ({tables}), j1 AS (SELECT src, row_id, TRY_CAST(t AS JSON) AS j FROM j0 WHERE json_valid(t)), j2 AS (SELECT src, row_id, {obj('j')} AS o FROM j1),"
        f" j3 AS (SELECT src, row_id, o, {arr(chr(34) + 'chunks' + chr(34))} AS cs FROM (SELECT src, row_id, o, json_extract(o, '$.chunks') AS chunks FROM j2 WHERE o IS NOT NULL)),"
        f" j4 AS (SELECT src, row_id, CAST(k - 1 AS INTEGER) AS chunk_no, {obj('cs[k]')} AS c FROM (SELECT src, row_id, cs, unnest(range(1, len(cs) + 1)) AS k FROM j3 WHERE len(cs) > 0) UNION ALL SELECT src, row_id, 0, o FROM j3 WHERE len(cs) = 0),"
        f" j5 AS (SELECT src, row_id, chunk_no, c, {obj('n')} AS i FROM (SELECT src, row_id, chunk_no, c, json_extract(c, '$.nlp_results') AS n FROM j4)),"
        f" p AS (SELECT src, row_id, chunk_no, {picked} FROM j5)"
    )


def _below(name: str, parent: str, keys: str, value: str, no: str) -> str:
    """A CTE with the objects among the elements of value, with their positions."""
    return f"{name} AS (SELECT {keys}, CAST(k - 1 AS INTEGER) AS {no}, {obj('l[k]')} AS o FROM (SELECT {keys}, l, unnest(range(1, len(l) + 1)) AS k FROM (SELECT {keys}, {arr(value)} AS l FROM {parent})) WHERE {obj('l[k]')} IS NOT NULL)"


KEYS = "src, row_id, chunk_no"
_ENTITIES = "WITH " + documents() + ", " + _below("en", "p", KEYS, "entities", "ent_no")
_KB = _ENTITIES + f", kb AS (SELECT {KEYS}, ent_no, kb FROM (SELECT {KEYS}, ent_no, {obj('v')} AS kb FROM (SELECT {KEYS}, ent_no, json_extract(o, '$.kb_entity') AS v FROM en)) WHERE kb IS NOT NULL)"
_REL = _KB + ", " + _below("rl", "(SELECT *, json_extract(kb, '$.relationships') AS rels FROM kb)", f"{KEYS}, ent_no", "rels", "rel_no")
_SENTENCES = "WITH " + documents() + ", " + _below("st", "p", KEYS, "sentences", "sent_no")

LEVELS = {
    "found": _REL + f" SELECT {KEYS}, ent_no, rel_no FROM rl UNION ALL SELECT {KEYS}, ent_no, -1 FROM en WHERE NOT EXISTS (SELECT 1 FROM rl WHERE rl.src = en.src AND rl.row_id = en.row_id AND rl.chunk_no = en.chunk_no AND rl.ent_no = en.ent_no)",
    "entities": _ENTITIES + f" SELECT {KEYS}, ent_no, " + _field("o", "text", "label", "type", "start_char", "end_char", "start", "end", "confidence") + " FROM en",
    "kb_links": _KB + f" SELECT {KEYS}, ent_no, " + _field("kb", "kb_id", "entity_id", "text") + " FROM kb",
    "synonyms": _KB + f" SELECT {KEYS}, ent_no, CAST(k - 1 AS INTEGER) AS syn_no, {text('l[k]')} AS synonym FROM (SELECT {KEYS}, ent_no, l, unnest(range(1, len(l) + 1)) AS k FROM (SELECT {KEYS}, ent_no, {arr('v')} AS l FROM (SELECT {KEYS}, ent_no, json_extract(kb, '$.synonyms') AS v FROM kb))) WHERE {text('l[k]')} IS NOT NULL",
    "relationships": _REL + f" SELECT {KEYS}, ent_no, rel_no, " + _field("o", "source_id", "target_id", "relationship_type", "confidence", "metadata") + " FROM rl",
    "sentences": _SENTENCES + f" SELECT {KEYS}, sent_no, " + _field("o", "text", "start", "end") + " FROM st",
    "tokens": _SENTENCES + ", " + _below("tk", "(SELECT *, json_extract(o, '$.tokens') AS toks FROM st)", f"{KEYS}, sent_no", "toks", "tok_no") + f" SELECT {KEYS}, sent_no, tok_no, " + _field("o", "text", "lemma", "pos", "tag", "dep", "head", "idx", "i") + " FROM tk",
}
