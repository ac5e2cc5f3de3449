"""Records equal but for outward form: white space, letter case, punctuation and the order of fields.

Each text is a sequence of forms, records and stretches of running text. Field names, values and stretches are dictionary-encoded in two
steps. A worker keeps a dictionary of its own lot of rows: each distinct string is canonicalised once and gets the next number of the lot.
The lots' dictionaries, not the rows, then meet: each distinct canonical value of all lots gets one integer, and each lot a table from its
numbers to these integers. So a value that every record has costs one row for each lot. Records are rewritten lot by lot as tuples of
integers, the fields of a record sorted, and the tuples themselves are grouped, after partial aggregation. The members find the first of
their set by a join whose other side is one row for a set, which AQE splits if a set is hot.
"""

from __future__ import annotations

import json
import re
import string
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import cut

#: Distinct canonical values of a lot; a worker that meets more closes the lot and opens the next.
LOT_VALUES = 1 << 18

_FIELD = re.compile(r"\s*([^\W\d_][\w \xa0 \t]{0,39}?)\s*[:=]\s*(?!//|[\"“”„«»「『‘'])(.*?)\s*", re.S)
_SEPARATORS = ("|", ";")


class _Kept(dict):
    """Translation table: white space, punctuation, controls and format characters go; everything else stays."""

    def __missing__(self, cp: int) -> int | None:
        c = chr(cp)
        self[cp] = None if c.isspace() or unicodedata.category(c)[0] in "PZC" or c in string.punctuation else cp
        return self[cp]


_kept = _Kept()


def canonical(text: str) -> str:
    """text without white space, letter case and punctuation."""
    return text.casefold().translate(_kept)


class Lot:
    """Numbers of strings by their canonical form, from 0; canonical values are kept as 128-bit digests."""

    def __init__(self) -> None:
        import xxhash

        self._digest = xxhash.xxh3_128_digest
        self._of_string: dict[str, int] = {}
        self._of_digest: dict[bytes, int] = {}

    def number(self, value: str) -> int:
        i = self._of_string.get(value)
        if i is None:
            i = self._of_digest.setdefault(self._digest(canonical(value)), len(self._of_digest))
            # long strings rarely come twice
            if len(value) <= 64:
                self._of_string[value] = i
        return i

    def __len__(self) -> int:
        return len(self._of_digest)

    def digests(self) -> np.ndarray:
        """Both halves of the digests, in the order of the numbers."""
        return np.frombuffer(b"".join(self._of_digest), "<i8").reshape(-1, 2)


def _pairs(value: object, path: str = "") -> Iterator[tuple[str, str]]:
    """Fields of a JSON value with their paths. Positions in arrays are part of the path, for the order there counts."""
    if isinstance(value, _Object):
        for k, v in value.pairs:
            yield from _pairs(v, f"{path}\x1f{k}" if path else k)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from _pairs(v, f"{path}\x1f{i}")
    else:
        yield path, "" if value is None else value if isinstance(value, str) else json.dumps(value)


class _Object:
    def __init__(self, pairs: list[tuple[str, object]]) -> None:
        self.pairs = pairs


def _as_json(text: str) -> list[tuple[str, str]] | None:
    if not text.lstrip().startswith("{"):
        return None
    try:
        # any white space may stand between the parts, or a raw tab or line break in a string
        value = json.loads(" ".join(text.split()), object_pairs_hook=_Object)
    except (ValueError, RecursionError):
        return None
    return list(_pairs(value)) if isinstance(value, _Object) and value.pairs else None


def _as_row(text: str) -> list[tuple[str, str]] | None:
    for s in _SEPARATORS:
        if s in text:
            found = [_FIELD.fullmatch(p) for p in text.split(s) if p.strip()]
            if len(found) > 1 and all(found):
                return [(m[1], m[2]) for m in found if m]
    return None


def blocks(text: str) -> Iterator[list[tuple[str, str]] | str]:
    """The parts of a text in order: a list of fields for each form or record, a string for each stretch of anything else."""
    fields = _as_json(text) or _as_row(text)
    if fields:
        yield fields
        return
    if ":" not in text and "=" not in text:
        yield text
        return
    run: list[tuple[str, str]] = []
    run_lines: list[str] = []
    prose: list[str] = []
    for line in [*text.splitlines(), None]:
        if line is not None and not line.strip():
            continue
        m = _FIELD.fullmatch(line) if line is not None else None
        if m:
            run.append((m[1], m[2]))
            run_lines.append(line)
            continue
        if len(run) > 1:
            if prose:
                yield "\n".join(prose)
                prose = []
            yield run
        else:
            prose += run_lines
        run, run_lines = [], []
        if line is not None:
            prose.append(line)
    if prose:
        yield "\n".join(prose)


#: Marks in a record's numbers: a stretch of text follows, or so many pairs of name and value.
TEXT, RECORD = -1, -2


def record_numbers(text: str, lot: Lot) -> list[int]:
    """The text in the lot's numbers: TEXT and a number, or RECORD, the number of fields and each field's name and value."""
    out: list[int] = []
    for b in blocks(text):
        if isinstance(b, str):
            out += (TEXT, lot.number(b))
        else:
            out += (RECORD, len(b), *(lot.number(x) for pair in b for x in pair))
    return out


def _translated(numbers: list[int], ids: np.ndarray) -> list[int]:
    """A record in integers that stand for the same values in all lots, the fields of each form sorted."""
    out: list[int] = []
    i = 0
    while i < len(numbers):
        if numbers[i] == TEXT:
            out += (TEXT, int(ids[numbers[i + 1]]))
            i += 2
        else:
            n = numbers[i + 1]
            pairs = ids[numbers[i + 2 : i + 2 + 2 * n]].reshape(-1, 2).tolist()
            out += (RECORD, n, *(x for p in sorted(pairs) for x in p))
            i += 2 + 2 * n
    return out


def record_tuples(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, tuple) of each row with a text that is neither null nor blank."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, lots, lot = TaskContext.get().partitionId(), 0, Lot()
        names = ["lot", "id", "numbers", "high", "low"]
        types = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()))

        def row(ids: list, numbers: list, high: list, low: list) -> pa.RecordBatch:
            n = len(numbers)
            columns = ([(task << 24) + lots] * n, ids, numbers, high, low)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        for b in batches:
            ids, numbers = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                t = t.as_py()
                if t and not t.isspace():
                    ids.append(i)
                    numbers.append(record_numbers(t, lot))
            yield row(ids, numbers, [None] * len(ids), [None] * len(ids))
            if len(lot) >= LOT_VALUES:
                d = lot.digests()
                yield row([None], [None], [d[:, 0]], [d[:, 1]])
                lots, lot = lots + 1, Lot()
        if len(lot):
            d = lot.digests()
            yield row([None], [None], [d[:, 0]], [d[:, 1]])

    rows = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where("text IS NOT NULL")
    coded = cut(rows.mapInArrow(encode, "lot long, id long, numbers array<int>, high array<long>, low array<long>"))
    values = coded.where("high IS NOT NULL").select("lot", F.posexplode(F.arrays_zip("high", "low")).alias("number", "v")).select("lot", "number", "v.high", "v.low")
    # one integer for each distinct value; the cut keeps it, for these integers depend on where a row happens to lie
    table = cut(values.select("high", "low").distinct().withColumn("value_id", F.monotonically_increasing_id()))
    of_lot = values.join(table, ["high", "low"]).groupBy("lot").agg(F.sort_array(F.collect_list(F.struct("number", "value_id"))).alias("v")).select(F.col("lot").alias("of_lot"), F.col("v.value_id").alias("ids"))

    def rewrite(records: pa.Table, ids: pa.Table) -> pa.Table:
        table = ids.column("ids").combine_chunks().values.to_numpy(zero_copy_only=False) if ids.num_rows else np.zeros(0, "int64")
        tuples = [_translated(n, table) for n in records.column("numbers").to_pylist()]
        return pa.table({"id": records.column("id"), "tuple": pa.array(tuples, pa.list_(pa.int64()))})

    return coded.where("numbers IS NOT NULL").select("lot", "id", "numbers").groupBy("lot").cogroup(of_lot.groupBy("of_lot")).applyInArrow(rewrite, "id long, tuple array<long>")


def groups(df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """One row for each set of copies, single records included: tuple, id_first (smallest id), n_copies (rows in the set).

    Null and blank texts belong to no set; texts of punctuation only are equal to each other; rows with a null id count, but are never
    first unless the set has no other; an empty table gives no rows; other columns are ignored.
    """
    return record_tuples(df, key, text).groupBy("tuple").agg(F.min("id").alias("id_first"), F.count(F.lit(1)).alias("n_copies"))


def copies(df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(id_first, id_copy) for each row that is not the first of its set, as groups() defines the sets."""
    tuples = cut(record_tuples(df, key, text))
    sets = tuples.groupBy("tuple").agg(F.min("id").alias("id_first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return tuples.join(sets, "tuple").where("id <> id_first").select("id_first", F.col("id").alias("id_copy"))
