"""Splitting texts above a limit into overlapping pieces, cut at natural boundaries.

Whether a place is a boundary depends on CONTEXT characters before it and one behind it, so workers find the boundaries of ranges of a
text, each with a halo of that size, and the table of all ranges is the same however the text is cut into ranges. One walk over that table
in order, which never sees the text, sets the pieces; it holds no more of the table than one piece needs. Files are read as byte ranges:
each range gives its number of code points and its boundaries, running sums of the numbers turn them into offsets, and pieces come out by
offset.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.sentences import NEVER_LAST
from lectern.session import lanes

#: Characters of a range; it only decides how work is shared out, never where pieces are cut.
RANGE_CHARS = 1 << 20
#: Characters before a place that decide whether it is a boundary.
CONTEXT = 128
#: Models with a limit, above which the list is not sent to the workers but an error raised.
MAX_MODELS = 10_000

_CLOSERS = r"[\p{Pe}\p{Pf}\"'»]{0,8}"
_PARAGRAPH = regex.compile(r"(?:\n| )[^\S\n ]{0,30}(?:\n| )\s{0,30}(?=\S)| \s{0,30}(?=\S)", regex.V1)
_LINE = regex.compile(r"[\n\r\u0085 ]\s{0,60}(?=\S)", regex.V1)
_SENTENCE = regex.compile(rf"[\p{{STerm}}.…]{_CLOSERS}\s{{1,40}}(?=\S)", regex.V1)
_UNSPACED = regex.compile(rf"[。！？｡]{_CLOSERS}(?=[^\s\p{{Pe}}\p{{Pf}}。！？｡])", regex.V1)
_WORD = regex.compile(r"(?<=\s)(?=\S)")
_WORD_BEFORE = regex.compile(r"[\p{L}\p{M}\p{N}.]{1,24}$", regex.V1)
_MARK = regex.compile(r"[\p{M}‍️]", regex.V1)

#: Boundaries in order of preference, then the places before which nothing may be cut.
KINDS = ("paragraphs", "sentences", "words", "marks")
Table = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _abbreviated(text: str, at: int) -> bool:
    """Whether the period at this place ends a single letter or an abbreviation after which sentences go on."""
    word = _WORD_BEFORE.search(text, max(0, at - 24), at)
    if text[at] != "." or not word:
        return False
    last = word[0].rsplit(".", 1)[-1]
    return len(last) == 1 and last.isalpha() or word[0].lower() in NEVER_LAST


def boundaries(text: str, start: int = 0, end: int | None = None) -> Table:
    """Where a new piece may begin in text[start:end], by kind, with the places of combining marks; what lies before start is context."""
    end = len(text) if end is None else end
    low = max(0, start - CONTEXT)
    sentences = {m.end() for m in _LINE.finditer(text, low)}
    sentences |= {m.end() for m in _UNSPACED.finditer(text, low)}
    sentences |= {m.end() for m in _SENTENCE.finditer(text, low) if not text[m.end()].islower() and not _abbreviated(text, m.start())}
    found = ({m.end() for m in _PARAGRAPH.finditer(text, low)}, sentences, {m.start() for m in _WORD.finditer(text, low)}, {m.start() for m in _MARK.finditer(text, start)})
    tables = [np.array(sorted(f), "int64") for f in found]
    return tuple(t[(t >= max(start, 1)) & (t < end)] for t in tables)


class Walk:
    """Pieces of at most limit characters, each sharing overlap with the one before, from the boundary tables of ranges in order.

    A piece ends at the last paragraph break of its second half, else the last sentence end there, else the last word end, else at the
    limit (not before a combining mark). overlap counts for less than limit.
    """

    def __init__(self, limit: int, overlap: int) -> None:
        self.limit, self.overlap, self.start = limit, max(0, min(overlap, limit - 1)), 0
        self.known: list[np.ndarray] = [np.zeros(0, "int64")] * len(KINDS)

    def feed(self, table: Table, upto: int, last: bool) -> list[tuple[int, int]]:
        """The pieces that are certain once the boundaries before upto are known; upto is the length of the text when it is the last range."""
        self.known = [np.concatenate([k[k > self.start], t]) for k, t in zip(self.known, table)]
        out = []
        while upto - self.start > self.limit:
            end = self._end()
            out.append((self.start, end))
            self.start = end - self.overlap
        if last and (upto > self.start or not out):
            out.append((self.start, upto))
        return out

    def _end(self) -> int:
        high = self.start + self.limit
        low = self.start + max(self.overlap, self.limit // 2)
        for kind in self.known[:3]:
            i = int(np.searchsorted(kind, high, side="right")) - 1
            if i >= 0 and kind[i] > low:
                return int(kind[i])
        marks, end, least = self.known[3], high, self.start + self.overlap + 1
        i = int(np.searchsorted(marks, end, side="right")) - 1
        while end > least and i >= 0 and marks[i] == end:
            end, i = end - 1, i - 1
        return end if end > least else high


def pieces(text: str, limit: int, overlap: int, table: Table | None = None) -> list[tuple[int, int]]:
    """The pieces of a whole text; one that keeps within the limit is one piece."""
    return Walk(limit, overlap).feed(table or boundaries(text), len(text), True)


# --- tables -------------------------------------------------------------------------------------------------------------------------

_OUT = "id long, model_id string, piece_no int, start_char long, end_char long"
_TYPES = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64())
_TABLE = ", ".join(f"{k} array<long>" for k in KINDS)


def _batch(rows: list[tuple], types: tuple, names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def split_texts(df: DataFrame, models: DataFrame, key: str = "id", text: str = "text", domain: str = "domain", range_chars: int = RANGE_CHARS) -> DataFrame:
    """(id, model_id, piece_no, start_char, end_char): the pieces of each text for each model of its domain whose limit it exceeds.

    Texts of one range are cut where they are read. Of longer ones the ranges find their boundaries apart, and one task for each text walks
    over their tables in order. Defined cases: null texts and domains have no pieces; a model with a null or non-positive limit has none; a
    null overlap is 0; a repeated model counts once, with its smallest limit and overlap; rows that share an id are texts of their own only
    while each is one range; other columns are ignored. models is the catalog: at most MAX_MODELS rows, checked, and sent to all workers.
    """
    spark = df.sparkSession
    m = models.where("max_sequence_length > 0 AND domain IS NOT NULL AND model_id IS NOT NULL").select("domain", "model_id", F.col("max_sequence_length").cast("int").alias("most"), F.coalesce(F.col("chunk_overlap").cast("int"), F.lit(0)).alias("share"))
    rows = m.groupBy("domain", "model_id").agg(F.min(F.struct("most", "share")).alias("m")).select("domain", "model_id", "m.*").limit(MAX_MODELS + 1).collect()
    if len(rows) > MAX_MODELS:
        raise ValueError(f"more than {MAX_MODELS} models")
    if not rows:
        return spark.createDataFrame([], _OUT)
    catalog: dict[str, list[tuple[str, int, int]]] = {}
    for r in sorted(rows, key=lambda r: (r["domain"], r["model_id"])):
        catalog.setdefault(r["domain"], []).append((r["model_id"], r["most"], r["share"]))
    names = [c.split()[0] for c in _OUT.split(", ")]

    limit = F.coalesce(*(F.when(F.col("domain") == d, F.lit(min(x[1] for x in v))) for d, v in catalog.items()))
    t = df.select(F.col(key).cast("long").alias("id"), F.col(domain).alias("domain"), F.col(text).alias("text")).withColumn("n", F.char_length("text")).where(F.col("n") > limit)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for i, d, body in zip(b.column("id").to_pylist(), b.column("domain").to_pylist(), b.column("text")):
                body = body.as_py()
                table = boundaries(body)
                for model, most, share in catalog[d]:
                    if len(body) > most:
                        out += [(i, model, k, x, y) for k, (x, y) in enumerate(pieces(body, most, share, table))]
            yield _batch(out, _TYPES, names)

    short = t.where(F.col("n") <= range_chars).select("id", "domain", "text").mapInArrow(whole, _OUT)

    first = F.greatest(F.lit(0), F.col("range_no") * range_chars - CONTEXT)
    r = t.where(F.col("n") > range_chars).withColumn("range_no", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / range_chars).cast("int"))))
    r = r.select("id", "domain", "n", "range_no", first.alias("at"), F.substring(F.col("text"), first + 1, F.lit(range_chars + CONTEXT + 1)).alias("body"))

    def table_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in b.to_pylist():
                at, k, n = row["at"], row["range_no"], row["n"]
                lo, hi = k * range_chars, min((k + 1) * range_chars, n)
                out.append((row["id"], row["domain"], n, k, *(x + at for x in boundaries(row["body"], lo - at, hi - at))))
            yield _batch(out, (pa.int64(), pa.string(), pa.int32(), pa.int32(), *[pa.list_(pa.int64())] * len(KINDS)), ["id", "domain", "n", "range_no", *KINDS])

    tables = r.mapInArrow(table_of, "id long, domain string, n int, range_no int, " + _TABLE)
    tables = tables.repartition(lanes(spark), "id").sortWithinPartitions("id", "range_no")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, walks, counts = None, {}, {}
        for b in batches:
            for j in range(b.num_rows):
                row = b.slice(j, 1)
                i, d, n, k = (row.column(c)[0].as_py() for c in ("id", "domain", "n", "range_no"))
                if i != now:
                    now, walks = i, {model: Walk(most, share) for model, most, share in catalog[d] if n > most}
                    counts = dict.fromkeys(walks, 0)
                table = tuple(row.column(c)[0].values.to_numpy(zero_copy_only=False) for c in KINDS)
                upto = min((k + 1) * range_chars, n)
                out = []
                for model, w in walks.items():
                    for x, y in w.feed(table, upto, upto == n):
                        out.append((i, model, counts[model], x, y))
                        counts[model] += 1
                yield _batch(out, _TYPES, names)

    return short.unionByName(tables.mapInArrow(walk, _OUT))


def numbered(split: DataFrame) -> DataFrame:
    """The pieces with their numbers, which the walk has given already."""
    return split.select("id", "model_id", "piece_no", "start_char", "end_char")


# --- files --------------------------------------------------------------------------------------------------------------------------


def split_files(spark: SparkSession, paths: list[str], limit: int, overlap: int = 0, range_bytes: int = 8 << 20) -> DataFrame:
    """(path, piece_no, start_char, end_char) of the pieces of UTF-8 files (files, folders or patterns) on storage that all workers share.

    No worker reads more than a byte range and its halos, and each byte is read once. Every range gives its number of code points and its
    boundaries; one walk over the ranges' tables in order sums the numbers and emits the pieces by offset. Bytes that are no UTF-8 count as
    replacement characters. An empty file has no pieces.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", F.col("length").alias("bytes")).where("bytes > 0")
    ranges = files.withColumn("range_no", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("bytes") - 1) / range_bytes))))
    # a range is much work and a row of a few bytes
    ranges = ranges.repartition(lanes(spark), "path", "range_no")
    halo = 4 * CONTEXT

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                start, end = r["range_no"] * range_bytes, min((r["range_no"] + 1) * range_bytes, r["bytes"])
                low = max(0, start - halo)
                data = _read(r["path"], low, min(end + 8, r["bytes"]))
                lo, hi = _aligned(data, start - low), _aligned(data, end - low)
                before = data[_aligned(data, 0) if low else 0 : lo].decode("utf-8", "replace")[-CONTEXT:]
                own = data[lo:hi].decode("utf-8", "replace")
                after = data[hi : hi + 4].decode("utf-8", "replace")[:1]
                table = boundaries(before + own + after, len(before), len(before) + len(own))
                out.append((r["path"], r["range_no"], end == r["bytes"], len(own), *(t - len(before) for t in table)))
            yield _batch(out, (pa.string(), pa.int64(), pa.bool_(), pa.int64(), *[pa.list_(pa.int64())] * len(KINDS)), ["path", "range_no", "last", "chars", *KINDS])

    tables = ranges.mapInArrow(scan, "path string, range_no long, last boolean, chars long, " + _TABLE)
    tables = tables.repartition(lanes(spark), "path").sortWithinPartitions("path", "range_no")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, w, base, n = None, Walk(limit, overlap), 0, 0
        for b in batches:
            for j in range(b.num_rows):
                row = b.slice(j, 1)
                path, last, chars = (row.column(c)[0].as_py() for c in ("path", "last", "chars"))
                if path != now:
                    now, w, base, n = path, Walk(limit, overlap), 0, 0
                table = tuple(row.column(c)[0].values.to_numpy(zero_copy_only=False) + base for c in KINDS)
                base += chars
                found = w.feed(table, base, last)
                yield _batch([(path, n + i, x, y) for i, (x, y) in enumerate(found)], (pa.string(), pa.int32(), pa.int64(), pa.int64()), ["path", "piece_no", "start_char", "end_char"])
                n += len(found)

    return tables.mapInArrow(walk, "path string, piece_no int, start_char long, end_char long")


def _read(path: str, start: int, end: int) -> bytes:
    """Bytes of a file on any storage that the workers can reach."""
    from pyarrow import fs

    storage, name = fs.FileSystem.from_uri(path)
    with storage.open_input_file(name) as f:
        f.seek(start)
        return f.read(end - start)


def _aligned(data: bytes, at: int) -> int:
    """The first place at or behind at where a code point begins; three bytes on at most, for no code point is longer."""
    end = min(at + 3, len(data))
    while at < end and data[at] & 0xC0 == 0x80:
        at += 1
    return at
