"""Encoding of texts with a public tokenizer, as a monoid over text spans.

A long text is halved until the pieces are small; the halves are encoded on their own and joined by re-encoding a window around the seam.
A place where white space (space, tab, line break) follows a character that is no white space is a token boundary in whatever text it
stands: no pre-token of a byte-level BPE pattern goes on over white space after something else. Tokens before the last such place left of
the seam and after the first one right of it therefore stay as they are; only what lies between is encoded again. The window grows until
both places are found, at most to the whole of both halves. Lists of ids concatenate, so decoding concatenates up the same tree.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

DEFAULT_VOCABULARY = "byte_bpe_50k.tiktoken"
#: Characters up to which a text is encoded in one go.
LEAF_CHARS = 1 << 15
_WINDOW = 64
_SPACE = " \n\t\r"


class Encoder:
    """Encodes with a rank file of byte-level BPE. Special tokens' strings are ordinary text; empty and null texts have no ids."""

    def __init__(self, path: str, pattern: str, leaf_chars: int = LEAF_CHARS) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._encoding = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._leaf: Callable[[str], list[int]] = self._encoding._core_bpe.encode_ordinary
        self._width = np.zeros(max(ranks.values()) + 1, "int64")
        for token, rank in ranks.items():
            self._width[rank] = len(token)
        self.leaf_chars = leaf_chars

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if len(text) <= self.leaf_chars:
            return self._leaf(text)
        return self._tree(text, 0, len(text))

    def decode(self, ids: list[int]) -> str:
        return self._encoding.decode(ids)

    def _tree(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= self.leaf_chars:
            return self._leaf(text[lo:hi])
        mid = (lo + hi) // 2
        return self._join(text, lo, mid, hi, self._tree(text, lo, mid), self._tree(text, mid, hi))

    def _join(self, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        p, q = _boundary_before(text, lo, mid), _boundary_after(text, mid, hi)
        drop_left = self._tokens(left[::-1], len(text[p:mid].encode()))
        drop_right = self._tokens(right, len(text[mid:q].encode()))
        return left[: len(left) - drop_left] + self._leaf(text[p:q]) + right[drop_right:]

    def _tokens(self, ids: list[int], n_bytes: int) -> int:
        """How many of the first ids make up n_bytes; a seam is a token boundary, so the sum is exact."""
        if not n_bytes:
            return 0
        take, step = 0, 256
        total = 0
        while total < n_bytes:
            widths = np.cumsum(self._width[ids[take : take + step]]) + total
            k = int(np.searchsorted(widths, n_bytes))
            if k < len(widths):
                if widths[k] != n_bytes:
                    raise AssertionError("a seam lies within a token")
                return take + k + 1
            take, total, step = take + len(widths), int(widths[-1]), step * 2
        return take


def _boundary_before(text: str, lo: int, mid: int) -> int:
    """The last place in (lo, mid) where white space follows something else; lo if there is none."""
    start, width = mid, _WINDOW
    while start > lo:
        start = max(lo, mid - width)
        for p in range(mid - 1, max(start, lo + 1) - 1, -1):
            if text[p] in _SPACE and not text[p - 1].isspace():
                return p
        width *= 2
    return lo


def _boundary_after(text: str, mid: int, hi: int) -> int:
    """The first place in (mid, hi) where white space follows something else; hi if there is none."""
    for q in range(mid + 1, hi):
        if text[q] in _SPACE and not text[q - 1].isspace():
            return q
    return hi


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> tuple[str, str]:
    """Path of an installed public vocabulary file, and the pre-token pattern that goes with it."""
    import public_tokenizers

    return str(public_tokenizers.path(name)), public_tokenizers.PATTERN


_encoders: dict[tuple[str, str, int], Encoder] = {}


def encoder(path: str, pattern: str, leaf_chars: int = LEAF_CHARS) -> Encoder:
    """One encoder for each Python worker."""
    key = (path, pattern, leaf_chars)
    if key not in _encoders:
        _encoders[key] = Encoder(path, pattern, leaf_chars)
    return _encoders[key]


def encode_column(df: DataFrame, key: str, text: str, path: str | None = None, pattern: str | None = None, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """(key, ids: array<int>) of each row, ids of null and empty texts being the empty list. Whole texts, no shuffle; other columns are left out."""
    if path is None or pattern is None:
        path, pattern = vocabulary_path()
    key_type = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern, leaf_chars)
        for b in batches:
            if not b.num_rows:
                continue
            for part in _by_chars(b):
                rows = [np.array(e.encode(t), "int32") for t in part.column(1).to_pylist()]
                offsets = np.zeros(len(rows) + 1, "int32")
                np.cumsum([len(r) for r in rows], out=offsets[1:])
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[key, "ids"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {key_type}, ids array<int>")


def count_column(df: DataFrame, key: str, text: str, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(key, n_tokens: int) of each row; 0 for null and empty texts."""
    if path is None or pattern is None:
        path, pattern = vocabulary_path()
    key_type = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for b in batches:
            if b.num_rows:
                n = [len(e.encode(t.as_py())) for t in b.column(1)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32())], names=[key, "n_tokens"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {key_type}, n_tokens int")


def _by_chars(b: pa.RecordBatch, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about so many bytes of text each, to bound what a worker holds."""
    start, size = 0, 0
    lengths = pc.binary_length(b.column(1)).fill_null(0).to_pylist()
    for i, n in enumerate(lengths):
        size += n
        if size >= limit:
            yield b.slice(start, i + 1 - start)
            start, size = i + 1, 0
    if start < b.num_rows:
        yield b.slice(start)
