"""Vectorised word handling over UTF-8 bytes, shared by the text operators.

A word is a run of digits, letters a-z and characters above U+007F after lower-casing A-Z; this is the
pattern ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. Nothing is cut: documents of any length are handled whole.
"""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes of text that are handled at once, and rows of a batch: each worker holds some forty bytes for each byte, and copies of the rows.
_CHUNK, ROWS = 1 << 18, 1024


def word_table() -> np.ndarray:
    """Byte to lower-cased byte of a word, or 0 between words."""
    t = np.zeros(256, np.uint8)
    for a, b in ((0x30, 0x3A), (0x61, 0x7B), (0x80, 0x100)):
        t[a:b] = np.arange(a, b)
    t[0x41:0x5B] = np.arange(0x61, 0x7B)
    return t


_WORD = word_table()


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all 64 bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        m = max(n, _CHUNK * 2)
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(m, base, np.uint64)
            x[0] = 1
            _powers[key] = np.cumprod(x, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def give_back() -> None:
    """Freed memory goes back to the system, which else a worker keeps while other stages run."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows in order, in batches of at most ``ROWS``."""
    give_back()
    for batch in batches:
        for s in range(0, batch.num_rows, ROWS):
            yield batch.slice(s, ROWS)
    give_back()


def texts_as_bytes(column: pa.Array) -> list[bytes]:
    """Nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def chunks(texts: list[bytes], limit: int = _CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one text."""
    start = size = 0
    for i, x in enumerate(texts):
        if i > start and size + len(x) > limit:
            yield start, i
            start, size = i, 0
        size += len(x) + 1
    if start < len(texts):
        yield start, len(texts)


_BETWEEN = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def _pieces(raw: bytes, limit: int) -> Iterator[bytes]:
    """The text in pieces of about ``limit`` bytes that end between words."""
    at = 0
    while at < len(raw):
        gap = _BETWEEN.search(raw, at + limit)
        end = gap.start() if gap else len(raw)
        yield raw[at:end]
        at = end


def word_hashes(texts: list[bytes], limit: int = _CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and where each text's words begin (one more entry than texts).

    A text of over ``limit`` bytes goes piece by piece, so that memory is that of its hashes and of one piece.
    """
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    if len(texts) == 1 and len(texts[0]) > limit:
        h = np.concatenate([_hashes([x])[0] for x in _pieces(texts[0], limit)])
        return h, np.array([0, len(h)], np.int64)
    return _hashes(texts)


def _hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    joined = b"\0".join(texts) + b"\0"
    c = _WORD[np.frombuffer(joined, np.uint8)]
    up, down = _power_tables(len(c))
    inside = (c != 0).view(np.int8)
    edge = np.diff(inside, prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.cumsum(c.astype(np.uint64) * up[: len(c)], dtype=np.uint64)
    before = np.where(starts > 0, total[starts - 1], np.uint64(0))
    h = mix((total[ends - 1] - before) * down[starts])
    firsts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in texts], out=firsts[1:])
    return h, np.searchsorted(starts, firsts)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Order-sensitive hashes of all runs of ``k`` entries of one text."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = (out ^ h[j : j + n]) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(j)
        out ^= out >> np.uint64(32)
    return mix(out)


def shingle_set(h: np.ndarray, raw: bytes, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word k-grams. Fewer than k words: one of all words; no word: one of the raw text."""
    if len(h) >= k:
        return np.unique(grams(h, k))
    if len(h):
        return grams(h, len(h))
    x = np.frombuffer(raw, np.uint8).astype(np.uint64)
    return mix(np.array([(x * _power_tables(len(x) + 1)[0][1 : len(x) + 1]).sum(dtype=np.uint64) + np.uint64(len(x) + 7)], np.uint64))
