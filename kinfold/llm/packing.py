"""Packing tokens into sequences by order-preserving dynamic programming.

The documents of a partition form one stream of tokens that is cut into windows. Cuts lie at ends of documents or
sentences; only where those are far apart may a sentence be cut. The cheapest set of cuts, by padding plus a
penalty for each cut that truncates, comes from one pass: padding is linear in the window's length, so the best
start of a padded window is the head of a monotone queue, and windows whose length is a power of two need none.
"""

from __future__ import annotations

import sys
import types
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from kinfold.llm._text import slices
from kinfold.plans.runtime import table

WINDOW, END = 1024, 0
#: Costs in tokens of padding: of a sequence, of a cut at a sentence's end, and of a cut elsewhere.
PER_SEQUENCE, SENTENCE_CUT, HARD_CUT = 8.0, 4.0, 24.0
#: Gaps between cut places beyond this get further ones at this distance.
GAP = 128
#: Tokens after which the cuts made so far are settled.
SEGMENT = 1 << 18
#: Words or blanks longer than this go to the library that takes n log n time.
LONG_RUN = 2000


def _process_cache() -> dict:
    """A dictionary that lives as long as the Python worker, whatever task runs in it."""
    return vars(sys.modules.setdefault("_kinfold_process_cache", types.ModuleType("_kinfold_process_cache"))).setdefault("held", {})


class Encoder:
    """Ids of a byte-level BPE file of the tokenizers library, as that library gives them without special tokens added.

    Texts go through a faster implementation of the same algorithm, which is given the ranks of that very file;
    texts with very long runs of letters or blanks go through the library itself.
    """

    def __init__(self, path: str, pattern: str) -> None:
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        # The format's alphabet: printable bytes stand for themselves, the others for characters from 256 on.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        letters = {chr(b): b for b in plain}
        letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.vocabulary = {bytes(letters[c] for c in k): v for k, v in model["model"]["vocab"].items() if k not in special}
        self.fast = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=self.vocabulary, special_tokens=special)
        self.special, self.path, self.exact = set(special), path, None
        self.ends = np.zeros(max(self.vocabulary.values(), default=0) + 2 + len(special), bool)
        for k, v in self.vocabulary.items():
            self.ends[v] = k.strip(b" ")[-1:] in (b".", b"!", b"?", b"\n") and len(k.strip(b" ")) > 0

    def __call__(self, text: str) -> np.ndarray:
        words = text.split()
        longest = max(map(len, words), default=0)
        if longest > LONG_RUN or len(text) - sum(map(len, words)) - len(words) > LONG_RUN:
            if self.exact is None:
                from tokenizers import Tokenizer

                self.exact = Tokenizer.from_file(self.path)
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, allowed_special=self.special)


def encoder(path: str | None = None) -> Encoder:
    import public_tokenizers

    path = path or public_tokenizers.path("byte_bpe_50k.json")
    held = _process_cache()
    if path not in held:
        held[path] = Encoder(path, public_tokenizers.PATTERN)
    return held[path]


def cut_places(doc_ends: np.ndarray, sentence_ends: np.ndarray, total: int, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Sorted places (0 and ``total`` among them) and the penalty of a cut at each."""
    soft = np.unique(np.concatenate([[0, total], doc_ends, sentence_ends]))
    gaps = np.diff(soft)
    gap = min(GAP, max(1, window // 4))
    wide = np.flatnonzero(gaps > 2 * gap)
    more = [np.arange(soft[i] + gap, soft[i + 1], gap) for i in wide]
    near_end = total - (1 << np.arange(window.bit_length()))
    places = np.unique(np.concatenate([soft, *more, near_end[near_end > 0]])).astype(np.int64)
    cost = np.full(len(places), HARD_CUT)
    cost[np.searchsorted(places, sentence_ends)] = SENTENCE_CUT
    cost[np.searchsorted(places, np.concatenate([[0, total], doc_ends]))] = 0
    return places, cost


def best_cuts(places: np.ndarray, cost: np.ndarray, window: int = WINDOW) -> tuple[list[float], list[int]]:
    """Least cost up to each place, and the index of the place before it on that way."""
    n = len(places)
    exact: list[list[int]] = [[] for _ in range(n)]
    for k in range(window.bit_length() - 1):
        before = places - (1 << k)
        i = np.minimum(np.searchsorted(places, before), n - 1)
        for j in np.flatnonzero((places[i] == before) & (before >= 0)).tolist():
            exact[j].append(int(i[j]))
    at, extra = places.tolist(), cost.tolist()
    least, back = [0.0] * n, [-1] * n
    queue: deque[tuple[float, int]] = deque([(at[0], 0)])
    for j in range(1, n):
        here = at[j]
        while at[queue[0][1]] < here - window:
            queue.popleft()
        value, i = queue[0]
        value += window - here
        for x in exact[j]:
            if least[x] < value:
                value, i = least[x], x
        value += extra[j] + PER_SEQUENCE
        least[j], back[j] = value, i
        key = value + here
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    return least, back


class Packer:
    """Takes documents in order and gives rows (document, start, length, crc, tokens, sequence, offset, ids)."""

    def __init__(self, ends: np.ndarray, first_sequence: int, window: int = WINDOW, segment: int = SEGMENT) -> None:
        self.ends, self.sequence, self.window, self.segment = ends, first_sequence, window, segment
        self.docs: list[tuple[int, np.ndarray, int, int]] = []  # row, ids still to pack, ids before them, ids of all
        self.held = 0

    def add(self, row: int, ids: np.ndarray) -> Iterator[tuple]:
        self.docs.append((row, ids, 0, len(ids)))
        self.held += len(ids)
        if self.held >= self.segment:
            yield from self.flush(False)

    def flush(self, last: bool) -> Iterator[tuple]:
        if not self.docs:
            return
        ids = np.concatenate([d[1] for d in self.docs])
        ends = np.cumsum([len(d[1]) for d in self.docs])
        total = int(ends[-1])
        sentences = np.flatnonzero(self.ends[np.minimum(ids, len(self.ends) - 1)]) + 1
        places, cost = cut_places(ends, sentences, total, self.window)
        least, back = best_cuts(places, cost, self.window)
        stop = len(places) - 1
        if not last:  # settle up to the cheapest cut of the last window; what follows waits for more documents
            from_ = int(np.searchsorted(places, total - self.window))
            stop = min(range(max(1, from_), len(places)), key=lambda j: least[j] / places[j])
        cuts = []
        j = stop
        while j > 0:
            cuts.append(int(places[j]))
            j = back[j]
        cuts.reverse()
        d, begin, start = 0, 0, 0
        for cut in cuts:
            offset = 0
            while start < cut:
                row, own, before, tokens = self.docs[d]
                end = min(cut, begin + len(own))
                piece = own[start - begin : end - begin]
                yield row, before + start - begin, len(piece), zlib.crc32(piece.astype("<u4").tobytes()), tokens, self.sequence, offset, piece
                offset += len(piece)
                start = end
                if end == begin + len(own):
                    begin, d = end, d + 1
            self.sequence += 1
        rest = self.docs[d:]
        if rest and start > begin:
            row, own, before, tokens = rest[0]
            rest[0] = (row, own[start - begin :], before + start - begin, tokens)
        self.docs, self.held = rest, total - start


_ROW = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, with_ids: bool = False, window: int = WINDOW) -> DataFrame:
    """One row per piece: (key, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]).

    Each partition packs its own rows in their order, so texts are not shuffled; the high bits of ``sequence_id`` are
    the partition. A null text counts as empty and is its closing id alone; repeated and null keys are documents of
    their own; an empty table gives no rows; other columns take no part.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        encode = encoder(path)
        packer = Packer(encode.ends, TaskContext.get().partitionId() << 36, window)
        seen: dict[int, object] = {}  # keys of the rows that are not packed yet
        rows: list[tuple] = []
        n = 0

        def out() -> pa.RecordBatch:
            cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(1, 7)]
            names = [key, *(x.split()[0] for x in _ROW.split(", "))]
            if with_ids:
                cols.append(pa.array([r[7].astype(np.int32) for r in rows], pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays([pa.array([seen[r[0]] for r in rows], arrow), *cols], names=names)

        for batch in slices(batches):
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[n] = k
                rows += packer.add(n, np.append(encode(x or "").astype(np.uint32), np.uint32(END)))
                n += 1
                if len(rows) >= 10_000:
                    yield out()
                    rows.clear()
                    seen = {d[0]: seen[d[0]] for d in packer.docs}
        rows += packer.flush(True)
        yield out()

    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(df.schema[key].dataType)
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, {_ROW}" + ", ids array<int>" * with_ids)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
