import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kinfold.llm import packing
from tests.llm.conftest import ODD


@pytest.fixture(scope="module")
def exact():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_equal_the_librarys(exact):
    e = packing.encoder()
    rng = random.Random(1)
    pool = [chr(c) for c in (*range(0x250), 0x1680, 0x2003, 0x2028, 0x3000, 0x200B, 0xFEFF, 0x4E2D, 0x660, 0x1F600, 0x300, 0x10FFFF)]
    texts = [t or "" for _, t, *_ in ODD] + ["<|endoftext|> a<|endoftext|>", " " * 5000 + "a", "\n" * 3000]
    for _ in range(1500):
        texts.append("".join(rng.choice(pool) if rng.random() < 0.6 else rng.choice(["  ", "\n", "the", " The", "'s", "'ll", "12", "<|endoftext|>"]) for _ in range(rng.randint(0, 30))))
    for t in texts:
        assert list(e(t)) == exact.encode(t, add_special_tokens=False).ids, t[:50]


def least_cost(places, cost, window):
    n = len(places)
    best = [0.0] + [float("inf")] * (n - 1)
    for j in range(1, n):
        for i in range(j):
            length = places[j] - places[i]
            if length <= window:
                padding = 0 if length & (length - 1) == 0 else window - length
                best[j] = min(best[j], best[i] + padding + cost[j] + packing.PER_SEQUENCE)
    return best


def test_dynamic_program_by_brute_force():
    rng = np.random.default_rng(2)
    for window in (16, 64, 256):
        for _ in range(30):
            gaps = rng.integers(1, window // 2, rng.integers(2, 40))
            places = np.concatenate([[0], np.cumsum(gaps)])
            cost = rng.choice([0.0, 4.0, 24.0], len(places))
            least, back = packing.best_cuts(places, cost, window)
            assert least == pytest.approx(least_cost(places.tolist(), cost.tolist(), window))
            j = len(places) - 1
            while j:
                assert 0 < places[j] - places[back[j]] <= window
                j = back[j]


def check(rows, texts, exact, window=packing.WINDOW):
    """All pieces are the documents' ids, each once; sequences are gapless and within the window."""
    by, seq = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    for key, copies in texts.items():
        for text, n in copies.items():
            ids = np.array([*exact.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
            own = [r for r in by[key] if r.doc_tokens == len(ids)]
            assert sum(r.length for r in own) == n * len(ids)
            for r in own:
                assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    return seq


def test_pack(spark, odd, empty, exact):
    texts = {}
    for i, t, *_ in ODD:
        texts.setdefault(i, {}).setdefault(t, 0)
        texts[i][t] += 1
    got = packing.pack(odd, with_ids=True).collect()
    check(got, texts, exact)
    assert all(len(r.ids) == r.length for r in got)
    assert packing.pack(empty).count() == 0
    check(packing.pack(odd, window=64).collect(), texts, exact, 64)


def test_padding_and_segments():
    ends = packing.encoder().ends
    full_stop = int(np.flatnonzero(ends)[0])
    rng = np.random.default_rng(3)
    packer = packing.Packer(ends, 0, segment=5000)
    rows, docs = [], []
    for k in range(300):
        ids = rng.integers(1, 10, rng.integers(1, 900)).astype(np.uint32)
        ids[rng.random(len(ids)) < 0.05] = full_stop
        docs.append(ids)
        rows += packer.add(k, ids)
    rows += packer.flush(True)
    lengths = {}
    for row, start, length, _, tokens, sequence, _, piece in rows:
        assert (docs[row][start : start + length] == piece).all() and tokens == len(docs[row])
        lengths[sequence] = lengths.get(sequence, 0) + length
    assert [r[0] for r in rows] == sorted(r[0] for r in rows)
    total = sum(lengths.values())
    assert total == sum(map(len, docs))
    padding = sum(1024 - n for n in lengths.values() if n & (n - 1))
    assert padding < 0.02 * total
