import random
import re

import numpy as np
import pytest

from kinfold.llm import jaccard as j
from tests.llm.conftest import ODD


def shingles(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else {("raw", text)}


def brute(rows):
    """(class, copy, links) of each id, ids distinct."""
    sets = {i: shingles(t) for i, t in rows if t is not None}
    links = {i: set() for i, _ in rows}
    ids = list(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if 9 * both >= 4 * (len(sets[a]) + len(sets[b])):
                links[a].add(b)
                links[b].add(a)
    label = {}
    for i in sorted(links):
        if i not in label:
            stack = [i]
            while stack:
                x = stack.pop()
                if x not in label:
                    label[x] = i
                    stack += links[x]
    copy = {i: min(k for k in sets if sets[k] == sets[i]) if i in sets else i for i in links}
    return {i: (label[i], copy[i], len(links[i])) for i in links}


def documents(seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for k in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(3, 120))]
        if k % 4 == 0:
            words += passage
        copies = 40 if k == 7 else rng.choice([1, 1, 1, 2, 4])
        for c in range(copies):
            w = list(words)
            for _ in range(rng.randint(0, 3) if c else 0):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, ""), (len(rows) + 3, "!!"), (len(rows) + 4, "a B"), (len(rows) + 5, "A b")]
    return rows


@pytest.mark.parametrize("bucket,whole,deepest", [(j.BUCKET, j.WHOLE, j.DEEPEST), (8, 4, 3)])
def test_against_brute_force(spark, bucket, whole, deepest):
    rows = documents()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.class_id, r.copy_of, r.n_links) for r in j.jaccard_join(df, bucket=bucket, whole=whole, deepest=deepest).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("k", [3, 6, 7, 8, 11, 100, 1999])
def test_similarity_of_exactly_the_threshold(k):
    a = np.arange(5 * k, dtype=np.uint64)
    sets = [a, a[: 4 * k], a[: 4 * k - 1]]
    links, label = j.exact_links(np.arange(3), np.ones(3), sets, np.array([2, 2, 2]), 0.8)
    assert links.tolist() == [1, 2, 1] and label.tolist() == [0, 0, 0]
    links, label = j.exact_links(np.arange(2), np.ones(2), [sets[0], sets[2]], np.array([2, 2]), 0.8)
    assert links.tolist() == [0, 0] and label.tolist() == [0, 1]


def test_exact_ties_against_brute_force(spark):
    rows = []
    for k in (3, 6, 7, 8, 10, 11, 25):
        words = [f"w{k}x{i}" for i in range(5 * k + 4)]
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(words[: 4 * k + 4]))]
    want = brute(rows)
    assert all(n == 1 for _, _, n in want.values())
    assert {r.doc_id: (r.class_id, r.copy_of, r.n_links) for r in j.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_odd_rows(spark, odd, empty):
    got = j.jaccard_join(odd).collect()
    assert len(got) == len(ODD)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.class_id, r.copy_of, r.n_links))
    assert by[None] == [(None, None, 0)] and by[1] == [(1, 1, 2)] and by[6] == [(1, 1, 2)] * 2 and by[2] == [(2, 2, 0)]
    assert j.jaccard_join(empty).count() == 0
    kept = j.keep_one(odd)
    assert kept.columns == odd.columns and sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, [1, 2, 3, 4, 5, 7, 8, 9, None]))
    assert j.keep_one(empty).count() == 0
    with pytest.raises(TypeError):
        j.jaccard_join(odd, key="key")


def test_parts():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40))).astype(np.uint64) for _ in range(50)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert j.intersections(sets).tolist() == want
    assert 0.9 < j.shared(0.95, 2) < 1 and j.expected_recall(0.8, j.DEEPEST, j.runs_needed()) >= j.RECALL > j.expected_recall(0.8, j.DEEPEST, j.runs_needed() - 1)
    assert j.runs_needed(depth=6) > j.runs_needed() > j.runs_needed(depth=2)
    a = np.unique(rng.integers(0, 1 << 62, 500, dtype=np.uint64))
    b = np.concatenate([a[:450], np.unique(rng.integers(0, 1 << 62, 50, dtype=np.uint64))])
    assert abs((j.embed(a) == j.embed(b)).mean() - 450 / 550) < 0.2
    tokens = np.stack([j.embed(a), j.embed(a), j.embed(b)])
    who, key = j.paths(tokens, 4)
    assert sorted(key[who == 0].tolist()) == sorted(key[who == 1].tolist())


def test_recall_by_simulation():
    """Pairs whose tokens agree with the threshold's probability meet as often as they should in the runs that are made; the runs' roots are the same for all pairs."""
    rng = np.random.default_rng(4)
    n, runs = 2000, j.runs_needed()
    a = rng.integers(0, 1 << 16, (n, j.TOKENS)).astype(np.uint16)
    b = np.where(rng.random(a.shape) < 0.8, a, rng.integers(0, 1 << 16, a.shape).astype(np.uint16))
    met = np.zeros(n, bool)
    for s in range(0, n, 500):
        sides = []
        for x in (a, b):
            who, key = j.paths(x[s : s + 500], runs, 4)
            sides.append({(int(w), int(k)) for w, k in zip(who, key, strict=True)})
        for w, _ in sides[0] & sides[1]:
            met[s + w] = True
    met &= (a == b).sum(1) >= j.tokens_needed()
    assert met.mean() > 0.998


def test_keep_one_moves_no_row_that_stays(spark):
    rows = documents(2)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows] + [(0, "quite another text of the first key", "y"), (0, rows[0][1], "z")], "doc_id long, text string, row string")
    heads = {i for i, (c, _, _) in brute(rows).items() if c == i}
    got = j.keep_one(df).collect()
    assert {r.doc_id for r in got} == heads and sorted(r.text for r in got if r.doc_id == 0) == sorted([rows[0][1], "quite another text of the first key"])
    assert len(got) == len(heads) + 1
