import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.llm import knn


def brute(rows, is_query, k=10):
    good = {(i, tuple(math.floor(1024 * float(x)) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q, v in good:
        if is_query(q):
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), c) for c, w in good if (c, w) != (q, v) and len(w) == len(v))[:k]
            out += [(q, n, c, -s) for n, (s, c) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("n,dim,shard", [(150, 4, 4), (400, 3, 20), (60, 16, 1000), (7, 3, 3)])
def test_against_brute_force(spark, n, dim, shard):
    rng = random.Random(n)
    rows = [(i, [float(np.float32(rng.gauss(0, 1))) for _ in range(dim)]) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(30)] if n > 50 else []
    rows += [(900, None), (901, [1.0] * (dim - 1) + [None]), (902, [float("nan")] * dim), (903, [float("inf")] * dim), (904, [1.0] * (dim + 1)), (906, [2.0] * (dim + 1)), (905, []), (None, [1.0] * dim)]
    rows += [rows[1], rows[1], (3, rows[4][1])]  # repeated rows, and a key with two vectors
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, v int, shard int").repartition(3)
    got = knn.top_k(df, F.col("vec_id") % 3 == 0, shard_rows=shard)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda q: q % 3 == 0)


def test_sql_agrees_on_repeated_and_null_rows(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i * 50, [float(np.float32(rng.gauss(0, 1))) for _ in range(6)]) for i in range(30)]
    rows += [rows[2], (100, rows[7][1]), (None, rows[3][1]), (150, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df.write.parquet(str(tmp_path / "e"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/e/*.parquet'")
    want = sorted((r[0], r[1], r[2], r[3]) for r in con.sql(knn.OP8_SQL).fetchall())
    assert sorted(map(tuple, knn.top_k(df, F.col("vec_id") % 100 == 0).collect())) == want == brute(rows, lambda q: q % 100 == 0)


def test_empty_and_large_numbers(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert knn.top_k(df, F.col("vec_id") % 3 == 0).count() == 0
    big = spark.createDataFrame([(0, [1e12, 1.0]), (1, [1e12, 3.0]), (2, [-1e30, 0.0])], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.score for r in knn.top_k(big, F.col("vec_id") == 0).collect()}
    assert got[1] == (1 << 63) - 1 and got[2] == -(1 << 63)


@pytest.mark.parametrize("large", [1, 1 << 40])
def test_tree(large):
    rng = np.random.default_rng(0)
    rows = np.floor(rng.normal(0, 100, (500, 5))) * large
    tree = knn.KDTree(rows, 8)
    q = rng.normal(0, 50, 5).round() * large
    assert sorted(tree.order.tolist()) == list(range(500))
    s = [sum(int(a) * int(b) for a, b in zip(r, q, strict=True)) for r in rows]
    assert all(tree.bounds(q)[n] >= max(s[i] for i in tree.order[a:b]) for n, (a, b) in enumerate(zip(tree.start, tree.end, strict=True)))
    want = sorted(((v, i, i) for i, v in enumerate(s)), key=lambda x: (-x[0], x[1]))[:7]
    assert tree.search(q, np.arange(500), 7) == want
    floor = want[3][0]
    assert tree.search(q, np.arange(500), 7, floor) == want[: sum(x[0] >= floor for x in want)]


def test_boxes_spare_leaves_where_vectors_have_structure():
    """Vectors near a turned plane: boxes along the principal axes leave most leaves out."""
    rng = np.random.default_rng(1)
    basis = np.linalg.qr(rng.normal(0, 1, (32, 32)))[0][:2]
    rows = np.floor(1024 * (rng.normal(0, 1, (8000, 2)) @ basis))
    tree = knn.KDTree(rows, 64)
    seen = []
    for i in range(0, 8000, 400):
        tree.search(rows[i], np.arange(8000), 10)
        seen.append(tree.visited)
    assert np.mean(seen) < 0.2 * sum(x < 0 for x in tree.left)


def test_shards_below_the_floor_are_not_asked(spark):
    low, high = np.array([0.0, 0.0]), np.array([10.0, 10.0])
    boxes = {1: (low, high), 2: (low + 100, high + 100), 3: (low + 50, high + 50)}
    q = spark.createDataFrame([(7, knn.pack(np.array([1.0, 1.0])), None), (8, knn.pack(np.array([1.0, 1.0])), 150)], "q long, v binary, floor long")
    got = sorted((r.q, r.shard) for r in knn._asked(q, boxes, 0, None).collect())
    assert got == [(7, 1), (7, 2), (7, 3), (8, 2)]
    assert [(r.q, r.shard) for r in knn._asked(q, boxes, 1, 2).collect()] == [(7, 3)]
