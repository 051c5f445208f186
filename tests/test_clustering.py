import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.operators import clustering as k
from kinfold.operators import components
from kinfold.operators.classify import result
from kinfold.operators.components import connected_components
from kinfold.plans.runtime import cut_lineage


def naive_components(edges):
    label = {x: x for e in edges for x in e}
    while True:
        done = True
        for a, b in edges:
            low = min(label[a], label[b])
            done &= label[a] == label[b]
            label[a] = label[b] = low
        if done:
            return label


@pytest.mark.parametrize("n,m", [(50, 30), (60, 120), (40, 39), (5, 0)])
def test_components(spark, n, m):
    rng = random.Random(n + m)
    edges = [(i, i + 1) for i in range(39)] if m == 39 else [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    df = spark.createDataFrame([*edges, (None, 1), (3, 3)], "src long, dst long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    want = naive_components([e for e in edges if e[0] != e[1]])
    assert got == want


def test_components_of_few_edges_leave_few_files(spark, tmp_path):
    """Each file of a lineage cut is a process of the executor's on a local file system; only the edge table has one a shuffle partition."""
    sc, named = spark.sparkContext, spark.conf.get("spark.sql.shuffle.partitions")
    before = sc.getCheckpointDir()
    sc.setCheckpointDir(str(tmp_path))
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        edges = spark.createDataFrame([(i, i + 1) for i in range(12)], "src long, dst long")
        assert {r.component for r in connected_components(edges).collect()} == {0}
        files = len(list(tmp_path.rglob("part-*")))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", named)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        if before:
            sc._jsc.sc().setCheckpointDir(before.rsplit("/", 1)[0])
    assert files < 2 * 40, files


def digits_of_size(df):
    return len(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def test_loops_of_checkpoints_do_not_grow_the_estimated_size(spark):
    """The digits of a join's estimated size doubled in every round of the components and filled the driver's memory."""
    kept = spark.range(4)
    for _ in range(8):
        kept = cut_lineage(kept.join(kept.toDF("other"), kept.id == F.col("other")).select("id"))
    assert sorted(r.id for r in kept.collect()) == [0, 1, 2, 3] and digits_of_size(kept) < 60


@pytest.mark.parametrize("most,kind", [(0, "long"), (0, "string"), (64, "long")])
def test_components_by_contraction(spark, monkeypatch, most, kind):
    """A path in no order, a star and many pairs, ended by one task or not; a path of n nodes takes far fewer rounds than nodes."""
    monkeypatch.setattr(components, "ROWS_A_FILE", most)
    ids = random.Random(3).sample(range(1000), 300)
    edges = [*zip(ids, ids[1:]), *[(2000, 2001 + i) for i in range(60)], *[(3000 + 2 * i, 3001 + 2 * i) for i in range(40)]]
    edges = [(f"{a:04d}", f"{b:04d}") for a, b in edges] if kind == "string" else edges
    got = connected_components(spark.createDataFrame(edges, f"src {kind}, dst {kind}"), max_rounds=30)
    assert {r.node: r.component for r in got.collect()} == naive_components(edges)
    assert digits_of_size(got) < 60
    with pytest.raises(RuntimeError, match="settle"):
        connected_components(spark.createDataFrame(edges, f"src {kind}, dst {kind}"), max_rounds=1)


def clusters_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.cluster_id, set()).add(r.record_id)
    return out


def classified(spark, pairs, kind="DUPLICATE"):
    df = spark.createDataFrame(pairs, "left_id string, right_id string")
    return df.withColumn("result", result(kind, 1.0, "test"))


def test_closure_and_ids(spark):
    found = classified(spark, [("b", "a"), ("c", "b"), ("y", "x")]).union(classified(spark, [("x", "a")], "NON_DUPLICATE"))
    got = k.transitive_closure(found)
    assert clusters_of(got) == {"a": {"a", "b", "c"}, "x": {"x", "y"}}
    again = k.transitive_closure(classified(spark, [("c", "x"), ("n", "m")]), got)
    assert clusters_of(again) == {"a": {"a", "b", "c", "x", "y"}, "m": {"m", "n"}}
    assert clusters_of(k.numbered(got)) == {0: {"a", "b", "c"}, 1: {"x", "y"}} and set(clusters_of(k.numbered(got, "c"))) == {"c0", "c1"}
    assert set(clusters_of(k.named_by(got, lambda ids: F.array_join(ids, "+")))) == {"a+b+c", "x+y"}
    assert {(r.cluster_id, r["size"]) for r in k.nested(got).collect()} == {("a", 3), ("x", 2)}
    left = k.remove_cluster(got, got.where("cluster_id = 'a'"))
    assert set(clusters_of(left)) == {"x"}
    with pytest.raises(ValueError):
        k.remove_cluster(got, got.where("record_id = 'a'"))
    assert k.containing_cluster(got, spark.createDataFrame([("b",)], "record_id string")).first().cluster_id == "a"
    with pytest.raises(Exception, match="exactly one"):
        k.containing_cluster(got, spark.createDataFrame([("q",)], "record_id string")).collect()


def test_helpers():
    assert [k.triangular(n) for n in (1, 2, 5, 100)] == [1, 3, 15, 5050]
    assert [k.gauss_pair(i) for i in range(28)] == [(a, b) for a in range(7) for b in range(a + 1)]
    assert len(set(k.random_edges(11, 45))) == 45 and all(a > b for a, b in k.random_edges(11, 45))
    assert len(k.partitions(5)) == 52 and len(np.unique(k.partitions(6), axis=0)) == 203
    assert k.greedy_partition(5, [(0, 1, 1), (2, 3, 1), (3, 4, 1), (1, 3, 1)]) == [0, 0, 0, 0, 0]
    assert k.greedy_partition(5, [(0, 1, 1), (2, 4, 1), (1, 3, 1)]) == [0, 0, 2, 0, 2]
    assert len(k.expanded_edges(20, [(1, 0), (2, 1)], 55)) == 3 and len(k.expanded_edges(20, [], 55)) == 55


@pytest.mark.parametrize("names,small,want", [(["Joanna"] * 5, 10, 1), (["Joanna"] * 5, 4, 1), (["Joanna"] * 2 + ["Johanna"] * 3, 10, 2), (["Joanna"] * 2 + ["Johanna"] * 3, 4, 2), (["Joanna"] * 130, 120, 1)])
def test_refine(spark, names, small, want):
    ids = list(range(len(names)))
    clusters = spark.createDataFrame([(0, i) for i in ids], "cluster_id long, record_id long")
    people = spark.createDataFrame(list(zip(ids, names, strict=True)), "id long, name string")

    def classify(pairs):
        a, b = people.select(F.col("id").alias("left_id"), F.col("name").alias("l")), people.select(F.col("id").alias("right_id"), F.col("name").alias("r"))
        joined = pairs.join(a, "left_id").join(b, "right_id")
        return joined.withColumn("result", F.when(F.col("l") == F.col("r"), result("DUPLICATE", 1.0, "")).otherwise(result("NON_DUPLICATE", 1.0, "")))

    known = spark.createDataFrame([(i, i - 1) for i in ids[1:]], "left_id long, right_id long")
    linked = classify(known) if want == 2 else known.withColumn("result", result("DUPLICATE", 1.0, ""))
    assert len(clusters_of(k.refined_transitive_closure(linked, classify, None, small))) == want
    split = k.refine(clusters, classify(k.pairs_to_score(clusters, known.limit(0), small)), small)
    assert len(clusters_of(split)) == want
    if want == 2:
        assert clusters_of(split) == {0: {0, 1}, 2: {2, 3, 4}}


def test_changes_and_oracle(spark):
    before = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (8, 8), (8, 9)], "cluster_id long, record_id long")
    now = spark.createDataFrame([(1, 1), (1, 2), (3, 3), (3, 4), (8, 8), (8, 9)], "cluster_id long, record_id long")
    assert set(clusters_of(k.changed_clusters(now, before))) == {3}
    assert [(r.old_id, r.parts) for r in k.split_events(now, before).collect()] == [(1, [1, 3])]
    assert clusters_of(k.consistent(now, before)) == {1: {1, 2, 3, 4}, 8: {8, 9}}
    pairs = spark.createDataFrame([(9, 100)], "left_id long, right_id long")
    assert set(clusters_of(k.oracle_clustering(pairs, before))) == {8}
    store = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, v long, w string")
    assert {(r.k, r.w) for r in k.last_versions(store, "k", "v").collect()} == {("a", "y"), ("b", "z")}


def test_greedy_partition_by_whole_scores():
    """Against the score of every trial, computed from all edges."""
    rng = np.random.default_rng(5)
    for _ in range(60):
        n = int(rng.integers(2, 25))
        edges = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, n, 3 * n), rng.integers(0, n, 3 * n), rng.uniform(-1, 1, 3 * n), strict=True)]
        label = list(range(n))
        for a, b, _ in sorted(edges, key=lambda e: -e[2]):
            x, y = sorted((label[a], label[b]))
            trial = [x if v == y else v for v in label]
            before, after = k.scores(np.array([label, trial]), edges)
            if after - before > k.TINY:
                label = trial
        assert k.greedy_partition(n, edges) == label
    ring = [(i, (i + 1) % 20_000, 1.0) for i in range(20_000)]
    assert len(k.greedy_partition(20_000, ring)) == 20_000
