"""Clusters of classified pairs: transitive closure, refinement, stable identities.

Clusters are tables (cluster_id, record_id); the id is by default the smallest record id, so it is stable.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.operators.candidates import global_rank
from kinfold.operators.classify import DUPLICATE
from kinfold.operators.components import connected_components
from kinfold.plans.runtime import cut_lineage, fresh

MAX_SMALL = 10
TINY = 1e-12


def transitive_closure(classified: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """(cluster_id, record_id) of everything that DUPLICATE pairs link, together with clusters found before."""
    edges = classified.where(F.col("result.classification") == DUPLICATE).select("left_id", "right_id")
    if previous is not None:
        edges = edges.union(previous.select("cluster_id", "record_id"))
    return connected_components(edges, "left_id", "right_id").select(F.col("component").alias("cluster_id"), F.col("node").alias("record_id"))


def remove_cluster(clusters: DataFrame, removed: DataFrame) -> DataFrame:
    """Clusters without those of ``removed`` (cluster_id, record_id), which must hold exactly the same records."""
    wrong = clusters.join(removed.select("cluster_id").distinct(), "cluster_id", "left_semi").exceptAll(removed.select(*clusters.columns))
    missing = removed.select(*clusters.columns).exceptAll(clusters)
    if wrong.limit(1).count() or missing.limit(1).count():
        raise ValueError("a cluster to remove differs from the one held")
    return clusters.join(removed.select("cluster_id").distinct(), "cluster_id", "left_anti")


def nested(clusters: DataFrame) -> DataFrame:
    """(cluster_id, elements, size)."""
    return clusters.groupBy("cluster_id").agg(F.array_sort(F.collect_list("record_id")).alias("elements"), F.count(F.lit(1)).alias("size"))


def merge_clusters(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def containing_cluster(clusters: DataFrame, records: DataFrame, id_col: str = "record_id") -> DataFrame:
    """Each record's cluster id; a record in no or in several clusters raises when the row is read."""
    n = clusters.groupBy("record_id").agg(F.min("cluster_id").alias("cluster_id"), F.count(F.lit(1)).alias("_n"))
    found = records.join(n, records[id_col] == n["record_id"], "left").select(records["*"], "cluster_id", "_n")
    checked = F.when(F.col("_n") == 1, F.col("cluster_id")).otherwise(F.raise_error(F.concat(F.lit("not in exactly one cluster: "), F.col(id_col).cast("string"))))
    return found.withColumn("cluster_id", checked).drop("_n")


def numbered(clusters: DataFrame, prefix: str | None = None) -> DataFrame:
    """Clusters with ids 0, 1, ... in the order of their smallest records, or ``prefix`` before these numbers."""
    firsts = clusters.groupBy("cluster_id").agg(F.min("record_id").alias("_first"))
    ranked = global_rank(firsts, ["_first"], "_n").select("cluster_id", "_n")
    name = F.col("_n") if prefix is None else F.concat(F.lit(prefix), F.col("_n").cast("string"))
    return clusters.join(ranked, "cluster_id").select(name.alias("cluster_id"), "record_id")


def named_by(clusters: DataFrame, name) -> DataFrame:
    """Clusters with ids made by an expression of the sorted array of their records."""
    ids = nested(clusters).select("cluster_id", name(F.col("elements")).alias("_name"))
    return clusters.join(ids, "cluster_id").select(F.col("_name").alias("cluster_id"), "record_id")


# --- refinement ------------------------------------------------------------------------------------------


def triangular(n: int) -> int:
    return n * (n + 1) // 2


def gauss_pair(i: int) -> tuple[int, int]:
    """The i-th of (0,0), (1,0), (1,1), (2,0), ..."""
    l = int((np.sqrt(8 * i + 1) - 1) // 2)
    while triangular(l + 1) <= i:
        l += 1
    while triangular(l) > i:
        l -= 1
    return l, i - triangular(l)


def random_edges(n: int, wanted: int, seed: int = 0) -> list[tuple[int, int]]:
    """``wanted`` different pairs (l, r), r < l, of n elements; all, if there are fewer."""
    potential = triangular(n - 1)
    if wanted >= potential:
        chosen = range(potential)
    else:
        chosen = sorted(np.random.default_rng(seed).choice(potential, wanted, replace=False).tolist())
    return [(l + 1, r) for l, r in map(gauss_pair, chosen)]


def edge_weight(classification: str, confidence: float) -> float:
    """Positive for duplicates, negative for non-duplicates, 0 for all that is undecided."""
    return confidence if classification == DUPLICATE else -confidence if classification == "NON_DUPLICATE" else 0.0


_PARTITIONS: dict[int, np.ndarray] = {}


def partitions(n: int) -> np.ndarray:
    """All partitions of n elements as rows of restricted growth strings, in lexicographic order; made once for each n."""
    if n in _PARTITIONS:
        return _PARTITIONS[n]
    rows = np.zeros((1, 1), np.int8)
    for _ in range(n - 1):
        top = rows.max(1).astype(np.int64) + 2
        rows = np.concatenate([np.repeat(rows, top, 0), (np.arange(top.sum()) - np.repeat(np.cumsum(top) - top, top))[:, None].astype(np.int8)], 1)
    _PARTITIONS[n] = rows
    return rows


def scores(rows: np.ndarray, edges: list[tuple[int, int, float]]) -> np.ndarray:
    """Of partitions: weights inside over the cluster's size, less weights between over what is outside either cluster."""
    n = rows.shape[1]
    size = np.stack([(rows == rows[:, [i]]).sum(1) for i in range(n)], 1).astype(float)
    out = np.zeros(len(rows))
    for a, b, w in edges:
        same = rows[:, a] == rows[:, b]
        apart = w / np.maximum(n - size[:, a], 1) + w / np.maximum(n - size[:, b], 1)
        out += np.where(same, w / size[:, a], -apart)
    return out


def exact_partition(n: int, edges: list[tuple[int, int, float]]) -> list[int]:
    rows = partitions(n)
    return rows[int(scores(rows, edges).argmax())].tolist()


def greedy_partition(n: int, edges: list[tuple[int, int, float]]) -> list[int]:
    """Edges by falling weight join their clusters where that raises the score; a cluster is named by its first element.

    Sums of weights inside and across are kept by cluster, so that a trial costs the same whatever the cluster's size; of
    two clusters the neighbours of the one with fewer are moved. A gain of less than ``TINY`` is rounding and no gain.
    """
    parent, first, size = list(range(n)), list(range(n)), [1] * n
    inside, across = [0.0] * n, [0.0] * n
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        if a == b:
            inside[a] += w
            continue
        for x, y in ((a, b), (b, a)):
            near[x][y] = near[x].get(y, 0.0) + w
            across[x] += w

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def score(elements: int, within: float, between: float) -> float:
        return within / elements - between / max(n - elements, 1)

    for a, b, _ in sorted(edges, key=lambda e: -e[2]):
        x, y = root(a), root(b)
        if x == y:
            continue
        if len(near[x]) < len(near[y]):
            x, y = y, x
        w = near[x][y]
        joined = size[x] + size[y], inside[x] + inside[y] + w, across[x] + across[y] - 2 * w
        if score(*joined) - score(size[x], inside[x], across[x]) - score(size[y], inside[y], across[y]) <= TINY:
            continue
        parent[y], first[x] = x, min(first[x], first[y])
        size[x], inside[x], across[x] = joined
        del near[x][y], near[y][x]
        for z, v in near[y].items():
            near[x][z] = near[x].get(z, 0.0) + v
            near[z][x] = near[x][z]
            del near[z][y]
        near[y] = {}
    return [first[root(i)] for i in range(n)]


def expanded_edges(n: int, known: list[tuple[int, int]], wanted: int) -> list[tuple[int, int]]:
    """Known pairs, then pairs of neighbours' neighbours, level by level, up to ``wanted``; known ones always stay."""
    pairs = {tuple(sorted(p, reverse=True)) for p in known if p[0] != p[1]}
    if not pairs:
        return random_edges(n, wanted)
    out = sorted(pairs)
    while len(out) < wanted:
        near: dict[int, set[int]] = {}
        for a, b in out:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        more = sorted({tuple(sorted((a, c), reverse=True)) for a in near for b in near[a] for c in near[b] if c != a} - set(out))
        if not more:
            break
        out += more[: wanted - len(out)]
    return out


def refine_labels(n: int, edges: list[tuple[int, int, float]], max_small: int = MAX_SMALL) -> list[int]:
    return list(range(n)) if n == 1 else [0] * n if n == 2 else exact_partition(n, edges) if n <= max_small else greedy_partition(n, edges)


def pairs_to_score(clusters: DataFrame, known: DataFrame, max_small: int = MAX_SMALL) -> DataFrame:
    """(cluster_id, left_id, right_id) that refinement needs and no known classification covers.

    All pairs of clusters of 3 to ``max_small`` records; of larger ones as many as a cluster of that size has.
    """
    sizes = clusters.groupBy("cluster_id").count()
    small = clusters.join(sizes.where(f"count between 3 and {max_small}").select("cluster_id"), "cluster_id")
    a, b = small.alias("a"), small.alias("b")
    every = a.join(b, (F.col("a.cluster_id") == F.col("b.cluster_id")) & (F.col("a.record_id") > F.col("b.record_id"))).select("a.cluster_id", F.col("a.record_id").alias("left_id"), F.col("b.record_id").alias("right_id"))
    large = clusters.join(sizes.where(f"count > {max_small}").select("cluster_id"), "cluster_id")
    kind = clusters.schema["record_id"].dataType.simpleString()
    inside = known.select("left_id", "right_id").join(large.select(F.col("record_id").alias("left_id"), "cluster_id"), "left_id").join(large.select(F.col("record_id").alias("right_id"), F.col("cluster_id").alias("_c")), "right_id").where("cluster_id = _c").select("cluster_id", "left_id", "right_id")

    def expand(pdf: pd.DataFrame, more: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({"cluster_id": [], "left_id": [], "right_id": []})
        ids = sorted(pdf["record_id"].tolist())
        at = {x: i for i, x in enumerate(ids)}
        have = [(at[x], at[y]) for x, y in zip(more["left_id"], more["right_id"], strict=True)] if len(more) else []
        out = expanded_edges(len(ids), have, triangular(max_small))
        return pd.DataFrame([(pdf["cluster_id"].iloc[0], ids[x], ids[y]) for x, y in out], columns=["cluster_id", "left_id", "right_id"])

    cid = clusters.schema["cluster_id"].dataType.simpleString()
    grown = fresh(large).groupBy("cluster_id").cogroup(fresh(inside).groupBy("cluster_id")).applyInPandas(expand, f"cluster_id {cid}, left_id {kind}, right_id {kind}")
    both = known.select("left_id", "right_id").union(known.select("right_id", "left_id")).distinct()
    return every.union(grown).join(both, ["left_id", "right_id"], "left_anti").select("cluster_id", "left_id", "right_id")


def refine(clusters: DataFrame, classified: DataFrame, max_small: int = MAX_SMALL) -> DataFrame:
    """(cluster_id, record_id) after splitting clusters into the best-scoring groups; ids are the smallest records.

    ``classified`` (left_id, right_id, result) holds the known results and those of ``pairs_to_score``. Clusters of up
    to two records stay, of up to ``max_small`` are searched exhaustively, larger ones greedily.
    """
    kind = clusters.schema["record_id"].dataType.simpleString()
    sizes = clusters.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("_n"), F.min("record_id").alias("_first"))
    sized = cut_lineage(clusters.join(sizes, "cluster_id"))
    kept = sized.where("_n <= 2").select(F.col("_first").alias("cluster_id"), "record_id")
    searched = sized.where("_n > 2").select("cluster_id", "record_id")
    side = fresh(searched.select("record_id", "cluster_id"))
    e = classified.select("left_id", "right_id", "result.classification", "result.confidence")
    e = e.join(side.withColumnsRenamed({"record_id": "left_id"}), "left_id").join(side.withColumnsRenamed({"record_id": "right_id", "cluster_id": "_c"}), "right_id").where("cluster_id = _c").drop("_c")

    def split(pdf: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(pdf["record_id"].tolist())
        at = {x: i for i, x in enumerate(ids)}
        weight: dict[tuple[int, int], float] = {}
        for r in edges.itertuples(index=False):
            a, b = sorted((at[r.left_id], at[r.right_id]), reverse=True)
            if a != b:
                weight[a, b] = edge_weight(r.classification, r.confidence)
        label = refine_labels(len(ids), [(a, b, w) for (a, b), w in sorted(weight.items())], max_small)
        first: dict[int, object] = {}
        for x, l in zip(ids, label, strict=True):
            first.setdefault(l, x)
        return pd.DataFrame({"cluster_id": [first[l] for l in label], "record_id": ids})

    return kept.union(fresh(searched).groupBy("cluster_id").cogroup(fresh(e).groupBy("cluster_id")).applyInPandas(split, f"cluster_id {kind}, record_id {kind}"))


def refined_transitive_closure(classified: DataFrame, classify_pairs, previous: DataFrame | None = None, max_small: int = MAX_SMALL) -> DataFrame:
    """Closure, then refinement; ``classify_pairs`` classifies (cluster_id, left_id, right_id) rows that are not known yet."""
    closed = cut_lineage(transitive_closure(classified, previous))
    known = classified.select("left_id", "right_id", "result")
    more = classify_pairs(pairs_to_score(closed, known, max_small)).select("left_id", "right_id", "result")
    return refine(closed, known.union(more), max_small)


def changed_clusters(now: DataFrame, before: DataFrame) -> DataFrame:
    """Rows of clusters of which some record had another cluster id (or none) before."""
    old = before.select("record_id", F.col("cluster_id").alias("_old"))
    moved = now.join(old, "record_id", "left").where("_old is null or _old <> cluster_id").select("cluster_id").distinct()
    return now.join(moved, "cluster_id", "left_semi")


def split_events(now: DataFrame, before: DataFrame) -> DataFrame:
    """(old_id, parts): clusters whose records are in several clusters now, with the new ids, the largest part first."""
    joined = now.join(before.select("record_id", F.col("cluster_id").alias("old_id")), "record_id")
    parts = joined.groupBy("old_id", "cluster_id").count()
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), "cluster_id"))), lambda x: x["cluster_id"])
    return parts.groupBy("old_id").agg(ordered.alias("parts")).where(F.size("parts") > 1)


def veto_splits(now: DataFrame, before: DataFrame) -> DataFrame:
    return consistent(now, before)


def consistent(now: DataFrame, before: DataFrame) -> DataFrame:
    """Clusters of ``now``, never splitting one of ``before``: closure over both assignments."""
    edges = now.select("cluster_id", "record_id").union(before.select("cluster_id", "record_id"))
    linked = connected_components(edges, "cluster_id", "record_id").select(F.col("component").alias("_id"), F.col("node").alias("record_id"))
    every = now.select("record_id").union(before.select("record_id")).distinct()
    return every.join(linked, "record_id", "left").select(F.coalesce("_id", "record_id").alias("cluster_id"), "record_id")


def oracle_clustering(classified: DataFrame, gold: DataFrame) -> DataFrame:
    """Rows of the gold assignment (cluster_id, record_id) for clusters that some pair touches on either side."""
    ids = classified.select(F.col("left_id").alias("record_id")).union(classified.select("right_id")).distinct()
    touched = gold.join(ids, "record_id", "left_semi").select("cluster_id").distinct()
    return gold.join(touched, "cluster_id", "left_semi")


def last_versions(changes: DataFrame, key: str, version: str) -> DataFrame:
    """The newest row of each key: what a key-value store holds after all upserts."""
    names = [c for c in changes.columns if c != key]
    return changes.groupBy(key).agg(F.max_by(F.struct(*names), F.col(version)).alias("_row")).select(key, "_row.*")
