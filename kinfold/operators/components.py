"""Connected components of an edge table by contraction."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.plans.runtime import ROWS_A_FILE, cut_lineage, fresh

#: Types of ids that Python finishes small tables of; others are contracted to the end.
PLAIN = {"tinyint", "smallint", "int", "bigint", "string"}


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, most: int | None = None) -> DataFrame:
    """(node, component) for every node of ``edges``; the component is its smallest node.

    In each round every node goes over to the first of itself and its neighbours, in an order drawn anew by a hash; edges
    between those are what is left. Whatever the graph's shape, a quarter of the nodes with edges goes in a round on
    average, so tables shrink geometrically and paths cost no more than stars. Once no more edges are left than one task
    writes anyway, one task ends it. The smallest ids go up with the nodes; then the nodes of each round, the last first,
    take over what the nodes they went to have found, so that no table is dealt by component. Both inputs of every join are plain tables or shuffled, so adaptive execution can split a hub's
    partition. Null ends, loops and repeated edges are ignored; no edges give no rows. Raises if ``max_rounds`` do not
    suffice. ``most``: about how many edges there are at most, if that is known.
    """
    one = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null and a <> b")
    both = cut_lineage(one.union(one.select("b", "a")).distinct(), most and 2 * most, after=True)
    kind = both.schema["a"].dataType.simpleString()
    few = ROWS_A_FILE if kind in PLAIN and both.schema["b"].dataType.simpleString() == kind else 0
    n = nodes = both.count()  # nodes are no more
    rounds, low = [], None
    while n > few:
        if len(rounds) == max_rounds:
            raise RuntimeError(f"components did not settle within {max_rounds} rounds")
        near = _first_near(both, len(rounds))
        went = cut_lineage(near.withColumn("low", F.col("node")) if low is None else near.join(fresh(low), "node").select("node", "first", "low"), n)
        low = went.groupBy(F.col("first").alias("node")).agg(F.min("low").alias("low"))
        rounds.append((went, low))
        left, right = went.select("node", "first").toDF("a", "ra"), went.select("node", "first").toDF("b", "rb")
        moved = both.join(left, "a").select("b", "ra").join(right, "b").where("ra <> rb")
        both = cut_lineage(moved.select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), n, after=True)
        n = both.count()
    ends = both.withColumn("low", F.col("a")) if low is None else both.join(fresh(low).toDF("a", "low"), "a").select("a", "b", "low")
    found = ends.repartition(1).mapInPandas(_joined, f"node {kind}, component {kind}") if few else ends.select("a", "low").toDF("node", "component")
    for went, low in reversed(rounds):
        known = fresh(low).join(fresh(found), "node", "left").select("node", F.coalesce("component", "low").alias("component"))
        found = went.join(fresh(known).toDF("first", "component"), "first").select("node", "component")
    return cut_lineage(found, nodes)


def _order(node: str, turn: int) -> Column:
    return F.xxhash64(node, F.lit(turn))


def _first_near(both: DataFrame, turn: int) -> DataFrame:
    """(node, first): the first of each node and its neighbours."""
    near = both.withColumn("h", _order("b", turn)).groupBy(F.col("a").alias("node")).agg(F.min_by("b", "h").alias("b"), F.min("h").alias("h"))
    return near.select("node", F.when(_order("node", turn) <= F.col("h"), F.col("node")).otherwise(F.col("b")).alias("first"))


def _joined(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, component) of all edges (a, b) with the smallest id ``low`` that a stands for."""
    parent, low = {}, {}

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for pdf in batches:
        for a, b, l in zip(pdf["a"].tolist(), pdf["b"].tolist(), pdf["low"].tolist(), strict=True):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            low[a] = l
            parent[root(b)] = root(a)
    least: dict = {}
    for x, l in low.items():
        least[root(x)] = min(l, least.get(root(x), l))
    if parent:
        yield pd.DataFrame({"node": list(parent), "component": [least[root(x)] for x in parent]})
