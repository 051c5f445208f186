"""Exact top-k by inner product with KD-trees, one per shard of the vectors.

Shards are cells of a coarse KD split. Each has one tree, with median splits along its principal axes and tight boxes;
a search visits leaves by the largest product that their boxes allow and stops when no box can reach the k-th best
so far. Every query goes to the shard of its best box first; its k-th score then goes with it to the next shards in the
order of their boxes, and on to the rest, and shards whose boxes stay below it are left out. Vectors are dealt to
their shards, queries stream past them: nothing is gathered but one shard's vectors.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinfold.plans.runtime import cut_lineage, table

#: Vectors of a shard, about, and of a leaf; shards at most (beyond that many they grow), so that their boxes fit anywhere.
SHARD, LEAF, MOST_SHARDS = 16_384, 128, 4_096
#: Numbers of the sample from which the cells of the shards are drawn; they decide about speed only.
SAMPLE = 1 << 20
#: A query meets the shard of its best box, then those up to this place, then the rest.
NEXT = 8
#: Magnitude below which products of 64-bit floats are exact, and the share by which a bound is lifted against rounding.
_EXACT, _LIFT = 1 << 53, 1e-9


class KDTree:
    """Tree over rows of integers (as floats): order of rows, leaf ranges and boxes of all nodes in rotated coordinates."""

    def __init__(self, rows: np.ndarray, leaf: int = LEAF) -> None:
        self.order, self.visited = np.arange(len(rows)), 0
        self.largest = float(np.abs(rows).max(initial=0))
        some = rows[:: max(1, len(rows) // 4096)]
        scale = self.largest or 1.0
        self.axes = np.linalg.eigh(np.cov((some / scale).T).reshape(rows.shape[1], rows.shape[1]))[1] if len(some) > 1 and rows.shape[1] else np.eye(rows.shape[1])
        turned = rows @ self.axes
        low, high, self.start, self.end, self.left, self.right = [], [], [], [], [], []
        stack = [(0, len(rows), -1, False)] if len(rows) else []
        while stack:
            s, e, parent, is_left = stack.pop()
            node = len(self.start)
            part = turned[self.order[s:e]]
            low.append(part.min(0))
            high.append(part.max(0))
            self.start.append(s)
            self.end.append(e)
            self.left.append(-1)
            self.right.append(-1)
            if parent >= 0:
                (self.left if is_left else self.right)[parent] = node
            spread = high[node] - low[node]
            if e - s <= leaf or not spread.any():
                continue
            axis, mid = int(spread.argmax()), (e - s) // 2
            self.order[s:e] = self.order[s:e][np.argpartition(part[:, axis], mid)]
            stack += [(s, s + mid, node, True), (s + mid, e, node, False)]
        self.low, self.high = np.array(low).reshape(len(low), rows.shape[1]), np.array(high).reshape(len(low), rows.shape[1])
        self.sorted = rows[self.order]

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """No product of a query with a point of a box is larger."""
        return box_bounds(self.low, self.high, self.axes.T @ q)

    def scores(self, s: int, e: int, q: np.ndarray) -> np.ndarray:
        """Exact products with the rows of a leaf; in Python's integers where floats would round."""
        if self.largest * float(np.abs(q).max(initial=0)) * max(1, len(q)) < _EXACT:
            return self.sorted[s:e] @ q
        return np.array([sum(int(a) * int(b) for a, b in zip(r, q, strict=True)) for r in self.sorted[s:e]], object)

    def search(self, q: np.ndarray, ids: np.ndarray, k: int, floor: int | None = None) -> list[tuple[int, int, int]]:
        """The k best (score, id, place), ties to the smaller id; nothing below ``floor``. Best box first."""
        self.visited = 0
        if not len(self.order):
            return []
        bound = self.bounds(q)
        best: list[tuple[int, int, int]] = []  # a heap of (score, -id, place): its head is the worst kept
        queue = [(-bound[0], 0)]
        while queue:
            b, node = heapq.heappop(queue)
            least = best[0][0] if len(best) == k else None
            if floor is not None and (least is None or floor > least):
                least = floor
            if least is not None and -b < least:
                break
            if self.left[node] >= 0:
                for child in (self.left[node], self.right[node]):
                    if least is None or bound[child] >= least:
                        heapq.heappush(queue, (-bound[child], child))
                continue
            self.visited += 1
            s, e = self.start[node], self.end[node]
            score = self.scores(s, e, q)
            for j in np.flatnonzero(score >= least).tolist() if least is not None else range(e - s):
                at = int(self.order[s + j])
                item = (int(score[j]), -int(ids[at]), at)
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
        return [(s, -i, at) for s, i, at in sorted(best, key=lambda x: (-x[0], -x[1]))]


def box_bounds(low: np.ndarray, high: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Largest product of ``q`` with any point of each box, lifted by more than rounding can take from it."""
    plus, minus = np.maximum(q, 0), np.minimum(q, 0)
    return high @ plus + low @ minus + (np.maximum(np.abs(low), np.abs(high)) @ np.abs(q)) * _LIFT


def pack(v: np.ndarray) -> bytes:
    """Whole numbers as 32-bit integers where they fit, else as doubles; equal vectors have equal bytes."""
    return b"i" + v.astype("<i4").tobytes() if np.abs(v).max(initial=0) < 1 << 31 else b"d" + (v + 0.0).astype("<f8").tobytes()


def unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<i4" if raw[:1] == b"i" else "<f8", offset=1).astype(np.float64)


def scaled(df: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component, packed; vectors that are null or hold null, NaN or infinite components (before or after scaling) are left out, as are null keys."""

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            flat = np.array(column.values.to_numpy(zero_copy_only=False), np.float64)
            at = np.asarray(column.offsets)
            with np.errstate(over="ignore", invalid="ignore"):
                flat = np.floor(scale * flat)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            good = np.asarray(batch.column(0).is_valid()) & np.asarray(column.is_valid()) & (bad[at[1:]] == bad[at[:-1]])
            packed = [pack(flat[at[i] : at[i + 1]]) for i in np.flatnonzero(good).tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), pa.array(packed, pa.binary())], names=["vec_id", "v"])

    return df.select(F.col(key).cast("long"), F.col(vector).cast("array<double>")).mapInArrow(run, "vec_id long, v binary")


class Cells:
    """Cells of a coarse KD split: at each level of a sample's tree the axis of the largest spread is cut at the median."""

    def __init__(self, rows: np.ndarray, depth: int) -> None:
        self.depth, self.axis, self.cut = depth, np.zeros(1 << depth, np.int64), np.full(1 << depth, np.inf)
        groups = {1: rows}
        for node in range(1, 1 << depth):
            part = groups.pop(node, rows[:0])
            if len(part) > 1:
                axis = int((part.max(0) - part.min(0)).argmax())
                cut = float(np.median(part[:, axis]))
                self.axis[node], self.cut[node] = axis, cut
                groups[2 * node], groups[2 * node + 1] = part[part[:, axis] <= cut], part[part[:, axis] > cut]

    def of(self, v: np.ndarray) -> int:
        node = 1
        for _ in range(self.depth):
            node = 2 * node + int(v[self.axis[node]] > self.cut[node])
        return node - (1 << self.depth)


def _dimension(v: str) -> Column:
    return F.expr(f"if(substr({v}, 1, 1) = X'69', (length({v}) - 1) div 4, (length({v}) - 1) div 8)").cast("long")


def dealt(held: DataFrame, shard_rows: int) -> tuple[DataFrame, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """``held`` (vec_id, v) with a column ``shard``, and the box of each shard. Shards hold vectors of one dimension; cells of many more vectors than planned are dealt further by hash."""
    counts = {r[0]: r[1] for r in held.groupBy(_dimension("v").alias("d")).count().collect()}  # a number for each dimension
    cells = {}
    for d, n in counts.items():
        depth = min(int(math.log2(MOST_SHARDS)), max(0, math.ceil(math.log2(n / shard_rows)))) if d else 0
        if depth:
            share = min(1.0, SAMPLE / d / n)
            drawn = held.where((_dimension("v") == d) & (F.pmod(F.xxhash64("v", F.lit("cells")), F.lit(1 << 30)) < int(share * (1 << 30)))).select("v").limit(max(2, 2 * SAMPLE // d))
            cells[d] = Cells(np.array([unpack(bytes(r[0])) for r in drawn.collect()]).reshape(-1, d), depth)

    def place(batches):
        for batch in batches:
            shards = []
            for raw in batch.column(1).to_pylist():
                v = unpack(raw)
                shards.append((len(v) << 13) + (cells[len(v)].of(v) if len(v) in cells else 0))
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), *batch.columns], names=["shard", "vec_id", "v"])

    placed = held.select("vec_id", "v").mapInArrow(place, "shard long, vec_id long, v binary")
    sizes = placed.groupBy("shard").count()
    placed = cut_lineage(placed)
    n_max = max(shard_rows * 4, max(counts.values(), default=0) * 4 // MOST_SHARDS)
    large = {r[0]: -(-r[1] // n_max) for r in sizes.where(F.col("count") > n_max).collect()}
    if large:
        parts = F.coalesce(F.create_map(*[F.lit(x) for kv in large.items() for x in kv])[F.col("shard")], F.lit(1))
        placed = cut_lineage(placed.withColumn("shard", F.col("shard") + F.shiftleft(F.pmod(F.xxhash64("vec_id", "v"), parts), 40)))

    def extent(batches):
        low: dict[int, np.ndarray] = {}
        high: dict[int, np.ndarray] = {}
        for batch in batches:
            shard, rows = np.asarray(batch.column(0)), batch.column(1).to_pylist()
            for s in np.unique(shard).tolist():
                x = np.array([unpack(rows[i]) for i in np.flatnonzero(shard == s)])
                low[s] = np.minimum(low.get(s, np.inf), x.min(0))
                high[s] = np.maximum(high.get(s, -np.inf), x.max(0))
        yield pa.RecordBatch.from_arrays([pa.array(list(low), pa.int64()), pa.array([x.tobytes() for x in low.values()], pa.binary()), pa.array([x.tobytes() for x in high.values()], pa.binary())], names=["shard", "low", "high"])

    shape = "shard long, low binary, high binary"
    partial = placed.select("shard", "v").mapInArrow(extent, shape)

    def joined(t: pa.Table) -> pa.Table:
        stack = lambda c: np.array([np.frombuffer(x, np.float64) for x in t.column(c).to_pylist()])
        return pa.table({"shard": t.column("shard").slice(0, 1), "low": pa.array([stack("low").min(0).tobytes()], pa.binary()), "high": pa.array([stack("high").max(0).tobytes()], pa.binary())})

    boxes = partial.groupBy("shard").applyInArrow(joined, shape).collect()  # at most about 4 * MOST_SHARDS boxes a dimension
    return placed, {r[0]: (np.frombuffer(r[1], np.float64), np.frombuffer(r[2], np.float64)) for r in boxes}


def _asked(queries: DataFrame, boxes: dict[int, tuple[np.ndarray, np.ndarray]], first: int, last: int | None) -> DataFrame:
    """(shard, q, v, floor) of the shards in places ``first`` to ``last`` of each query's order, without those whose box stays below its floor."""
    by_dim: dict[int, tuple[list[int], np.ndarray, np.ndarray]] = {}
    for d in {len(low) for low, _ in boxes.values()}:
        own = sorted(s for s, (low, _) in boxes.items() if len(low) == d)
        by_dim[d] = own, np.array([boxes[s][0] for s in own]).reshape(len(own), d), np.array([boxes[s][1] for s in own]).reshape(len(own), d)

    def run(batches):
        for batch in batches:
            at, shards = [], []
            for i, (raw, floor) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                v = unpack(raw)
                own, low, high = by_dim.get(len(v), ([], None, None))
                if own:
                    bound = box_bounds(low, high, v)
                    for j in np.argsort(-bound, kind="stable")[first:last].tolist():
                        if floor is not None and bound[j] < floor:
                            break
                        at.append(i)
                        shards.append(own[j])
                if len(at) > 10_000 or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), *(c.take(pa.array(at, pa.int64())) for c in batch.columns)], names=["shard", "q", "v", "floor"])
                    at, shards = [], []

    return queries.select("q", "v", "floor").mapInArrow(run, "shard long, q long, v binary, floor long")


def searched(placed: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(q, vec_id, score, same): the best of each query in each shard asked; ``same`` marks candidates whose vector is the query's."""

    def run(batches):
        shard, tree, ids, raws, out = None, None, [], [], []
        for batch in batches:
            for s, kind, i, raw, floor in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != shard:
                    shard, tree, ids, raws = s, None, [], []
                if kind == 0:
                    ids.append(i)
                    raws.append(raw)
                elif raws:
                    if tree is None:
                        tree, ids = KDTree(np.array([unpack(x) for x in raws])), np.array(ids, np.int64)
                    out += [(i, c, max(min(score, (1 << 63) - 1), -(1 << 63)), raws[at] == raw) for score, c, at in tree.search(unpack(raw), ids, k, floor)]
                if len(out) > 20_000:
                    yield _hits(out)
                    out = []
        yield _hits(out)

    vectors = placed.select("shard", F.lit(0).alias("kind"), F.col("vec_id").alias("id"), "v", F.lit(None).cast("long").alias("floor"))
    queries = asked.select("shard", F.lit(1), "q", "v", "floor")
    return vectors.union(queries).repartition(F.col("shard")).sortWithinPartitions("shard", "kind").mapInArrow(run, "q long, vec_id long, score long, same boolean")


def _hits(out: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.bool_())], names=["q", "vec_id", "score", "same"])


def top_k(df: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 10, shard_rows: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's ``k`` highest integer inner products, ties to the smaller id.

    A query meets every row of its length but its own. Rows that agree in key and vector are one; rows of one key with
    different vectors are rows of their own, as queries and as candidates. Rows with a null key or a vector that is null
    or not finite take no part. Scores beyond 64 bits saturate. A query without candidates has no rows; an empty table
    gives none. Of equal vectors only the k + 1 smallest keys can be among the best, and equal queries are asked once,
    so a vector that many rows share is no larger than any other.
    """
    rows = cut_lineage(scaled(df, key, vector).distinct())
    smallest = Window.partitionBy("v").orderBy("vec_id")
    held = cut_lineage(rows.withColumn("n", F.row_number().over(smallest)).where(F.col("n") <= k + 1).drop("n"))
    placed, boxes = dealt(held, shard_rows)
    queries = cut_lineage(rows.where(is_query).select("v").distinct().withColumn("q", F.monotonically_increasing_id()))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id", F.desc("same"))
    found: DataFrame | None = None
    for first, last in ((0, 1), (1, NEXT), (NEXT, None)):
        if found is None:
            now = queries.withColumn("floor", F.lit(None).cast("long"))
        elif len(boxes) <= first:
            break
        else:
            kth = found.groupBy("q").agg(F.when(F.count(F.lit(1)) > k, F.min("score")).alias("floor"))
            now = queries.join(kth, "q", "left")
        more = searched(placed, _asked(now, boxes, first, last), k + 1)
        both = more if found is None else found.unionByName(more)
        found = cut_lineage(both.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n"))
    asked = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "v").join(queries, "v").select("query_id", "q")
    others = asked.join(found, "q").where("not (same and vec_id = query_id)")
    ranked = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    return others.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


OP8_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, q.e AS query, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON len(q.e) = len(c.e) AND (q.vec_id <> c.vec_id OR q.e <> c.e) WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id, query ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
