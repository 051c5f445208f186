"""Candidate selection: sorted neighbourhoods, offline and online, without global sorts in one task.

Pairs are (left, right) = (new record, older record). Null keys and keys with a null part are not indexed.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from kinfold.operators.filters import key_filter, with_membership
from kinfold.plans.runtime import cut_lineage, fresh, setting

DEFAULT_WINDOW = 10
#: Characters of a key's last part by which rows are sorted; what follows moves only where it decides.
HEAD = 64
#: Characters of long texts that are ranked in one partition, and texts a partition by which their ranges are chosen: these go to the driver whole.
CHARS_A_PART = 1 << 23
TEXTS_A_RANGE = 10


@dataclass(frozen=True)
class SortingKey:
    """A named key of one or more columns, ordered by the first, then the next, and null if any is null."""

    name: str
    columns: tuple[Column | str, ...]

    def and_(self, *more: Column | str) -> SortingKey:
        return SortingKey(self.name, (*self.columns, *more))

    def column(self) -> Column:
        cols = [F.col(c) if isinstance(c, str) else c for c in self.columns]
        present = reduce(lambda a, b: a & b, [c.isNotNull() for c in cols])
        return F.when(present, F.struct(*[c.alias(f"k{i}") for i, c in enumerate(cols)]))


def sorting_key(name: str, *columns: Column | str) -> SortingKey:
    return SortingKey(name, columns)


@dataclass(frozen=True)
class Pass:
    key: SortingKey
    window: int = DEFAULT_WINDOW

    def __post_init__(self) -> None:
        if self.window < 2:
            raise ValueError("a window needs at least 2 records")


def passes(keys: Sequence[SortingKey | Pass | tuple[SortingKey, int]], default_window: int = DEFAULT_WINDOW) -> list[Pass]:
    return [k if isinstance(k, Pass) else Pass(*k) if isinstance(k, tuple) else Pass(k, default_window) for k in keys]


def global_rank(df: DataFrame, order: Sequence[Column | str], out: str = "rank", keep: Sequence[str] | None = None, parts: int | None = None, sample: int | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with positions from 0 in the given order: range partitions are sorted apart and shifted by the sizes of those before.

    ``parts``: their number; ``sample``: keys a partition that are sent to the driver to choose them (Spark takes up to three times as many).
    """
    dealt = (df.repartitionByRange(*order) if parts is None else df.repartitionByRange(parts, *order)).sortWithinPartitions(*order)
    placed = dealt.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    with setting(df.sparkSession, "spark.sql.execution.rangeExchange.sampleSizePerPartition", sample):
        local = cut_lineage(placed.select(*(keep or df.columns), "_part", "_at"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = local.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_shift"))
    # As many rows as there are partitions.
    return local.join(F.broadcast(shift), "_part").withColumn(out, F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def key_rank(keyed: DataFrame) -> DataFrame:
    """(id, rank) of (id, key), ordered by key, then id, without nulls.

    A key that ends in a long text is sorted by the first ``HEAD`` characters of it. Where different texts share these,
    one row of each text is fetched and these texts are ranked apart; copies of a text never move with it. Shorter texts
    precede all longer ones of the same beginning, and earlier parts of a key stay whole, so the order is that of whole keys.
    Ranges of whole texts are few and chosen by few texts, as these are sent to the driver.
    """
    parts = keyed.schema["key"].dataType.fields
    if parts[-1].dataType != StringType():
        return global_rank(keyed, ["key", "id"], keep=["id"])
    last = F.col("key")[parts[-1].name]
    head = F.struct(*[F.col("key")[p.name].alias(p.name) for p in parts[:-1]], F.substring(last, 1, HEAD).alias("head"))
    whole = keyed.select("id", "key", head.alias("head"), F.when(F.length(last) > HEAD, F.sha2(last, 256)).alias("digest"), F.length(last).alias("chars"))
    rows = cut_lineage(whole.drop("key"))
    contents = cut_lineage(rows.where("digest is not null").groupBy("head", "digest").agg(F.min("id").alias("id"), F.max("chars").alias("chars")))
    shared = contents.groupBy("head").count().where("count > 1").select("head")
    contested = cut_lineage(fresh(contents).join(shared, "head", "left_semi").select("head", "digest", "id", "chars"))
    parts = -(-(contested.agg(F.sum("chars")).first()[0] or 1) // CHARS_A_PART)
    possible = with_membership(whole.where("digest is not null"), key_filter(contested, ["id"]), ["id"], "_possible").where("_possible")
    texts = possible.select("head", "digest", "id", "key").join(fresh(contested.select("head", "digest", "id")), ["head", "digest", "id"], "left_semi")
    # Repeated rows of one id give a text several positions, of which one counts.
    order = global_rank(texts, ["key"], "order", keep=["head", "digest"], parts=parts, sample=TEXTS_A_RANGE).groupBy("head", "digest").agg(F.min("order").alias("order"))
    placed = rows.where("digest is not null").join(order, ["head", "digest"], "left").select("id", "head", F.coalesce("order", F.lit(0)).alias("order"))
    placed = placed.union(rows.where("digest is null").select("id", "head", F.lit(-1).cast("long")))
    return global_rank(placed, ["head", "order", "id"], keep=["id"])


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, frames).distinct()


def sorted_neighborhood(df: DataFrame, keys: Sequence, id_col: str = "id", default_window: int = DEFAULT_WINDOW) -> DataFrame:
    """(left_id, right_id) of records less than a window apart in the order of a pass (ties by id), the smaller id on the right.

    Linear in rows times window: positions are cut into stretches of one window, and a record meets its own stretch
    and the next. Repeated pairs of several passes appear once.
    """
    found = []
    for p in passes(keys, default_window):
        keyed = df.select(F.col(id_col).alias("id"), p.key.column().alias("key")).where("key is not null and id is not null")
        ranked = key_rank(keyed).select("id", "rank", F.floor(F.col("rank") / p.window).alias("stretch"))
        here = ranked.select(F.col("id").alias("a"), F.col("rank").alias("ra"), F.explode(F.array("stretch", F.col("stretch") + 1)).alias("stretch"))
        there = ranked.select(F.col("id").alias("b"), F.col("rank").alias("rb"), "stretch")
        pairs = here.join(there, "stretch").where(f"rb - ra between 1 and {p.window - 1}")
        found.append(pairs.select(F.greatest("a", "b").alias("left_id"), F.least("a", "b").alias("right_id")))
    return _union(found).where("left_id <> right_id")


def _needed(rows: list[tuple], half: int, earliest: float) -> list[tuple]:
    """Of (group, arrival, id) in order of nearness, those that a later query (arrival > ``earliest``) can have among its ``half`` nearest older ones."""
    heap: list[float] = []  # the half smallest arrivals so far, negated
    out = []
    for r in rows:
        if len(heap) < half or -heap[0] >= max(r[1], earliest):
            out.append(r)
        if len(heap) < half:
            heapq.heappush(heap, -r[1])
        elif -heap[0] > r[1]:
            heapq.heapreplace(heap, -r[1])
    return out


def _neighbours(rows: list[tuple], local: set, half: int, since: int) -> list[tuple]:
    """(new, old) for the local ones of (group, arrival, id) from arrival ``since`` on: newest first, each is taken out of the order and sees what is left, the older ones."""
    groups: dict[int, list[tuple]] = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1])):
        groups.setdefault(r[0], []).append(r)
    order = sorted(groups)
    after = dict(zip(order, [*order[1:], None], strict=True))
    before = dict(zip(order, [None, *order[:-1]], strict=True))
    out = []
    for g, arrival, i in sorted(rows, key=lambda r: -r[1]):
        if arrival < since:
            break
        groups[g].pop()
        if i in local:
            seen: dict = {}
            for step in (before, after):
                n, at = 0, g
                while at is not None and n < half:
                    for r in groups[at][: half - n]:
                        seen[r[2]] = None
                        n += 1
                    at = step[at]
            out += [(i, o) for o in seen]
        if not groups[g]:
            a, b = before[g], after[g]
            if a is not None:
                after[a] = b
            if b is not None:
                before[b] = a
    return out


def online_sorted_neighborhood(df: DataFrame, keys: Sequence, id_col: str = "id", arrival_col: str = "arrival", default_window: int = DEFAULT_WINDOW, since: int = 0) -> DataFrame:
    """(left_id, right_id): what each record met when it arrived, as if records came one by one in order of ``arrival_col``.

    Only records that arrived at ``since`` or later are asked for; all are met.

    In each pass a record meets up to half a window of older records with keys up to its own, nearest first, and as many
    with keys from its own on; equal keys count for both sides, oldest first. Arrivals are unique whole numbers.

    Only the first half window of records of a key can ever be met, so a frequent key costs no more than a rare one.
    Keys are ranked and cut into ranges; each range hands the few records that queries beyond it may meet to the others,
    and then answers its own.
    """
    found = []
    kind = df.schema[id_col].dataType.simpleString()
    for p in passes(keys, default_window):
        half = p.window // 2
        base = df.select(F.col(id_col).alias("id"), F.col(arrival_col).cast("long").alias("arrival"), p.key.column().alias("key")).where("key is not null")
        oldest = Window.partitionBy("key").orderBy("arrival")
        early = cut_lineage(base.withColumn("n", F.row_number().over(oldest)).where(F.col("n") <= half).drop("n"))
        late = base.where(F.col("arrival") >= since).join(early.select("id"), "id", "left_anti")
        same = early.select("key", F.col("id").alias("old"))
        found.append(late.join(same, "key").select(F.col("id").alias("left_id"), F.col("old").alias("right_id")))
        groups = global_rank(early.select("key").distinct(), ["key"], "group")
        indexed = early.join(groups, "key").select("group", "arrival", "id")
        indexed = cut_lineage(indexed)
        n_groups = (indexed.agg(F.max("group")).first()[0] or 0) + 1
        n_parts = max(1, min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_groups))
        chunk = -(-n_groups // n_parts)
        indexed = indexed.withColumn("part", F.floor(F.col("group") / chunk).cast("int"))
        # One number for each range.
        first = {r[0]: max(r[1], since) for r in indexed.groupBy("part").agg(F.min("arrival")).collect()}
        below = lambda q: min((v for k, v in first.items() if k < q), default=float("inf"))
        above = lambda q: min((v for k, v in first.items() if k > q), default=float("inf"))
        summary, carried, answer = _range_functions({q: (above(q), below(q)) for q in first}, half, since)
        shape = f"part int, group long, arrival long, id {kind}"
        summaries = indexed.groupBy("part").applyInPandas(summary, f"part int, way string, group long, arrival long, id {kind}")
        carries = cut_lineage(summaries.groupBy("way").applyInPandas(carried, shape))
        mine, theirs = fresh(indexed), fresh(carries)
        found.append(mine.groupBy("part").cogroup(theirs.groupBy("part")).applyInPandas(answer, f"left_id {kind}, right_id {kind}"))
    return _union(found)


def _range_functions(earliest: dict[int, tuple[float, float]], half: int, since: int):
    """What a range hands on, how that is carried to the ranges beyond, and the answers of a range."""
    def summary(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(zip(pdf["group"].tolist(), pdf["arrival"].tolist(), pdf["id"].tolist(), strict=True))
        q = int(pdf["part"].iloc[0])
        up = _needed(sorted(rows, key=lambda r: (-r[0], r[1])), half, earliest[q][0])
        down = _needed(sorted(rows, key=lambda r: (r[0], r[1])), half, earliest[q][1])
        out = [(q, "up", *r) for r in up] + [(q, "down", *r) for r in down]
        return pd.DataFrame(out, columns=["part", "way", "group", "arrival", "id"])

    def carried(pdf: pd.DataFrame) -> pd.DataFrame:
        way = pdf["way"].iloc[0]
        by: dict[int, list] = {}
        for r in pdf.itertuples(index=False):
            by.setdefault(r.part, []).append((r.group, r.arrival, r.id))
        out, held, last = [], [], None
        for q in sorted(earliest, reverse=way == "down"):
            if last is not None:
                near = sorted(by.get(last, []), key=lambda r: (-r[0] if way == "up" else r[0], r[1]))
                held = _needed(near + held, half, earliest[last][0 if way == "up" else 1])
                out += [(q, *r) for r in held]
            last = q
        return pd.DataFrame(out, columns=["part", "group", "arrival", "id"])

    def answer(pdf: pd.DataFrame, more: pd.DataFrame) -> pd.DataFrame:
        rows = [t for d in (pdf, more) for t in zip(d["group"].tolist(), d["arrival"].tolist(), d["id"].tolist(), strict=True)]
        return pd.DataFrame(_neighbours(rows, set(pdf["id"].tolist()), half, since), columns=["left_id", "right_id"])

    return summary, carried, answer


def with_records(pairs: DataFrame, records: DataFrame, id_col: str = "id", columns: Sequence[str] | None = None) -> DataFrame:
    """(left_id, right_id, left, right) with the records (or the columns that are compared) as structs."""
    picked = F.struct(*(columns or records.columns))
    for side in ("left", "right"):
        pairs = pairs.join(records.select(F.col(id_col).alias(f"{side}_id"), picked.alias(side)), f"{side}_id")
    return pairs.select("left_id", "right_id", "left", "right")
