"""Fusion: every cluster becomes one record by resolving the conflicts of each field.

A field's values travel as an array of structs (value, source, weight, ts) in the order of arrival. A resolution
narrows that array (ties stay), terminal ones leave at most one entry; all are expressions over arrays, so a merge
of any number of fields is one aggregation by cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Source and weight of values that are computed, and of records whose source is null.
CALCULATED, UNKNOWN_SOURCE = ("calculated", 1.0), ("Unknown", 1.0)


class Context:
    """What the resolutions of one record share: tagged values so far, the cluster's key and the time of computed values."""

    def __init__(self, key: Column | None = None, now: Column | None = None) -> None:
        self.tags: dict[str, Column] = {}
        self.key = F.lit(0) if key is None else key
        self.now = F.lit(None).cast("timestamp_ntz") if now is None else now

    def calculated(self, value: Column) -> Column:
        return entry(value, F.lit(CALCULATED[0]), F.lit(CALCULATED[1]), self.now)


def entry(value: Column, source: Column, weight: Column, ts: Column) -> Column:
    return F.struct(value.alias("value"), source.cast("string").alias("source"), weight.cast("double").alias("weight"), ts.cast("timestamp_ntz").alias("ts"))


@dataclass(frozen=True)
class Resolution:
    run: Callable[[Column, Context], Column]
    terminal: bool = False

    def __call__(self, vals: Column, ctx: Context | None = None) -> Column:
        return self.run(vals, ctx or Context())

    def and_then(self, after: Resolution) -> Resolution:
        """``after`` is always applied, also to a single value."""
        return Resolution(lambda v, ctx: after.run(self.run(v, ctx), ctx), after.terminal)


def chain(*resolutions: Resolution) -> Resolution:
    return reduce(Resolution.and_then, resolutions)


def _values(vals: Column) -> Column:
    return F.transform(vals, lambda v: v["value"])


def _best(rank: Callable[[Column], Column], smallest: bool) -> Resolution:
    pick = F.array_min if smallest else F.array_max
    return Resolution(lambda vals, ctx: _bound(pick(F.transform(vals, rank)), lambda best: F.filter(vals, lambda v: rank(v) == best)))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _one(value: Callable[[Column], Column], computed: bool = True) -> Resolution:
    """A terminal resolution that computes one value of a non-empty array."""

    def run(vals: Column, ctx: Context) -> Column:
        return F.when(F.size(vals) > 0, F.array(ctx.calculated(value(vals)) if computed else value(vals))).otherwise(F.array())

    return Resolution(run, True)


def min_() -> Resolution:
    return _best(lambda v: v["value"], True)


def max_() -> Resolution:
    return _best(lambda v: v["value"], False)


def sum_() -> Resolution:
    return _one(lambda vals: F.aggregate(vals, F.lit(0.0), lambda t, v: t + v["value"].cast("double")))


def mean() -> Resolution:
    return _one(lambda vals: F.aggregate(vals, F.lit(0.0), lambda t, v: t + v["value"].cast("double")) / F.size(vals))


def median(compat: bool = False) -> Resolution:
    """The middle value, or both middle values of an even number (``compat``: none)."""

    def run(vals: Column, ctx: Context) -> Column:
        n = F.size(vals)
        by_value = F.array_sort(vals, lambda a, b: F.when(a["value"] < b["value"], -1).when(a["value"] > b["value"], 1).otherwise(0))
        both = F.lit(0 if compat else 2)
        return F.when(n > 0, F.slice(by_value, ((n + 1) / 2).cast("int"), F.when(n % 2 == 0, both).otherwise(1))).otherwise(vals)

    return Resolution(run)


def random(seed: int = 0) -> Resolution:
    """One entry, chosen by a hash of the cluster's key and ``seed``."""

    def run(vals: Column, ctx: Context) -> Column:
        drawn = F.conv(F.substring(F.md5(F.concat_ws("|", ctx.key.cast("string"), F.lit(str(seed))).cast("binary")), 1, 8), 16, 10).cast("long")
        return F.when(F.size(vals) > 0, F.slice(vals, (drawn % F.size(vals)).cast("int") + 1, 1)).otherwise(vals)

    return Resolution(run, True)


def first() -> Resolution:
    return Resolution(lambda vals, ctx: F.slice(vals, 1, 1), True)


def last() -> Resolution:
    return Resolution(lambda vals, ctx: F.when(F.size(vals) > 0, F.slice(vals, -1, 1)).otherwise(vals), True)


def distinct() -> Resolution:
    """Each value once in order of first occurrence; repeated ones count as computed."""

    def run(vals: Column, ctx: Context) -> Column:
        each = F.array_distinct(_values(vals))

        def one(x: Column) -> Column:
            same = F.filter(vals, lambda v: v["value"] == x)
            return F.when(F.size(same) > 1, ctx.calculated(x)).otherwise(F.get(same, 0))

        return F.transform(each, one)

    return Resolution(run)


def shortest() -> Resolution:
    return _best(lambda v: F.length(v["value"]), True)


def longest() -> Resolution:
    return _best(lambda v: F.length(v["value"]), False)


def _heaviest(weight: Callable[[Column], Column]) -> Resolution:
    """Entries whose values have the largest sum of weights."""

    def run(vals: Column, ctx: Context) -> Column:
        def total(x: Column) -> Column:
            return F.aggregate(F.filter(vals, lambda v: v["value"] == x), F.lit(0.0), lambda t, v: t + weight(v))

        summed = F.transform(F.array_distinct(_values(vals)), lambda x: F.struct(x.alias("value"), total(x).alias("sum")))
        return _bound(summed, lambda s: _bound(F.array_max(F.transform(s, lambda x: x["sum"])), lambda top: F.filter(vals, lambda v: F.exists(s, lambda x: (x["value"] == v["value"]) & (x["sum"] == top)))))

    return Resolution(run)


def most_frequent() -> Resolution:
    return _heaviest(lambda v: F.lit(1.0))


def vote() -> Resolution:
    """By the weights of the sources."""
    return _heaviest(lambda v: v["weight"])


def earliest() -> Resolution:
    return _best(lambda v: v["ts"], True)


def latest() -> Resolution:
    return _best(lambda v: v["ts"], False)


def prefer_source(*sources: str, compat: bool = False) -> Resolution:
    """Entries of the source that comes first in the list; unlisted ones come last (``compat``: first)."""
    unlisted = -1 if compat else len(sources) + 1

    def rank(v: Column) -> Column:
        listed = F.array(*[F.lit(s) for s in sources])
        return F.coalesce(F.nullif(F.array_position(listed, v["source"]), F.lit(0).cast("long")), F.lit(unlisted).cast("long"))

    return _best(rank, True)


def union() -> Resolution:
    """Of arrays: all elements once, sorted."""
    return _one(lambda vals: F.array_sort(F.array_distinct(F.flatten(_values(vals)))))


def union_all(finish: Callable[[Column], Column] = lambda c: c) -> Resolution:
    """Of arrays: all elements; ``finish`` makes another collection of them."""
    return _one(lambda vals: finish(F.flatten(_values(vals))))


def assume_equal_value() -> Resolution:
    return Resolution(lambda vals, ctx: vals)


def transform(fn: Callable[[Column], Column]) -> Resolution:
    """Another value with the same lineage."""
    return Resolution(lambda vals, ctx: F.transform(vals, lambda v: entry(fn(v["value"]), v["source"], v["weight"], v["ts"])))


def corresponding(tag: str) -> Resolution:
    """Entries whose source is one of the tagged result's; an unset tag fails when the plan is built."""

    def run(vals: Column, ctx: Context) -> Column:
        if tag not in ctx.tags:
            raise KeyError(f"nothing is saved as {tag}")
        sources = F.transform(ctx.tags[tag], lambda v: v["source"])
        return F.filter(vals, lambda v: F.array_contains(sources, v["source"]))

    return Resolution(run)


def save_as(resolution: Resolution, tag: str) -> Resolution:
    def run(vals: Column, ctx: Context) -> Column:
        ctx.tags[tag] = resolution.run(vals, ctx)
        return ctx.tags[tag]

    return Resolution(run, resolution.terminal)


def resolved(vals: Column) -> tuple[Column, Column]:
    """(value, error): the one value left, or NULL and a message where several are."""
    each = F.array_distinct(_values(vals))
    value = F.when(F.size(each) == 1, F.get(vals, 0)["value"])
    error = F.when(F.size(each) > 1, F.concat(F.lit("Could not fully resolve: "), F.to_json(each)))
    return value, error


def is_non_empty(c: Column, kind: str) -> Column:
    return c.isNotNull() & (c != "") if kind == "string" else c.isNotNull()


@dataclass(frozen=True)
class FieldMerge:
    name: str
    resolutions: tuple[Resolution, ...] = ()
    read: Callable[[Column], Column] | None = None
    write: Callable[[Column], Column] | None = None
    tag: str | None = None


@dataclass(frozen=True)
class Merge:
    """Builder of a record merge: ``merge().field(name).with_(...).then(...)`` and so on, for the columns of a record.

    Null and empty values take no part. A field that cannot be fully resolved stays NULL and adds an error. Names
    that the records lack, and tags that no earlier field saves, fail when the merge is applied.
    """

    fields: tuple[FieldMerge, ...] = ()

    def field(self, name: str, read: Callable[[Column], Column] | None = None, write: Callable[[Column], Column] | None = None) -> Merge:
        """``read`` takes the value from the record struct, by default the field; ``write`` converts the result."""
        return replace(self, fields=(*self.fields, FieldMerge(name, (), read, write)))

    def _last(self, **changes) -> Merge:
        return replace(self, fields=(*self.fields[:-1], replace(self.fields[-1], **changes)))

    def with_(self, *resolutions: Resolution) -> Merge:
        return self._last(resolutions=(*self.fields[-1].resolutions, *resolutions))

    then = with_

    def converting_with(self, fn: Callable[[Column], Column]) -> Merge:
        return self.with_(transform(fn))

    converting_back = converting_with

    def save_as(self, tag: str) -> Merge:
        return self._last(tag=tag)

    def corresponding(self, tag: str) -> Merge:
        return self.with_(corresponding(tag))

    def corresponding_to_previous(self) -> Merge:
        before = self.fields[-2]
        tag = before.tag or f"_{before.name}"
        named = (*self.fields[:-2], replace(before, tag=tag), self.fields[-1])
        return replace(self, fields=named).corresponding(tag)

    def columns(self, cluster: Column, schema, ctx: Context) -> tuple[list[Column], list[Column]]:
        """(fields, errors) for an array of structs (record, source, weight, ts)."""
        out, errors = [], []
        for f in self.fields:
            read = f.read or (lambda r, n=f.name: r.getField(n))
            kind = schema[f.name].dataType.simpleString() if f.read is None else ""
            vals = _read(cluster, read, kind)
            for r in f.resolutions:
                vals = r.run(vals, ctx)
            if f.tag:
                ctx.tags[f.tag] = vals
            value, error = resolved(vals)
            out.append((f.write(value) if f.write else value).alias(f.name))
            errors.append(F.when(error.isNotNull(), F.concat(F.lit(f"{f.name}: "), error)))
        return out, errors


def _read(cluster: Column, read: Callable[[Column], Column], kind: str) -> Column:
    vals = F.transform(cluster, lambda e: entry(read(e["record"]), e["source"], e["weight"], e["ts"]))
    return F.filter(vals, lambda v: is_non_empty(v["value"], kind))


def merge() -> Merge:
    return Merge()


def with_lineage(records: DataFrame, source_col: str | None, ts_col: str | None, weights: dict[str, float] | None = None) -> DataFrame:
    """``records`` with _source, _weight and _ts: a null source is Unknown, sources without a weight count 1."""
    source = F.coalesce(F.col(source_col), F.lit(UNKNOWN_SOURCE[0])) if source_col else F.lit(UNKNOWN_SOURCE[0])
    known = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else None
    weight = F.coalesce(known[source], F.lit(1.0)) if known is not None else F.lit(1.0)
    ts = F.col(ts_col).cast("timestamp_ntz") if ts_col else F.lit(None).cast("timestamp_ntz")
    return records.withColumns({"_source": source, "_weight": weight, "_ts": ts})


def fuse(records: DataFrame, cluster_col: str, merging: Merge, source_col: str | None = None, ts_col: str | None = None, arrival_col: str | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """(cluster_col, fused struct, originals array, errors array): one row per cluster.

    Clusters of one record pass it through. Order within a cluster is that of ``arrival_col``. A cluster of which
    nothing can be resolved gives NULL fields and errors, never an exception.
    """
    schema = records.schema
    missing = [f.name for f in merging.fields if f.read is None and f.name not in records.columns]
    if missing:
        raise ValueError(f"Unknown property {missing[0]}")
    names = [f.name for f in merging.fields]
    record = F.struct(*[c for c in records.columns if c != cluster_col])
    rows = with_lineage(records, source_col, ts_col, weights)
    arrival = F.col(arrival_col) if arrival_col else F.lit(0)
    members = rows.groupBy(cluster_col).agg(F.array_sort(F.collect_list(F.struct(arrival.alias("arrival"), F.xxhash64(record).alias("tie"), record.alias("record"), F.col("_source").alias("source"), F.col("_weight").alias("weight"), F.col("_ts").alias("ts"))), lambda a, b: _order(a, b)).alias("_cluster"))
    ctx = Context(F.col(cluster_col), F.array_max(F.transform("_cluster", lambda e: e["ts"])))
    cols, errors = merging.columns(F.col("_cluster"), schema, ctx)
    alone = F.size("_cluster") < 2
    only = F.get(F.col("_cluster"), 0)["record"]
    kept = [F.when(alone, only.getField(n)).otherwise(c).alias(n) if n in records.columns else c for n, c in zip(names, cols, strict=True)]
    return members.select(
        cluster_col,
        F.struct(*kept).alias("fused"),
        F.transform("_cluster", lambda e: e["record"]).alias("originals"),
        F.when(alone, F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*errors)).cast("array<string>")).alias("errors"),
    )


def _order(a: Column, b: Column) -> Column:
    def by(name: str, rest: Column) -> Column:
        return F.when(a[name] < b[name], -1).when(a[name] > b[name], 1).otherwise(rest)

    return by("arrival", by("tie", F.lit(0)))


def accept_complete(fused: DataFrame) -> DataFrame:
    """Fused records without errors."""
    return fused.where(F.size("errors") == 0)


def accept_all(fused: DataFrame) -> DataFrame:
    return fused


def dont_fuse(fused: DataFrame) -> DataFrame:
    return fused.where(F.lit(False))


def group_values(df: DataFrame, key: str, value: str | Column, order: Sequence[str | Column], source: str | Column | None = None, weight: str | Column | None = None, ts: str | Column | None = None) -> DataFrame:
    """(key, vals): the values of each group as the array that resolutions take, null and empty ones left out."""
    c = lambda x, d: d if x is None else F.col(x) if isinstance(x, str) else x
    v = c(value, None)
    kept = df.where(v.isNotNull())
    e = entry(v, c(source, F.lit(UNKNOWN_SOURCE[0])), c(weight, F.lit(1.0)), c(ts, F.lit(None)))
    ordered = F.array_sort(F.collect_list(F.struct(*[c(o, None).alias(f"_o{i}") for i, o in enumerate(order)], e.alias("e"))))
    return kept.groupBy(key).agg(F.transform(ordered, lambda x: x["e"]).alias("vals"))


# --- fields of hot clusters ------------------------------------------------------------------------------

#: Resolutions that aggregates can do without gathering a cluster, each of them with ties broken by the smallest value.
AGGREGATES = ("min", "max", "sum", "mean", "first", "last", "most_frequent", "vote", "earliest", "latest", "longest", "shortest", "count")


def aggregate_fields(records: DataFrame, cluster_col: str, fields: dict[str, tuple[str, str]], source_col: str | None = None, ts_col: str | None = None, arrival_col: str | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """(cluster_col, one column per entry of ``fields``: name to (column, resolution)) for clusters of any size.

    Everything is partially aggregated before it is shuffled, so a cluster that holds a third of all rows costs a task
    no more than others: votes are summed by value first, the rest are running minima and maxima. Null and empty
    values take no part. For chains of resolutions and lineage use ``fuse``, which gathers each cluster.
    """
    wrong = [r for _, r in fields.values() if r not in AGGREGATES]
    if wrong:
        raise ValueError(f"{wrong[0]} is none of {', '.join(AGGREGATES)}")
    rows = with_lineage(records, source_col, ts_col, weights)
    arrival = F.col(arrival_col) if arrival_col else F.lit(0)
    plain, voted = [], []
    for name, (column, how) in fields.items():
        kind = records.schema[column].dataType.simpleString()
        c = F.when(is_non_empty(F.col(column), kind), F.col(column))
        if how in ("vote", "most_frequent"):
            voted.append((name, column, kind, F.col("_weight") if how == "vote" else F.lit(1.0)))
            continue
        # The smallest of (rank, value) with the rank of the resolution, or the largest negated.
        by = {"first": arrival, "last": arrival, "earliest": F.col("_ts"), "latest": F.col("_ts"), "longest": F.length(c), "shortest": F.length(c)}.get(how)
        if how in ("min", "max", "sum", "count"):
            plain.append(getattr(F, how)(c).alias(name))
        elif how == "mean":
            plain.append(F.avg(c).alias(name))
        elif how in ("last", "latest", "longest"):
            falling = -F.unix_micros(by.cast("timestamp")) if how == "latest" else -by
            plain.append(F.min(F.when(c.isNotNull(), F.struct(falling.alias("by"), c.alias("v"))))["v"].alias(name))
        else:
            plain.append(F.min(F.when(c.isNotNull(), F.struct(by.alias('by'), c.alias("v"))))["v"].alias(name))
    out = rows.groupBy(cluster_col).agg(*(plain or [F.count(F.lit(1)).alias("_n")]))
    for name, column, kind, weight in voted:
        counted = rows.where(is_non_empty(F.col(column), kind)).groupBy(cluster_col, F.col(column).alias("_v")).agg(F.sum(weight).alias("_w"))
        won = counted.groupBy(F.col(cluster_col).alias("_c")).agg(F.min(F.struct(-F.col("_w"), F.col("_v").alias("v")))["v"].alias(name))
        out = out.join(won, out[cluster_col].eqNullSafe(won["_c"]), "left").drop("_c")
    return out.select(cluster_col, *fields)
