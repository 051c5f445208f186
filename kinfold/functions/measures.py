"""Similarity measures: trees that compile to column expressions, with unknown as NULL.

Every measure also scores plain Python values, for use inside Python operators (stable matching) and as a check of
the expression. ``measure(left, right)`` gives NULL (or the ``null`` measure's value) where a side is NULL.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.functions.transforms import Transform, field
from kinfold.operators import matching

Score = float | None


class Measure:
    """Base: subclasses give ``known`` (Column of two non-null Columns) and ``plain`` (the same for values)."""

    symmetric = False

    def known(self, left: Column, right: Column) -> Column:
        raise NotImplementedError

    def plain(self, left: Any, right: Any) -> Score:
        raise NotImplementedError

    def __call__(self, left: Column, right: Column, null: Column | None = None) -> Column:
        other = F.lit(None).cast("double") if null is None else null
        return F.when(left.isNotNull() & right.isNotNull(), self.known(left, right)).otherwise(other)

    def score(self, left: Any, right: Any) -> Score:
        return None if left is None or right is None else self.plain(left, right)

    def errors(self, left: Column, right: Column) -> list[Column]:
        """Messages (NULL if none) of transformations that refuse a value."""
        return []

    def of(self, transform: Transform | str) -> Measure:
        return Transformed(self, field(transform) if isinstance(transform, str) else transform)

    def cutoff(self, threshold: float) -> Measure:
        return Cutoff(self, threshold)

    def scale_with_threshold(self, threshold: float) -> Measure:
        """(s - t) / (1 - t) above the threshold, else 0; unknown is 0."""
        inner = self.cutoff(threshold)
        return Modified(inner, lambda s: F.when(s > threshold, (s - threshold) / (1 - threshold)).otherwise(0.0), lambda s: (s - threshold) / (1 - threshold) if s is not None and s > threshold else 0.0)

    def binarize(self) -> Measure:
        return Modified(self, F.signum, lambda s: None if s is None else float((s > 0) - (s < 0)))

    def unknown_if_zero(self) -> Measure:
        """Unknown where the score is not positive, else 1, also for unknown."""
        return Modified(self, lambda s: F.when(s <= 0, F.lit(None)).otherwise(1.0), lambda s: None if s is not None and s <= 0 else 1.0)

    def unknown_if(self, test: Callable[[Any], Any]) -> Measure:
        return Modified(self, lambda s: F.when(test(s), F.lit(None)).otherwise(s), lambda s: None if s is None or test(s) else s)

    def negate(self) -> Measure:
        return Modified(self, lambda s: 1 - s, lambda s: None if s is None else 1 - s)


@dataclass(frozen=True)
class Expression(Measure):
    """A measure given by its two forms."""

    column: Callable[[Column, Column], Column]
    python: Callable[[Any, Any], Score] | None = None
    symmetric: bool = False

    def known(self, left: Column, right: Column) -> Column:
        return self.column(left, right)

    def plain(self, left: Any, right: Any) -> Score:
        if self.python is None:
            raise TypeError("this measure has no Python form")
        return self.python(left, right)


@dataclass(frozen=True)
class Transformed(Measure):
    inner: Measure
    transform: Transform

    @property
    def symmetric(self) -> bool:
        return self.inner.symmetric

    def known(self, left: Column, right: Column) -> Column:
        return self.inner(self.transform(left), self.transform(right))

    def plain(self, left: Any, right: Any) -> Score:
        return self.inner.score(self.transform.value(left), self.transform.value(right))

    def cutoff(self, threshold: float) -> Measure:
        return replace(self, inner=self.inner.cutoff(threshold))

    def errors(self, left: Column, right: Column) -> list[Column]:
        own = [self.transform.fails(c) for c in (left, right)] if self.transform.fails else []
        return own + self.inner.errors(self.transform(left), self.transform(right))


@dataclass(frozen=True)
class Modified(Measure):
    inner: Measure
    column: Callable[[Column], Column]
    python: Callable[[Score], Score]

    @property
    def symmetric(self) -> bool:
        return self.inner.symmetric

    def __call__(self, left: Column, right: Column, null: Column | None = None) -> Column:
        return self.column(self.inner(left, right, null))

    def known(self, left: Column, right: Column) -> Column:
        return self.column(self.inner.known(left, right))

    def score(self, left: Any, right: Any) -> Score:
        return self.python(self.inner.score(left, right))

    plain = score

    def errors(self, left: Column, right: Column) -> list[Column]:
        return self.inner.errors(left, right)


class Cutoff(Modified):
    """Scores below the threshold are 0; the higher of two nested thresholds holds."""

    def __init__(self, inner: Measure, threshold: float) -> None:
        super().__init__(inner, lambda s: F.when(s < threshold, 0.0).otherwise(s), lambda s: 0.0 if s is not None and s < threshold else s)
        object.__setattr__(self, "threshold", threshold)

    def cutoff(self, threshold: float) -> Measure:
        return self if threshold <= self.threshold else Cutoff(self.inner, threshold)


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@dataclass(frozen=True)
class Levenshtein(Measure):
    """1 - distance / longer length; two empty strings are unknown. A cutoff bounds the distance and is checked on lengths first."""

    threshold: float | None = None
    symmetric = True

    def known(self, left: Column, right: Column) -> Column:
        longer = F.greatest(F.length(left), F.length(right))
        value = 1 - F.try_divide(F.levenshtein(left, right), longer)
        if self.threshold is None:
            return value
        most = (longer * (1 - self.threshold)).cast("int")
        near = F.abs(F.length(left) - F.length(right)) <= most
        return F.when(longer == 0, F.lit(None)).when(near & (F.levenshtein(left, right) <= most), value).otherwise(0.0)

    def plain(self, left: str, right: str) -> Score:
        longer = max(len(left), len(right))
        if not longer:
            return None
        most = longer if self.threshold is None else int(longer * (1 - self.threshold))
        if abs(len(left) - len(right)) > most:
            return 0.0
        d = edit_distance(left, right)
        return 1 - d / longer if d <= most else 0.0

    def cutoff(self, threshold: float) -> Measure:
        return Levenshtein(threshold if self.threshold is None else max(threshold, self.threshold))


def jaro_winkler_score(a: str, b: str) -> float:
    """Jaro similarity with a bonus for up to four common first characters from 0.7 on."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    reach = max(len(long) // 2 - 1, 0)
    used = [False] * len(long)
    first = []
    for i, c in enumerate(short):
        for j in range(max(0, i - reach), min(len(long), i + reach + 1)):
            if not used[j] and long[j] == c:
                used[j] = True
                first.append(c)
                break
    m = len(first)
    if not m:
        return 0.0
    half = sum(x != y for x, y in zip(first, (long[j] for j in range(len(long)) if used[j]), strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - half) / m) / 3
    if jaro < 0.7:
        return jaro
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro)


def _pairwise(python: Callable[[Any, Any], Score], name: str) -> Callable[[Column, Column], Column]:
    """An Arrow-batched function of two columns that computes each distinct pair of a batch once."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        memo: dict = {}
        out = []
        for x, y in zip(a, b, strict=True):
            if x is None or y is None or x is pd.NA or y is pd.NA:
                out.append(None)
                continue
            key = (x, y) if isinstance(x, str) else (tuple(x), tuple(y))
            if key not in memo:
                memo[key] = python(*key)
            out.append(memo[key])
        return pd.Series(out, dtype="Float64")

    run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    run.__name__ = name
    # Made anew at each use: a function that is held would keep a handle of the JVM, and measures travel to executors.
    return lambda a, b: F.pandas_udf(run, T.DoubleType())(a, b)


def equality() -> Measure:
    return Expression(lambda a, b: (a == b).cast("double"), lambda a, b: float(a == b), True)


def inequality() -> Measure:
    return equality().negate()


def levenshtein() -> Measure:
    return Levenshtein()


def jaro_winkler() -> Measure:
    return Expression(_pairwise(jaro_winkler_score, "jaro_winkler"), jaro_winkler_score, True)


def similarity_score(python: Callable[[str, str], Score], name: str = "similarity_score", symmetric: bool = False) -> Measure:
    """Any Python score of two values."""
    return Expression(_pairwise(python, name), python, symmetric)


def to_similarity(column: Callable[[Column, Column], Column], python: Callable[[str, str], int] | None = None) -> Measure:
    """1 - distance / longer length for an edit distance given as an expression; -1 (or less) means too far."""

    def plain(a: str, b: str) -> Score:
        d, longer = python(a, b), max(len(a), len(b))
        return 0.0 if d <= -1 else (1 - d / longer if longer else None)

    def known(a: Column, b: Column) -> Column:
        d = column(a, b)
        return F.when(d <= -1, 0.0).otherwise(1 - F.try_divide(d, F.greatest(F.length(a), F.length(b))))

    return Expression(known, plain if python else None)


def collection(column: Callable[[Column, Column], Column], python: Callable[[list, list], Score] | None = None, symmetric: bool = False) -> Measure:
    """Guard for arrays: two empty ones are 1, one empty is 0."""
    return Expression(
        lambda a, b: F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(column(a, b)),
        (lambda a, b: 1.0 if not a and not b else 0.0 if not a or not b else python(a, b)) if python else None,
        symmetric,
    )


def set_measure(column: Callable[[Column, Column], Column], python: Callable[[set, set], Score] | None = None, symmetric: bool = False) -> Measure:
    inner = collection(column, (lambda a, b: python(set(a), set(b))) if python else None, symmetric)
    return Expression(lambda a, b: inner.known(F.array_distinct(a), F.array_distinct(b)), inner.python, symmetric)


def jaccard(distinct: bool = False) -> Measure:
    """Of sets; ``distinct`` promises that no array repeats an element, which saves the union."""

    def known(a: Column, b: Column) -> Column:
        if distinct:
            return F.element_at(F.transform(F.array(F.size(F.array_intersect(a, b))), lambda n: n / (F.size(a) + F.size(b) - n)), 1)
        # Both array functions drop repeated elements themselves.
        return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))

    return collection(known, lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)), True)


def cosine() -> Measure:
    """Of the numbers of occurrences of the elements."""

    def known(a: Column, b: Column) -> Column:
        n = lambda xs, x: F.size(F.filter(xs, lambda y: y == x)).cast("double")
        counts = F.transform(F.array_distinct(F.concat(a, b)), lambda x: F.struct(n(a, x).alias("l"), n(b, x).alias("r")))
        total = lambda f: F.aggregate(counts, F.lit(0.0), lambda t, c: t + f(c))
        return F.try_divide(total(lambda c: c["l"] * c["r"]), F.sqrt(total(lambda c: c["l"] * c["l"])) * F.sqrt(total(lambda c: c["r"] * c["r"])))

    def plain(a: list, b: list) -> Score:
        x, y = Counter(a), Counter(b)
        return sum(x[k] * y[k] for k in x) / (math.sqrt(sum(v * v for v in x.values())) * math.sqrt(sum(v * v for v in y.values())))

    return collection(known, plain, True)


def monge_elkan(measure: Measure, max_position_diff: int | None = None, compat: bool = False) -> Measure:
    """Mean over the left elements of the best score on the right, at most ``max_position_diff`` places away.

    ``compat`` leaves the last of these places out, as the original does. Measures that need Python run in one batched
    function over both arrays.
    """
    d = max_position_diff

    def window(i: int, n: int) -> range:
        return range(n) if d is None else range(max(0, i - d), min(n, i + d + (0 if compat else 1)))

    def plain(a: list, b: list) -> Score:
        if not len(a):  # a batched function sees all rows, also those that a guard decides
            return None
        return sum(max((s for j in window(i, len(b)) if (s := measure.score(x, b[j])) is not None), default=0.0) for i, x in enumerate(a)) / len(a)

    def known(a: Column, b: Column) -> Column:
        if needs_python(measure):
            return _pairwise(plain, "monge_elkan")(a, b)
        best = lambda x, near: F.coalesce(F.array_max(F.transform(near, lambda y: measure(x, y))), F.lit(0.0))
        if d is None:
            each = F.transform(a, lambda x: best(x, b))
        else:
            each = F.transform(a, lambda x, i: best(x, F.slice(b, F.greatest(i - d, F.lit(0)) + 1, F.greatest(i + d + (0 if compat else 1) - F.greatest(i - d, F.lit(0)), F.lit(0)))))
        return F.aggregate(each, F.lit(0.0), lambda t, s: t + s) / F.size(a)

    return collection(known, plain)


def position_wise(measure: Measure, compat: bool = False) -> Measure:
    return monge_elkan(measure, 0, compat)


def needs_python(measure: Measure) -> bool:
    """Whether an expression of the measure calls Python, which a lambda over an array cannot."""
    text = str(measure(F.col("a"), F.col("b"))._jc.toString()) if measure is not None else ""
    return any(x in text for x in ("jaro_winkler(", "similarity_score(", "monge_elkan(", "stable_matching(", "cologne(", "beider_morse(", "encoder("))


def stable_matching(measure: Measure) -> Measure:
    return matching_similarity("weak", measure)


def matching_similarity(matcher: str | matching.Matcher, measure: Measure) -> Measure:
    """Sum of the matched scores over the longer length; unknown scores make a pair unacceptable."""
    chosen = matching.MATCHERS[matcher] if isinstance(matcher, str) else matcher

    def plain(a: list, b: list) -> Score:
        if not len(a) or not len(b):
            return 1.0 if not len(a) and not len(b) else 0.0
        forth = [matching.Edge(x, y, s) for x in dict.fromkeys(a) for y in dict.fromkeys(b) if (s := measure.score(x, y)) is not None]
        if measure.symmetric:
            back = [e.reversed() for e in forth]
        else:
            back = [matching.Edge(y, x, s) for y in dict.fromkeys(b) for x in dict.fromkeys(a) if (s := measure.score(y, x)) is not None]
        return sum(e.weight for e in matching.match(forth, back, chosen)) / max(len(a), len(b))

    return Expression(_pairwise(plain, "stable_matching"), plain)


def scaled_difference(max_diff: float, unit: str | None = None) -> Measure:
    """1 - difference / max_diff, 0 at least: of numbers, or of dates and timestamps in whole ``unit``s."""

    def known(a: Column, b: Column) -> Column:
        diff = F.abs(a - b) if unit is None else F.abs(F.timestamp_diff(unit, a, b))
        return F.greatest(F.lit(0.0), 1 - diff / F.lit(float(max_diff)))

    def plain(a: Any, b: Any) -> Score:
        if unit is None:
            return max(0.0, 1 - abs(a - b) / max_diff)
        if unit.upper() != "DAY":
            raise TypeError("the Python form knows days only")
        return max(0.0, 1 - abs((b - a).days) / max_diff)

    return Expression(known, plain, True)


def unknown() -> Measure:
    return Expression(lambda a, b: F.lit(None).cast("double"), lambda a, b: None, True)


@dataclass(frozen=True)
class Aggregated(Measure):
    """Several measures of the same two values, combined by ``column`` (of a list of scores) and ``python``."""

    measures: tuple[Measure, ...]
    column: Callable[[list[Column]], Column]
    python: Callable[[list[Score]], Score]

    def __post_init__(self) -> None:
        if not self.measures:
            raise ValueError("at least one measure is needed")

    @property
    def symmetric(self) -> bool:
        return all(m.symmetric for m in self.measures)

    def known(self, left: Column, right: Column) -> Column:
        return self.column([m(left, right) for m in self.measures])

    def plain(self, left: Any, right: Any) -> Score:
        return self.python([m.score(left, right) for m in self.measures])

    def errors(self, left: Column, right: Column) -> list[Column]:
        return [e for m in self.measures for e in m.errors(left, right)]


def _known(scores: list[Score]) -> list[float]:
    return [s for s in scores if s is not None]


def aggregate(column: Callable[[list[Column]], Column], python: Callable[[list[Score]], Score], *measures: Measure) -> Measure:
    return Aggregated(measures, column, python)


def max_(*measures: Measure) -> Measure:
    return Aggregated(measures, lambda s: F.greatest(*s) if len(s) > 1 else s[0], lambda s: max(_known(s), default=None))


def min_(*measures: Measure, compat: bool = False) -> Measure:
    """The smallest known score. ``compat``: of the known scores before the first that is not positive."""

    def prefix(s: list[Column]) -> Column:
        start = F.struct(F.lit(False).alias("stop"), F.lit(None).cast("double").alias("least"))
        step = lambda t, x: F.struct((t["stop"] | (x <= 0)).alias("stop"), F.when(t["stop"] | (x <= 0), t["least"]).otherwise(F.least(t["least"], x)).alias("least"))
        return F.aggregate(F.filter(F.array(*s), lambda x: x.isNotNull()), start, step, lambda t: t["least"])

    def plain(s: list[Score]) -> Score:
        out = None
        for x in _known(s):
            if compat and x <= 0:
                break
            out = x if out is None else min(out, x)
        return out

    return Aggregated(measures, prefix if compat else (lambda s: F.least(*s) if len(s) > 1 else s[0]), plain)


def mean(*measures: Measure) -> Measure:
    def column(s: list[Column]) -> Column:
        total = sum((F.coalesce(x, F.lit(0.0)) for x in s), F.lit(0.0))
        return F.try_divide(total, sum((x.isNotNull().cast("int") for x in s), F.lit(0)))

    return Aggregated(measures, column, lambda s: sum(_known(s)) / len(_known(s)) if _known(s) else None)


def first(*measures: Measure) -> Measure:
    return Aggregated(measures, lambda s: F.coalesce(*s), lambda s: next(iter(_known(s)), None))


def last(*measures: Measure) -> Measure:
    return first(*reversed(measures))


@dataclass(frozen=True)
class Weighted(Measure):
    """Weighted measures of parts of two values; ``combine`` gets (weight, score) pairs in both forms."""

    parts: tuple[tuple[float, Measure], ...] = ()
    combine: Callable[[list[tuple[float, Column]]], Column] | None = None
    python: Callable[[list[tuple[float, float]]], Score] | None = None

    @property
    def symmetric(self) -> bool:
        return all(m.symmetric for _, m in self.parts)

    def add(self, weight: float, extract: Transform | str | Measure, measure: Measure | None = None) -> Weighted:
        part = extract if measure is None else measure.of(extract)
        return replace(self, parts=(*self.parts, (float(weight), part)))

    def known(self, left: Column, right: Column) -> Column:
        if not self.parts:
            raise ValueError("at least one measure is needed")
        scored = [(w, m(left, right)) for w, m in self.parts]
        if self.combine:
            return self.combine(scored)
        total = sum((F.coalesce(s * w, F.lit(0.0)) for w, s in scored), F.lit(0.0))
        return F.try_divide(total, sum((F.when(s.isNotNull(), w).otherwise(0.0) for w, s in scored), F.lit(0.0)))

    def plain(self, left: Any, right: Any) -> Score:
        scored = [(w, s) for w, m in self.parts if (s := m.score(left, right)) is not None]
        if self.python:
            return self.python(scored)
        return sum(w * s for w, s in scored) / sum(w for w, _ in scored) if scored else None

    def errors(self, left: Column, right: Column) -> list[Column]:
        return [e for _, m in self.parts for e in m.errors(left, right)]


def weighted_average() -> Weighted:
    return Weighted()


def weighted_aggregation(combine: Callable, python: Callable | None = None) -> Weighted:
    return Weighted((), combine, python)


def with_similarity(pairs: DataFrame, measure: Measure, left: str, right: str, out: str = "similarity", cache: bool = False) -> DataFrame:
    """``pairs`` with a score column. ``cache`` scores each distinct pair of values once and joins back, for dear measures."""
    if out in pairs.columns:
        raise ValueError(f"there is a column {out} already")
    if not cache:
        return pairs.withColumn(out, measure(F.col(left), F.col(right)))
    swap = (F.col(left) > F.col(right)) if measure.symmetric else F.lit(False)
    a, b = F.when(swap, F.col(right)).otherwise(F.col(left)), F.when(swap, F.col(left)).otherwise(F.col(right))
    keyed = pairs.withColumns({"_l": a, "_r": b})
    scored = keyed.select("_l", "_r").where("_l is not null and _r is not null").distinct().withColumn(out, measure(F.col("_l"), F.col("_r")))
    return keyed.join(scored, ["_l", "_r"], "left").drop("_l", "_r")
