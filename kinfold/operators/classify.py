"""Classification of candidate pairs by ordered rules over similarity measures."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions.measures import Measure

DUPLICATE, POSSIBLE_DUPLICATE, NON_DUPLICATE, UNKNOWN = "DUPLICATE", "POSSIBLE_DUPLICATE", "NON_DUPLICATE", "UNKNOWN"
RESULT = "struct<classification:string,confidence:double,explanation:string>"

Condition = Callable[[Column, Column], Column]


def result(classification: str | Column, confidence: float | Column, explanation: str | Column) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(classification).alias("classification"), lit(confidence).cast("double").alias("confidence"), lit(explanation).alias("explanation"))


def is_ambiguous(c: Column) -> Column:
    return c.isin(POSSIBLE_DUPLICATE, UNKNOWN)


def is_unknown(c: Column) -> Column:
    return c == UNKNOWN


@dataclass(frozen=True)
class Rule:
    """``kind``: signed (score <= 0 is NON_DUPLICATE), positive, negative or threshold; unknown scores pass on to the next rule."""

    name: str
    measure: Measure
    kind: str = "signed"
    threshold: float | None = None
    condition: Condition | None = None

    def score(self, left: Column, right: Column) -> Column:
        s = self.measure(left, right)
        return s if self.condition is None else F.when(self.condition(left, right), s)

    def outcome(self, s: Column, compat: bool = False) -> Column:
        if self.kind == "positive":
            return F.when(s > 0, result(DUPLICATE, s, self.name))
        if self.kind == "negative":
            return F.when(s > 0, result(NON_DUPLICATE, s, self.name))
        if self.kind == "threshold":
            t = self.threshold
            if compat:
                s = F.when(s >= t, F.try_divide(s - t, F.lit(1.0 - t))).when(s < t, -F.try_divide(t - s, F.lit(float(t))))
            else:
                above = F.lit(1.0) if t == 1 else F.try_divide(s - t, F.lit(1.0 - t))
                return F.when(s >= t, result(DUPLICATE, above, self.name)).when(s < t, result(NON_DUPLICATE, F.try_divide(t - s, F.lit(float(t))), self.name))
        return F.when(s <= 0, result(NON_DUPLICATE, -s, self.name)).when(s > 0, result(DUPLICATE, s, self.name))


@dataclass(frozen=True)
class RuleBasedClassifier:
    """The first rule that applies decides; else the default result.

    A threshold rule gives DUPLICATE from the threshold on (``compat``: beyond it, as the original does). ``errors``
    lists values that a rule's transformations refuse; ``strict`` raises on them.
    """

    rules: tuple[Rule, ...] = ()
    default: tuple[str, float, str] = (UNKNOWN, 0.0, "no rule")
    compat: bool = False
    strict: bool = False

    def _with(self, *args, **kwargs) -> RuleBasedClassifier:
        return replace(self, rules=(*self.rules, Rule(*args, **kwargs)))

    def rule(self, name: str, measure: Measure, condition: Condition | None = None) -> RuleBasedClassifier:
        return self._with(name, measure, "signed", None, condition)

    def positive_rule(self, name: str, measure: Measure, condition: Condition | None = None) -> RuleBasedClassifier:
        return self._with(name, measure, "positive", None, condition)

    def negative_rule(self, name: str, measure: Measure, condition: Condition | None = None) -> RuleBasedClassifier:
        return self._with(name, measure, "negative", None, condition)

    def threshold_rule(self, name: str, measure: Measure, threshold: float, condition: Condition | None = None) -> RuleBasedClassifier:
        return self._with(name, measure, "threshold", threshold, condition)

    def default_rule(self, measure: Measure, threshold: float) -> RuleBasedClassifier:
        return self.threshold_rule("default", measure, threshold)

    def default_result(self, classification: str, confidence: float = 0.0, explanation: str = "no rule") -> RuleBasedClassifier:
        return replace(self, default=(classification, confidence, explanation))

    def column(self, left: Column, right: Column, scores: list[Column] | None = None) -> Column:
        scores = [r.score(left, right) for r in self.rules] if scores is None else scores
        decided = F.coalesce(*[r.outcome(s, self.compat) for r, s in zip(self.rules, scores, strict=True)], result(*self.default))
        if self.strict:
            errors = self.errors(left, right)
            return F.when(F.size(errors) > 0, F.raise_error(F.array_join(errors, "; ")).cast(RESULT)).otherwise(decided)
        return decided

    def errors(self, left: Column, right: Column) -> Column:
        found = [e for r in self.rules for e in r.measure.errors(left, right)]
        return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")

    def classify(self, pairs: DataFrame, left: str = "left", right: str = "right") -> DataFrame:
        """``pairs`` with the columns ``result`` and ``errors``. Scores are columns first, so each is computed once."""
        a, b = F.col(left), F.col(right)
        names = [f"_score{i}" for i in range(len(self.rules))]
        scored = pairs.withColumns({n: r.score(a, b) for n, r in zip(names, self.rules, strict=True)}) if names else pairs
        return scored.withColumn("result", self.column(a, b, [F.col(n) for n in names])).withColumn("errors", self.errors(a, b)).drop(*names)


@dataclass(frozen=True)
class OracleClassifier:
    """Pairs of a gold table (``left_id``, ``right_id``, either way round) are duplicates, all others are not."""

    gold: DataFrame

    def classify(self, pairs: DataFrame) -> DataFrame:
        g = self.gold.select("left_id", "right_id")
        both = g.union(g.select("right_id", "left_id")).distinct().withColumn("_gold", F.lit(True))
        known = pairs.join(both, ["left_id", "right_id"], "left")
        return known.withColumn("result", F.when(F.col("_gold"), result(DUPLICATE, 1.0, "gold")).otherwise(result(NON_DUPLICATE, 1.0, "gold"))).withColumn("errors", F.array().cast("array<string>")).drop("_gold")


Handler = Callable[[Column], Column]


def keep(r: Column) -> Column:
    return r


def promote_to_duplicate(r: Column) -> Column:
    return result(DUPLICATE, 0.0, "possible duplicate promoted to duplicate")


def demote_to_non_duplicate(r: Column) -> Column:
    return result(NON_DUPLICATE, 0.0, "possible duplicate demoted to non-duplicate")


def to_unknown(r: Column) -> Column:
    return result(UNKNOWN, 0.0, "possible duplicate is unknown")


def handle_possible(classified: DataFrame, handler: Handler = keep) -> DataFrame:
    """Replace the results that are POSSIBLE_DUPLICATE, and only those."""
    r = F.col("result")
    return classified.withColumn("result", F.when(r["classification"] == POSSIBLE_DUPLICATE, handler(r)).otherwise(r))
