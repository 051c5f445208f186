import pytest
from pyspark.sql import functions as F

from kinfold.functions import measures as m
from kinfold.functions import transforms as t
from kinfold.operators import classify as c


@pytest.fixture
def pairs(spark):
    rows = [(1, 2, 0.95, "a"), (1, 3, 0.9, "a"), (1, 4, 0.1, "b"), (1, 5, None, "b"), (1, 6, 1.0, None)]
    df = spark.createDataFrame(rows, "left_id long, right_id long, s double, g string")
    return df.select("left_id", "right_id", F.struct("s", "g").alias("left"), F.struct("s", "g").alias("right"))


score = m.Expression(lambda a, b: a["s"])


def results(df):
    return {r.right_id: (r.result.classification, None if r.result.confidence is None else round(r.result.confidence, 6), r.result.explanation) for r in df.collect()}


def test_rules(pairs):
    got = results(c.RuleBasedClassifier().default_rule(score, 0.9).classify(pairs))
    assert got == {2: ("DUPLICATE", 0.5, "default"), 3: ("DUPLICATE", 0.0, "default"), 4: ("NON_DUPLICATE", round(0.8 / 0.9, 6), "default"), 5: ("UNKNOWN", 0.0, "no rule"), 6: ("DUPLICATE", 1.0, "default")}
    assert results(c.RuleBasedClassifier(compat=True).default_rule(score, 0.9).classify(pairs))[3] == ("NON_DUPLICATE", 0.0, "default")
    assert results(c.RuleBasedClassifier().default_rule(score, 1.0).classify(pairs))[6] == ("DUPLICATE", 1.0, "default")
    rules = c.RuleBasedClassifier().negative_rule("g", m.Expression(lambda a, b: F.lit(0.7)), lambda a, b: a["g"] == "b").positive_rule("s", score.cutoff(0.95)).default_result(c.POSSIBLE_DUPLICATE, 0.2, "perhaps")
    got = results(rules.classify(pairs))
    assert got[4] == got[5] == ("NON_DUPLICATE", 0.7, "g") and got[2][0] == "DUPLICATE" and got[3] == ("POSSIBLE_DUPLICATE", 0.2, "perhaps")
    signed = results(c.RuleBasedClassifier().rule("r", m.Expression(lambda a, b: a["s"] - 0.5)).classify(pairs))
    assert signed[4][:2] == ("NON_DUPLICATE", 0.4) and signed[5][0] == "UNKNOWN"


def test_possible_duplicates(pairs):
    found = c.RuleBasedClassifier().positive_rule("s", score.cutoff(0.95)).default_result(c.POSSIBLE_DUPLICATE).classify(pairs)
    for handler, want in ((c.keep, "POSSIBLE_DUPLICATE"), (c.promote_to_duplicate, "DUPLICATE"), (c.demote_to_non_duplicate, "NON_DUPLICATE"), (c.to_unknown, "UNKNOWN")):
        got = results(c.handle_possible(found, handler))
        assert got[3][0] == want and got[2][0] == "DUPLICATE"
    r = F.col("result.classification")
    assert found.where(c.is_ambiguous(r)).count() == 3 and found.where(c.is_unknown(r)).count() == 0


def test_errors(spark):
    df = spark.createDataFrame([(1, 2, ("Müller",), ("Muller",)), (1, 3, ("Muller",), ("Muller",))], "left_id long, right_id long, left struct<n:string>, right struct<n:string>")
    rules = c.RuleBasedClassifier().default_rule(m.equality().of(t.soundex()).of("n"), 0.5)
    got = {r.right_id: (r.result.classification, len(r.errors)) for r in rules.classify(df).collect()}
    assert got == {2: ("UNKNOWN", 1), 3: ("DUPLICATE", 0)}
    from dataclasses import replace

    with pytest.raises(Exception, match="not mapped"):
        replace(rules, strict=True).classify(df).collect()


def test_oracle(spark, pairs):
    gold = spark.createDataFrame([(2, 1), (9, 8)], "left_id long, right_id long")
    got = results(c.OracleClassifier(gold).classify(pairs))
    assert got[2] == ("DUPLICATE", 1.0, "gold") and {v[0] for k, v in got.items() if k != 2} == {"NON_DUPLICATE"}
