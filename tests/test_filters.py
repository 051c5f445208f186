from pyspark.sql import functions as F

from kinfold.operators.filters import key_filter, with_membership


def test_no_key_is_missed_and_few_others_pass(spark):
    keys = spark.range(0, 20_000, 2).select("id", F.when(F.col("id") % 10 > 0, F.col("id").cast("string")).alias("s"))
    held = key_filter(keys, ["id", "s"])
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 10 > 0, F.col("id").cast("string")).alias("s"), F.lit(1).alias("slot"), F.lit(2).alias("inside"))
    got = with_membership(rows, held, ["id", "s"], "inside")
    assert got.columns == rows.columns
    assert got.where("id % 2 = 0 and not inside").count() == 0 and got.where("id % 2 = 1 and inside").count() < 300
    assert with_membership(rows, key_filter(keys.limit(0), ["id", "s"]), ["id", "s"], "inside").where("inside").count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
