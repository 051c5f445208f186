"""Keys that end in long texts: what ranking them sends to the driver."""

from pyspark.sql import functions as F

from kinfold.operators import candidates as c


def sent(spark):
    """Bytes of all task results up to now."""
    sc, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm
    sc.listenerBus().waitUntilEmpty(30_000)
    none = spark.sparkContext._gateway.new_array(jvm.double, 0)
    return sum(s.resultSize() for s in jvm.scala.jdk.javaapi.CollectionConverters.asJava(sc.statusStore().stageList(None, False, False, none, jvm.java.util.ArrayList())))


def test_ranges_of_long_texts_are_chosen_by_few(spark, monkeypatch):
    """All 400 texts of 20,000 characters went to the driver, 8 MB."""
    monkeypatch.setattr(c, "CHARS_A_PART", 4_000_000, raising=False)
    key = "spark.sql.execution.rangeExchange.sampleSizePerPartition"
    text = F.concat(F.repeat(F.lit("same"), 20), F.sha2(F.col("id").cast("string"), 256), F.repeat(F.sha2(F.col("id").cast("string"), 512), 155))
    df = spark.range(0, 400, 1, 8).select("id", F.struct(text.alias("k0")).alias("key"))
    want = [r.id for r in df.orderBy("key.k0").select("id").collect()]
    before, was = sent(spark), spark.conf.get(key)
    ranked = c.key_rank(df).select("id", "rank")
    assert [r.id for r in ranked.orderBy("rank").collect()] == want
    assert sent(spark) - before < 3_500_000
    assert spark.conf.get(key) == was
