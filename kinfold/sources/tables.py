"""Sources and sinks: delimited person files, upsert stores, prefixes of arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.operators.clustering import last_versions

PERSON_FIELDS = ("id", "title", "firstname_standard", "firstname_full", "lastname", "birthdate", "gender", "salutation", "language", "currency", "photo_url", "card_id")


def read_delimited(spark: SparkSession, path: str, names: Iterable[str], sep: str = "\t") -> DataFrame:
    """Text with a header and quoted fields, all columns as strings under an explicit schema."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.option("sep", sep).option("header", True).option("quote", '"').option("encoding", "UTF-8").option("enforceSchema", False).schema(schema).csv(path)


def read_persons(spark: SparkSession, path: str, source: str | None = None) -> DataFrame:
    """Records (id, firstName, lastName, birthDate, gender, source, originalId, lastModified, fusedIds); two-digit years are of this century."""
    rows = read_delimited(spark, path, PERSON_FIELDS)
    return rows.select(
        "id",
        F.col("firstname_full").alias("firstName"),
        F.col("lastname").alias("lastName"),
        F.to_date("birthdate", "dd.MM.yy").alias("birthDate"),
        F.upper("gender").alias("gender"),
        F.lit(source).cast("string").alias("source"),
        F.lit(None).cast("string").alias("originalId"),
        F.lit(None).cast("timestamp_ntz").alias("lastModified"),
        F.array().cast("array<string>").alias("fusedIds"),
    )


def records(spark: SparkSession, rows: Iterable, schema: str) -> DataFrame:
    """In-memory rows under an explicit schema."""
    return spark.createDataFrame(list(rows), schema)


def latest_by_key(changes: DataFrame, key: str, version: str) -> DataFrame:
    """What a key-value sink holds after all rows were upserted in order of ``version``."""
    return last_versions(changes, key, version)


def upsert(spark: SparkSession, path: str, changes: DataFrame, key: str, version: int) -> DataFrame:
    """Write the next version of a table under ``path``: rows of ``changes`` replace those of their keys. A version that exists is left alone, so a repeated batch changes nothing."""
    before = read_version(spark, path)
    if before is not None and before[0] >= version:
        return before[1]
    rows = changes if before is None else changes.unionByName(before[1].join(changes.select(key).distinct(), key, "left_anti"))
    rows.write.mode("overwrite").parquet(f"{path}/version={version:012d}")
    return spark.read.parquet(f"{path}/version={version:012d}")


def read_version(spark: SparkSession, path: str) -> tuple[int, DataFrame] | None:
    """(number, table) of the newest complete version, seen through the file system of the path."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    names = sorted(x.getPath().getName() for x in fs.listStatus(p))
    done = [n for n in names if n.startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return (int(done[-1].split("=")[1]), spark.read.parquet(f"{path}/{done[-1]}")) if done else None


def take_while_inclusive(array: Column, test: Callable[[Column], Column]) -> Column:
    """The elements before the first that fails ``test``, and that one."""
    fails = F.array_position(F.transform(array, lambda x: F.coalesce(test(x), F.lit(False))), False)
    return F.when(fails > 0, F.slice(array, F.lit(1), fails.cast("int"))).otherwise(array)


def take_while_inclusive_iter(items: Iterable, test: Callable[[object], bool]) -> Iterator:
    for x in items:
        yield x
        if not test(x):
            return
