"""Session helpers shared by all operators: reliable lineage cuts and table access."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows that a task and a file get at least where a table's size is known.
ROWS_A_FILE = 1 << 14
#: The same where a task does nothing but write.
ROWS_WRITTEN = 1 << 17
#: Estimated bytes of a table beyond which the estimate tells nothing.
MOST_BYTES = 1 << 62


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset (tests, laptops)
    a temporary folder of this machine is used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if named:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(named)
    elif not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="kinfold-checkpoint-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame, rows: int | None = None, after: bool = False) -> DataFrame:
    """Compute ``df`` once and keep it in the checkpoint folder, so that a lost executor costs no recomputation of its past.

    ``rows``: about how many its last stage reads and makes at most, if that is known. A small table then goes into few files: each costs
    a request, and on a local file system processes that the executor starts. Large tables keep all their partitions.
    ``after``: ``rows`` is only what the last stage makes at most. It keeps its tasks, and the few rows move into few files.

    A checkpoint keeps the size that was estimated for its plan, and of a join that is the product of both sides. Where loops join
    checkpoints again and again, its digits double each time, until they fill the driver's memory; such a size is forgotten.
    """
    ensure_checkpoint_dir(df.sparkSession)
    if rows is not None:
        files = max(1, -(-rows // (ROWS_WRITTEN if after else ROWS_A_FILE)))
        if not after:
            df = df.coalesce(files)
        elif files < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
            df = df.repartition(files)
    return without_huge_estimate(df.checkpoint(eager=True))


def estimated_bytes(df: DataFrame) -> int:
    """The size that the optimizer takes ``df`` to have."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def without_huge_estimate(kept: DataFrame) -> DataFrame:
    """A checkpoint as it is, or without its estimated size if that is beyond ``MOST_BYTES``."""
    if estimated_bytes(kept) < MOST_BYTES:
        return kept
    spark, plan = kept.sparkSession, kept._jdf.queryExecution()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(plan.toRdd(), kept._jdf.schema(), False), spark)


@contextmanager
def setting(spark: SparkSession, key: str, value: object | None) -> Iterator[None]:
    """The session's setting ``key`` is ``value`` inside, and what it was afterwards; None changes nothing."""
    was = spark.conf.get(key, None)
    if value is not None:
        spark.conf.set(key, str(value))
    try:
        yield
    finally:
        if value is not None:
            spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def delete(spark: SparkSession, path: str) -> None:
    """Remove a table's files, through the file system of the path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def fresh(df: DataFrame) -> DataFrame:
    """``df`` with new column identities, for joins and cogroups of tables that come from one."""
    return df.toDF(*df.columns)
