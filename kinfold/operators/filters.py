"""Bloom filters of a fixed largest size as broadcast tables, so that rows of large tables are parted before they move."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.plans.runtime import cut_lineage

#: Rows of a filter at most: 16 bytes each, whatever the number of keys. Beyond some ten million keys most rows pass, which costs time but no row.
SLOTS = 1 << 19


def _slot(columns: Sequence[str | Column]) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SLOTS)).cast("int")


def _mask(columns: Sequence[str | Column]) -> Column:
    h = F.xxhash64(*columns, F.lit("bits"))
    bit = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, n).bitwiseAND(63).cast("int"))
    return bit(0).bitwiseOR(bit(6)).bitwiseOR(bit(12))


def key_filter(keys: DataFrame, columns: Sequence[str | Column], rows: int | None = None) -> DataFrame:
    """(slot, bits) of all keys, computed once; no keys give an empty table. ``rows``: about how many keys there are at most, if known."""
    return cut_lineage(keys.select(_slot(columns).alias("slot"), _mask(columns).alias("bits")).groupBy("slot").agg(F.bit_or("bits").alias("bits")), rows)


def with_membership(df: DataFrame, held: DataFrame, columns: Sequence[str | Column], out: str) -> DataFrame:
    """``df`` with a boolean column ``out``: false only if the row's key is none of those of ``held``.

    The columns must have the types that the keys had. A column that is called like ``out`` is replaced. Nothing is
    shuffled; null keys are keys like any other.
    """
    base = df.drop(out)
    side = held.select(F.col("slot").alias("_slot_of_filter"), F.col("bits").alias("_bits_of_filter"))
    joined = base.join(F.broadcast(side), _slot(columns) == F.col("_slot_of_filter"), "left")
    inside = F.coalesce(F.col("_bits_of_filter").bitwiseAND(_mask(columns)) == _mask(columns), F.lit(False))
    return joined.withColumn(out, inside).drop("_slot_of_filter", "_bits_of_filter")
