"""Bounded, documented samples for the trained operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STEPS = 1 << 30


def held_out(key: str, modulus: int, remainder: int) -> Column:
    """crc32 of the key as text modulo ``modulus`` is ``remainder``; a null key is held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % modulus == remainder, F.lit(True))


def sample_classes(df: DataFrame, label: str, key: str, per_class: int) -> tuple[DataFrame, dict]:
    """About ``per_class`` rows of each label (all, if fewer), chosen by a hash of ``key``, and the number of rows of each.

    One number a label comes to the driver.
    """
    n = {r[0]: r[1] for r in df.where(F.col(label).isNotNull()).groupBy(label).count().orderBy(label).collect()}
    if not n:
        return df.limit(0), n
    share = F.create_map(*[F.lit(x) for k, v in n.items() for x in (k, min(_STEPS, int(_STEPS * per_class / v) + 1))])
    drawn = F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(_STEPS)) < share[F.col(label)]
    return df.where(F.col(label).isNotNull() & drawn), n
