"""Bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SCALE = 1 << 30


def remainder(column: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


def sample_by_label(rows: DataFrame, label: str, key: str, most: int | dict) -> DataFrame:
    """About ``most`` rows of each label, chosen by a hash of ``key``; all of them where there are fewer."""
    counts = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return rows.limit(0)
    keep = F.lit(0)
    for value, n in counts.items():
        bound = most[value] if isinstance(most, dict) else most
        keep = F.when(F.col(label) == F.lit(value), F.lit(min(_SCALE, int(_SCALE * bound / n)))).otherwise(keep)
    return rows.filter(F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(_SCALE)) < keep)
