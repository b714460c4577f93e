"""Ranges of a numeric column with about equal numbers of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cuts_of(df: DataFrame, column: str, parts: int, most: int = 16_383) -> list[int]:
    """Sorted boundaries of at most ``parts`` ranges; fewer where values repeat. Nulls are left out."""
    parts = min(most, parts)
    if parts < 2:
        return []
    found = df.agg(F.percentile_approx(column, [k / parts for k in range(1, parts)], 10 * parts)).first()[0]
    return sorted(set(found or []))


def place_of(cuts: list[int], value: Column) -> Column:
    """Number of cuts below ``value``, by binary search."""
    if not cuts:
        return F.lit(0)
    listed = F.expr(f"array({', '.join(f'{c}L' for c in cuts)})")

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        left, going = listed[middle] >= value, s["lo"] < s["hi"]
        return F.struct(F.when(going & ~left, middle + 1).otherwise(s["lo"]).alias("lo"), F.when(going & left, middle).otherwise(s["hi"]).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(cuts).bit_length())), start, halve, lambda s: s["lo"])
