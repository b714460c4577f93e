"""Running aggregates that never gather a whole group in one task.

A plain ``Window.partitionBy(key).orderBy(seq)`` sends every row of a key to one
task, which breaks when one key holds a third of the data. Here the key is cut
into slices of the order column (``seq div width``): slice totals are combined
by an ordinary aggregate, running totals over slices give each slice its
carry-in, and only rows of one slice share a window. ``seq`` is unique within a
key, so a slice has at most ``width`` rows however skewed the keys are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import broadcast_within

SLICE_WIDTH = 1 << 20

_FOLD = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count}


def _combine(kind: str, carry: Column, local: Column) -> Column:
    if kind in ("sum", "count"):
        zero = F.lit(0)
        return F.coalesce(carry, zero) + F.coalesce(local, zero)
    pick = F.least if kind == "min" else F.greatest
    return F.when(carry.isNull(), local).when(local.isNull(), carry).otherwise(pick(carry, local))


def slice_of(order: str, width: int = SLICE_WIDTH) -> Column:
    return F.floor(F.col(order) / F.lit(width)).cast("long")


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    aggs: Mapping[str, tuple[str, Column]],
    inclusive: bool = True,
    width: int = SLICE_WIDTH,
) -> DataFrame:
    """Append running aggregates over ``order`` within ``keys``.

    ``aggs`` maps an output name to ``(kind, column)`` with kind one of sum,
    count, min, max. With ``inclusive=False`` a row sees only earlier rows.
    """
    keys = list(keys)
    base = df.withColumn("_slice", slice_of(order, width))
    for name, (_, column) in aggs.items():
        base = base.withColumn(f"_in_{name}", column)

    totals = base.groupBy(*keys, "_slice").agg(
        *[(_FOLD[kind](F.col(f"_in_{name}"))).alias(f"_t_{name}") for name, (kind, _) in aggs.items()]
    )
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    fold_total = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
    carried = totals.select(
        *keys,
        "_slice",
        *[fold_total[kind](f"_t_{name}").over(before).alias(f"_c_{name}") for name, (kind, _) in aggs.items()],
    )

    within = W.partitionBy(*keys, "_slice").orderBy(order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    left = base.alias("l")
    right = carried.alias("r")
    match = F.col("l._slice") == F.col("r._slice")
    for k in keys:
        match = match & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    joined = left.join(right, match).select("l.*", *[f"r._c_{name}" for name in aggs])
    out = joined
    for name, (kind, _) in aggs.items():
        out = out.withColumn(f"_w_{name}", _FOLD[kind](F.col(f"_in_{name}")).over(within))
    return out.select(
        *[F.col(c) for c in df.columns],
        *[
            _combine(kind, F.col(f"_c_{name}"), F.col(f"_w_{name}")).alias(name)
            for name, (kind, _) in aggs.items()
        ],
    )


def rank_in_order(df: DataFrame, keys: Sequence[str], order: str, name: str, width: int = SLICE_WIDTH) -> DataFrame:
    """Distributed ``row_number`` over a unique integer order column."""
    return running(df, keys, order, {name: ("count", F.lit(1))}, width=width)


def newest(df: DataFrame, keys: Sequence[str], order: str, limit: Column, width: int = SLICE_WIDTH) -> DataFrame:
    """Last ``limit`` rows per key, exactly, without sorting whole keys.

    Slice counts from the newest end show which slices can hold the wanted
    rows; only those are read for the final ranking. ``limit`` may differ by
    key and must be a column of ``df`` constant within a key.
    """
    keys = list(keys)
    base = df.withColumn("_slice", slice_of(order, width)).withColumn("_limit", limit.cast("long"))
    counts = base.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"), F.max("_limit").alias("_lim"))
    later = W.partitionBy(*keys).orderBy(F.desc("_slice")).rowsBetween(W.unboundedPreceding, -1)
    wanted = (
        counts.withColumn("_newer", F.coalesce(F.sum("_n").over(later), F.lit(0)))
        .where(F.col("_newer") < F.col("_lim"))
        .select(*keys, "_slice", "_newer")
    )
    # Few slices are wanted, so the rows are filtered where they are read.
    ranked = base.join(broadcast_within(wanted), [*keys, "_slice"]).withColumn(
        "_back",
        F.col("_newer") + F.row_number().over(W.partitionBy(*keys, "_slice").orderBy(F.desc(order))),
    )
    return ranked.where(F.col("_back") <= F.col("_limit")).select(*df.columns)
