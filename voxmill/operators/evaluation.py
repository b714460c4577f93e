"""Joining results with the truth, and the metrics over the pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.coercion import ratio, to_number
from ..session import broadcast_within
from .routing import with_scopes

GROUP = ("scope", "target")


def truth_of(records: DataFrame, targets: DataFrame) -> DataFrame:
    """(scope, target, recordID, actual, ts) of records that carry the target."""
    routed = with_scopes(records).join(broadcast_within(targets.select("scope", "target").distinct()), "scope")
    actual = F.trim(F.try_element_at("fields", F.col("target")))
    return routed.select("scope", "target", "recordID", actual.alias("actual"), "ts").where("actual IS NOT NULL AND actual <> ''")


def interval_pairs(truth: DataFrame, results: DataFrame, hours: int = 24) -> DataFrame:
    """Truth and prediction of a record at most ``hours`` apart.

    ``truth`` has ``ts`` and ``results`` has ``pts``. Works on batch frames and
    on two watermarked streams alike.
    """
    span = F.expr(f"INTERVAL {int(hours)} HOURS")
    t, p = truth.alias("t"), results.alias("p")
    keys = [c for c in GROUP if c in truth.columns and c in results.columns]
    match = (F.col("t.recordID") == F.col("p.recordID")) & (F.col("p.pts") >= F.col("t.ts") - span) & (
        F.col("p.pts") <= F.col("t.ts") + span
    )
    for c in keys:
        match = match & (F.col(f"t.{c}") == F.col(f"p.{c}"))
    return t.join(p, match).select(
        *[f"t.{c}" for c in keys], "t.recordID", "t.actual", "p.predicted", "t.ts", "p.pts"
    )


def confusion(pairs: DataFrame, group: tuple[str, ...] = GROUP) -> DataFrame:
    """Counts per (actual, predicted); additive over batches."""
    return pairs.groupBy(*group, "actual", "predicted").agg(F.count(F.lit(1)).alias("n"))


def accuracy(matrix: DataFrame, group: tuple[str, ...] = GROUP) -> DataFrame:
    hit = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0))
    return matrix.groupBy(*group).agg(
        F.sum("n").alias("samples"), hit.alias("correct"), ratio(hit, F.sum("n")).alias("accuracy")
    )


def class_scores(matrix: DataFrame, group: tuple[str, ...] = GROUP) -> DataFrame:
    """Per class tp, fn, fp, tn, precision, recall, F1.

    Each cell contributes to its row class and its column class, so one
    aggregate over the exploded matrix covers classes seen on either side.
    """
    hit = F.col("actual") == F.col("predicted")
    sides = F.when(hit, F.array(F.struct(F.col("actual").alias("label"), F.col("n").alias("tp"), F.lit(0).cast("long").alias("fn"), F.lit(0).cast("long").alias("fp")))).otherwise(
        F.array(
            F.struct(F.col("actual").alias("label"), F.lit(0).cast("long").alias("tp"), F.col("n").alias("fn"), F.lit(0).cast("long").alias("fp")),
            F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fn"), F.col("n").alias("fp")),
        )
    )
    cells = matrix.select(*group, F.explode(sides).alias("s")).select(*group, "s.*")
    per = cells.groupBy(*group, "label").agg(*[F.sum(c).alias(c) for c in ("tp", "fn", "fp")])
    totals = matrix.groupBy(*group).agg(F.sum("n").alias("_all"))
    scored = per.join(totals, list(group))
    precision = ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return scored.select(
        *group, "label", "tp", "fn", "fp", (F.col("_all") - F.col("tp") - F.col("fn") - F.col("fp")).alias("tn"),
        precision.alias("precision"), recall.alias("recall"),
        ratio(2 * precision * recall, precision + recall).alias("f1"),
    )


def f1_summary(scores: DataFrame, group: tuple[str, ...] = GROUP) -> DataFrame:
    """Macro and micro F1 from the class scores."""
    sums = scores.groupBy(*group).agg(
        F.avg("f1").alias("macro_f1"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn")
    )
    p = ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    r = ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return sums.select(*group, "macro_f1", ratio(2 * p * r, p + r).alias("micro_f1"))


def classification_report(matrix: DataFrame, group: tuple[str, ...] = GROUP) -> DataFrame:
    return accuracy(matrix, group).join(f1_summary(class_scores(matrix, group), group), list(group))


def regression_sums(pairs: DataFrame, group: tuple[str, ...] = GROUP) -> DataFrame:
    """Additive counters n, sum|e|, sum e^2; pairs with a missing side drop out."""
    e = to_number(F.col("actual").cast("string")) - to_number(F.col("predicted").cast("string"))
    return (
        pairs.withColumn("_e", e).where("_e IS NOT NULL").groupBy(*group)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.abs("_e")).alias("sum_abs"), F.sum(F.col("_e") * F.col("_e")).alias("sum_sq"))
    )


def regression_report(sums: DataFrame, group: tuple[str, ...] = GROUP) -> DataFrame:
    mse = ratio(F.col("sum_sq"), F.col("n"))
    return sums.select(*group, "n", ratio(F.col("sum_abs"), F.col("n")).alias("mae"), mse.alias("mse"), F.sqrt(mse).alias("rmse"))


def merge_counters(parts: DataFrame, group: tuple[str, ...], counters: tuple[str, ...]) -> DataFrame:
    """Running metrics: the sum of per-batch counters."""
    return parts.groupBy(*group).agg(*[F.sum(c).alias(c) for c in counters])
