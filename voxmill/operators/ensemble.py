"""Combining partial predictions: dedupe, completeness, vote, mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coercion import to_number
from ..session import broadcast_within
from .control import ensemble_gate

RECORD = ("scope", "target", "recordID")


def usable(partials: DataFrame) -> DataFrame:
    return partials.where("algorithmType IS NOT NULL AND hyperParams IS NOT NULL")


def _hash() -> Column:
    """Hash of a record, to lead its keys: rows are sorted by one number, texts are compared only where it is equal."""
    return F.xxhash64(*RECORD).alias("_record")


def first_per_model(partials: DataFrame) -> DataFrame:
    """First partial of each model for a record; copies combine map-side."""
    return usable(partials).groupBy(_hash(), *RECORD, "model_id").agg(
        F.min_by(
            F.struct("algorithmType", "hyperParams", "prediction", "seq"),
            F.struct("seq", "prediction"),
        ).alias("p")
    ).select(*RECORD, "model_id", "p.*")


def required(active: DataFrame, minimum: int = 2) -> DataFrame:
    """Model rows that must answer, with the count and task of their ensemble."""
    members = active.select("scope", "target", "model_id")
    return members.join(ensemble_gate(active, minimum), ["scope", "target"])


def _answers(partials: DataFrame, active: DataFrame, minimum: int) -> DataFrame:
    needed = broadcast_within(required(active, minimum))
    return partials.join(needed, ["scope", "target", "model_id"])


def majority(prediction: Column) -> Column:
    """Most frequent non-null text; ties go to the smallest."""
    return F.mode(prediction, True)


def mean_text(prediction: Column) -> Column:
    """Mean of the parsable texts as text, ``NaN`` when there is none."""
    return F.coalesce(F.avg(to_number(prediction)), F.lit(float("nan"))).cast("string")


def combine(partials: DataFrame, active: DataFrame, minimum: int = 2, deduplicated: bool = False) -> DataFrame:
    """Ensemble results of complete records.

    A record is complete when every active model of its (scope, target) has
    answered; partials of other models are ignored. Task type decides between
    vote and mean.
    """
    firsts = usable(partials) if deduplicated else first_per_model(partials)
    entry = F.struct("algorithmType", "prediction", "hyperParams")
    grouped = _answers(firsts, active, minimum).groupBy(_hash(), *RECORD).agg(
        F.count(F.lit(1)).alias("_n"),
        F.first("n_models").alias("_needed"),
        F.first("task_type").alias("_task"),
        majority(F.col("prediction")).alias("_vote"),
        mean_text(F.when(F.col("task_type") == "regression", F.col("prediction"))).alias("_mean"),
        F.sort_array(F.collect_list(entry)).alias("partialPredictions"),
        F.max("seq").alias("seq"),
    )
    final = F.when(F.col("_task") == "regression", F.col("_mean")).otherwise(F.col("_vote"))
    return grouped.where("_n = _needed").select(
        "scope", "target", F.col("recordID").alias("recordId"), final.alias("finalPrediction"),
        "partialPredictions", F.col("_task").alias("task_type"), "seq",
    )


def incomplete(partials: DataFrame, active: DataFrame, minimum: int = 2) -> DataFrame:
    """Partials of records still waiting for a model (the pending table).

    Partials whose model is inactive stay pending as well: membership may grow
    back, and the caller's horizon removes what never completes.
    """
    firsts = first_per_model(partials)
    done = combine(firsts, active, minimum, deduplicated=True).select(
        "scope", "target", F.col("recordId").alias("recordID")
    )
    return firsts.join(done, list(RECORD), "left_anti")
