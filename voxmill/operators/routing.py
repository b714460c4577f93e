"""Fan-out of records to scopes and to the models active on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keys
from .control import small_models


def with_scopes(records: DataFrame) -> DataFrame:
    """One row per record and scope it belongs to."""
    return records.withColumn("scope", F.explode(keys.record_scopes(F.col("streamID"), F.col("dataSetKey"))))


def route_to_scopes(records: DataFrame, active: DataFrame) -> DataFrame:
    """Records fanned out to scopes that have at least one model."""
    scopes = active.select("scope").distinct()
    return with_scopes(records).join(small_models(scopes), "scope", "left_semi")


def route_to_models(records: DataFrame, active: DataFrame, since: bool = False) -> DataFrame:
    """Records fanned out to every active model of their scopes.

    One join replaces a join per scope kind. With ``since`` a model only gets
    records that follow its creation.
    """
    models = active.select("scope", "model_id", "target", "task_type", F.col("seq").alias("_created"))
    routed = with_scopes(records).join(small_models(models), "scope")
    if since:
        routed = routed.where(F.col("seq") >= F.col("_created"))
    return routed.drop("_created")


def destination(kind: str):
    """Per-row destination name of the dynamic sink."""
    prefix = {"training": "DataTopic-", "prediction": "PredTopic-"}[kind]
    return F.concat(F.lit(prefix), F.col("scope"))
