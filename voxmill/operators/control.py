"""Requests: validation, fold into active models, membership, ensemble gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import keys
from ..functions.scans import running
from ..session import broadcast_within

MODEL_COLUMNS = (
    "scope", "target", "task_type", "model_id", "model_key", "algorithm_id",
    "algorithm_type", "family", "hyper_params", "hp_text", "seq",
)


def catalog(spark: SparkSession) -> DataFrame:
    """The learners that exist; its size is fixed."""
    rows = [(a.id, a.name, a.family, list(a.tasks)) for a in schema.CATALOG]
    return spark.createDataFrame(rows, "cat_id int, cat_name string, family string, tasks array<string>")


def _command(column: Column) -> Column:
    return F.lower(F.trim(column))


def check_requests(requests: DataFrame) -> DataFrame:
    """Add normalised columns and ``reject`` (null for a valid request)."""
    known = F.broadcast(catalog(requests.sparkSession))
    r = requests.join(known, F.lower(F.trim("algorithmType")) == F.lower("cat_name"), "left")
    task = F.lower(F.coalesce(F.col("taskType"), F.lit(schema.CLASSIFICATION)))
    reject = (
        F.when(F.coalesce(~_command(F.col("commandType")).isin("create", "delete", "load"), F.lit(True)), F.lit("unknown command"))
        .when(F.col("cat_id").isNull(), F.lit("unknown algorithm"))
        .when(F.coalesce(F.col("cat_id") != F.col("algorithmID"), F.lit(True)), F.lit("algorithm id mismatch"))
        .when(F.coalesce(F.col("dataSetKey"), F.lit("")) == "", F.lit("no dataset"))
        .when(F.coalesce(F.col("target"), F.lit("")) == "", F.lit("no target"))
        .when(~F.array_contains("tasks", task), F.lit("task not supported"))
    )
    scope = keys.scope_key(F.col("streamID"), F.col("dataSetKey"))
    key = keys.model_key(scope, F.col("cat_name"), F.col("target"), keys.params_signature(F.col("hyperParams")))
    return r.select(
        *requests.columns,
        _command(F.col("commandType")).alias("command"),
        scope.alias("scope"),
        task.alias("task_type"),
        F.col("cat_id").alias("algorithm_id"),
        F.col("cat_name").alias("algorithm_type"),
        "family",
        key.alias("model_key"),
        reject.alias("reject"),
    )


def valid_requests(requests: DataFrame) -> DataFrame:
    return check_requests(requests).where("reject IS NULL").drop("reject")


def rejected_requests(requests: DataFrame) -> DataFrame:
    return check_requests(requests).where("reject IS NOT NULL").select(*requests.columns, "reject")


def fold_requests(requests: DataFrame) -> DataFrame:
    """Active models after all requests (command log as a table).

    A model is active when a CREATE follows its last DELETE. Its descriptor is
    the first such CREATE, since repeated creates change nothing. Both steps
    are combinable aggregates, so a key with many requests is not gathered.
    """
    valid = valid_requests(requests)
    deletes = valid.where("command = 'delete'").groupBy("model_key").agg(F.max("seq").alias("_deleted"))
    descriptor = F.struct(
        "scope", "target", "task_type", "algorithm_id", "algorithm_type", "family",
        F.coalesce("hyperParams", F.create_map().cast("map<string,string>")).alias("hyper_params"), "seq",
    )
    kept = (
        valid.where("command = 'create'")
        .join(deletes, "model_key", "left")
        .where(F.col("_deleted").isNull() | (F.col("seq") > F.col("_deleted")))
        .groupBy("model_key")
        .agg(F.min_by(descriptor, "seq").alias("d"))
    )
    return kept.select(
        "model_key", keys.model_id(F.col("model_key"), F.col("d.seq")).alias("model_id"), "d.*"
    ).withColumn("hp_text", keys.params_text(F.col("hyper_params"))).select(*MODEL_COLUMNS)


def effective_requests(requests: DataFrame) -> DataFrame:
    """The requests that changed something, in log order.

    Presence before a request is decided by the last CREATE or DELETE ahead of
    it, found with a sliced running maximum.
    """
    valid = valid_requests(requests)
    switch = F.when(F.col("command") != "load", F.struct("seq", "command"))
    seen = running(valid, ["model_key"], "seq", {"_last": ("max", switch)}, inclusive=False)
    present = F.coalesce(F.col("_last.command") == "create", F.lit(False))
    return seen.where(F.when(F.col("command") == "create", ~present).otherwise(present)).drop("_last")


def saved_model_loads(requests: DataFrame, active: DataFrame) -> DataFrame:
    """Latest LOAD per active model."""
    loads = valid_requests(requests).where("command = 'load'").groupBy("model_key").agg(F.max("seq").alias("load_seq"))
    return loads.join(active.select("model_key", "model_id", "family"), "model_key")


def membership(active: DataFrame) -> DataFrame:
    """One row per scope with its models as a map; empty scopes vanish."""
    details = F.struct(
        F.col("algorithm_type").alias("algorithmType"), F.col("algorithm_id").alias("algorithmId"),
        F.col("model_id").alias("microserviceId"), "target", F.col("task_type").alias("taskType"),
        F.col("hyper_params").alias("hyperParams"),
    )
    entry = F.struct(F.col("model_key").alias("key"), details.alias("value"))
    return active.groupBy("scope").agg(F.map_from_entries(F.collect_list(entry)).alias("models"))


def ensemble_gate(active: DataFrame, minimum: int = 2) -> DataFrame:
    """(scope, target) pairs with enough learners to be combined."""
    return (
        active.groupBy("scope", "target")
        .agg(F.count(F.lit(1)).alias("n_models"), F.min_by("task_type", F.struct("seq", "model_id")).alias("task_type"))
        .where(F.col("n_models") >= minimum)
    )


def latest_by_key(changes: DataFrame, key: str, order: str, tombstone: Column) -> DataFrame:
    """A change log as a table: newest row per key, deleted keys dropped."""
    rest = [c for c in changes.columns if c != key]
    newest = changes.withColumn("_gone", tombstone).groupBy(key).agg(
        F.max_by(F.struct(*rest, "_gone"), order).alias("r")
    )
    return newest.where("NOT r._gone").select(key, *[f"r.{c}" for c in rest])


def trained_enough(counts: DataFrame, least: int) -> DataFrame:
    """Models (model_id) that have seen ``least`` training rows; ``counts`` has model_id, after."""
    return counts.where(F.col("after") >= least).select("model_id")


def small_models(active: DataFrame) -> DataFrame:
    """Active models marked for broadcast while they fit."""
    return broadcast_within(active)
