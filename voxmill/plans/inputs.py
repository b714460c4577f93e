"""Derived inputs of the query catalog: requests, partials, series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..operators import control, features, routing
from ..session import broadcast_within, cut
from ..sources import tables

C, R = schema.CLASSIFICATION, schema.REGRESSION


def event_requests(spark: SparkSession, folder: str) -> DataFrame:
    """A command log with one request per event, with repeats and bad ones."""
    e = tables.load(spark, folder, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    names = F.array(*[F.lit(a.name) for a in schema.CATALOG])
    number = k % 10
    regression = number.isin(7, 8, 9)
    params = F.when(F.col("value") < 10, F.create_map().cast("map<string,string>")).otherwise(
        F.create_map(F.lit("k"), F.floor(F.col("value") / 50).cast("string"))
    )
    return e.select(
        F.when(F.col("event_type") == "error", F.lit("DELETE")).when(F.col("event_type") == "click", F.lit("Load"))
        .when(F.col("event_type") == "view", F.lit("create")).otherwise(F.lit("Create")).alias("commandType"),
        (number + 1).alias("algorithmID"),
        F.get(names, F.when(k >= 95, (number + 1) % 10).otherwise(number)).alias("algorithmType"),
        F.when(F.col("user_id") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("u"), (F.col("user_id") % 7).cast("string"))).alias("streamID"),
        F.concat(F.lit("d"), (F.col("user_id") % 11).cast("string")).alias("dataSetKey"),
        params.alias("hyperParams"),
        F.when(regression, F.lit("price")).otherwise(F.lit("status")).alias("target"),
        F.when(regression, F.lit(R)).otherwise(F.lit(C)).alias("taskType"),
        F.col("event_id").alias("seq"),
    )


def active_for(records: DataFrame, wanted, per_stream: bool = True) -> DataFrame:
    return cut(control.fold_requests(tables.create_requests(records, wanted, per_stream)))


def instances_for(records: DataFrame, active: DataFrame) -> DataFrame:
    routed = routing.route_to_models(records, active)
    pinned = cut(features.pin_schema(routed))
    return features.trainable(features.encode(routed, pinned))


def binary_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with a two-class target and unit-scale features."""
    o = tables.load(spark, folder, "orders")
    return tables.as_records(
        o, stream=F.lit("all"), dataset="orders", record_id=F.col("o_orderkey"), seq=F.col("o_orderkey"),
        fields={
            "a": (F.col("o_custkey") % 100) / 100, "b": F.month("o_orderdate") / 12, "c": F.dayofweek("o_orderdate") / 7,
            "side": F.when(F.col("o_totalprice") > 250000, F.lit("hi")).otherwise(F.lit("lo")),
            "amount": F.col("o_totalprice") / 500000,
        },
    )


def _stumps(target: str) -> list[tuple[int, str, Column]]:
    if target == "status":
        return [
            (1, "HoeffdingTree", F.when(F.col("price") < 200000, F.lit("F")).when(F.col("price") < 350000, F.lit("O")).otherwise(F.lit("P"))),
            (2, "Naive-Bayes", F.when(F.col("month") <= 4, F.lit("O")).when(F.col("month") <= 8, F.lit("F")).otherwise(F.lit("P"))),
            (3, "kNN", F.when(F.col("dow") <= 3, F.lit("P")).when(F.col("dow") <= 5, F.lit("F")).otherwise(F.lit("O"))),
        ]
    return [
        (8, "FIMT-DD", (F.col("month") * 20000).cast("string")),
        (9, "AMRules", F.when(F.col("custmod") < 5, F.lit("n/a")).otherwise((F.col("custmod") * 2500).cast("string"))),
        (10, "Random-Forest-Regressor", F.when(F.col("dow") == 2, F.lit("NaN")).otherwise((F.col("dow") * 60000).cast("string"))),
    ]


def order_columns(spark: SparkSession, folder: str) -> DataFrame:
    o = tables.load(spark, folder, "orders")
    return o.select(
        F.col("o_orderkey").alias("seq"), F.col("o_orderkey").cast("string").alias("recordID"), F.col("o_orderpriority").alias("streamID"),
        F.col("o_totalprice").alias("price"), (F.col("o_custkey") % 100).alias("custmod"), F.month("o_orderdate").alias("month"),
        F.dayofweek("o_orderdate").alias("dow"), F.col("o_orderstatus").alias("status"),
    )


def stump_models(spark: SparkSession, folder: str, target: str) -> DataFrame:
    """Active models of the hand-made predictors, one set per order stream."""
    records = tables.order_records(spark, folder)
    wanted = [(i, name, target, C if target == "status" else R, {}) for i, name, _ in _stumps(target)]
    requests = tables.create_requests(records, wanted).where("streamID <> ''")
    return cut(control.fold_requests(requests))


def stump_partials(spark: SparkSession, folder: str, target: str = "status", models: DataFrame | None = None) -> DataFrame:
    """Partials of three simple predictors over all orders.

    Records with a small ``custmod`` get a late second answer of the second
    predictor, and the third predictor does not answer on some weekdays.
    """
    o = order_columns(spark, folder)
    first, second, third = _stumps(target)

    def answers(frame: DataFrame, stump, order: int, prediction: Column) -> DataFrame:
        return frame.select(
            F.concat_ws("-", "streamID", F.lit("orders")).alias("scope"), F.lit(target).alias("target"), "recordID",
            F.lit(stump[1]).alias("algorithmType"), F.lit("{}").alias("hyperParams"), prediction.alias("prediction"),
            (F.col("seq") * 10 + order).alias("seq"),
        )

    late = F.lit("P") if target == "status" else F.lit("1.0")
    parts = [
        answers(o, first, 1, first[2]), answers(o, second, 2, second[2]), answers(o.where("dow <> 1"), third, 3, third[2]),
        answers(o.where("custmod < 10"), second, 4, late),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    models = stump_models(spark, folder, target) if models is None else models
    names = models.select("scope", "target", F.col("algorithm_type").alias("algorithmType"), "model_id")
    return out.join(broadcast_within(names), ["scope", "target", "algorithmType"])


def series(spark: SparkSession, folder: str) -> DataFrame:
    """Bounded series per event type for the change detectors: k / 100."""
    e = tables.load(spark, folder, "events")
    return e.select("event_type", F.col("event_id").alias("seq"), (F.get_json_object("props", "$.k").cast("double") / 100).alias("x"), "ts", "value")
