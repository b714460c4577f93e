"""Feature preparation: schema pinning, dense vectors, label domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import coercion
from ..functions.scans import rank_in_order
from ..session import broadcast_within, cut


def pin_schema(routed: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Feature list per model, fixed by the first record the model sees.

    ``known`` holds models pinned earlier; they keep their features.
    """
    # The smallest number first: a minimum of names would sort all rows.
    given = routed.where(F.size("fields") > 0)
    at = cut(given.groupBy("model_id", "target").agg(F.min("seq").alias("seq")))
    first = given.join(broadcast_within(at), ["model_id", "target", "seq"]).groupBy("model_id", "target").agg(
        F.min_by(F.map_keys("fields"), "seq").alias("names")
    )
    fresh = first.select(
        "model_id", F.array_sort(F.array_except("names", F.array("target"))).alias("features")
    )
    if known is None:
        return fresh
    return known.unionByName(fresh.join(known, "model_id", "left_anti"))


def schema_rows(pinned: DataFrame) -> DataFrame:
    """Long form (model, position, feature)."""
    return pinned.select("model_id", F.posexplode("features").alias("pos", "feature"))


def field(name: Column) -> Column:
    return F.try_element_at(F.col("fields"), name)


def vector(features: Column) -> Column:
    """Dense vector in schema order; missing or unparsable is null."""
    return F.transform(features, lambda f: coercion.to_number(F.try_element_at(F.col("fields"), f)))


def encode(routed: DataFrame, pinned: DataFrame) -> DataFrame:
    """Instances (model_id, scope, target, seq, recordID, x, label, y).

    ``label`` is the class text, ``y`` its numeric reading; the target never
    enters ``x``.
    """
    schemas = broadcast_within(pinned, F.size("features") + 1)
    truth = F.trim(field(F.col("target")))
    return routed.join(schemas, "model_id").select(
        "model_id", "scope", "target", "task_type", "seq", "recordID",
        vector(F.col("features")).alias("x"),
        F.when(truth != "", truth).alias("label"),
        coercion.to_number(field(F.col("target"))).alias("y"),
    )


def trainable(instances: DataFrame) -> DataFrame:
    """Instances with a usable target for their task."""
    regression = F.col("task_type") == "regression"
    return instances.where(F.when(regression, F.col("y").isNotNull()).otherwise(F.col("label").isNotNull()))


def long_features(instances: DataFrame) -> DataFrame:
    """One row per instance and present feature."""
    return instances.select("*", F.posexplode("x").alias("pos", "value")).where("value IS NOT NULL")


def label_domain(instances: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Class labels per model, numbered from 0 in order of first appearance."""
    seen = (
        instances.where("label IS NOT NULL AND task_type = 'classification'")
        .groupBy("model_id", "label")
        .agg(F.min("seq").alias("first_seq"))
    )
    if known is not None:
        seen = seen.unionByName(known.select("model_id", "label", "first_seq"))
        seen = seen.groupBy("model_id", "label").agg(F.min("first_seq").alias("first_seq"))
    ranked = rank_in_order(seen, ["model_id"], "first_seq", "idx")
    return ranked.withColumn("idx", (F.col("idx") - 1).cast("int"))


def category_dictionary(records: DataFrame, dataset: list[str]) -> DataFrame:
    """Categories of text features, numbered from 0 by first appearance.

    Distinct values are aggregated first; only they are ranked, so an index
    stays valid when later records bring new categories.
    """
    values = records.select(*dataset, "seq", F.explode("fields").alias("feature", "value"))
    texts = values.where(coercion.typed_kind(F.col("value")) == "categorical")
    first = texts.groupBy(*dataset, "feature", F.trim("value").alias("value")).agg(F.min("seq").alias("first_seq"))
    ranked = rank_in_order(first, [*dataset, "feature"], "first_seq", "idx")
    return ranked.withColumn("idx", (F.col("idx") - 1).cast("int"))


def typed_number(text: Column, category: Column) -> Column:
    """Typed encoding: number, date, time of day, else the category index."""
    t = F.trim(text)
    return F.coalesce(
        coercion.to_number(t), coercion.date_number(t), coercion.time_number(t), category.cast("double")
    )


def as_partials(predictions: DataFrame, active: DataFrame) -> DataFrame:
    """Predictions as partial-prediction rows; nulls are not emitted."""
    describe = active.select("model_id", F.col("algorithm_type").alias("algorithmType"), F.col("hp_text").alias("hyperParams"))
    return (
        predictions.where("prediction IS NOT NULL AND recordID IS NOT NULL")
        .join(broadcast_within(describe), "model_id")
        .select("scope", "target", "recordID", "model_id", "algorithmType", "hyperParams", "prediction", "seq")
    )
