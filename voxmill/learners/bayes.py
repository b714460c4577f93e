"""Gaussian naive Bayes with exactly mergeable statistics."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_within
from .base import PREDICTION, State, argmax_label

MIN_VARIANCE = 1e-9
CLASS_ROW = -1  # position of the row that counts the class itself


def batch_stats(instances: DataFrame) -> DataFrame:
    """(model_id, label, pos, n, mean, m2); position -1 counts the class.

    One aggregate with map-side combine: what is shuffled is one row per model,
    class and feature, whatever the number of instances.
    """
    padded = F.concat(F.array(F.lit(0.0)), F.coalesce("x", F.array().cast("array<double>")))
    long = instances.where("label IS NOT NULL").select("model_id", "label", F.posexplode(padded).alias("pos", "value"))
    return (
        long.where("value IS NOT NULL")
        .groupBy("model_id", "label", (F.col("pos") - 1).alias("pos"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("value").alias("mean"),
            (F.var_pop("value") * F.count(F.lit(1))).alias("m2"),
        )
    )


def merge_stats(a: DataFrame, b: DataFrame) -> DataFrame:
    """Exact merge of two statistics tables (pairwise update of mean and M2)."""
    keys = ["model_id", "label", "pos"]
    both = a.select(*keys, *[F.col(c).alias(f"{c}_a") for c in ("n", "mean", "m2")]).join(
        b.select(*keys, *[F.col(c).alias(f"{c}_b") for c in ("n", "mean", "m2")]), keys, "full_outer"
    )
    na, nb = F.coalesce("n_a", F.lit(0)), F.coalesce("n_b", F.lit(0))
    ma, mb = F.coalesce("mean_a", F.lit(0.0)), F.coalesce("mean_b", F.lit(0.0))
    n, d = na + nb, mb - ma
    return both.select(
        *keys,
        n.alias("n"),
        F.when(na == 0, mb).when(nb == 0, ma).otherwise(ma + d * nb / n).alias("mean"),
        (
            F.coalesce("m2_a", F.lit(0.0)) + F.coalesce("m2_b", F.lit(0.0))
            + F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(d * d * na * nb / n)
        ).alias("m2"),
    )


def compiled(stats: DataFrame) -> DataFrame:
    """One row per model: classes with their prior and per-feature terms."""
    var = F.when(F.col("n") < 2, F.lit(MIN_VARIANCE)).otherwise(
        F.greatest(F.col("m2") / F.greatest(F.col("n") - 1, F.lit(1)), F.lit(MIN_VARIANCE))
    )
    term = F.struct(
        F.col("mean"), (F.log(var * (2 * math.pi)) * 0.5).alias("offset"), (F.lit(0.5) / var).alias("scale")
    )
    per_class = stats.groupBy("model_id", "label").agg(
        F.max(F.when(F.col("pos") == CLASS_ROW, F.col("n"))).alias("n"),
        F.max("pos").alias("last"),
        F.map_from_entries(
            F.collect_list(F.when(F.col("pos") >= 0, F.struct("pos", term.alias("term"))))
        ).alias("terms"),
    )
    dense = F.when(F.col("last") < 0, F.expr("CAST(array() AS array<struct<mean:double,offset:double,scale:double>>)")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest("last", F.lit(0))), lambda i: F.try_element_at("terms", i))
    )
    classes = per_class.select("model_id", F.struct("label", "n", dense.alias("terms")).alias("c"))
    return classes.groupBy("model_id").agg(
        F.array_sort(F.collect_list("c")).alias("classes"), F.sum("c.n").alias("total"),
        F.sum(F.size("c.terms") * 3 + 2).alias("cells"),
    )


class NaiveBayes:
    family = "bayes"
    tables = ("stats",)

    def update(self, state: State | None, instances: DataFrame, models: DataFrame, chunks: int = 1) -> State:
        fresh = batch_stats(instances)
        return {"stats": merge_stats(state["stats"], fresh) if state else fresh}

    def predict(self, state: State, instances: DataFrame, models: DataFrame) -> DataFrame:
        model_rows = compiled(state["stats"])
        joined = instances.join(broadcast_within(model_rows, F.col("cells")), "model_id")

        def loglik(terms):
            parts = F.zip_with(
                "x", terms,
                lambda v, t: F.coalesce(t["offset"] + (v - t["mean"]) * (v - t["mean"]) * t["scale"], F.lit(0.0)),
            )
            return F.aggregate(parts, F.lit(0.0), lambda s, v: s + v)

        scores = F.transform(
            "classes",
            lambda c, i: F.struct(
                (F.log(c["n"] / F.col("total")) - loglik(c["terms"])).alias("score"), (-i).alias("order"), c["label"].alias("label")
            ),
        )
        return joined.withColumn("prediction", argmax_label(scores)).select(*PREDICTION)

    def trained(self, state: State) -> DataFrame:
        return state["stats"].select("model_id").distinct()
