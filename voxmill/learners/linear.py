"""Perceptron and SGD: a step per row, in parallel slices whose weights are averaged.

The rows of a model, in order, are cut into slices of ``SLICE`` rows. A slice is folded row by
row from the weights it is given, and the weights of all slices of a round are averaged by
their rows. The first round is the first slice, and each later round has twice as many, so
the early steps, which move most, follow each other, later ones run side by side, and n rows take
log2(n / SLICE) rounds. Every row steps once, however the rows are chunked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import coercion
from ..functions.scans import rank_in_order
from ..operators.features import label_domain
from ..session import broadcast_within, cut, stage
from .base import PREDICTION, State, argmax_label

ONLY = ""  # name of the single output of a two-class or numeric model
SLICE = 256  # rows of one fold


def settings(models: DataFrame) -> DataFrame:
    """Loss, step and shrinkage per model (the request's intended meaning)."""
    hp = F.col("hyper_params")
    perceptron = F.col("algorithm_type") == "Perceptron"
    option = coercion.param_int(hp, ("lossFunctionOption", "lossFunction"), 0)
    loss = (
        F.when(F.col("task_type") == "regression", F.lit("squared"))
        .when(perceptron, F.lit("sigmoid"))
        .when(option == 1, F.lit("logistic"))
        .when(option == 2, F.lit("squared"))
        .otherwise(F.lit("hinge"))
    )
    return models.select(
        "model_id",
        loss.alias("loss"),
        F.when(perceptron, coercion.param(hp, ("learningRatio", "learningRatioOption"), 1.0))
        .otherwise(coercion.param(hp, "learningRate", 1e-4)).alias("eta"),
        F.when(perceptron, F.lit(0.0)).otherwise(coercion.param(hp, "lambdaRegularization", 1e-4)).alias("lam"),
    )


def _dot(x: Column, w: Column) -> Column:
    products = F.zip_with(x, w, lambda a, b: F.coalesce(a * b, F.lit(0.0)))
    return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)


def initial_weights(outputs: DataFrame, previous: DataFrame | None) -> DataFrame:
    """Zero weights for outputs (model_id, label, idx, size, loss, eta, lam) not known yet."""
    fresh = outputs.select(
        "model_id", "label", "idx", "loss", "eta", "lam",
        F.expr("array_repeat(CAST(0 AS DOUBLE), size)").alias("w"), F.lit(0.0).alias("b"),
    )
    if previous is None:
        return fresh
    return previous.unionByName(fresh.join(previous, ["model_id", "label"], "left_anti"))


def outputs_of(instances: DataFrame, models: DataFrame, domain: DataFrame) -> DataFrame:
    """One output per class for sigmoid models, one in all for the others.

    A hinge or logistic model with other than two classes is left out: it
    cannot be trained and hence never answers.
    """
    sizes = instances.groupBy("model_id").agg(F.max(F.size("x")).alias("size"))
    known = settings(models).join(sizes, "model_id")
    classes = domain.groupBy("model_id").agg(F.count(F.lit(1)).alias("n_classes"))
    per_class = known.where("loss = 'sigmoid'").join(domain.select("model_id", "label", "idx"), "model_id")
    binary = known.where("loss IN ('hinge', 'logistic')").join(classes.where("n_classes = 2"), "model_id").drop("n_classes")
    numeric = known.where("loss = 'squared'")
    single = binary.unionByName(numeric).withColumn("label", F.lit(ONLY)).withColumn("idx", F.lit(0))
    return per_class.unionByName(single)


def sliced(instances: DataFrame) -> DataFrame:
    """Staged slices (model_id, slice, rows) by ``round``; a slice has at most ``SLICE`` rows, in order."""
    ranked = rank_in_order(instances.select("model_id", "seq", "x", "label", "y"), ["model_id"], "seq", "_n")
    numbered = ranked.withColumn("slice", F.expr(f"(_n - 1) DIV {SLICE}"))
    slices = numbered.groupBy("model_id", "slice").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "label", "y"))).alias("rows"))
    return stage(slices.withColumn("round", F.expr("length(bin(slice + 1)) - 1")), "round")


#: Gradient factor of a row for the score ``s``; null where the row has no truth.
FACTOR = """CASE o.loss
 WHEN 'sigmoid' THEN (double(r.label = o.label) - 1D / (1D + exp(-s))) * (1D / (1D + exp(-s))) * (1D - 1D / (1D + exp(-s)))
 WHEN 'hinge' THEN CASE WHEN sign * s < 1D THEN sign ELSE 0D END
 WHEN 'logistic' THEN sign / (1D + exp(sign * s))
 ELSE r.y - s END"""


def _folded() -> str:
    """Weights of one output after all rows of a slice, as SQL over ``rows``, ``o`` and ``index``."""
    dot = "a.b + aggregate(zip_with(a.w, r.x, (p, q) -> coalesce(p * q, 0D)), 0D, (t, v) -> t + v)"
    sign = "CASE try_element_at(index, r.label) WHEN 0 THEN -1D ELSE CASE WHEN r.label IS NOT NULL THEN 1D END END"
    moved = (
        "named_struct('w', zip_with(a.w, r.x, (p, q) -> (1D - o.eta * o.lam) * p + o.eta * coalesce(g * q, 0D)), 'b', a.b + o.eta * g)"
    )
    named = lambda value, name, body: f"get(transform(array({value}), {name} -> {body}), 0)"
    step = named(dot, "s", named(sign, "sign", named(FACTOR, "g", f"CASE WHEN g IS NULL THEN a ELSE {moved} END")))
    return f"aggregate(rows, named_struct('w', o.w, 'b', o.b), (a, r) -> {step})"


def step(slices: DataFrame, weights: DataFrame, domain: DataFrame) -> DataFrame:
    """Weights after one round: each slice folded from ``weights``, averaged by rows. Outputs without rows keep theirs."""
    outs = weights.groupBy("model_id").agg(F.collect_list(F.struct("label", "loss", "eta", "lam", "w", "b")).alias("outs"))
    outs = outs.join(
        domain.groupBy("model_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "idx"))).alias("index")), "model_id", "left"
    )
    cells = F.aggregate("outs", F.lit(4), lambda s, o: s + F.size(o["w"]) + 5)
    folded = (
        slices.join(broadcast_within(outs, cells), "model_id").select("model_id", "rows", "index", F.explode("outs").alias("o"))
        .selectExpr("model_id", "o.label AS label", "size(rows) AS n", f"{_folded()} AS made")
        .selectExpr("model_id", "label", "n", "posexplode(concat(array(made.b), made.w)) AS (pos, v)")
    )
    means = folded.groupBy("model_id", "label", "pos").agg((F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("v"))
    moved = means.groupBy("model_id", "label").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("m")).selectExpr(
        "model_id", "label", "get(m.v, 0) AS _b", "slice(m.v, 2, size(m)) AS _w"
    )
    return weights.join(moved, ["model_id", "label"], "left").select(
        "model_id", "label", "idx", "loss", "eta", "lam", F.coalesce("_w", "w").alias("w"), F.coalesce("_b", "b").alias("b")
    )


class Linear:
    family = "linear"
    tables = ("weights", "domain")

    def update(self, state: State | None, instances: DataFrame, models: DataFrame, chunks: int = 1) -> State:
        tasks = broadcast_within(models.select("model_id", "task_type"))
        domain = cut(label_domain(instances.drop("task_type").join(tasks, "model_id"), state["domain"] if state else None))
        weights = cut(initial_weights(outputs_of(instances, models, domain), state["weights"] if state else None))
        slices = sliced(instances)
        last = slices.agg(F.max("round")).first()[0]
        for at in range(0 if last is None else last + 1):
            weights = cut(step(slices.where(F.col("round") == at), weights, domain))
        return {"weights": weights, "domain": domain}

    def predict(self, state: State, instances: DataFrame, models: DataFrame) -> DataFrame:
        outs = state["weights"].groupBy("model_id").agg(
            F.array_sort(F.collect_list(F.struct("idx", "label", "w", "b"))).alias("outs"), F.first("loss").alias("loss")
        )
        order = state["domain"].groupBy("model_id").agg(F.array_sort(F.collect_list(F.struct("idx", "label"))).alias("classes"))
        rows = outs.join(order, "model_id", "left")
        cells = F.aggregate("outs", F.lit(4), lambda s, o: s + F.size(o["w"]) + 3)
        joined = instances.join(broadcast_within(rows, cells), "model_id")
        scores = F.transform(
            "outs",
            lambda o: F.struct((o["b"] + _dot(F.col("x"), o["w"])).alias("score"), (-o["idx"]).alias("order"), o["label"].alias("label")),
        )
        single = F.get(scores, 0)["score"]
        prediction = (
            F.when(F.col("loss") == "sigmoid", argmax_label(scores))
            .when(F.col("loss") == "squared", single.cast("string"))
            .when(single > 0, F.get("classes", 1)["label"])
            .otherwise(F.get("classes", 0)["label"])
        )
        return joined.withColumn("prediction", prediction).select(*PREDICTION)

    def trained(self, state: State) -> DataFrame:
        return state["weights"].select("model_id").distinct()
