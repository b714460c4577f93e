"""Batch dataflow: requests -> training -> partials -> ensemble -> metrics."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..learners import FAMILIES, State
from ..operators import control, ensemble, evaluation, features, routing
from ..session import cut, discard, stage
from ..sources.records import split_unordered


@dataclass
class Fitted:
    """Everything a prediction needs: active models, schemas, family states."""

    active: DataFrame
    schemas: DataFrame
    states: dict[str, State] = field(default_factory=dict)


def families_of(active: DataFrame) -> list[str]:
    """Families with at least one active model; at most one row per family."""
    return sorted(r["family"] for r in active.select("family").distinct().collect())


def of_family(active: DataFrame, family: str) -> DataFrame:
    return active.where(F.col("family") == family)


def fit(
    active: DataFrame, training: DataFrame, chunks: int = 1, previous: Fitted | None = None, since: bool = False, schemas: DataFrame | None = None
) -> Fitted:
    """Train all active models; families run one after another, models together.

    ``schemas`` (model_id, target, features) given by the caller saves the pass
    that finds each model's first record. State tables are materialised: they
    are small and read many times, the training rows are not kept.
    """
    if schemas is None:
        routed = routing.route_to_models(training, active, since)
        schemas = cut(features.pin_schema(routed, previous.schemas if previous else None))
    states = dict(previous.states) if previous else {}
    for name in families_of(active):
        models = of_family(active, name)
        own = routing.route_to_models(training, models, since)
        instances = features.trainable(features.encode(own, schemas))
        state = FAMILIES[name].update(states.get(name), instances, models, chunks)
        states[name] = {table: cut(df) for table, df in state.items()}
    return Fitted(active, schemas, states)


def answer(fitted: Fitted, prediction: DataFrame) -> DataFrame:
    """Partial predictions of every trained active model."""
    parts = []
    for name in families_of(fitted.active):
        if name not in fitted.states:
            continue
        models = of_family(fitted.active, name)
        instances = features.encode(routing.route_to_models(prediction, models), fitted.schemas)
        parts.append(FAMILIES[name].predict(fitted.states[name], instances, models))
    if not parts:
        raise ValueError("no trained model is active")
    return features.as_partials(reduce(DataFrame.unionByName, parts), fitted.active)


def vote(partials: DataFrame, active: DataFrame, minimum: int = 2) -> DataFrame:
    """Ensemble results; of a record asked several times each model's first answer counts."""
    return ensemble.combine(partials, active, minimum)


def judge(results: DataFrame, prediction: DataFrame, active: DataFrame) -> DataFrame:
    """(scope, target, task_type, recordID, actual, predicted) of results with a truth.

    ``active`` names the targets without running ``results`` for them.
    """
    wanted = results.select("scope", "target", "task_type", F.col("recordId").alias("recordID"), F.col("finalPrediction").alias("predicted"))
    truth = evaluation.truth_of(prediction, active)
    return wanted.join(truth.drop("ts"), ["scope", "target", "recordID"])


def run(requests: DataFrame, training: DataFrame, prediction: DataFrame, chunks: int = 1) -> dict[str, DataFrame]:
    """The whole batch flow with its intermediate tables.

    Rows without an order come back in ``rejects``; no learner takes them.
    """
    training, unordered = split_unordered(training)
    prediction, unasked = split_unordered(prediction)
    active = cut(control.fold_requests(requests))
    fitted = fit(active, training, chunks)
    # Partials cost a pass of every learner, pairs a pass of the votes: each is made once.
    partials = stage(answer(fitted, prediction))
    results = vote(partials, active)
    pairs = stage(judge(results, prediction, active))
    matrix = cut(evaluation.confusion(pairs.where("task_type = 'classification'")))
    sums = cut(evaluation.regression_sums(pairs.where("task_type = 'regression'")))
    discard(pairs)
    return {
        "active": active,
        "rejects": unordered.unionByName(unasked),
        "partials": partials,
        "ensemble": results,
        "classification": evaluation.classification_report(matrix),
        "regression": evaluation.regression_report(sums),
    }
