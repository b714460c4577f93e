import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from voxmill.operators import ensemble, evaluation
from voxmill.plans.queries import CATALOG

PARTIAL = "scope string, target string, recordID string, model_id string, algorithmType string, hyperParams string, prediction string, seq long"
ACTIVE = "scope string, target string, model_id string, task_type string, seq long"


def _active(spark, models, task="classification"):
    return spark.createDataFrame([("d", "t", m, task, i) for i, m in enumerate(models)], ACTIVE)


def _partials(spark, rows):
    return spark.createDataFrame([("d", "t", r, m, m, "{}", p, i) for i, (r, m, p) in enumerate(rows)], PARTIAL)


def test_vote_rules(spark):
    active = _active(spark, "abc")
    rows = [
        ("1", "a", "x"), ("1", "b", "y"), ("1", "b", "x"), ("1", "c", "y"),  # second answer of b ignored
        ("2", "a", "z"), ("2", "b", "y"), ("2", "c", "x"),  # tie: smallest
        ("3", "a", "x"), ("3", "b", "x"),  # c missing
        ("4", "a", "x"), ("4", "b", None), ("4", "c", "w"), ("4", "gone", "w"),  # inactive model ignored
    ]
    random.Random(3).shuffle(rows)
    order = {("1", "b", "y"): 0, ("1", "b", "x"): 1}
    rows.sort(key=lambda r: order.get(r, 2))
    p = _partials(spark, rows)
    got = {r["recordId"]: (r["finalPrediction"], len(r["partialPredictions"])) for r in ensemble.combine(p, active).collect()}
    assert got == {"1": ("y", 3), "2": ("x", 3), "4": ("w", 3)}
    assert {r["recordID"] for r in ensemble.incomplete(p, active).collect()} == {"3"}
    assert ensemble.combine(p, _active(spark, "a")).count() == 0  # one learner is no ensemble


def test_mean_rules(spark):
    active = _active(spark, "ab", "regression")
    p = _partials(spark, [("1", "a", "2"), ("1", "b", "n/a"), ("2", "a", "NaN"), ("2", "b", None), ("3", "a", "1"), ("3", "b", "2")])
    got = {r["recordId"]: r["finalPrediction"] for r in ensemble.combine(p, active).collect()}
    assert got == {"1": "2.0", "2": "NaN", "3": "1.5"}


def test_scores(spark):
    pairs = spark.createDataFrame(
        [("d", "t", "a", "a")] * 3 + [("d", "t", "a", "b")] + [("d", "t", "only_truth", "a")] + [("d", "t", "b", "only_pred")], "scope string, target string, actual string, predicted string"
    )
    matrix = evaluation.confusion(pairs)
    per = {r["label"]: r for r in evaluation.class_scores(matrix).collect()}
    assert (per["a"]["tp"], per["a"]["fn"], per["a"]["fp"], per["a"]["tn"]) == (3, 1, 1, 1)
    assert per["only_truth"]["f1"] == 0 and per["only_pred"]["f1"] == 0 and per["b"]["precision"] == 0
    report = evaluation.classification_report(matrix).first()
    assert report["accuracy"] == pytest.approx(0.5) and report["micro_f1"] == pytest.approx(report["accuracy"])
    assert report["macro_f1"] == pytest.approx(0.75 / 4)
    assert evaluation.classification_report(matrix.limit(0)).count() == 0


def test_regression_report(spark):
    pairs = spark.createDataFrame([("d", "t", "1", "3"), ("d", "t", "2", "2"), ("d", "t", "x", "2"), ("d", "t", "2", "NaN")], "scope string, target string, actual string, predicted string")
    r = evaluation.regression_report(evaluation.regression_sums(pairs)).first()
    assert (r["n"], r["mae"], r["mse"]) == (2, 1.0, 2.0)


def test_interval_edges(spark):
    t0 = dt.datetime(2024, 1, 2)
    truth = spark.createDataFrame([("1", "a", t0), ("2", "a", t0), ("3", "a", t0)], "recordID string, actual string, ts timestamp")
    late = [("1", "a", t0 + dt.timedelta(hours=24)), ("2", "a", t0 + dt.timedelta(hours=24, microseconds=1)), ("3", "a", t0 - dt.timedelta(hours=24))]
    results = spark.createDataFrame(late, "recordID string, predicted string, pts timestamp")
    assert sorted(r["recordID"] for r in evaluation.interval_pairs(truth, results).collect()) == ["1", "3"]


def test_interval_stream(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 2)
    truth = spark.createDataFrame([(str(i), "a", t0 + dt.timedelta(minutes=i)) for i in range(50)], "recordID string, actual string, ts timestamp")
    results = truth.select("recordID", F.lit("a").alias("predicted"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("pts"))
    truth.write.parquet(str(tmp_path / "t"))
    results.write.parquet(str(tmp_path / "p"))
    left = spark.readStream.schema(truth.schema).parquet(str(tmp_path / "t")).withWatermark("ts", "1 hour")
    right = spark.readStream.schema(results.schema).parquet(str(tmp_path / "p")).withWatermark("pts", "1 hour")
    q = (
        evaluation.interval_pairs(left, right).writeStream.format("memory").queryName("interval_pairs")
        .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    assert spark.table("interval_pairs").count() == 50


def test_truth_targets_come_from_the_models(spark, monkeypatch):
    """The votes are not run only to learn which targets need a truth."""
    seen, real = [], evaluation.truth_of
    monkeypatch.setattr(evaluation, "truth_of", lambda records, targets: seen.append(targets) or real(records, targets))
    for name in ("accuracy", "regression_metrics", "learner_metrics", "learner_errors"):
        CATALOG[name](spark, "/root/testdata/sf0.001")
    plans = [targets._jdf.queryExecution().optimizedPlan().toString() for targets in seen]
    assert len(plans) == 4 and not [p for p in plans if "Relation" in p or "Union" in p]
