import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxmill.functions.hashing import poisson_weight
from voxmill.learners import kernels, split_stats as ss, trees
from voxmill.operators import control
from voxmill.plans import batch
from voxmill.session import cut
from voxmill.sources import tables

C, R = "classification", "regression"


def _leaf_rows(n=900):
    rnd = random.Random(5)
    odd = [None, float("nan"), float("inf"), -float("inf"), 0.5]
    return [
        (i % 7, i, [rnd.random(), rnd.choice([*odd, rnd.random()]), float(rnd.randrange(4))], rnd.choice("abc"), rnd.gauss(0, 3), rnd.randrange(4), [rnd.random() - 0.5 for _ in range(3)], rnd.gauss(0, 1))
        for i in range(n)
    ]


def test_cells_and_verdicts_are_those_of_the_sql_form(spark):
    rows = cut(spark.createDataFrame(_leaf_rows(), "leaf int, seq long, x array<double>, label string, yc double, w int, z array<double>, g double"))
    wanted = rows.groupBy("leaf").agg(F.count("*").cast("double").alias("ask")).withColumn("tree_id", F.lit(2))
    cuts = cut(trees.fresh_cuts(rows, wanted))
    held = cuts.orderBy("leaf").collect()
    cells = cut(kernels.tally(rows, np.arange(7), [r["cuts"] for r in held]))
    named = F.lit("m").alias("model_id"), F.lit(2).alias("tree_id"), F.col("leaf").alias("node_id")
    bins = rows.join(cuts, "leaf").select(*named, "label", F.col("yc").alias("y"), F.lit(0.0).alias("y0"), "w", "g", "z", F.expr(ss.cut_bins("x", "cuts")).alias("bins"))
    stats = cut(ss.collect(bins))
    key = lambda r, node: (r[node], r["pos"], r["bin"], r["label"])
    got = cells.groupBy("leaf", "pos", "bin", "label").agg(*[F.sum(c).alias(c) for c in (*ss.SUMS, "sg", "rows")]).collect()
    got = {key(r, "leaf"): [r[c] for c in (*ss.SUMS, "sg", "rows")] for r in got}
    want = {key(r, "node_id"): [r[c] for c in (*ss.SUMS, "sg", "rows")] for r in stats.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    for algorithm, task, features in ((1, C, 0), (4, C, 2), (8, R, 0), (10, R, 0)):
        models = spark.createDataFrame([("m", algorithm, task, {"tieThreshold": "0.4", "gracePeriod": "150", "mFeaturesPerTreeSize": str(features)})], "model_id string, algorithm_id int, task_type string, hyper_params map<string,string>")
        params = ss.settings(models)
        nodes = stats.select(*ss.NODE).distinct().withColumn("last_n", F.col("node_id") * 10.0)
        want = {r["node_id"]: r for r in ss.decide(stats, nodes, params).collect()}
        p, ids = params.first(), np.arange(7)
        about = {name: np.full(7, p[c]) for name, c in (("grace", "grace"), ("delta", "delta"), ("tau", "tau"), ("regression", "regression"), ("algorithm", "algorithm_id"), ("m_features", "m_features"))}
        got = {r["leaf"]: r for r in kernels.judge(cells.coalesce(1), {**about, "ids": ids, "tree": np.full(7, 2), "node": ids, "last_n": ids * 10.0}).collect()}
        assert got.keys() == want.keys() and any(r["split"] for r in want.values())
        for k, r in want.items():
            assert (got[k]["split"], got[k]["pos"], got[k]["bin"], got[k]["seen"]) == (r["split"], r["pos"], r["bin"], r["seen"]), (algorithm, k)


def test_poisson_weights_by_arrays(spark):
    df = spark.range(5000).selectExpr("id * 7919 - 3 AS seq", "int(id % 9) AS tree_id")
    assert df.where(kernels.poisson_weights(F.col("seq"), F.col("tree_id")) != poisson_weight("seq", "tree_id")).count() == 0


def test_rows_do_not_carry_their_trees_and_levels_take_few_jobs(spark, make_records):
    """Trees of thousands of nodes were copied into every routed row, and a level of a tree took about fifty jobs."""
    rnd = random.Random(6)
    rows = [("s", "d", str(i), {"a": (a := rnd.random()), "b": rnd.random(), "y": 10 * np.sin(9 * a)}) for i in range(3000)]
    records = cut(make_records(rows))
    active = cut(control.fold_requests(tables.create_requests(records, [(8, "FIMT-DD", "y", R, {})], per_stream=False)))
    done = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    before = done()
    fitted = batch.fit(active, records)
    state = fitted.states["trees"]
    levels = state["nodes"].agg(F.max("depth")).first()[0] + 1
    assert levels >= 5 and done() - before < 15 * levels + 90
    instances = spark.createDataFrame([(active.first()["model_id"], 1, [0.2, None]), (active.first()["model_id"], 2, [0.9, 0.1])], "model_id string, seq long, x array<double>")
    routed = trees.route(instances, trees.compile_trees(state), state["edges"])
    assert not {"threshold", "h_threshold", "feature", "child"} & set(routed.columns)
    compiled = cut(trees.compile_trees(state))
    plain = instances.join(compiled, "model_id").selectExpr("seq", f"{trees.leaf_sql()} AS leaf").collect()
    assert {(r["seq"], r["leaf"]) for r in plain} == {(r["seq"], r["node_id"]) for r in routed.collect()}


@pytest.mark.parametrize(("wanted", "chunks"), [((8, "FIMT-DD", "y", R, {}), 1), ((6, "HAT", "lab", C, {}), 3)], ids=["FIMT-DD", "HAT"])
def test_reactions_to_drift_change_what_few_chunks_answer(spark, make_records, monkeypatch, wanted, chunks):
    """In one chunk no detector was asked, in three none in time: with or without reactions the answers were the same."""
    rnd = random.Random(12)
    rows = []
    for i in range(3600):
        a, b = rnd.random(), rnd.random()
        high = (a > 0.5) != (i >= 1200)
        rows.append(("s", "d", str(i), {"a": a, "b": b, "lab": "hot" if high else "cold", "y": 100.0 * high + b}))
    records = cut(make_records(rows))
    plain, got = trees.adapt_subtrees, []
    active = cut(control.fold_requests(tables.create_requests(records, [wanted], per_stream=False)))
    known = active.select("model_id", F.array(F.lit("a"), F.lit("b")).alias("features"))
    for react in (plain, lambda state, params: state):
        monkeypatch.setattr(trees, "adapt_subtrees", react)
        fitted = batch.fit(active, records, chunks, schemas=known)
        got.append({r["recordID"]: r["prediction"] for r in batch.answer(fitted, records).collect()})
    assert len(got[0]) == len(got[1]) == 3600
    assert any(got[0][k] != got[1][k] for k in got[0])


def test_trees_without_rows(spark, make_records):
    records = cut(make_records([("s", "d", str(i), {"a": float(i % 7), "lab": "xy"[i % 2]}) for i in range(40)]))
    active = cut(control.fold_requests(tables.create_requests(records, [(1, "HoeffdingTree", "lab", C, {})], per_stream=False)))
    none = batch.fit(active, records.where("seq < 0"), schemas=active.select("model_id", F.array(F.lit("a")).alias("features")))
    assert batch.answer(none, records).count() == 0
    gap = batch.fit(active, records.where("seq < 5 OR seq > 35"), 6, previous=none)
    assert batch.answer(gap, records).count() == 40
