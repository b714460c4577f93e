import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxmill.learners import bayes, drift, linear, neighbours, split_stats as ss, trees
from voxmill.learners.base import with_chunks
from voxmill.operators import control
from voxmill.plans import batch, inputs
from voxmill.plans.queries import CATALOG
from voxmill.session import cut, stage
from voxmill.sources import registry, tables

C, R = "classification", "regression"


def _rows(n, target, seed=0):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        a, b, c = rnd.random(), rnd.random(), rnd.random()
        fields = {"a": a, "b": b, "c": None if rnd.random() < 0.05 else c}
        if target == "lab":
            fields["lab"] = "hot" if a + 0.3 * b > 0.65 else "cold"
        else:
            fields["y"] = 10 * (a > 0.5) + 5 * b
        out.append(("s", "d", str(i), fields))
    return out


def _fit(records, wanted, chunks):
    active = cut(control.fold_requests(tables.create_requests(records, wanted, per_stream=False)))
    fitted = batch.fit(active, records, chunks)
    return active, fitted, cut(batch.answer(fitted, records))


def test_classifiers_beat_majority(spark, make_records):
    records = cut(make_records(_rows(2400, "lab")))
    wanted = [
        (1, "HoeffdingTree", "lab", C, {}), (2, "Naive-Bayes", "lab", C, {}), (3, "kNN", "lab", C, {"k": 5}),
        (4, "Random-Forest", "lab", C, {"ensembleSize": 3}), (5, "Perceptron", "lab", C, {"learningRatio": 20}), (6, "HAT", "lab", C, {}),
        (7, "SGD", "lab", C, {"lossFunctionOption": 1, "learningRate": 3}),
    ]
    active, fitted, partials = _fit(records, wanted, 4)
    truth = records.select("recordID", F.col("fields")["lab"].alias("actual"))
    scored = partials.join(truth, "recordID").groupBy("algorithmType").agg(F.avg((F.col("actual") == F.col("prediction")).cast("int")).alias("acc"), F.count("*").alias("n"))
    got = {r["algorithmType"]: (r["acc"], r["n"]) for r in scored.collect()}
    majority = max(r["count"] for r in truth.groupBy("actual").count().collect()) / 2400
    assert set(got) == {w[1] for w in wanted}
    for name, (acc, n) in got.items():
        assert n == 2400 and acc > majority + 0.05, (name, acc, majority)
    results = batch.vote(partials, active)
    assert results.count() == 2400


def test_regressors_beat_mean(spark, make_records):
    records = cut(make_records(_rows(2400, "y")))
    wanted = [
        (3, "kNN", "y", R, {"k": 5}), (8, "FIMT-DD", "y", R, {}), (9, "AMRules", "y", R, {}),
        (10, "Random-Forest-Regressor", "y", R, {"ensembleSize": 3}), (7, "SGD", "y", R, {"lossFunctionOption": 2, "learningRate": 0.5}),
    ]
    _, _, partials = _fit(records, wanted, 4)
    truth = records.select("recordID", F.col("fields")["y"].cast("double").alias("actual"))
    err = F.sqrt(F.avg(F.pow(F.col("actual") - F.col("prediction").cast("double"), 2)))
    got = {r["algorithmType"]: r["e"] for r in partials.join(truth, "recordID").groupBy("algorithmType").agg(err.alias("e")).collect()}
    sd = truth.agg(F.stddev_pop("actual")).first()[0]
    assert set(got) == {w[1] for w in wanted}
    for name, e in got.items():
        assert e < 0.9 * sd, (name, e, sd)


def test_bayes_merge_is_exact(spark, make_records):
    records = make_records(_rows(900, "lab", 5))
    active = inputs.active_for(records, [(2, "Naive-Bayes", "lab", C, {})], per_stream=False)
    instances = cut(with_chunks(inputs.instances_for(records, active), 3))
    whole = {(r["label"], r["pos"]): r for r in bayes.batch_stats(instances).collect()}
    merged = bayes.batch_stats(instances.where("chunk = 0"))
    for c in (1, 2):
        merged = bayes.merge_stats(merged, bayes.batch_stats(instances.where(f"chunk = {c}")))
    rows = merged.collect()
    assert len(rows) == len(whole)
    for r in rows:
        w = whole[(r["label"], r["pos"])]
        assert r["n"] == w["n"] and math.isclose(r["mean"], w["mean"], abs_tol=1e-12) and math.isclose(r["m2"], w["m2"], abs_tol=1e-9)


def test_neighbours_against_brute_force(spark, make_records, monkeypatch):
    rows = _rows(300, "lab", 7)
    records = make_records(rows)
    wanted = [(3, "kNN", "lab", C, {"k": 3, "limitOption": 120})]
    active, fitted, partials = _fit(records, wanted, 1)
    one = {r["recordID"]: r["prediction"] for r in partials.collect()}
    monkeypatch.setattr(neighbours, "BROADCAST_CELLS", 0)
    monkeypatch.setattr(neighbours, "ROWS_PER_GROUP", 70)
    two = {r["recordID"]: r["prediction"] for r in batch.answer(fitted, records).collect()}
    names = ["a", "b", "c"]
    x = np.array([[np.nan if f[n] is None else f[n] for n in names] for *_, f in rows], dtype=float)
    labels = [f["lab"] for *_, f in rows]
    held = range(180, 300)
    span = np.nanmax(x[180:], axis=0) - np.nanmin(x[180:], axis=0)
    for i in range(300):
        d = []
        for j in held:
            t = ((x[i] - x[j]) / span) ** 2
            d.append((round(float(np.sqrt(np.where(np.isnan(t), 1.0, t).sum())), 9), j))
        near = [labels[j] for _, j in sorted(d)[:3]]
        best = min(set(near), key=lambda l: (-near.count(l), l))
        assert one[str(i)] == best and two[str(i)] == best


def test_page_hinkley_and_adwin_fire_on_a_jump(spark):
    rnd = random.Random(1)
    rows = [("steady", i, rnd.gauss(0.3, 0.05)) for i in range(400)] + [("jump", i, rnd.gauss(0.1 if i < 200 else 0.9, 0.05)) for i in range(400)]
    s = cut(spark.createDataFrame(rows, "k string, seq long, x double"))
    alarms = {r["k"]: r["first_alarm"] for r in drift.page_hinkley_alarms(s, ["k"], threshold=5.0, width=64).collect()}
    assert alarms["steady"] is None and 200 < alarms["jump"] < 220
    b = s.groupBy("k", F.floor(F.col("seq") / 20).alias("b")).agg(F.count("*").cast("double").alias("n"), F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("sxx"))
    cuts = {r["k"]: (r["cut_at"], r["rose"]) for r in drift.adwin(b, ["k"], "b").collect()}
    assert cuts["steady"][0] is None and cuts["jump"][0] is not None and cuts["jump"][1]


def _plain_window(rows, delta):
    """Adaptive window by its definition: add a tick, merge overflowing levels, drop while two means differ."""
    b, cuts = [], []
    for at, x in rows:
        b.append([0, float(len(x)), sum(x), sum(v * v for v in x), at])
        for k in range(20):
            held = [i for i, e in enumerate(b) if e[0] == k]
            if len(held) > drift.CAPACITY:
                i = held[0]
                p, q = b[i], b[i + 1]
                b[i : i + 2] = [[k + 1, p[1] + q[1], p[2] + q[2], p[3] + q[3], q[4]]]
        had = sum(e[1] for e in b)
        while len(b) > 1:
            n, s, q = (sum(e[j] for e in b) for j in (1, 2, 3))
            var, spread, hit, n0, s0 = max(q / n - (s / n) ** 2, 0), math.log(2 * max(math.log(n), 1) / delta), False, 0, 0
            for e in b[:-1]:
                n0, s0 = n0 + e[1], s0 + e[2]
                inv = 1 / n0 + 1 / (n - n0)
                hit = hit or abs(s0 / n0 - (s - s0) / (n - n0)) > math.sqrt(2 * inv * var * spread) + 2 / 3 * inv * spread
            if not hit:
                break
            b.pop(0)
        now = sum(e[1] for e in b)
        if now < had:
            cuts.append((at, had - now, now))
    return b, cuts


def test_windows_by_their_definition_and_in_two_updates(spark):
    rnd = random.Random(3)
    series = {"flat": [rnd.random() for _ in range(3000)], "jumps": [rnd.random() * 0.3 + 0.5 * (i // 700 % 2) for i in range(3000)]}
    rows = [(k, i, v) for k, vs in series.items() for i, v in enumerate(vs)]
    df = cut(spark.createDataFrame(rows, "k string, seq long, x double"))
    state, cuts = drift.adwin_windows(drift.ticks(df, ["k"]), ["k"])
    half, early = drift.adwin_windows(drift.ticks(df.where("seq < 1600"), ["k"]), ["k"])
    again, late = drift.adwin_windows(drift.ticks(df.where("seq >= 1600"), ["k"]), ["k"], state=half)
    for k, vs in series.items():
        want, dropped = _plain_window([(min(i + 31, 2999), vs[i : i + 32]) for i in range(0, 3000, 32)], drift.DELTA)
        for s, c in ((state, cuts.collect()), (again, early.collect() + late.collect())):
            got = sorted((r["at"], r["level"], r["n"], r["sx"]) for r in s.where(F.col("k") == k).collect())
            assert [g[:3] for g in got] == [(e[4], e[0], e[1]) for e in want] and np.allclose([g[3] for g in got], [e[2] for e in want])
            assert sorted((r["at"], r["dropped"], r["kept"]) for r in c if r["k"] == k) == dropped
        assert len(want) <= drift.CAPACITY * 10 and bool(dropped) == (k == "jumps")
    # a compacted table holds every row, in few buckets
    fine = df.selectExpr("k", "0 AS level", "seq AS at", "1D AS n", "x AS sx", "x * x AS sxx")
    small = {r["k"]: r for r in drift.compact(fine, ["k"]).groupBy("k").agg(F.count("*").alias("c"), F.sum("n").alias("n"), F.sum("sx").alias("s")).collect()}
    assert all(r["n"] == 3000 and r["c"] <= 5 * 12 and math.isclose(r["s"], sum(series[k])) for k, r in small.items())


def test_page_hinkley_restarts_for_any_width(spark):
    rnd = random.Random(2)
    rows = [("a", 3 * i, rnd.random() + 0.6 * (i // 300 % 2)) for i in range(2000)] + [("calm", i, 0.5) for i in range(500)] + [("a", 7, None)]
    df = cut(spark.createDataFrame(rows, "k string, seq long, x double"))
    want, n, total, m, low = [], 0, 0.0, 0.0, None
    for _, at, x in sorted(r for r in rows if r[0] == "a" and r[2] is not None):
        n, total = n + 1, total + x
        m += x - total / n - drift.ALPHA
        low = m if low is None else min(low, m)
        if m - low > 2.0:
            want.append(at)
            n, total, m, low = 0, 0.0, 0.0, None
    assert len(want) > 3
    for width in (3000, 1 << 16):
        got = drift.page_hinkley_restarts(df, ["k"], threshold=2.0, width=width).collect()
        assert [r["at"] for r in sorted(got, key=lambda r: r["alarm"])] == want and {r["k"] for r in got} == {"a"}
    assert drift.page_hinkley_restarts(df.where("k = 'calm'"), ["k"]).count() == 0


def test_forest_and_subtree_reactions(spark, make_records):
    """A flipped concept makes the forest swap trees and HAT grow an alternate."""
    rnd = random.Random(11)
    rows = []
    for i in range(4000):
        a, b = rnd.random(), rnd.random()
        hot = (a > 0.5) != (i >= 2400)
        rows.append(("s", "d", str(i), {"a": a, "b": b, "lab": "hot" if hot else "cold"}))
    records = cut(make_records(rows))
    wanted = [(4, "Random-Forest", "lab", C, {"ensembleSize": 2}), (6, "HAT", "lab", C, {})]
    active, fitted, partials = _fit(records, wanted, 10)
    roster = fitted.states["trees"]["roster"].join(active, "model_id").collect()
    forest = [r for r in roster if r["algorithm_type"] == "Random-Forest"]
    assert sorted(r["slot"] for r in forest if r["role"] == "main") == [0, 1]
    assert any(r["tree_id"] >= 2 for r in forest)
    hat = [r for r in roster if r["algorithm_type"] == "HAT"]
    ids = fitted.states["trees"]["ids"].join(active.where("algorithm_type = 'HAT'"), "model_id").first()
    assert len([r for r in hat if r["role"] == "main"]) == 1 and ids["last_id"] >= 1
    late = records.where("seq >= 3600").select("recordID", F.col("fields")["lab"].alias("actual"))
    acc = partials.join(late, "recordID").groupBy("algorithmType").agg(F.avg((F.col("actual") == F.col("prediction")).cast("int")).alias("acc")).collect()
    assert all(r["acc"] > 0.6 for r in acc), acc


def _plain_rounds(x, y, eta, lam, size):
    """Squared loss, slice by slice in rounds of 1, 2, 4, ... slices, by plain loops."""
    w, b, at, width = np.zeros(x.shape[1]), 0.0, 0, 1
    while at < len(x):
        made = []
        for lo in range(at, min(len(x), at + width * size), size):
            v, c = w.copy(), b
            for i in range(lo, min(len(x), lo + size)):
                g = y[i] - (c + v @ x[i])
                v, c = (1 - eta * lam) * v + eta * g * x[i], c + eta * g
            made.append((min(size, len(x) - lo), v, c))
        n = sum(m[0] for m in made)
        w, b = sum(m[0] * m[1] for m in made) / n, sum(m[0] * m[2] for m in made) / n
        at, width = at + width * size, 2 * width
    return w, b


def _line(n):
    rnd = random.Random(8)
    rows = []
    for i in range(n):
        a, b = rnd.random(), rnd.random()
        rows.append(("s", "d", str(i), {"a": a, "b": b, "y": 3 * a - 2 * b + 1}))
    return rows


def test_linear_steps_follow_the_rows(spark, make_records, monkeypatch):
    monkeypatch.setattr(linear, "SLICE", 20)
    losses = []
    for n in (60, 600):
        rows = _line(n)
        records = cut(make_records(rows))
        active = inputs.active_for(records, [(7, "SGD", "y", R, {"lossFunctionOption": 2, "learningRate": 0.05, "lambdaRegularization": 0.01})], per_stream=False)
        instances = inputs.instances_for(records, active)
        got = [linear.Linear().update(None, instances, active, chunks)["weights"].first() for chunks in (1, 3)]
        x = np.array([[f["a"], f["b"]] for *_, f in rows])
        y = np.array([f["y"] for *_, f in rows])
        w, b = _plain_rounds(x, y, 0.05, 0.01, 20)
        for g in got:
            assert np.allclose(g["w"], w, atol=1e-12) and math.isclose(g["b"], b, abs_tol=1e-12)
        losses.append(float(np.mean((x @ w + b - y) ** 2)))
    assert losses[1] < 0.6 * losses[0]


def test_neighbours_grade_few_pairs_and_answer_by_the_definition():
    rng = np.random.default_rng(4)
    held, asked = rng.integers(0, 30, (600, 3)).astype(float), rng.integers(-2, 33, (700, 3)).astype(float)
    held[::9, 0], asked[::7, 2], asked[3, 1], asked[4, 1] = np.nan, np.nan, np.inf, 1e200
    rows = neighbours.pd.DataFrame({"seq": np.arange(600), "x": list(held), "label": rng.choice(list("abc"), 600), "y": rng.normal(size=600)})
    span = np.nanmax(held, axis=0) - np.nanmin(held, axis=0)
    with np.errstate(all="ignore"):
        apart = np.stack([np.where(np.isnan(d := asked[:, None, j] - held[None, :, j]), 1.0, (d / span[j]) ** 2) for j in range(3)], axis=2)
        far = np.round(np.sqrt(apart.sum(axis=2)), 9)
    near = np.argsort(far, axis=1, kind="stable")[:, :5]
    memory = neighbours._Memory(rows, 5, False)
    labels = rows["label"].to_numpy()
    assert memory.answer(asked) == [max(sorted(set(labels[n])), key=list(labels[n]).count) for n in near]
    assert memory.graded < far.size // 20
    means = [float(v) for v in neighbours._Memory(rows, 5, True).answer(asked)]
    assert np.allclose(means, rows["y"].to_numpy()[near].mean(axis=1))


def test_linear_rows_without_truth_change_nothing(spark):
    rows = [("m", i, [0.1 * i, None if i % 3 else 1.0], None if i % 4 == 0 else ("a" if i % 2 else "b"), None) for i in range(30)]
    df = spark.createDataFrame(rows, "model_id string, seq long, x array<double>, label string, y double")
    models = spark.createDataFrame([("m", "SGD", "classification", {"lossFunctionOption": "1", "learningRate": "0.1"})], "model_id string, algorithm_type string, task_type string, hyper_params map<string,string>")
    whole = linear.Linear().update(None, df, models)["weights"].first()
    known = linear.Linear().update(None, df.where("label IS NOT NULL"), models)["weights"].first()
    assert np.allclose(whole["w"], known["w"]) and np.isfinite(whole["w"]).all()


def _wave(n, spread=1.0):
    rnd = random.Random(21)
    out = []
    for i in range(n):
        a, b = rnd.random(), rnd.random() ** 3
        a = spread if i == 5 else a
        out.append(("s", "d", str(i), {"a": a, "b": b, "lab": "hot" if (a > 0.5) == (b < 0.4) or a > 0.9 else "cold", "y": 10 * math.sin(9 * a) + 20 * b}))
    return out


def _tree_run(make_records, rows):
    """Both trees with default arguments in one chunk: depth and error of each, and all thresholds."""
    records = cut(make_records(rows))
    wanted = [(1, "HoeffdingTree", "lab", C, {}), (8, "FIMT-DD", "y", R, {})]
    # the targets must not be features of each other
    active = cut(control.fold_requests(tables.create_requests(records, wanted, per_stream=False)))
    known = active.select("model_id", F.array(F.lit("a"), F.lit("b")).alias("features"))
    fitted = batch.fit(active, records, schemas=known)
    truth = records.select("recordID", F.col("fields")["lab"].alias("lab"), F.col("fields")["y"].cast("double").alias("y"))
    scored = batch.answer(fitted, records).join(truth, "recordID")
    wrong = F.when(F.col("algorithmType") == "FIMT-DD", F.abs(F.col("prediction").cast("double") - F.col("y"))).otherwise((F.col("prediction") != F.col("lab")).cast("double"))
    errors = {r["algorithmType"]: r["e"] for r in scored.groupBy("algorithmType").agg(F.avg(wrong).alias("e")).collect()}
    nodes = fitted.states["trees"]["nodes"].join(active.select("model_id", "algorithm_type"), "model_id")
    depths = {r["algorithm_type"]: r["d"] for r in nodes.groupBy("algorithm_type").agg(F.max("depth").alias("d")).collect()}
    splits = {(r["algorithm_type"], r["node_id"], r["feature"], r["threshold"]) for r in nodes.where("child >= 0").collect()}
    return depths, errors, splits


def test_ten_times_the_rows_give_a_deeper_tree_and_a_smaller_error(spark, make_records):
    small, large = _tree_run(make_records, _wave(400)), _tree_run(make_records, _wave(4000))
    for name in ("HoeffdingTree", "FIMT-DD"):
        assert large[0][name] > small[0][name] >= 1, (name, small[0], large[0])
        assert large[1][name] < small[1][name], (name, small[1], large[1])


def test_one_outlier_changes_no_split(spark, make_records):
    plain, odd = _tree_run(make_records, _wave(500, 0.5)), _tree_run(make_records, _wave(500, 1e9))
    assert plain[2] and {s[:3] for s in plain[2]} == {s[:3] for s in odd[2]}
    near = {s[:3]: s[3] for s in plain[2]}
    assert all(abs(near[s[:3]] - s[3]) < 0.01 for s in odd[2])


def test_cuts_are_quantiles_and_bins_count_them(spark):
    rnd = random.Random(4)
    rows = [("m", i, [rnd.gauss(0, 1), float(rnd.randrange(3)), None if i % 2 else 1e6 * rnd.random()]) for i in range(400)]
    df = spark.createDataFrame(rows, "model_id string, seq long, x array<double>")
    got = df.groupBy("model_id").agg(F.collect_list("x").alias("s")).selectExpr("model_id", f"{ss.quantile_cuts('s')} AS cuts")
    cuts = got.first()["cuts"]
    for p in range(3):
        v = sorted(r[2][p] for r in rows if r[2][p] is not None)
        assert cuts[p] == sorted({v[math.ceil(j * len(v) / 32) - 1] for j in range(1, 32)})
    for r in df.join(got, "model_id").selectExpr("x", f"{ss.cut_bins('x', 'cuts')} AS b").collect():
        assert r["b"] == [0 if v is None else sum(c < v for c in cuts[p]) for p, v in enumerate(r["x"])]
    many = spark.range(200_000).selectExpr("id AS seq")
    assert 300 < many.where(ss.drawn("200000D", "1")).count() < 800 and many.where(ss.drawn("512D", "1")).count() == 200_000


def test_outgrown_cuts_are_renewed(spark, make_records):
    """A first chunk of a few rows does not fix the thresholds for good."""
    rows = _wave(1500)
    records = cut(make_records(rows))
    active = cut(control.fold_requests(tables.create_requests(records, [(1, "HoeffdingTree", "lab", C, {})], per_stream=False)))
    first = batch.fit(active, records.where("seq < 12"))
    both = batch.fit(active, records.where("seq >= 12"), previous=first)
    assert first.states["trees"]["cuts"].first()["cut_n"] == 12
    assert both.states["trees"]["nodes"].agg(F.max("depth")).first()[0] >= 2
    held = both.states["trees"]["stats"].where("pos < 0").agg(F.sum("n")).first()[0]
    assert held <= 1500


def test_graft_keeps_the_tree_consistent(spark):
    node = "model_id string, tree_id int, node_id int, "
    nodes = [("m", 0, 0, 0, 0.5, 1, 0, 0.0), ("m", 0, 1, -1, None, -1, 1, 0.0), ("m", 0, 2, 1, 0.5, 3, 1, 0.0), ("m", 0, 3, -1, None, -1, 2, 0.0), ("m", 0, 4, -1, None, -1, 2, 0.0)]
    alt = [("m", 7, 0, 2, 0.25, 1, 0, 0.0), ("m", 7, 1, -1, None, -1, 1, 0.0), ("m", 7, 2, -1, None, -1, 1, 0.0)]
    stats = [("m", 0, n, -1, 0, l, 5.0, 0.0, 0.0) for n, l in ((1, "a"), (3, "b"), (4, "c"))] + [("m", 7, 1, -1, 0, "d", 5.0, 0.0, 0.0), ("m", 7, 2, -1, 0, "e", 5.0, 0.0, 0.0)]
    state = {
        "nodes": spark.createDataFrame(nodes + alt, node + "feature int, threshold double, child int, depth int, last_n double"),
        "stats": spark.createDataFrame(stats, node + "pos int, bin int, label string, n double, sy double, syy double"),
        "leaf_models": spark.createDataFrame([], node + "pos int, weight double"),
        "errors": spark.createDataFrame([], node + "at long, n double, sx double, sxx double"),
        "cuts": spark.createDataFrame([("m", 7, 1, [[0.1]], 5.0)], node + "cuts array<array<double>>, cut_n double"),
        "roster": spark.createDataFrame([("m", 0, 0, "main", -1, -1, -1)], "model_id string, tree_id int, slot int, role string, host_tree int, host_node int, since long"),
    }
    swaps = spark.createDataFrame([("m", 7, 0, 2)], "model_id string, tree_id int, host_tree int, host_node int")
    out = trees._graft(state, swaps)
    compiled = trees.compile_trees({**out}).where("tree_id = 0")
    points = spark.createDataFrame([("m", [0.1, 0.0, 0.0]), ("m", [0.9, 0.0, 0.1]), ("m", [0.9, 0.9, 0.9])], "model_id string, x array<double>")
    got = points.join(compiled, "model_id").selectExpr("x", f"get(vote, {trees.leaf_sql()}) AS v").collect()
    assert {tuple(r["x"]): r["v"] for r in got} == {(0.1, 0.0, 0.0): "a", (0.9, 0.0, 0.1): "d", (0.9, 0.9, 0.9): "e"}


def test_save_and_load(spark, make_records, tmp_path):
    records = cut(make_records(_rows(400, "lab", 9)))
    wanted = [(2, "Naive-Bayes", "lab", C, {}), (3, "kNN", "lab", C, {})]
    _, fitted, partials = _fit(records, wanted, 1)
    for family, state in fitted.states.items():
        registry.save(state, str(tmp_path), family, 4)
    loaded = {f: registry.load(spark, str(tmp_path), f, 4) for f in fitted.states}
    assert registry.load(spark, str(tmp_path), "bayes", 5) is None
    again = batch.answer(batch.Fitted(fitted.active, fitted.schemas, loaded), records)
    key = lambda d: sorted((r["model_id"], r["recordID"], r["prediction"]) for r in d.collect())
    assert key(again) == key(partials)


def test_tree_rows_are_dealt_to_all_cores_and_each_level_reads_fewer(spark, make_records, monkeypatch):
    passes, plain = [], trees.fresh_cuts

    def counted(rows, wanted):
        passes.append((rows.rdd.getNumPartitions(), rows.count(), wanted.count()))
        return plain(rows, wanted)

    monkeypatch.setattr(trees, "fresh_cuts", counted)
    rnd = random.Random(3)  # a narrow band of one feature is a class: one side settles at once
    rows = [("s", "d", str(i), {"a": (a := rnd.random()), "b": rnd.random(), "lab": "in" if 0.8 < a < 0.9 else "out"}) for i in range(4000)]
    records = make_records(rows).coalesce(1)
    active = cut(control.fold_requests(tables.create_requests(records, [(1, "HoeffdingTree", "lab", C, {})], per_stream=False)))
    batch.fit(active, records)
    assert len(passes) >= 3 and passes[0][0] >= 4 and passes[0][1] == 4000
    assert passes[-1][1] < 4000 and all(a[1] >= b[1] for a, b in zip(passes, passes[1:]))


def test_restarting_detector_reads_its_rows_a_few_times_however_many_alarms(spark, monkeypatch):
    read, plain = [], drift._tracked

    def counted(series, *rest):
        read.append(series.count())
        return plain(series, *rest)

    monkeypatch.setattr(drift, "_tracked", counted)
    # an alarm in every slice of the first half, none in the second
    rows = [("k", i, 1.0 if i < 640 and i % 64 >= 32 else 0.0) for i in range(1280)] + [("late", 900, 0.5)]
    df = spark.createDataFrame(rows, "k string, seq long, x double")
    got = [r["at"] for r in drift.page_hinkley_restarts(df, ["k"], threshold=5.0, width=64).orderBy("alarm").collect()]
    n, s, m, low, want = 0, 0.0, 0.0, None, []
    for k, i, x in rows:
        if k != "k":
            continue
        n, s = n + 1, s + x
        m += x - s / n - drift.ALPHA
        low = m if low is None else min(low, m)
        if m - low > 5.0:
            want.append(i)
            n, s, m, low = 0, 0.0, 0.0, None
    assert got == want and len(want) >= 8
    assert sum(read) <= 2 * len(rows)


def test_root_statistics_parse_rows_once(spark, monkeypatch):
    """Ranges are found in one pass over staged rows; rows without features or target count as before."""
    rows = [("a", [1.0, None], 3.0), ("a", [4.0, 2.0], 5.0), ("a", None, 10.0), ("a", [0.0, 7.0], None), ("b", [], 1.0), ("c", [2.0], None)]
    made = stage(spark.createDataFrame(rows, "model_id string, x array<double>, y double"))
    edges = ss.bin_edges(made)
    assert edges._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    got = {r["model_id"]: (r["lo"], r["hi"], round(r["y0"], 9), round(r["ysd"], 9)) for r in edges.collect()}
    assert got == {"a": ([0.0, 2.0], [4.0, 7.0], 6.0, round((26 / 3) ** 0.5, 9)), "c": ([2.0], [2.0], 0.0, 0.0)}
    seen, real = [], ss.bin_edges
    monkeypatch.setattr(ss, "bin_edges", lambda instances: seen.append(instances) or real(instances))
    assert CATALOG["rule_expand"](spark, "/root/testdata/sf0.001").columns
    assert hasattr(seen[0], "_staged_at")
