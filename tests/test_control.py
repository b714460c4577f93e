from voxmill.operators import control, routing

REQ = (
    "commandType string, algorithmID int, algorithmType string, streamID string, dataSetKey string, "
    "hyperParams map<string,string>, target string, taskType string, seq long"
)


def _requests(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], REQ)


def _r(command, algorithm=2, name="Naive-Bayes", stream="s", data="d", params=None, target="t", task="Classification"):
    return (command, algorithm, name, stream, data, params or {}, target, task)


def test_fold_and_effective(spark):
    log = _requests(
        spark,
        [
            _r("Create"), _r("CREATE"), _r("delete"), _r("Delete"), _r("create"),
            _r("create", 3, "KNN", params={"k": "5", "limitOption": "9"}), _r("create", 3, "knn", params={"limitOption": "9", "k": "5"}),
            _r("delete", 1, "HoeffdingTree"), _r("load"), _r("load", 1, "HoeffdingTree"),
            _r("create", 3, "Naive-Bayes"), _r("drop"), _r("create", 99, "Oracle"), _r("create", 8, "FIMT-DD"), _r("create", stream="", data="d"),
        ],
    )
    active = control.fold_requests(log)
    got = {(r["scope"], r["algorithm_type"]): r["seq"] for r in active.collect()}
    assert got == {("s-d", "Naive-Bayes"): 4, ("s-d", "kNN"): 5, ("d", "Naive-Bayes"): 14}
    assert sorted(r["seq"] for r in control.effective_requests(log).collect()) == [0, 2, 4, 5, 8, 14]
    bad = {r["seq"]: r["reject"] for r in control.rejected_requests(log).collect()}
    assert bad == {10: "algorithm id mismatch", 11: "unknown command", 12: "unknown algorithm", 13: "task not supported"}
    gate = control.ensemble_gate(active).collect()
    assert [(r["scope"], r["n_models"]) for r in gate] == [("s-d", 2)]
    sizes = {r["scope"]: len(r["models"]) for r in control.membership(active).collect()}
    assert sizes == {"s-d": 2, "d": 1}
    assert [r["model_key"].startswith("s-d___Naive-Bayes") for r in control.saved_model_loads(log, active).collect()] == [True]


def test_routing(spark, make_records):
    active = control.fold_requests(_requests(spark, [_r("create"), _r("create", stream="")]))
    records = make_records([("s", "d", "1", {"a": 1}), ("z", "d", "2", {"a": 1}), ("", "d", "3", {"a": 1}), (None, "d", "4", {"a": 1}), ("s", "other", "5", {"a": 1})])
    got = sorted((r["recordID"], r["scope"]) for r in routing.route_to_models(records, active).collect())
    assert got == [("1", "d"), ("1", "s-d"), ("2", "d"), ("3", "d"), ("4", "d")]
