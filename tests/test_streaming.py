import json

import pytest
from pyspark.sql import functions as F

from voxmill.operators import control
from voxmill.plans import batch
from voxmill.sources import records as R
from voxmill.sources import tables
from voxmill.streaming.engine import Engine, both_kinds


def _record(i, recorded=True):
    fields = {"a": i % 7 + i / 1000, "b": (i * 3) % 5, "lab": "x" if i % 7 > 3 else "y"}
    return {"streamID": "s", "dataSetKey": "d", "recordID": str(i) if recorded else "", "fields": fields}


def _request(command, algorithm, name, params=None):
    return {"commandType": command, "algorithmID": algorithm, "algorithmType": name, "streamID": "", "dataSetKey": "d", "hyperParams": params or {}, "target": "lab", "taskType": "classification"}


@pytest.fixture
def flow(spark, tmp_path):
    for d in ("train", "pred", "req"):
        (tmp_path / d).mkdir()

    class Flow:
        log = [_request("Create", 2, "Naive-Bayes"), _request("Create", 3, "kNN", {"k": 3})]
        engine = Engine(spark, str(tmp_path / "state"), lambda: R.read_requests(spark, str(tmp_path / "req")), save_every=50)

        def put(self, folder, name, rows):
            (tmp_path / folder / f"{name}.json").write_text("\n".join(json.dumps(r) for r in rows) + "\n")

        def run(self):
            (tmp_path / "req" / "log.json").write_text(json.dumps(self.log))
            stream = both_kinds(R.stream_records(spark, str(tmp_path / "train")), R.stream_records(spark, str(tmp_path / "pred")))
            self.engine.start(stream, str(tmp_path / "checkpoint")).awaitTermination()

        def count(self, table):
            return self.engine.table(table).count()

    return Flow()


def test_hold_train_answer_load(spark, flow, make_records):
    flow.put("pred", "p0", [_record(i) for i in range(1000, 1030)] + [{"broken": 1}])
    flow.run()
    assert flow.count("ensemble") == 0 and flow.count("rejects") == 1  # no model yet: held
    flow.put("train", "t0", [_record(i, False) for i in range(200)])
    flow.run()
    assert flow.count("ensemble") == 30

    training = make_records([("s", "d", "", _record(i)["fields"]) for i in range(200)])
    asked = make_records([("s", "d", str(i), _record(i)["fields"]) for i in range(1000, 1030)])
    wanted = [(2, "Naive-Bayes", "lab", "classification", {}), (3, "kNN", "lab", "classification", {"k": 3})]
    active = control.fold_requests(tables.create_requests(training, wanted, per_stream=False))
    fitted = batch.fit(active, training)
    want = sorted((r["recordId"], r["finalPrediction"]) for r in batch.vote(batch.answer(fitted, asked), active).collect())
    got = sorted((r["recordId"], r["finalPrediction"]) for r in flow.engine.table("ensemble").collect())
    assert got == want  # the stream gives what the batch gives
    m = flow.engine.classification_metrics().first()
    assert m["samples"] == 30 and m["accuracy"] > 0.8

    # a new learner without training: its answers are held, records stay open
    flow.log = flow.log + [_request("Create", 1, "HoeffdingTree"), _request("Load", 2, "Naive-Bayes")]
    flow.put("pred", "p1", [_record(i) for i in range(2000, 2010)])
    flow.run()
    assert flow.count("ensemble") == 30
    loads = flow.engine.table("loads").collect()
    assert [r["loaded"] for r in loads] == [True]
    # deleting the learner completes them in the next batch
    flow.log = flow.log + [_request("Delete", 1, "HoeffdingTree")]
    flow.put("pred", "p2", [_record(i) for i in range(3000, 3005)])
    flow.run()
    assert flow.count("ensemble") == 45
    # replaying a batch changes nothing
    batch_id = flow.engine.table("input").agg(F.max("batch_id")).first()[0]
    rows = flow.engine.table("input").where(F.col("batch_id") == batch_id).drop("batch_id").collect()
    flow.engine.process(spark.createDataFrame(rows, flow.engine.table("input").drop("batch_id").schema), batch_id)
    assert flow.count("ensemble") == 45 and flow.engine.classification_metrics().first()["samples"] == 45


def test_order_rejects_expiry_and_second_life(spark, flow, tmp_path):
    flow.engine.horizon = 0
    flow.engine.process(both_kinds(*[_plain(spark, []) for _ in range(2)]), 69_999)
    held = _plain(spark, [("s", "d", "7", {"a": "1", "lab": "x"})]).withColumn("seq", F.lit(5).cast("long"))
    lost = _plain(spark, [("s", "d", "8", {"a": "1", "lab": "x"})]).withColumn("seq", F.lit(None).cast("long"))
    (tmp_path / "req" / "log.json").write_text(json.dumps(flow.log))
    none = held.limit(0)
    flow.engine.process(both_kinds(none, held.unionByName(lost)), 70_000)
    assert [r["recordID"] for r in flow.engine.table("rejects").collect()] == ["8"]  # no order
    flow.engine.process(both_kinds(none, none), 70_001)
    gone = flow.engine.table("expired").collect()
    assert {(r["recordID"], r["stage"]) for r in gone} == {("7", "prediction")} and len(gone) == 1
    # a model deleted and created again starts empty
    rows = _plain(spark, [("s", "d", "", {"a": str(i), "lab": "old"}) for i in range(10)])
    flow.engine.process(both_kinds(rows, rows.limit(0)), 70_002)
    flow.log = flow.log + [_request("Delete", 2, "Naive-Bayes"), _request("Create", 2, "Naive-Bayes")]
    (tmp_path / "req" / "log.json").write_text(json.dumps(flow.log))
    rows = _plain(spark, [("s", "d", "", {"a": str(i), "lab": "new"}) for i in range(10)])
    flow.engine.process(both_kinds(rows, rows.limit(0)), 70_003)
    state = flow.engine._latest("models", "bayes", 70_004)
    assert {r["label"] for r in state["stats"].collect()} == {"new"}
    seqs = [r["seq"] for r in flow.engine.table("input").where("batch_id >= 70002").orderBy("batch_id", "seq").collect()]
    assert seqs == sorted(set(seqs)) and max(seqs) < 1000


def _plain(spark, rows):
    return spark.createDataFrame(rows, "streamID string, dataSetKey string, recordID string, fields map<string,string>")
