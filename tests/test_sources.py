import json
import os

from voxmill.sources import delimited, records, sinks
from voxmill.operators import control, routing


def test_delimited(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "s-d.csv").write_text('a, b ,flag,word\n1,,true, hi \n2\n3,x,False,"q,9,9\n')
    (tmp_path / "sub" / "s2-d2-more.LOGS").write_text("v\n2147483648\nNaN\n")
    (tmp_path / "noscope.txt").write_text("a\n1\n")
    (tmp_path / "s-empty.csv").write_text("\n")
    (tmp_path / "s-skip.dat").write_text("a\n1\n")
    got = delimited.read_delimited(spark, str(tmp_path)).collect()
    by = {(r["streamID"], r["dataSetKey"], r["fields"].get("a") or r["fields"].get("v")): r["fields"] for r in got}
    assert by[("s", "d", "1")] == {"a": "1", "b": None, "flag": "true", "word": "hi"}
    assert by[("s", "d", "2")] == {"a": "2", "b": None, "flag": None, "word": None}
    assert by[("s", "d", "3")]["word"] == '"q'
    assert ("s2", "d2", "NaN") in by and len(got) == 5
    assert len({r["recordID"] for r in got}) == 5
    bad = {r["file_name"]: r["reason"] for r in delimited.rejected_files(spark, str(tmp_path)).collect()}
    assert bad == {"noscope.txt": "bad file name", "s-empty.csv": "no header"}
    delimited.convert(spark, str(tmp_path), str(tmp_path / "out"), "training")
    lines = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "out")).collect()]
    one = next(x for x in lines if x["fields"].get("a") == 1)
    assert one == {"streamID": "s", "dataSetKey": "d", "recordID": "", "fields": {"a": 1, "b": None, "flag": True, "word": "hi"}}


def test_records_and_requests(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.json").write_text('{"streamID":"s","dataSetKey":"d","recordID":"1","fields":{"x":189.2,"n":null,"b":true}}\nnot json\n{"dataSetKey":"d"}\n')
    good, bad = records.split_rejects(records.read_records(spark, str(tmp_path / "r")))
    assert good.first()["fields"] == {"x": "189.2", "n": None, "b": "true"}
    assert good.count() == 1 and bad.count() == 2
    (tmp_path / "q").mkdir()
    one = {"commandType": "Create", "algorithmID": 3, "algorithmType": "kNN", "streamID": "s", "dataSetKey": "d", "hyperParams": {"k": 5}, "target": "t", "taskType": "classification"}
    (tmp_path / "q" / "b.json").write_text(json.dumps([dict(one, commandType="Delete")], indent=1))
    (tmp_path / "q" / "a.json").write_text(json.dumps([one, dict(one, algorithmID=2, algorithmType="Naive-Bayes")], indent=1))
    log = records.read_requests(spark, str(tmp_path / "q"))
    assert [r["algorithm_type"] for r in control.fold_requests(log).collect()] == ["Naive-Bayes"]


def test_sinks(spark, make_records, tmp_path):
    rows = make_records([("s", "d", str(i), {"a": i}) for i in range(6)] + [("z", "d", "9", {"a": 1})])
    sinks.write_routed(routing.with_scopes(rows), "training", str(tmp_path / "out"))
    found = sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir())
    assert found == ["destination=DataTopic-d", "destination=DataTopic-s-d", "destination=DataTopic-z-d"]
    topics = sinks.topic_rows(routing.with_scopes(rows), "prediction")
    assert topics.where("topic = 'PredTopic-d'").count() == 7
    for _ in range(2):
        sinks.write_batch(rows, str(tmp_path), "t", 3)
    assert sinks.read_table(spark, str(tmp_path), "t").count() == 7
    assert sinks.read_table(spark, str(tmp_path), "missing") is None


def test_arrival_order_follows_file_time(spark, tmp_path):
    def put(name, n, when):
        path = tmp_path / name
        path.write_text("".join(json.dumps({"streamID": "s", "dataSetKey": "d", "recordID": f"{name}{i}", "fields": {"n": i}}) + "\n" for i in range(n)))
        os.utime(path, (when, when))

    put("b.json", 3, 1_000_000_000)  # oldest and smallest, last by name
    put("a.json", 300, 1_700_000_000)
    put("c.json", 2, 1_000_000_000)
    good, _ = records.split_rejects(records.read_records(spark, str(tmp_path)))
    got = [r["recordID"] for r in records.ordered(good).orderBy("seq").collect()]
    assert got == [f"b.json{i}" for i in range(3)] + [f"c.json{i}" for i in range(2)] + [f"a.json{i}" for i in range(300)]
    by_field = records.ordered(good, seq="n")
    assert by_field.where("seq IS NULL").count() == 0
    kept, lost = records.split_unordered(records.ordered(good, seq="missing"))
    assert kept.count() == 0 and lost.count() == 305


def test_broken_request_files_are_listed(spark, tmp_path):
    one = {"commandType": "Create", "algorithmID": 3, "algorithmType": "kNN", "streamID": "s", "dataSetKey": "d", "hyperParams": {}, "target": "t", "taskType": "classification"}
    (tmp_path / "a.json").write_text(json.dumps([one]))
    (tmp_path / "b.json").write_text('[{"commandType": "Create", ')
    (tmp_path / "c.json").write_text("no json")
    assert records.read_requests(spark, str(tmp_path)).count() == 1
    assert sorted(r["file"][-6:] for r in records.rejected_request_files(spark, str(tmp_path)).collect()) == ["b.json", "c.json"]
