"""Ledgers against a plain list of rows, and the interval join that is built on them."""

import datetime
import math
import random

from pyspark.sql import functions as F

from voxmill.sources import records as R
from voxmill.sources import sinks
from voxmill.sources.ledger import Ledger
from voxmill.streaming.engine import ANSWERED, RECENT, Engine

START = datetime.datetime(2024, 3, 1)


def hours(n, seconds=0):
    return START + datetime.timedelta(hours=n, seconds=seconds)


def test_changes_only(spark, tmp_path):
    written = []

    class Counted(Ledger):
        def _put(self, name, change):
            made = super()._put(name, change)
            written.append(made.rows)
            return made

    book = Counted(spark, str(tmp_path), "open", "id string, part long, n long", ("id", "part"))
    assert book.at(-1).count() == 0
    rng, held, changes = random.Random(4), [], 0
    for b in range(12):
        added = [(f"{b}-{i}" if i else None, b % 2, i) for i in range(40)] + ([("again", 0, b)] if b % 3 == 0 else [])
        last = [r for r in held if rng.random() < 0.97]
        gone = sorted({(r[0], r[1]) for r in last}, key=str) + [("never", 0)]
        for _ in range(2 if b in (5, 9) else 1):  # a replay changes nothing
            book.write(b, spark.createDataFrame(added, book.schema), spark.createDataFrame(gone, "id string, part long"))
        changes += len(added) + len(gone)
        held = [r for r in held if (r[0], r[1]) not in gone] + added
        if b % 3 == 2:
            assert sorted(map(tuple, book.at(b).collect()), key=str) == sorted(held, key=str)
        assert len(book.segments(b)) <= 2 + math.log2(changes)
    assert sum(written) <= changes * math.log2(changes) / 2
    folders = {p.name for p in (tmp_path / "open" / "segments").iterdir()}
    assert folders <= {s.name for b in (10, 11) for s in book.segments(b)} | {"11_11"}
    book.write(12, book.at(11).limit(0), book.at(11).select("id", "part"))
    assert book.at(12).count() == 0


def test_rows_end_by_the_clock(spark, tmp_path):
    book = Ledger(spark, str(tmp_path), "recent", "id long, ts timestamp", ("id",), "ts")
    for b in range(8):
        rows = spark.createDataFrame([(10 * b + i, hours(b)) for i in range(4)] + [(1000 + b, hours(b - 9))], book.schema)
        book.write(b, rows, floor=F.lit(hours(b - 3)))
    live = {r["id"] for r in book.at(7).where(F.col("ts") >= F.lit(hours(4))).collect()}
    assert live == {10 * b + i for b in range(4, 8) for i in range(4)}
    assert book.at(7).count() <= 2 * len(live) and book.at(7).where("id >= 1000").count() == 0


def test_pairs_count_once_whichever_side_comes_first(spark, tmp_path):
    engine = Engine(spark, str(tmp_path), lambda: R.read_requests(spark, str(tmp_path / "none")))
    shape = "scope string, target string, recordId string, finalPrediction string, pts timestamp, task_type string"

    def batch(b, now, results, truths):
        done = [("d", "lab", i, "x", t, "classification") for i, t in results]
        asked = [("s", "d", i, {"lab": "x"}, t) for i, t in truths]
        for _ in range(2 if b % 2 else 1):  # a replay changes nothing
            sinks.write_batch(spark.createDataFrame(done, shape), engine.root, "ensemble", b)
            engine._evaluate(spark.createDataFrame(asked, RECENT), b, F.lit(now))
        counts = sinks.read_batch(spark, engine.root, "confusion", b).where("scope = 'd'").agg(F.sum("n")).first()[0]
        return counts or 0

    assert batch(0, hours(0), [("1", hours(0)), ("2", hours(0))], [("2", hours(0))]) == 1  # both at once
    # the truth after the result: 24 hours later it counts, a second more and it does not
    assert batch(1, hours(24, 1), [], [("1", hours(24)), ("1", hours(24, 1))]) == 1
    # the truth before the result, here asked again: exactly 24 hours, beyond them, and later than the grace
    assert batch(2, hours(30), [("3", hours(30)), ("4", hours(30)), ("5", hours(30))], [("3", hours(6)), ("4", hours(6, -1)), ("5", hours(4))]) == 1
    # a known truth meets a new result, a known result a new truth, and earlier pairs do not return
    assert batch(3, hours(30), [("4", hours(30, -1)), ("9", hours(30))], [("3", hours(30)), ("8", hours(30))]) == 2
    left = engine.ledger("answered").at(3).where(F.col("pts") >= F.lit(hours(6))).collect()
    assert sorted(r["recordID"] for r in left) == ["3", "4", "4", "5", "9"] and set(left[0].asDict()) == {c.split()[0] for c in ANSWERED.split(", ")}
