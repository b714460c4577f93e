"""The dataflow as one Structured Streaming query.

Training and prediction records arrive in one stream with a ``kind`` column,
so both share a batch id and training is applied before prediction. Each
micro-batch runs the batch operators and writes every table under its own
``batch_id`` folder, so a replayed batch overwrites what it wrote before.

What outlives a batch (records that wait for a model, open answers, results and
records that the truth may still meet) is kept in ledgers: a batch writes its
changes, not the whole table, and reads no earlier batch's folders for them.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..learners import FAMILIES, State
from ..operators import control, ensemble, evaluation, features, routing, throughput
from ..plans.batch import families_of, of_family
from ..session import broadcast_within, cut
from ..sources import arrival, registry, sinks
from ..sources.ledger import Ledger
from ..sources.records import CORRUPT

TRAINING, PREDICTION = "training", "prediction"
ROUTED = "model_id string, scope string, target string, task_type string, seq long, recordID string, fields map<string,string>, opened long"
OPEN = "scope string, target string, recordID string, model_id string, algorithmType string, hyperParams string, prediction string, seq long, opened long"
RECENT = "streamID string, dataSetKey string, recordID string, fields map<string,string>, ts timestamp"
ANSWERED = "scope string, target string, recordID string, predicted string, pts timestamp, task_type string"
#: Results meet the truth within a day; an hour more is kept for what comes late.
JOIN_HOURS, GRACE_HOURS = 24, 1


def both_kinds(training: DataFrame, prediction: DataFrame) -> DataFrame:
    """One stream of two, told apart by ``kind``; duplicates are kept."""
    return training.withColumn("kind", F.lit(TRAINING)).unionByName(prediction.withColumn("kind", F.lit(PREDICTION)))


@dataclass
class Engine:
    """State folders and options of one running dataflow.

    ``requests`` returns the request log as of now; each batch keeps a copy of
    what it saw, so that a replay decides as the first run did.
    ``horizon`` is how many batches a record may wait for its first model or
    its last answer; None, the default, waits without limit. What runs out is
    listed in ``expired`` with the stage it waited in.
    ``prequential`` predicts with the state before the batch's training.
    """

    spark: SparkSession
    root: str
    requests: Callable[[], DataFrame]
    chunks: int = 1
    horizon: int | None = None
    prequential: bool = False
    save_every: int = registry.SAVE_EVERY
    seq_field: str | None = None

    # -- tables ---------------------------------------------------------------

    def table(self, name: str) -> DataFrame | None:
        return sinks.read_table(self.spark, self.root, name)

    def _before(self, name: str, batch_id: int) -> DataFrame | None:
        """The rows a table had at the end of the previous batch."""
        return sinks.read_batch(self.spark, self.root, name, batch_id - 1)

    def _latest(self, folder: str, family: str, below: int) -> State | None:
        """Newest complete state version under ``folder`` older than ``below``."""
        path = f"{self.root.rstrip('/')}/{folder}"
        marks = sinks.read_table(self.spark, path, f"{family}/_complete")
        if marks is None:
            return None
        newest = marks.where(F.col("version") < below).agg(F.max("version").alias("v")).first()["v"]
        return None if newest is None else registry.load(self.spark, path, family, newest)

    def ledger(self, name: str) -> Ledger:
        """One of the tables that outlive a batch: ``waiting``, ``open``, ``recent`` or ``answered``."""
        schema, keys, clock = {
            "waiting": (ROUTED, ("model_id", "scope", "target", "recordID", "seq"), None),
            "open": (OPEN, ensemble.RECORD, None),
            "recent": (RECENT, ("recordID",), "ts"),
            "answered": (ANSWERED, ensemble.RECORD, "pts"),
        }[name]
        return Ledger(self.spark, self.root, name, schema, keys, clock)

    # -- one micro-batch --------------------------------------------------------

    def process(self, batch: DataFrame, batch_id: int) -> None:
        started = time.time()
        now = self._clock(batch_id)
        kept, rows = self._ordered(batch, batch_id, now)
        good = kept.where("dataSetKey IS NOT NULL AND fields IS NOT NULL AND seq IS NOT NULL")
        sinks.write_batch(kept.where("dataSetKey IS NULL OR fields IS NULL OR seq IS NULL"), self.root, "rejects", batch_id)

        log = self._request_log(batch_id)
        active = sinks.write_batch(control.fold_requests(log), self.root, "active", batch_id)
        states = {f: self._latest("models", f, batch_id) for f in families_of(active)}
        states = self._apply_loads(log, active, states, batch_id)
        previous = dict(states)
        schemas = self._train(good.where(F.col("kind") == TRAINING), active, states, batch_id)
        answering = previous if self.prequential else states
        partials = self._predict(good.where(F.col("kind") == PREDICTION), active, answering, schemas, batch_id)
        self._combine(partials, active, batch_id, now)
        self._evaluate(good.where(F.col("kind") == PREDICTION), batch_id, now)
        sinks.write_batch(
            throughput.progress_row(self.spark, batch_id, "batch", rows, (time.time() - started) * 1000), self.root, "progress", batch_id
        )

    def _clock(self, batch_id: int) -> Column:
        """Time of the batch's first run, so that a replay stamps the same."""
        seen = sinks.read_batch(self.spark, self.root, "clock", batch_id)
        if seen is None:
            seen = sinks.write_batch(self.spark.range(1).select(F.current_timestamp().alias("now")), self.root, "clock", batch_id)
        return F.lit(seen.first()["now"])

    def _request_log(self, batch_id: int) -> DataFrame:
        """The request log this batch decides by, written at its first run."""
        seen = sinks.read_batch(self.spark, self.root, "requests", batch_id)
        return seen if seen is not None else sinks.write_batch(self.requests(), self.root, "requests", batch_id)

    def _ordered(self, batch: DataFrame, batch_id: int, now: Column) -> tuple[DataFrame, int]:
        """The batch written with order and ingest time, and its row count.

        Rows are numbered densely in arrival order, after all rows of earlier
        batches: parts (splits, or sorted partitions of a topic) are ranked,
        their sizes summed, and the stored running total added.
        """
        corrupt = F.col(CORRUPT) if CORRUPT in batch.columns else F.lit(None).cast("string")
        ts = F.col("ts").cast("timestamp") if "ts" in batch.columns else now
        if set(arrival.SPLIT) <= set(batch.columns):
            part = F.struct(*arrival.SPLIT)
        else:
            if {"_partition", "_offset", "ts"} <= set(batch.columns):
                batch = arrival.sorted_by(batch, "ts", "_partition", "_offset")
            part = F.struct(F.lit(None).cast("timestamp").alias("_file_time"), F.lit("").alias("_file"), F.spark_partition_id().cast("long").alias("_start"))
        own = F.try_element_at("fields", F.lit(self.seq_field)).try_cast("long") if self.seq_field else F.lit(None).cast("long")
        given = F.col("seq").cast("long") if "seq" in batch.columns and not self.seq_field else own
        raw = batch.select("kind", "streamID", "dataSetKey", "recordID", "fields", given.alias("_given"), part.alias("_part"), arrival.row_in_partition().alias("_row"), ts.alias("ts"), corrupt.alias(CORRUPT))
        raw = sinks.write_batch(raw, self.root, "arrived", batch_id)
        parts = raw.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
        earlier = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row per split
        parts = cut(parts.withColumn("_before", earlier))
        rows = parts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
        before = self._before("totals", batch_id)
        base = before.first()["total"] if before is not None else 0
        sinks.write_batch(self.spark.createDataFrame([(base + rows,)], "total long"), self.root, "totals", batch_id)
        inside = W.partitionBy("_part").orderBy("_row")
        dense = F.lit(base) + F.col("_before") + F.row_number().over(inside) - 1
        use_given = self.seq_field is not None or "seq" in batch.columns
        numbered = raw if use_given else raw.join(broadcast_within(parts.select("_part", "_before")), "_part")
        seq = F.col("_given") if use_given else dense
        kept = numbered.select("kind", "streamID", "dataSetKey", "recordID", "fields", seq.alias("seq"), "ts", CORRUPT)
        return sinks.write_batch(kept, self.root, "input", batch_id), rows

    def _train(self, training: DataFrame, active: DataFrame, states: dict, batch_id: int) -> DataFrame | None:
        known = self._before("schemas", batch_id)
        if training.isEmpty():
            if known is not None:
                sinks.write_batch(known, self.root, "schemas", batch_id)
            return known
        routed = routing.route_to_models(training, active)
        schemas = sinks.write_batch(features.pin_schema(routed, known), self.root, "schemas", batch_id)
        counts = sinks.write_batch(self._counts(routed, batch_id), self.root, "counts", batch_id)
        due = registry.due_for_save(counts, self.save_every)
        for family in families_of(active):
            models = of_family(active, family)
            instances = features.trainable(features.encode(routing.route_to_models(training, models), schemas))
            if instances.isEmpty():
                continue
            state = FAMILIES[family].update(states.get(family), instances, models, self.chunks)
            states[family] = registry.save(registry.only(state, models), f"{self.root}/models", family, batch_id)
            own = due.join(models.select("model_id"), "model_id", "left_semi")
            if not own.isEmpty():  # each model is saved at its own multiple; the others keep their last save
                before = self._latest("saved", family, batch_id)
                fresh = registry.only(states[family], own)
                registry.save(fresh if before is None else self._with_saved(before, fresh, own), f"{self.root}/saved", family, batch_id)
        return schemas

    @staticmethod
    def _with_saved(before: State, fresh: State, own: DataFrame) -> State:
        ids = own.select("model_id").distinct()
        return {t: before[t].select(*fresh[t].columns).join(ids, "model_id", "left_anti").unionByName(fresh[t]) for t in fresh}

    def _counts(self, routed: DataFrame, batch_id: int) -> DataFrame:
        """Training rows per model before and after the batch."""
        fresh = routed.groupBy("model_id").agg(F.count(F.lit(1)).alias("fresh"))
        old = self._last_counts(batch_id)
        if old is None:
            return fresh.selectExpr("model_id", "0L AS before", "fresh AS after")
        return fresh.join(old, "model_id", "full_outer").selectExpr(
            "model_id", "coalesce(total, 0) AS before", "coalesce(total, 0) + coalesce(fresh, 0) AS after"
        )

    def _last_counts(self, batch_id: int) -> DataFrame | None:
        all_counts = self.table("counts")
        if all_counts is None:
            return None
        return all_counts.where(F.col("batch_id") < batch_id).groupBy("model_id").agg(F.max("after").alias("total"))

    def _apply_loads(self, log: DataFrame, active: DataFrame, states: dict, batch_id: int) -> dict:
        """Replace models by their saved state where a new LOAD asks for it."""
        loads = control.saved_model_loads(log, active)
        done = self.table("loads")
        if done is not None:
            seen = done.where(F.col("batch_id") < batch_id).select("model_id", F.col("load_seq").alias("_seen"))
            last = seen.groupBy("model_id").agg(F.max("_seen").alias("_seen"))
            loads = loads.join(last, "model_id", "left").where("_seen IS NULL OR load_seq > _seen").drop("_seen")
        loads = cut(loads)
        outcome = [loads.limit(0).withColumn("loaded", F.lit(True))]
        lives = self.table("active").where(F.col("batch_id") <= batch_id).select("model_key", F.col("model_id").alias("old_id"), F.col("seq").alias("_life")).distinct()
        for family in families_of(loads):
            wanted = loads.where(F.col("family") == family)
            saved = self._latest("saved", family, batch_id)
            if saved is None:
                outcome.append(wanted.withColumn("loaded", F.lit(False)))
                continue
            # The save may stem from an earlier life of the model: the latest one with a save counts.
            have = FAMILIES[family].trained(saved).select(F.col("model_id").alias("old_id"))
            names = cut(wanted.join(lives, "model_key").join(have, "old_id", "left_semi").groupBy("model_id").agg(F.max_by("old_id", "_life").alias("old_id")))
            restored = registry.renamed(saved, names)
            if states.get(family) is None:
                states[family] = {t: cut(d) for t, d in restored.items()}
            else:
                states[family] = {t: cut(d) for t, d in registry.replace_models(states[family], restored, names).items()}
            outcome += [wanted.join(names.select("model_id"), "model_id", "left_semi").withColumn("loaded", F.lit(True)), wanted.join(names.select("model_id"), "model_id", "left_anti").withColumn("loaded", F.lit(False))]
        report = reduce(DataFrame.unionByName, outcome)
        sinks.write_batch(report.select("model_id", "model_key", "load_seq", "loaded"), self.root, "loads", batch_id)
        return states

    def _predict(self, prediction: DataFrame, active: DataFrame, states: dict, schemas: DataFrame | None, batch_id: int) -> DataFrame:
        """Answer what can be answered; rows of untrained models wait."""
        fresh = routing.route_to_models(prediction, active).withColumn("opened", F.lit(batch_id).cast("long"))
        waiting = self.ledger("waiting")
        fresh = fresh.select(*waiting.columns)
        ready = [FAMILIES[f].trained(s) for f, s in states.items() if s is not None]
        trained = reduce(DataFrame.union, ready) if ready and schemas is not None else active.select("model_id").limit(0)
        trained = trained.select("model_id").distinct()
        before = waiting.at(batch_id - 1)
        kept = before.join(active.select("model_id"), "model_id", "left_semi")
        rows = fresh.unionByName(kept.select(*waiting.columns))
        late = kept.join(trained, "model_id", "left_anti").where(self._expired(batch_id))
        leaving = [before.join(trained, "model_id", "left_semi"), before.join(active.select("model_id"), "model_id", "left_anti"), late]
        gone = reduce(DataFrame.unionByName, [d.select(*waiting.keys) for d in leaving])
        sinks.write_batch(late.select(*ensemble.RECORD, "opened", F.lit("prediction").alias("stage")).distinct(), self.root, "expired_held", batch_id)
        waiting.write(batch_id, fresh.join(trained, "model_id", "left_anti"), gone)
        parts = []
        for family, state in states.items():
            if state is None or schemas is None:
                continue
            models = of_family(active, family)
            own = rows.join(trained, "model_id", "left_semi").join(models.select("model_id"), "model_id", "left_semi")
            parts.append(FAMILIES[family].predict(state, features.encode(own, schemas), models))
        empty = self.spark.createDataFrame([], OPEN).drop("opened")
        partials = features.as_partials(reduce(DataFrame.unionByName, parts), active) if parts else empty
        return sinks.write_batch(partials, self.root, "partials", batch_id)

    def _combine(self, partials: DataFrame, active: DataFrame, batch_id: int, now: Column) -> None:
        """Complete records with new and open partials; the rest stays open.

        Of the open records only those are combined again that a new partial
        belongs to or whose learners have changed; the others cannot be complete.
        A record without an id has no later answers: it is complete at once or not kept.
        """
        ledger, record = self.ledger("open"), list(ensemble.RECORD)
        fresh = ensemble.first_per_model(partials).withColumn("opened", F.lit(batch_id).cast("long")).select(*ledger.columns)
        before = ledger.at(batch_id - 1)
        asked = broadcast_within(fresh.select(*record).distinct())
        touched = before.join(asked, record, "left_semi")
        regrouped = broadcast_within(self._regrouped(active, batch_id))
        other = before.join(asked, record, "left_anti").join(regrouped, ["scope", "target"], "left_semi")
        met = touched.unionByName(other.select(*touched.columns))
        done = sinks.write_batch(
            ensemble.combine(fresh.unionByName(met.select(*fresh.columns)), active).withColumn("pts", now), self.root, "ensemble", batch_id
        )
        finished = done.select("scope", "target", F.col("recordId").alias("recordID"))
        # An answer given again is added only if it comes before the one that is held.
        held = touched.groupBy(*record, "model_id").agg(F.min(F.struct("seq", "prediction")).alias("_held"))
        new = fresh.join(held, [*record, "model_id"], "left").where(F.col("_held").isNull() | (F.struct("seq", "prediction") < F.col("_held"))).drop("_held")
        old = before.where(self._expired(batch_id)).groupBy(*record).agg(F.min("opened").alias("opened")).join(finished, record, "left_anti")
        gone = met.select(*record).join(finished, record, "left_semi").unionByName(old.select(*record))
        new = new.where("recordID IS NOT NULL").join(finished, record, "left_anti").join(old, record, "left_anti")
        ledger.write(batch_id, new, gone)
        held = sinks.read_batch(self.spark, self.root, "expired_held", batch_id)
        late = old.select(*record, "opened", F.lit("ensemble").alias("stage"))
        sinks.write_batch(late.unionByName(held), self.root, "expired", batch_id)

    def _regrouped(self, active: DataFrame, batch_id: int) -> DataFrame:
        """(scope, target) whose required learners are not those of the previous batch; one row per ensemble at most."""
        members = ensemble.required(active).select("scope", "target", "model_id")
        last = self._before("active", batch_id)
        if last is None:
            return members.select("scope", "target").distinct()
        earlier = ensemble.required(last).select("scope", "target", "model_id")
        return members.exceptAll(earlier).unionByName(earlier.exceptAll(members)).select("scope", "target").distinct()

    def _expired(self, batch_id: int) -> Column:
        return F.lit(False) if self.horizon is None else F.col("opened") < batch_id - self.horizon

    def _evaluate(self, asked: DataFrame, batch_id: int, now: Column) -> None:
        """Counters of the pairs of result and truth that this batch completes.

        An interval join, step by step: new results meet the truth known by now,
        earlier results meet the truth that came with this batch. Each pair is
        counted once, whichever side comes first.
        """
        recent, answered = self.ledger("recent"), self.ledger("answered")
        floor = now - F.expr(f"INTERVAL {JOIN_HOURS + GRACE_HOURS} HOURS")
        fresh = asked.select(*recent.columns).where(F.col("ts") >= floor)
        known = recent.at(batch_id - 1).where(F.col("ts") >= floor)
        done = sinks.read_batch(self.spark, self.root, "ensemble", batch_id)
        results = done.select("scope", "target", F.col("recordId").alias("recordID"), F.col("finalPrediction").alias("predicted"), "pts", "task_type")
        earlier = answered.at(batch_id - 1).where(F.col("pts") >= floor)
        pairs = self._pairs(known.unionByName(fresh), results).unionByName(self._pairs(fresh, earlier))
        sinks.write_batch(evaluation.confusion(pairs.where("task_type = 'classification'")), self.root, "confusion", batch_id)
        sinks.write_batch(evaluation.regression_sums(pairs.where("task_type = 'regression'")), self.root, "regression", batch_id)
        recent.write(batch_id, fresh, floor=floor)
        answered.write(batch_id, results, floor=floor)

    @staticmethod
    def _pairs(records: DataFrame, results: DataFrame) -> DataFrame:
        kinds = results.select("scope", "target", "task_type").distinct()
        truth = evaluation.truth_of(records, kinds)
        return evaluation.interval_pairs(truth, results, JOIN_HOURS).join(broadcast_within(kinds), ["scope", "target"])

    # -- running metrics --------------------------------------------------------

    def classification_metrics(self) -> DataFrame:
        keys = ("scope", "target", "actual", "predicted")
        return evaluation.classification_report(evaluation.merge_counters(self.table("confusion"), keys, ("n",)))

    def regression_metrics(self) -> DataFrame:
        sums = evaluation.merge_counters(self.table("regression"), evaluation.GROUP, ("n", "sum_abs", "sum_sq"))
        return evaluation.regression_report(sums)

    def start(self, stream: DataFrame, checkpoint: str, every: str | None = None):
        """Run over ``stream``; without ``every`` what is there now, then stop."""
        writer = stream.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
        return writer.start()
