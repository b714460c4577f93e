"""Adaptive model rules for regression, over the shared split statistics.

A rule is a list of literals (feature, side, threshold). A row belongs to its
first covering rule in order of creation, else to the default rule 0. Rules
use the statistics layout of trees with the rule id as node id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import broadcast_within, cut, stage
from . import split_stats as ss
from .base import PREDICTION, State, with_chunks
from .drift import LAMBDA, bucket_page_hinkley

NODE = ss.NODE
LITERALS = "array<struct<pos:int,le:boolean,threshold:double>>"
RULES = [*NODE, "literals", "last_n"]


def covers(x: Column, literals: Column) -> Column:
    """Whether a vector meets all literals; a missing value goes with ``<=``."""
    return F.forall(
        literals,
        lambda l: F.coalesce((F.get(x, l["pos"]) <= l["threshold"]) == l["le"], l["le"]),
    )


def compile_rules(state: State) -> DataFrame:
    """One row per model: its rules in order, default last, with their means."""
    means = state["stats"].where("pos < 0").groupBy(*NODE).agg((F.sum("sy") / F.sum("n")).alias("mean"))
    entry = F.struct((F.col("node_id") == 0).alias("is_default"), "node_id", "literals", "mean")
    return state["rules"].join(means, NODE, "left").groupBy("model_id").agg(
        F.array_sort(F.collect_list(entry)).alias("rules"), F.sum(F.size("literals") * 3 + 4).alias("cells")
    )


def match(rows: DataFrame, state: State) -> DataFrame:
    """Rows with their first covering rule as ``hit``."""
    joined = rows.join(broadcast_within(compile_rules(state), F.col("cells")), "model_id").join(
        broadcast_within(state["edges"], F.size("lo") * 2 + 3), "model_id"
    )
    return joined.withColumn("hit", F.get(F.filter("rules", lambda r: covers(F.col("x"), r["literals"])), 0)).drop("rules")


def expand(state: State, params: DataFrame) -> State:
    """Specialise rules whose best literal passes the bound.

    A rule keeps the side with the smaller deviation. When the default rule
    expands, that side becomes a new rule and the default restarts with the other.
    """
    judged = cut(ss.decide(state["stats"], state["rules"], params))
    ranges = state["edges"].select("model_id", "lo", "hi")
    last = state["rules"].groupBy("model_id").agg(F.max("node_id").alias("_last"))
    winners = cut(
        judged.where("split").join(broadcast_within(ranges, F.size("lo") * 2 + 1), "model_id").join(last, "model_id").select(
            *NODE, "pos", "bin", (F.col("left_sd") <= F.col("right_sd")).alias("le"),
            ss.edge(F.get("lo", F.col("pos")), F.get("hi", F.col("pos")), F.col("bin")).alias("threshold"),
            F.when(F.col("node_id") == 0, F.col("_last") + 1).otherwise(F.col("node_id")).cast("int").alias("target_id"),
        )
    )
    literal = F.array(F.struct("pos", "le", F.col("threshold")))
    grown = state["rules"].join(judged.select(*NODE, "seen"), NODE, "left").join(
        winners.select(*NODE, literal.alias("_lit")), NODE, "left"
    )
    kept = grown.select(
        *NODE,
        F.when((F.col("node_id") != 0) & F.col("_lit").isNotNull(), F.concat("literals", "_lit")).otherwise(F.col("literals")).alias("literals"),
        F.when(F.col("_lit").isNotNull(), F.lit(0.0)).otherwise(F.coalesce("seen", "last_n")).alias("last_n"),
    )
    born = winners.where("node_id = 0").select(
        "model_id", "tree_id", F.col("target_id").alias("node_id"), literal.alias("literals"), F.lit(0.0).alias("last_n")
    )
    sides = ss.side_counts(state["stats"], winners).join(winners.select(*NODE, "le", "target_id"), NODE)
    keeps = (F.col("side") == 0) == F.col("le")
    handed = sides.where(keeps | (F.col("node_id") == 0)).select(
        "model_id", "tree_id", F.when(keeps, F.col("target_id")).otherwise(F.lit(0)).alias("node_id"),
        F.lit(ss.INHERITED).alias("pos"), F.lit(0).alias("bin"), "label", *ss.SUMS,
    )
    stats = state["stats"].join(winners.select(*NODE), NODE, "left_anti").unionByName(handed)
    return {**state, "rules": cut(kept.unionByName(born)), "stats": cut(stats)}


def retire(state: State) -> State:
    """Remove rules whose error has drifted upward."""
    drift = bucket_page_hinkley(state["errors"].where("node_id > 0"), NODE, "at")
    gone = cut(drift.where(F.col("drift") > LAMBDA).select(*NODE))
    if gone.isEmpty():
        return state
    return {**state, **{t: cut(state[t].join(gone, NODE, "left_anti")) for t in ("rules", "stats", "errors")}}


class Rules:
    family = "rules"
    tables = ("rules", "stats", "edges", "errors")

    def _start(self, params: DataFrame, first: DataFrame) -> State:
        spark = params.sparkSession
        edges = cut(ss.bin_edges(first))
        node = "model_id string, tree_id int, node_id int, "
        rules = edges.select(
            "model_id", F.lit(0).alias("tree_id"), F.lit(0).alias("node_id"), F.array().cast(LITERALS).alias("literals"), F.lit(0.0).alias("last_n")
        )
        return {
            "rules": cut(rules),
            "stats": spark.createDataFrame([], node + "pos int, bin int, label string, n double, sy double, syy double"),
            "edges": edges,
            "errors": spark.createDataFrame([], node + "at long, n double, sx double, sxx double"),
        }

    def update(self, state: State | None, instances: DataFrame, models: DataFrame, chunks: int = 1) -> State:
        params = broadcast_within(cut(ss.settings(models)))
        instances = instances.where("y IS NOT NULL").withColumn("label", F.lit(None).cast("string"))
        rows = stage(with_chunks(instances, chunks), "chunk") if chunks > 1 else instances.withColumn("chunk", F.lit(0))
        for chunk in range(chunks):
            part = rows.where(F.col("chunk") == chunk)
            if state is None:
                state = self._start(params, part)
            else:
                new = params.join(state["edges"], "model_id", "left_anti")
                if not new.isEmpty():
                    fresh = self._start(new, part.join(new.select("model_id"), "model_id", "left_semi"))
                    state = {t: cut(state[t].unionByName(fresh[t])) for t in self.tables}
            state = retire(expand(self._learn(state, part), params))
        return state

    def _learn(self, state: State, part: DataFrame) -> State:
        hit = match(part, state).select(
            "model_id", F.lit(0).alias("tree_id"), F.col("hit.node_id").alias("node_id"), "seq", "x", "y", "label", "lo", "hi", "y0", "ysd",
            F.col("hit.mean").alias("mean"), F.lit(1).alias("w"), F.lit(0.0).alias("g"),
        )
        hit = hit.withColumn("bins", ss.bins()).withColumn("z", ss.centred())
        error = F.abs(F.col("y") - F.col("y0") - F.col("mean")) / F.nullif(F.col("ysd"), F.lit(0.0))
        errors = hit.withColumn("e", error).where("e IS NOT NULL").groupBy(*NODE).agg(
            F.max("seq").alias("at"), F.count(F.lit(1)).cast("double").alias("n"), F.sum("e").alias("sx"), F.sum(F.col("e") * F.col("e")).alias("sxx")
        )
        return {
            **state, "stats": cut(ss.add(state["stats"], ss.collect(hit))), "errors": cut(state["errors"].unionByName(errors.select(*state["errors"].columns))),
        }

    def predict(self, state: State, instances: DataFrame, models: DataFrame) -> DataFrame:
        value = F.col("y0") + F.col("hit.mean")
        return match(instances, state).withColumn("prediction", value.cast("string")).select(*PREDICTION)

    def trained(self, state: State) -> DataFrame:
        return state["edges"].select("model_id").distinct()
