"""Binned split statistics shared by trees, forests and rules.

Statistics are counts per (model, tree, node, feature position, bin, label)
with n, sum y and sum y^2, all additive. Position -1 holds the node's own
class counts, position -2 those it inherited from the split that created it.

Trees bin a feature at the quantiles of the node's own rows, taken from a sample
of about ``SKETCH`` of them by a hash of their order, so thresholds follow the
rows that a node sees and an outlier moves none. ``bin_edges`` and ``bins`` are
the plain equal-width form over a range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import coercion
from ..functions.hashing import GRAIN, lcg_sql
from ..session import broadcast_within

BINS = 32
#: Rows of a node, or of a model for the scale of its features, that quantiles are read from.
SKETCH = 512
OWN, INHERITED = -1, -2
NODE = ["model_id", "tree_id", "node_id"]
STAT = [*NODE, "pos", "bin", "label"]
SUMS = ["n", "sy", "syy"]


def settings(models: DataFrame) -> DataFrame:
    """Split parameters per model, every accepted spelling read."""
    hp = F.col("hyper_params")
    forest = F.col("algorithm_id").isin(4, 10)
    return models.select(
        "model_id",
        "algorithm_id",
        (F.col("task_type") == "regression").alias("regression"),
        coercion.param(hp, ("gracePeriod", "gracePeriodOption"), 200).alias("grace"),
        coercion.param(hp, ("splitConfidence", "splitConfidenceOption"), 1e-7).alias("delta"),
        coercion.param(hp, ("tieThreshold", "tieThresholdOption"), 0.05).alias("tau"),
        coercion.param(hp, ("learningRatio", "learningRatioOption"), 0.02).alias("eta"),
        coercion.param_int(hp, ("maxAlternateTrees",), 1).alias("max_alternates"),
        F.when(forest, coercion.param_int(hp, ("ensembleSize", "ensembleSizeOption"), 10)).otherwise(F.lit(1)).alias("size"),
        coercion.param_int(hp, ("mFeaturesPerTreeSize", "mFeaturesPerTreeSizeOption"), 0).alias("m_features"),
    )


def bin_edges(instances: DataFrame) -> DataFrame:
    """Value range per model and feature, and centre and spread of the target.

    One row per model: lo and hi arrays by position, y0, ysd.
    """
    # One pass: the target goes before the features, as position 0.
    values = instances.selectExpr("model_id", "posexplode(concat(array(y), coalesce(x, array()))) AS (pos, v)")
    per = values.groupBy("model_id", "pos").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("y0"), F.stddev_pop("v").alias("ysd"))
    target = lambda c: F.coalesce(F.max(F.when(F.col("pos") == 0, F.col(c))), F.lit(0.0)).alias(c)
    spans = F.array_sort(F.collect_list(F.when(F.col("pos") > 0, F.struct("pos", "lo", "hi")))).alias("s")
    made = per.groupBy("model_id").agg(spans, target("y0"), target("ysd")).where(F.size("s") > 0)
    return made.select("model_id", F.col("s.lo").alias("lo"), F.col("s.hi").alias("hi"), "y0", "ysd")


def bins(x: str = "x", lo: str = "lo", hi: str = "hi") -> Column:
    """Equal-width bins; values outside the range go to the end bins, missing to 0."""
    return F.expr(
        f"transform({x}, (v, i) -> int(greatest(0, least({BINS - 1}, "
        f"coalesce(floor((v - get({lo}, i)) / nullif(get({hi}, i) - get({lo}, i), 0D) * {BINS}), 0)))))"
    )


def drawn(rows: str, seed: str) -> str:
    """Whether a row is one of about ``SKETCH`` of ``rows``, by its order; all are if there are no more."""
    draw = f"(double({lcg_sql('seq', seed)}) * {GRAIN} + {lcg_sql('seq', f'({seed}) + 7919')})"
    return f"{draw} * {rows} < {float(SKETCH * GRAIN * GRAIN)!r}D"


def quantile_cuts(sample: str) -> str:
    """Per feature the distinct inner quantiles, ascending, of an array of vectors; missing values are left out."""
    inner = f"filter(transform(sequence(1, {BINS - 1}), j -> get(v, int(ceil(j * size(v) / {float(BINS)}D)) - 1)), c -> c IS NOT NULL)"
    values = f"sort_array(filter(transform({sample}, r -> get(r, p)), c -> c IS NOT NULL))"
    return f"transform(get({sample}, 0), (_, p) -> get(transform(array({values}), v -> array_distinct({inner})), 0))"


def cut_bins(x: str, cuts: str) -> str:
    """Number of cuts below each value, by halving; a missing value goes to bin 0, and so left."""
    steps = ", ".join(str(1 << k) for k in reversed(range(BINS.bit_length() - 1)))
    return f"transform({cuts}, (c, i) -> aggregate(array({steps}), 0, (p, s) -> CASE WHEN get({x}, i) > get(c, p + s - 1) THEN p + s ELSE p END))"


def scales(instances: DataFrame) -> DataFrame:
    """Scale of a model's features and of its target: lo and hi arrays (outer quantiles) by position, y0, ysd."""
    known = instances.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.avg("y"), F.lit(0.0)).alias("y0"), F.coalesce(F.stddev_pop("y"), F.lit(0.0)).alias("ysd")
    )
    picked = instances.join(broadcast_within(known.select("model_id", "rows")), "model_id").where(drawn("rows", "0"))
    cuts = picked.groupBy("model_id").agg(F.collect_list("x").alias("s")).selectExpr("model_id", f"{quantile_cuts('s')} AS c")
    return cuts.join(known, "model_id").selectExpr("model_id", "transform(c, v -> get(v, 0)) AS lo", "transform(c, v -> get(v, size(v) - 1)) AS hi", "y0", "ysd")


def edge(lo: Column, hi: Column, bin_: Column) -> Column:
    """Upper edge of a bin, the threshold of a split after it."""
    return lo + (hi - lo) * (bin_ + 1) / F.lit(BINS)


def centred(x: str = "x", lo: str = "lo", hi: str = "hi") -> Column:
    """Features scaled so that the range is [-0.5, 0.5], cut off at 1; missing is 0."""
    return F.expr(
        f"transform({x}, (v, i) -> coalesce(greatest(-1D, least(1D, "
        f"(v - get({lo}, i)) / nullif(get({hi}, i) - get({lo}, i), 0D) - 0.5D)), 0D))"
    )


def collect(routed: DataFrame) -> DataFrame:
    """Statistics of routed rows (NODE, label, y, y0, w, bins, z, g).

    One aggregate with map-side combine: shuffled are only non-empty cells.
    ``sg`` sums the leaf-model gradient of each feature, ``rows`` counts without weights.
    """
    long = routed.where("w > 0").selectExpr(
        *NODE, "coalesce(label, '') AS label", "double(w) AS w", "coalesce(y - y0, 0D) AS yc", "coalesce(g, 0D) AS g",
        "posexplode(concat(array(named_struct('bins', 0, 'z', 0D)), arrays_zip(bins, z))) AS (pos, c)",
    ).selectExpr(*NODE, "label", "w", "yc", "g", "pos - 1 AS pos", "c.bins AS bin", "c.z AS z")
    return long.groupBy(*STAT).agg(
        F.sum("w").alias("n"), F.expr("sum(w * yc)").alias("sy"), F.expr("sum(w * yc * yc)").alias("syy"), F.expr("sum(w * g * z)").alias("sg"),
        F.count(F.lit(1)).alias("rows"),
    )


def add(stats: DataFrame | None, delta: DataFrame) -> DataFrame:
    delta = delta.select(*STAT, *SUMS)
    if stats is None:
        return delta
    return stats.select(*STAT, *SUMS).unionByName(delta).groupBy(*STAT).agg(*[F.sum(c).alias(c) for c in SUMS])


def prefix_sums(stats: DataFrame) -> DataFrame:
    """Left-side sums at every inner edge: (NODE, pos, label, bin, ln, lsy, lsyy, n, sy, syy).

    Histograms are assembled per (node, feature, label), so a bin without rows
    of a label still carries the running sum.
    """
    per = stats.where("pos >= 0").groupBy(*NODE, "pos", "label").agg(
        F.expr("map_from_entries(collect_list(struct(bin, struct(n, sy, syy))))").alias("h"), *[F.sum(c).alias(c) for c in SUMS]
    )
    step = ", ".join(f"'{c}', s.{c} + coalesce(try_element_at(h, i).{c}, 0D)" for c in SUMS)
    left = (
        f"transform(sequence(0, {BINS - 2}), b -> aggregate(sequence(0, b), named_struct('n', 0D, 'sy', 0D, 'syy', 0D), "
        f"(s, i) -> named_struct({step})))"
    )
    return per.selectExpr(*NODE, "pos", "label", *SUMS, f"posexplode({left}) AS (bin, l)").selectExpr(
        *NODE, "pos", "label", "bin", *[f"l.{c} AS l{c}" for c in SUMS], *SUMS
    )


def _deviation(n: str, s: str, q: str) -> str:
    return f"sqrt(greatest(coalesce(({q}) / nullif({n}, 0D) - (({s}) / nullif({n}, 0D)) * (({s}) / nullif({n}, 0D)), 0D), 0D))"


def candidate_merits(stats: DataFrame) -> DataFrame:
    """Information gain (bits) and deviation reduction of every inner edge."""
    plogp = lambda c: F.expr(f"sum(CASE WHEN {c} > 0 THEN ({c}) * log2({c}) ELSE 0D END)")
    sides = (
        prefix_sums(stats).groupBy(*NODE, "pos", "bin")
        .agg(
            *[F.sum(f"l{c}").alias(f"l{c}") for c in SUMS], *[F.sum(c).alias(c) for c in SUMS],
            plogp("ln").alias("pl"), plogp("n - ln").alias("pr"), plogp("n").alias("pt"),
        )
        .where("ln > 0 AND n - ln > 0")
        .selectExpr(
            "*", "n - ln AS rn", f"{_deviation('ln', 'lsy', 'lsyy')} AS left_sd",
            f"{_deviation('n - ln', 'sy - lsy', 'syy - lsyy')} AS right_sd", f"{_deviation('n', 'sy', 'syy')} AS all_sd",
        )
    )
    return sides.selectExpr(
        *NODE, "pos", "bin", "n", "ln",
        "(log2(n) - pt / n) - (ln * (log2(ln) - pl / ln) + rn * (log2(rn) - pr / rn)) / n AS gain",
        "all_sd - (ln * left_sd + rn * right_sd) / n AS sdr", "left_sd", "right_sd",
    )


def best_features(merits: DataFrame, merit: str, keep: Sequence[str] = ()) -> DataFrame:
    """Best edge per feature; ties go to the lower bin. ``keep`` names columns that a node has once."""
    best = F.expr(f"max(struct({merit} AS merit, -bin AS low, bin, left_sd, right_sd))")
    once = [F.first(c).alias(c) for c in ("n", *keep)]
    return merits.groupBy(*NODE, "pos").agg(best.alias("b"), *once).selectExpr(
        *NODE, "pos", "n", *keep, "b.merit", "b.bin", "b.left_sd", "b.right_sd"
    )


def subspace(features: DataFrame, seed_stride: int = 101) -> DataFrame:
    """Keep the node's random feature subset where the model has one (``m`` > 0)."""
    order = W.partitionBy(*NODE).orderBy(F.expr(lcg_sql(f"node_id * {seed_stride} + pos", "tree_id + 1")), "pos")
    return features.withColumn("_r", F.row_number().over(order)).where("m <= 0 OR _r <= m").drop("_r")


def decide(stats: DataFrame, nodes: DataFrame, params: DataFrame) -> DataFrame:
    """Evaluated nodes with their best split and whether it is taken.

    ``nodes`` brings ``last_n``, the row count at the last evaluation. A node
    is evaluated once it grew by the grace period; the split test is the
    Hoeffding bound on the gain difference, or on the deviation-reduction ratio.
    ``params`` is one row per model, marked for broadcast by the caller if small.
    All steps work on the statistics of one node, bounded by features, bins and labels, so
    these are dealt by node once.
    """
    stats, nodes = stats.repartition(*NODE), nodes.repartition(*NODE)
    own = stats.where(f"pos = {OWN}").groupBy(*NODE).agg(F.sum("n").alias("seen"), F.count_distinct("label").alias("classes"))
    due = (
        own.join(nodes.select(*NODE, "last_n"), NODE).join(params, "model_id")
        .where("seen - last_n >= grace AND (regression OR classes >= 2)")
    )
    wide = stats.where("pos >= 0").groupBy(*NODE).agg((F.max("pos") + 1).alias("width"))
    subset = due.join(wide, NODE).selectExpr(
        *NODE, "regression",
        "CASE WHEN algorithm_id NOT IN (4, 10) THEN 0 WHEN m_features > 0 THEN m_features ELSE int(floor(sqrt(width))) + 1 END AS m",
    )
    merits = candidate_merits(stats.join(due.select(*NODE), NODE, "left_semi")).join(subset, NODE)
    best = best_features(merits, "CASE WHEN regression THEN sdr ELSE gain END", ("m",))
    top = subspace(best).groupBy(*NODE).agg(
        F.expr("slice(reverse(array_sort(collect_list(struct(merit, -pos AS low, pos, bin, left_sd, right_sd)))), 1, 2)").alias("t")
    )
    span = "CASE WHEN regression THEN 1D ELSE log2(double(greatest(classes, 2))) END"
    return (
        due.join(top, NODE, "left")
        .selectExpr(
            *due.columns, "get(t, 0).pos AS pos", "get(t, 0).bin AS bin", "get(t, 0).left_sd AS left_sd", "get(t, 0).right_sd AS right_sd",
            "coalesce(get(t, 0).merit, 0D) AS g1", "greatest(coalesce(get(t, 1).merit, 0D), 0D) AS g2",
            f"sqrt(({span}) * ({span}) * ln(1D / delta) / (2 * seen)) AS eps",
        )
        .selectExpr(
            "*",
            "g1 > 1e-12 AND coalesce(CASE WHEN regression THEN g2 / nullif(g1, 0D) + eps < 1 ELSE g1 - g2 > eps END OR eps < tau, false) AS split",
        )
    )


def side_counts(stats: DataFrame, winners: DataFrame, sums: Sequence[str] = SUMS) -> DataFrame:
    """Label sums of both sides of the taken splits (``side`` 0 left, 1 right)."""
    chosen = winners.select(*NODE, "pos", F.col("bin").alias("_cut"))
    return (
        stats.join(chosen, [*NODE, "pos"])
        .groupBy(*NODE, F.when(F.col("bin") <= F.col("_cut"), F.lit(0)).otherwise(F.lit(1)).alias("side"), "label")
        .agg(*[F.sum(c).alias(c) for c in sums])
    )
