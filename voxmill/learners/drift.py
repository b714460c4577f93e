"""Change detectors as window queries, and as state that grows with the logarithm of the series.

An adaptive window is kept as an exponential histogram: buckets (level, n, sx, sxx, at), oldest
first, at most ``CAPACITY`` of a level; when a level overflows, its two oldest buckets
become one of the next. Its state is a table of such rows, mergeable with those of later rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scans import SLICE_WIDTH, rank_in_order, running
from ..session import broadcast_within, cut, discard, stage

ALPHA, LAMBDA, DELTA = 0.005, 50.0, 0.002
#: Buckets of one level; rows of a tick, the unit of a window; most ticks that a key gets from one update.
CAPACITY, CLOCK, TICKS = 5, 32, 1024
BUCKET = "struct<level:int,n:double,sx:double,sxx:double,at:bigint>"


def _tracked(series: DataFrame, keys: Sequence[str], order: str, value: str, alpha: float, width: int, carry: DataFrame | None = None) -> DataFrame:
    """Rows with the detector's state after each: ``_n``, ``_s``, ``m`` and ``_low``.

    Three stacked running aggregates, each sliced. A running aggregate reads its input twice, so the narrow
    results in between are materialised; otherwise the source would be read eight times.
    ``carry`` (keys, state) has what came before the rows, per key.
    """
    base = series.select(*keys, order, value)
    before = {name: F.lit(0) for name in ("n", "s", "m")} | {"low": F.lit(None).cast("double")}
    if carry is not None:
        base = base.join(broadcast_within(carry.select(*keys, "state")), list(keys), "left")
        before = {name: F.coalesce(F.col(f"state.{name}"), zero) for name, zero in before.items()}
    means = running(base, keys, order, {"_s": ("sum", F.col(value)), "_n": ("count", F.col(value))}, width=width)
    means = cut(means.withColumn("_s", F.col("_s") + before["s"]).withColumn("_n", F.col("_n") + before["n"]))
    step = F.col(value) - F.col("_s") / F.col("_n") - F.lit(alpha)
    sums = running(means.withColumn("_step", step), keys, order, {"m": ("sum", F.col("_step"))}, width=width).drop("_step")
    sums = cut(sums.withColumn("m", F.col("m") + before["m"]))
    low = running(sums, keys, order, {"_low": ("min", F.col("m"))}, width=width).withColumn("_low", F.least("_low", before["low"]))
    return low.drop("state")


def page_hinkley(series: DataFrame, keys: Sequence[str], order: str = "seq", value: str = "x", alpha: float = ALPHA, width: int = SLICE_WIDTH) -> DataFrame:
    """Rows with the statistic ``m`` and its rise ``drift`` above the minimum.

    m_t = sum of (x_i - mean_i - alpha) with mean_i the running mean; ``drift``
    is m_t - min m.
    """
    return _tracked(series, keys, order, value, alpha, width).withColumn("drift", F.col("m") - F.col("_low")).drop("_low")


def page_hinkley_alarms(series: DataFrame, keys: Sequence[str], order: str = "seq", value: str = "x", alpha: float = ALPHA, threshold: float = LAMBDA, width: int = SLICE_WIDTH) -> DataFrame:
    """First alarm per key, with the largest drift seen."""
    stat = page_hinkley(series, keys, order, value, alpha, width)
    return stat.groupBy(*keys).agg(
        F.min(F.when(F.col("drift") > threshold, F.col(order))).alias("first_alarm"), F.max("drift").alias("max_drift")
    )


def adwin_cuts(buckets: DataFrame, keys: Sequence[str], order: str, delta: float | Column = DELTA) -> DataFrame:
    """Every candidate cut of a bucketed series with its test.

    ``buckets`` has n, sx, sxx per bucket, a number of rows set by the chunking
    and not by the data. A cut after bucket b compares the means before and
    after it; ``cut`` is true when they differ by more than the bound.
    """
    head = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*keys)
    d = delta if isinstance(delta, Column) else F.lit(float(delta))
    t = buckets.select(
        "*",
        F.sum("n").over(head).alias("_n0"), F.sum("sx").over(head).alias("_s0"),
        F.sum("n").over(whole).alias("_n"), F.sum("sx").over(whole).alias("_s"), F.sum("sxx").over(whole).alias("_q"),
    ).where("_n0 < _n AND _n0 > 0")
    n1 = F.col("_n") - F.col("_n0")
    mean0, mean1 = F.col("_s0") / F.col("_n0"), (F.col("_s") - F.col("_s0")) / n1
    mean = F.col("_s") / F.col("_n")
    variance = F.greatest(F.col("_q") / F.col("_n") - mean * mean, F.lit(0.0))
    m = F.lit(1.0) / (F.lit(1.0) / F.col("_n0") + F.lit(1.0) / n1)
    spread = F.log(F.lit(2.0) * F.greatest(F.log(F.col("_n")), F.lit(1.0)) / d)
    bound = F.sqrt(F.lit(2.0) / m * variance * spread) + F.lit(2.0) / (F.lit(3.0) * m) * spread
    return t.select(
        *keys, order, mean0.alias("mean0"), mean1.alias("mean1"), bound.alias("bound"),
        (F.abs(mean0 - mean1) > bound).alias("cut"),
    )


def adwin(buckets: DataFrame, keys: Sequence[str], order: str, delta: float | Column = DELTA) -> DataFrame:
    """Per key the latest cut (null: no change) and whether the mean rose there."""
    cuts = adwin_cuts(buckets, keys, order, delta)
    found = F.when(F.col("cut"), F.struct(F.col(order).alias("at"), (F.col("mean1") > F.col("mean0")).alias("rose")))
    return cuts.groupBy(*keys).agg(F.max(found).alias("_c")).select(
        *keys, F.col("_c.at").alias("cut_at"), F.coalesce("_c.rose", F.lit(False)).alias("rose")
    )


#: Order values that one fold of a restarting detector may span, and so the rows it may take of a key.
FOLD_WIDTH = 1 << 18


def page_hinkley_restarts(series: DataFrame, keys: Sequence[str], order: str = "seq", value: str = "x", alpha: float = ALPHA, threshold: float = LAMBDA, width: int = FOLD_WIDTH) -> DataFrame:
    """All alarms (keys, alarm, at, drift): after an alarm the detector starts anew with the next row.

    Rounds go through slices of ``width`` order values. One slice is folded, at most ``width`` rows of a key, row by row
    through all its alarms and restarts. Behind a slice without an alarm the next 2, 4, ... slices are tracked side by
    side by running aggregates, which carry the state (n, sum, m, min m), up to the first slice with an alarm. So
    a series is never gathered, every row is read by a few rounds only, however many slices have alarms, and the width
    changes nothing. Rows without a value are left out.
    """
    keys = list(keys)
    state = "struct<n:double,s:double,m:double,low:double>"
    alarm = "array<struct<at:bigint,drift:double>>"
    rest = series.where(F.col(value).isNotNull()).select(*keys, F.col(order).cast("long").alias("at"), F.col(value).cast("double").alias("x"))
    # Ordered files: a round reads only those with rows of its slices.
    rest = stage(rest.withColumn("_k", F.floor(F.col("at") / F.lit(width)).cast("long")).repartitionByRange("_k", "at").sortWithinPartitions("_k"))
    at, last = rest.agg(F.min("_k"), F.max("_k")).first()
    start = f"named_struct('t', coalesce(state, CAST(named_struct('n', 0, 's', 0, 'm', 0, 'low', NULL) AS {state})), 'a', CAST(array() AS {alarm}))"
    mean = "(a.t.s + e.x) / (a.t.n + 1D)"
    bind = lambda text, name, body: f"get(transform(array({text}), {name} -> {body}), 0)"
    quiet = "named_struct('t', named_struct('n', a.t.n + 1D, 's', a.t.s + e.x, 'm', m, 'low', least(a.t.low, m)), 'a', a.a)"
    hit = f"named_struct('t', CAST(named_struct('n', 0, 's', 0, 'm', 0, 'low', NULL) AS {state}), 'a', concat(a.a, array(named_struct('at', e.at, 'drift', m - least(a.t.low, m)))))"
    step = bind(f"a.t.m + (e.x - {mean} - {alpha!r}D)", "m", f"CASE WHEN m - least(a.t.low, m) > {float(threshold)!r}D THEN {hit} ELSE {quiet} END")
    carry, found, span = None, [], 1
    while at is not None and at <= last:
        rows = rest.where((F.col("_k") >= at) & (F.col("_k") < at + span))
        if span > 1:
            tracked = _tracked(rows.select(*keys, "at", "x"), keys, "at", "x", alpha, width, carry)
            tracked = cut(tracked.withColumn("_k", F.floor(F.col("at") / F.lit(width)).cast("long")))
            first = tracked.where(F.col("m") - F.col("_low") > threshold).agg(F.min("_k")).first()[0]
            at, span = (at + span, 2 * span) if first is None else (first, 1)
            made = tracked.where(F.col("_k") < at).groupBy(*keys).agg(
                F.max_by(F.struct(F.col("_n").cast("double").alias("n"), F.col("_s").alias("s"), "m", F.col("_low").alias("low")), "at").alias("state")
            )
        else:
            lists = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("r"))
            lists = lists.withColumn("state", F.lit(None).cast(state)) if carry is None else lists.join(carry, keys, "left")
            folded = cut(lists.selectExpr(*keys, f"aggregate(r, {start}, (a, e) -> {step}) AS f"))
            alarms = folded.select(*keys, F.inline("f.a"))
            at, span = at + 1, 2
            if not alarms.isEmpty():
                found.append(alarms)
                span = 1
            made = folded.select(*keys, F.col("f.t").alias("state"))
        if carry is not None:  # keys without rows in these slices keep their state
            made = made.unionByName(carry.join(made, keys, "left_anti"))
        carry = cut(made)
    discard(rest)
    if not found:
        return series.limit(0).select(*keys, F.lit(0).cast("long").alias("alarm"), F.lit(0).cast("long").alias("at"), F.lit(0.0).alias("drift"))
    ranked = rank_in_order(reduce(DataFrame.unionByName, found), keys, "at", "alarm")
    return ranked.select(*keys, "alarm", "at", "drift")


def ticks(series: DataFrame, keys: Sequence[str], order: str = "seq", value: str = "x", clock: int = CLOCK) -> DataFrame:
    """Rows (keys, tick, n, sx, sxx, at): at most ``TICKS`` stretches of equal rows per key, of ``clock`` rows at least."""
    keys = list(keys)
    known = series.where(F.col(value).isNotNull()).select(*keys, F.col(order).cast("long").alias("at"), F.col(value).cast("double").alias("_x"))
    sizes = known.groupBy(*keys).agg(F.greatest(F.lit(clock), F.ceil(F.count(F.lit(1)) / F.lit(TICKS))).cast("long").alias("_w"))
    ranked = rank_in_order(known, keys, "at", "_r").join(broadcast_within(sizes), keys)
    return ranked.groupBy(*keys, F.expr("(_r - 1) DIV _w").alias("tick")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("_x").alias("sx"), F.sum(F.col("_x") * F.col("_x")).alias("sxx"), F.max("at").alias("at")
    )


def _compressed(b: str) -> str:
    """Buckets with the two oldest of each overflowing level made one, from the lowest level up."""
    at = "array_position(transform(b, e -> e.level), k)"
    one = (
        "named_struct('level', k + 1, 'n', b[i - 1].n + b[i].n, 'sx', b[i - 1].sx + b[i].sx, 'sxx', b[i - 1].sxx + b[i].sxx, 'at', b[i].at)"
    )
    merged = f"get(transform(array(int({at})), i -> concat(slice(b, 1, i - 1), array({one}), slice(b, i + 2, size(b)))), 0)"
    return f"aggregate(sequence(0, coalesce(get({b}, 0).level, 0)), {b}, (b, k) -> CASE WHEN size(filter(b, e -> e.level = k)) > {CAPACITY} THEN {merged} ELSE b END)"


def compact(buckets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Histogram rows (keys, level, n, sx, sxx, at) after bringing every level to its capacity, oldest ``at`` first.

    Called after every update, a key has few rows: those of the update and a logarithm of the ones before.
    """
    keys = list(keys)
    held = buckets.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("at", "level", "n", "sx", "sxx"))).alias("b"))
    listed = f"CAST(transform(b, e -> named_struct('level', e.level, 'n', e.n, 'sx', e.sx, 'sxx', e.sxx, 'at', e.at)) AS array<{BUCKET}>)"
    # Added one at a time, as an update brings more than one overflow at a level.
    added = f"aggregate({listed}, CAST(array() AS array<{BUCKET}>), (c, e) -> {_compressed('concat(c, array(e))')})"
    return held.select(*keys, F.inline(F.expr(added))).select(*keys, "level", "n", "sx", "sxx", "at")


def _is_cut(b: str, delta: float) -> str:
    """Whether some boundary between buckets separates two means by more than the bound."""
    total = f"aggregate({b}, named_struct('n', 0D, 's', 0D, 'q', 0D), (a, e) -> named_struct('n', a.n + e.n, 's', a.s + e.sx, 'q', a.q + e.sxx))"
    var = "greatest(t.q / t.n - (t.s / t.n) * (t.s / t.n), 0D)"
    spread = f"ln(2D * greatest(ln(t.n), 1D) / {delta!r}D)"
    inverse = "(1D / n0 + 1D / (t.n - n0))"  # of the harmonic size
    bound = f"sqrt(2D * {inverse} * {var} * {spread}) + 2D / 3D * {inverse} * {spread}"
    n0, s0 = "(a.n + e.n)", "(a.s + e.sx)"
    test = f"{n0} < t.n AND abs({s0} / {n0} - (t.s - {s0}) / (t.n - {n0})) > {bound.replace('n0', n0)}"
    scan = f"aggregate({b}, named_struct('n', 0D, 's', 0D, 'cut', false), (a, e) -> named_struct('n', {n0}, 's', {s0}, 'cut', a.cut OR ({test})))"
    return f"get(transform(array({total}), t -> {scan}.cut), 0)"


def adwin_windows(made: DataFrame, keys: Sequence[str], delta: float = DELTA, state: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Adaptive windows after the ticks ``made``, and the cuts on the way.

    Returns the state (keys, level, n, sx, sxx, at), of O(log n) rows per key, and the cuts
    (keys, at, dropped, kept, mean): at which tick's end how many rows were dropped and what was kept.
    A tick is added as a bucket of level 0; then the oldest bucket is dropped as long as some boundary
    separates two means. Ticks of one key are bounded by ``TICKS`` per update.
    """
    keys = list(keys)
    fresh = made.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("tick", "n", "sx", "sxx", "at"))).alias("ticks"))
    if state is None:
        held = fresh.withColumn("old", F.expr(f"CAST(array() AS array<{BUCKET}>)"))
    else:
        old = state.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("at", "level", "n", "sx", "sxx"))).alias("o")).selectExpr(
            *keys, f"CAST(transform(o, e -> named_struct('level', e.level, 'n', e.n, 'sx', e.sx, 'sxx', e.sxx, 'at', e.at)) AS array<{BUCKET}>) AS old"
        )
        held = fresh.join(old, keys, "full").select(*keys, F.coalesce("ticks", F.array()).alias("ticks"), F.coalesce("old", F.array()).alias("old"))
    one = "concat(s.b, array(named_struct('level', 0, 'n', t.n, 'sx', t.sx, 'sxx', t.sxx, 'at', t.at)))"
    dropping = (
        f"aggregate(sequence(1, size(w)), named_struct('b', w, 'go', true), (d, _) -> CASE WHEN d.go AND size(d.b) > 1 AND {_is_cut('d.b', delta)} "
        "THEN named_struct('b', slice(d.b, 2, size(d.b)), 'go', true) ELSE named_struct('b', d.b, 'go', false) END).b"
    )
    rows = "aggregate({0}, 0D, (n, e) -> n + e.n)".format
    cut_row = f"named_struct('at', t.at, 'dropped', {rows('w')} - {rows('r')}, 'kept', {rows('r')}, 'mean', aggregate(r, 0D, (n, e) -> n + e.sx) / {rows('r')})"
    moved = f"named_struct('b', r, 'cuts', CASE WHEN size(r) < size(w) THEN concat(s.cuts, array({cut_row})) ELSE s.cuts END)"
    bind = lambda value, name, body: f"get(transform(array({value}), {name} -> {body}), 0)"
    step = bind(one, "v", bind(_compressed("v"), "w", bind(dropping, "r", moved)))
    start = f"named_struct('b', old, 'cuts', CAST(array() AS array<struct<at:bigint,dropped:double,kept:double,mean:double>>))"
    done = cut(held.selectExpr(*keys, f"aggregate(ticks, {start}, (s, t) -> {step}) AS f"))
    return done.select(*keys, F.inline("f.b")), done.select(*keys, F.inline("f.cuts"))


def bucket_page_hinkley(buckets: DataFrame, keys: Sequence[str], order: str, alpha: float = ALPHA) -> DataFrame:
    """Page-Hinkley evaluated at bucket ends (n, sx per bucket): last drift per key."""
    head = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    step = F.col("sx") - F.col("n") * (F.col("_s") / F.col("_n") + F.lit(alpha))
    t = buckets.withColumn("_n", F.sum("n").over(head)).withColumn("_s", F.sum("sx").over(head)).withColumn("_m", step)
    t = t.withColumn("m", F.sum("_m").over(head)).withColumn("drift", F.col("m") - F.least(F.min("m").over(head), F.lit(0.0)))
    return t.groupBy(*keys).agg(F.max_by("drift", order).alias("drift"))
