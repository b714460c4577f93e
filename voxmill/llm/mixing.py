"""Mixing sources to target token weights by entropy balancing.

Document rates minimise the relative entropy to the corpus, measured per token, under
one token constraint per source. The dual is convex with one multiplier per source;
rates are exponential tilts ``exp(multiplier)`` of the corpus. Damped Newton steps run
as Spark aggregates over (source, size class) cells, so a step reads sufficient
statistics and not documents. Rates are then rounded into whole copies: each cell gets
a number of copies that carries the source's remaining error on to its smaller
documents, and within a cell copies are dealt evenly along a hash order.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxmill.llm.common import discard, fresh, stage, word_count

#: Sizes are exact up to this, then classed by their leading digits: at most 900 classes for each further power of ten.
EXACT = 1000


def size_class(size: Column) -> Column:
    """Classes of nearly equal size (within one percent): a number that grows with the size."""
    digits = F.greatest(F.length(size.cast("string")) - 3, F.lit(0))
    return F.when(size < EXACT, size).otherwise(digits * 1_000_000 + F.floor(size / F.pow(F.lit(10), digits))).cast("long")


def targets(sizes: DataFrame, weights: int = 3, most: float = 3.0) -> DataFrame:
    """Rows (source, source_size, target) from (source, source_size).

    Sources by code point, null last, weigh 1, 2, .. ``weights``, repeating, and share all
    tokens. A target stops at ``most`` times its source's size; the excess is shared
    again by weight among the rest until none is above. Sources with the smallest limit
    per weight stop first, so the level at which the rest stand follows from running
    sums. That needs one ordering of all sources, which are few against documents: a
    few integers for each.
    """
    order = W.orderBy(F.col("source").isNull(), F.col("source"))
    base = sizes.withColumn("weight", ((F.row_number().over(order) - 1) % weights + 1).cast("double")).withColumn("cap", F.col("source_size") * F.lit(most))
    by_level = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    rest = by_level.rowsBetween(W.currentRow, W.unboundedFollowing)
    everyone = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.sum("source_size").over(everyone) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    stood = base.withColumn("level", level).withColumn("place", F.row_number().over(by_level)).withColumn("free", F.col("weight") * F.col("level") <= F.col("cap"))
    final = F.min(F.when(F.col("free"), F.struct("place", "level"))).over(everyone)["level"]
    target = F.when(final.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * final))
    return stood.select("source", "source_size", target.cast("double").alias("target"))


def balance(cells: DataFrame, wanted: DataFrame, tolerance: float = 1e-9, most_steps: int = 60) -> DataFrame:
    """Multipliers (source, multiplier) of the dual, by Newton steps over all sources at once.

    ``cells`` has (source, tokens), ``wanted`` (source, target). A step aggregates the tilted
    token mass, which is the negative gradient's and the Hessian's only entry of a source;
    steps are limited to one, which keeps the descent monotone. A source without tokens
    or with a zero target has no finite optimum; it keeps rate zero (null multiplier).
    """
    now = stage(wanted.where("target > 0").select("source", "target", F.lit(0.0).alias("multiplier")))
    for _ in range(most_steps):
        tilted = cells.join(now, cells["source"].eqNullSafe(now["source"])).select(now["source"], "target", "multiplier", (F.col("tokens") * F.exp("multiplier")).alias("mass"))
        moved = tilted.groupBy("source", "target", "multiplier").agg(F.sum("mass").alias("mass")).where("mass > 0")
        step = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("target") - F.col("mass")) / F.col("mass")))
        after = stage(moved.select("source", "target", (F.col("multiplier") + step).alias("multiplier"), F.abs(F.col("target") / F.col("mass") - 1).alias("gap")))
        gap = after.agg(F.max("gap")).first()[0]
        discard(now)
        now = after.drop("gap")
        now._staged_at = after._staged_at
        if gap is None or gap <= tolerance:
            break
    return now.select("source", "multiplier")


def _cell_copies(cells: DataFrame, rates: DataFrame, most: float) -> DataFrame:
    """(source, class, whole, extra): every document of the cell gets ``whole`` copies, ``extra`` of them one more.

    Cells of a source are visited from large to small sizes; each takes the number of copies
    that best settles the tokens still owed. A source has at most a few thousand cells.
    """
    rated = cells.join(rates, cells["source"].eqNullSafe(rates["source"]), "left").select(
        cells["source"], "class", "n", "tokens", F.least(F.coalesce(F.exp("multiplier"), F.lit(0.0)), F.lit(float(most))).alias("rate")
    )
    listed = rated.groupBy("source").agg(F.sort_array(F.collect_list(F.struct(F.col("class").alias("k"), "n", "tokens", "rate")), asc=False).alias("cells"))

    def visit(state: Column, cell: Column) -> Column:
        mean = cell["tokens"] / cell["n"]
        owed = state["owed"] + cell["rate"] * cell["tokens"]
        copies = F.when(mean > 0, F.round(owed / mean)).otherwise(0)
        copies = F.greatest(F.lit(0).cast("double"), F.least(copies, F.floor(cell["rate"] + 1e-9) * cell["n"] + F.when(cell["rate"] - F.floor(cell["rate"] + 1e-9) > 1e-9, cell["n"]).otherwise(0)))
        return F.struct((owed - copies * mean).alias("owed"), F.concat(state["made"], F.array(F.struct(cell["k"].alias("class"), cell["n"].alias("n"), copies.cast("long").alias("copies")))).alias("made"))

    start = F.struct(F.lit(0.0).alias("owed"), F.array().cast("array<struct<class:bigint,n:bigint,copies:bigint>>").alias("made"))
    made = listed.select("source", F.explode(F.aggregate("cells", start, visit, lambda s: s["made"])).alias("c"))
    return made.select("source", F.col("c.class").alias("class"), F.floor(F.col("c.copies") / F.col("c.n")).cast("long").alias("whole"), (F.col("c.copies") % F.col("c.n")).alias("extra"), F.col("c.n").alias("n"))


def mix(docs: DataFrame, weights: int = 3, most: float = 3.0, rows_in_bucket: int = 1000) -> DataFrame:
    """Rows (doc_id, source, size, source_size, target, copies), one for each row of ``docs``.

    Size is the number of words (null text: 0); documents without words get no copies. Null
    ids and repeated rows are documents of their own. The order within a cell is a hash of
    doc_id, so reruns agree; rows alike in id, source and size are interchangeable.
    """
    read = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size")))
    keyed = read.withColumn("class", size_class(F.col("size"))).withColumn("h", F.xxhash64("doc_id"))
    cells = stage(keyed.groupBy("source", "class").agg(F.count("*").alias("n"), F.sum("size").alias("tokens")))
    total = cells.agg(F.sum("n")).first()[0] or 0
    wanted = stage(targets(cells.groupBy("source").agg(F.sum("tokens").alias("source_size")), weights, most))
    dealt = stage(_cell_copies(cells, balance(cells, wanted), most))

    # Ranks within a cell: buckets of the hash first, then rows of one bucket.
    buckets = max(64, -(-total // rows_in_bucket))
    placed = keyed.withColumn("bucket", F.pmod(F.col("h"), F.lit(buckets)))
    counts = placed.groupBy("source", "class", "bucket").agg(F.count("*").alias("k"))
    offset = F.sum("k").over(W.partitionBy("source", "class").orderBy("bucket")) - F.col("k")
    starts = counts.select("source", "class", "bucket", offset.alias("start"))
    dealt = dealt.select(F.col("source").alias("s"), F.col("class").alias("c"), "whole", "extra", "n")
    cell_of = starts.join(dealt, starts["source"].eqNullSafe(dealt["s"]) & (starts["class"] == dealt["c"])).join(
        wanted.select(F.col("source").alias("t"), "source_size", "target"), F.col("source").eqNullSafe(F.col("t"))
    ).select(F.col("source").alias("s"), F.col("class").alias("c"), F.col("bucket").alias("b"), "start", "whole", "extra", "n", "source_size", "target")
    ranked = placed.withColumn("rank", F.row_number().over(W.partitionBy("source", "class", "bucket").orderBy("h", "doc_id")))
    joined = ranked.join(cell_of, ranked["source"].eqNullSafe(cell_of["s"]) & (ranked["class"] == cell_of["c"]) & (ranked["bucket"] == cell_of["b"]))
    at = F.col("start") + F.col("rank")
    more = F.floor(at * F.col("extra") / F.col("n")) - F.floor((at - 1) * F.col("extra") / F.col("n"))
    return joined.select("doc_id", "source", "size", "source_size", "target", F.when(F.col("size") > 0, F.col("whole") + more).otherwise(0).cast("long").alias("copies"))


def taken(docs: DataFrame, **options: float) -> DataFrame:
    """Contract columns of the mix; see :func:`mix`."""
    return mix(docs, **options).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def apply(docs: DataFrame, **options: float) -> DataFrame:
    """``docs`` as the mix takes them: each row repeated by its copies.

    Rows that agree in doc_id, source and size are dealt alike up to one copy; which of
    several different texts under one id gets it follows their hash.
    """
    rank, copies, size = fresh(docs, "_rank"), fresh(docs, "_copies"), fresh(docs, "_size")
    d, s, z, r = (fresh(docs, name) for name in ("_d", "_s", "_z", "_r"))
    plan = mix(docs, **options).where("copies > 0").select(F.col("doc_id").alias(d), F.col("source").alias(s), F.col("size").alias(z), F.col("copies").alias(copies))
    plan = plan.withColumn(r, F.row_number().over(W.partitionBy(d, s, z).orderBy(F.desc(copies))))
    rows = docs.withColumn(size, word_count(F.col("text").cast("string")))
    rows = rows.withColumn(rank, F.row_number().over(W.partitionBy("doc_id", "source", size).orderBy(F.xxhash64("text"))))
    same = rows["doc_id"].cast("long").eqNullSafe(F.col(d)) & rows["source"].cast("string").eqNullSafe(F.col(s)) & (rows[size] == F.col(z)) & (rows[rank] == F.col(r))
    held = rows.join(plan, same)
    return held.select(*[rows[c] for c in docs.columns], F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))).alias(copies)).drop(copies)
