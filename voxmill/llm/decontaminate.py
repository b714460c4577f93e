"""Benchmark decontamination: size-partitioned MinHash containment search with exact check.

A test item is contained in a document if at least ``threshold`` of the item's distinct
shingles occur in it. Plain MinHash similarity fails here, because a short item and a
long document share little of their union; the search is for containment of the item.

Items are partitioned by their number of shingles n. In a partition at most
``n - ceil(threshold * n)`` shingles may be missing, so of the one more than that with
the smallest hash values (the item's MinHash sketch, sized by its partition) at least
one occurs in every document that contains the item. Documents meet the sketches by
their shingle hashes; candidates are then verified by counting common shingles as text.
The search therefore has no false negatives, for documents of any length.

Items of fewer words than a shingle form partitions of their own: their whole word
sequence is the one shingle, and documents are also cut to that width.

Only DataFrame functions are used. Sketches and item shingles are broadcast when their
measured size allows it and joined by shuffle otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.llm.common import bind, fresh, stage, words
from voxmill.session import broadcast_within


def _normal(text: Column) -> Column:
    return words(F.lower(text.cast("string")))


def _starts(listed: Column, width: int) -> Column:
    n = F.size(listed) - (width - 1)
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _hashes(listed: Column, width: int) -> Column:
    """Hash of each run of ``width`` words."""
    return F.transform(_starts(listed, width), lambda i: F.xxhash64(*[listed[i + k] for k in range(width)]))


def _texts(listed: Column, width: int) -> Column:
    return F.transform(_starts(listed, width), lambda i: F.concat_ws(" ", *[listed[i + k] for k in range(width)]))


def item_shingles(benchmark: DataFrame, width: int = 5) -> DataFrame:
    """Distinct rows (item_id, item_words, h, shingle, n): n shingles, ``item_words`` words in one.

    Repeated rows of an item count once; a null or blank item has no shingle and matches
    nothing. Different texts under one id are one item with the shingles of all; rows
    without an id are not items.
    """
    listed = _normal(F.col("text"))
    parts = []
    for k in range(1, width + 1):
        fits = (F.size("w") == k) if k < width else (F.size("w") >= width)
        rows = benchmark.where("item_id is not null").select("item_id", listed.alias("w")).where(fits)
        at = F.explode(F.arrays_zip(_hashes(F.col("w"), k).alias("h"), _texts(F.col("w"), k).alias("s"))).alias("x")
        parts.append(rows.select("item_id", F.lit(k).alias("item_words"), at).select("item_id", "item_words", F.col("x.h").alias("h"), F.col("x.s").alias("shingle")))
    made = parts[0]
    for more in parts[1:]:
        made = made.union(more)
    made = made.distinct()
    sizes = made.groupBy(F.col("item_id").alias("_i")).agg(F.count("*").alias("n"))
    return made.join(sizes, made["item_id"] == sizes["_i"]).drop("_i")


def sketches(shingles: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Rows (h, item_id): the smallest hash values of each item, as many as its size partition asks for."""
    share = F.lit(threshold) - 1e-9
    kept = F.col("n") - F.ceil(share * F.col("n")) + 1
    listed = shingles.groupBy("item_id", "n").agg(F.sort_array(F.collect_set("h")).alias("hs"))
    return listed.select("item_id", F.explode(F.slice("hs", 1, F.greatest(kept, F.lit(1)).cast("int"))).alias("h"))


def contained(docs: DataFrame, benchmark: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """Rows (doc_id, row_hash, item_id, n_item, n_shared, containment) for every contained item.

    Documents are told apart by doc_id and their text's hash, so repeated rows are one and
    null ids take part. Null and blank documents contain nothing.
    """
    shingles = stage(item_shingles(benchmark, width))
    short = sorted(r[0] for r in shingles.where(F.col("item_words") < width).select("item_words").distinct().collect())
    probe = broadcast_within(stage(sketches(shingles, threshold)).select("h").distinct())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("row_hash"), "text")

    def cut(listed: Column, of: object) -> Column:
        made = [of(listed, k) for k in (width, *short)]
        return made[0] if len(made) == 1 else F.concat(*made)

    hashed = rows.select("doc_id", "row_hash", F.explode(bind(_normal(F.col("text")), lambda w: cut(w, _hashes))).alias("h"))
    hits = stage(hashed.join(probe, "h").select("doc_id", "row_hash").distinct())
    suspects = rows.join(hits, rows["doc_id"].eqNullSafe(hits["doc_id"]) & (rows["row_hash"] == hits["row_hash"]), "left_semi")
    texts = suspects.select("doc_id", "row_hash", F.explode(bind(_normal(F.col("text")), lambda w: cut(w, _texts))).alias("shingle"))
    known = broadcast_within(shingles.select("item_id", "shingle", "n"))
    shared = texts.join(known, "shingle").groupBy("doc_id", "row_hash", "item_id", "n").agg(F.countDistinct("shingle").alias("n_shared"))
    share = F.col("n_shared") / F.col("n")
    return shared.where(share >= threshold - 1e-9).select("doc_id", "row_hash", "item_id", F.col("n").alias("n_item"), "n_shared", share.alias("containment"))


def clean(docs: DataFrame, benchmark: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """``docs`` without the documents that contain a test item; all other rows stay as they are."""
    key, mark = fresh(docs, "_row"), fresh(docs, "_hash")
    found = contained(docs, benchmark, width, threshold).select(F.col("doc_id").alias(key), F.col("row_hash").alias(mark)).distinct()
    found = stage(found)
    return docs.join(found, docs["doc_id"].cast("long").eqNullSafe(found[key]) & (F.xxhash64(docs["text"].cast("string")) == found[mark]), "left_anti")
