"""Shared helpers: table access, words, binding of intermediate values, staged tables, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.session import shared_folder, shuffles_freed

#: White space of all word rules: space and \t to \r.
BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = "[ \\t-\\r]+"
WORD_RUN = "[^ \\t-\\r]+"
#: Repeated texts that are told to all tasks; of more, the rows of all texts are shuffled.
MOST_REPEATED = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    Plain nesting would repeat a costly array expression inside every lambda that
    looks at its neighbours; a one-element transform gives it a name.
    """
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Words of a text, in order; null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_RUN))


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have (names compare without case)."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name += "_"
    return name


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RUN)), F.lit(0)).cast("long")


def stage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: no lineage, computed once; its shuffle files go at once."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/llm-{uuid.uuid4().hex}"
    with shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._staged_at = path
    return back


def discard(*frames: DataFrame) -> None:
    """Remove staged tables that no later result reads."""
    for df in frames:
        path = getattr(df, "_staged_at", None)
        if path:
            jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)


def sampled(rows: DataFrame, key: Column, most: int) -> DataFrame:
    """At most ``most`` rows, those of the smallest hash ``key``; all rows if there are no more.

    A uniform hash tells beforehand where the limit will lie, so tasks pass on about as many
    rows as are kept, however many tasks there are.
    """
    total = rows.count()
    if total <= most:
        return rows
    bound = int((1 << 64) * most / total) - (1 << 63)
    name = fresh(rows, "_key")
    return rows.withColumn(name, key).where(F.col(name) <= bound).orderBy(name).limit(most).drop(name)


def small(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node that its links reach) of all nodes but the smallest of each class."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = place[: len(a)], place[len(a) :]
    label = np.arange(len(nodes))
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            break
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(label, up := label[label]):
            label = up
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _forests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a task as stars of what they connect."""
    held = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches if x.num_rows]
    if held:
        u, v = forest(np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held]))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def components(links: DataFrame, left: str = "a", right: str = "b", most_rounds: int = 60, task_links: int = 1 << 19) -> DataFrame:
    """Connected components of undirected links as rows (node, label), label the smallest node.

    A round deals the links to tasks of about ``task_links``, each of which replaces its own by
    stars of what they connect. Links that need several tasks are then contracted twice: every node's larger
    neighbours, then its smaller ones, are linked to the smallest node it knows. Both
    are an aggregate and a join, so a hub is combined before the shuffle and never
    gathered. Nodes without a link have no row; null ends are ignored.
    """
    a, b = F.col(left).cast("long"), F.col(right).cast("long")
    pairs = stage(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    n, before = pairs.count(), None
    for _ in range(most_rounds):
        tasks = max(1, -(-n // task_links))
        stars = pairs.coalesce(tasks).mapInArrow(_forests, "u long, v long")
        if tasks > 1:
            both = stage(stars.distinct())
            stars, both = both, both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
            low = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
            after = stage(small)
            discard(stars)
        else:
            after = stage(stars)
        discard(pairs)
        pairs = after
        n, *sign = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tasks == 1 or (n, sign) == before:
            break
        before = n, sign
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("label")).union(pairs.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def keep_best(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """``docs`` with one row of each class (k, label) of text keys, chosen by (id is null, doc_id, text key)."""
    key = fresh(docs, "_text_key")
    rows = docs.select(text_key(F.col("text")).alias("k"), F.col("doc_id").cast("long").alias("id")).groupBy("k", "id").agg(F.count("*").alias("m"))
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k", "m")).alias("best")
    per_text = rows.groupBy("k").agg(best)
    chosen = per_text.join(classes, "k", "left").groupBy(F.coalesce("label", "k").alias("label")).agg(F.min("best").alias("best"))
    chosen = stage(chosen.select(F.col("best.id").alias("id"), F.col("best.k").alias(key), F.col("best.m").alias("m")))
    held = docs.withColumn(key, text_key(F.col("text")))

    def rows_of(wanted: DataFrame) -> DataFrame:
        wanted = wanted.withColumnRenamed("id", name := fresh(docs, "_id")).drop("m")
        same = (held[key] == wanted[key]) & held["doc_id"].cast("long").eqNullSafe(wanted[name])
        return held.join(wanted, same, "left_semi")

    # Texts are shuffled once; only rows that the table has again are shuffled to be one row each.
    again = chosen.where("m > 1")
    repeated = again.count()
    if not repeated:
        return rows_of(chosen).drop(key)
    if repeated > MOST_REPEATED:
        return rows_of(chosen).dropDuplicates([key]).drop(key)
    return rows_of(chosen.where("m = 1")).union(rows_of(F.broadcast(again)).dropDuplicates([key])).drop(key)
