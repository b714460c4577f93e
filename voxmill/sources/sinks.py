"""Writers: partitioned results, per-row destinations, batch-idempotent tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.routing import destination


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_routed(routed: DataFrame, kind: str, path: str) -> None:
    """Dynamic-destination sink: one folder per destination named by the row."""
    routed.withColumn("destination", destination(kind)).write.mode("append").partitionBy("destination").parquet(path)


def topic_rows(routed: DataFrame, kind: str) -> DataFrame:
    """Rows for a message sink that reads the destination from ``topic``."""
    body = F.struct("streamID", "dataSetKey", "recordID", "fields")
    return routed.select(destination(kind).alias("topic"), F.col("recordID").alias("key"), F.to_json(body).alias("value"))


def write_batch(df: DataFrame, root: str, table: str, batch_id: int) -> DataFrame:
    """Write a batch's rows of a table; a replay overwrites the same folder.

    Returns the written rows, free of the lineage that made them.
    """
    path = f"{root.rstrip('/')}/{table}/batch_id={batch_id}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def folder_exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder holds anything, on whatever file system the path names."""
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop_path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the engine's own, if it is there."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written beside its place and then moved there."""
    place, beside = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.new"))
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = files.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    files.delete(place, False)
    files.rename(beside, place)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, or None when there is none."""
    if not folder_exists(spark, path):
        return None
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    given = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(place)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(given, "UTF-8")
    finally:
        given.close()


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame | None:
    """All batches of a table with their ``batch_id``, or None when none was written."""
    path = f"{root.rstrip('/')}/{table}"
    return spark.read.option("basePath", path).parquet(path) if folder_exists(spark, path) else None


def read_batch(spark: SparkSession, root: str, table: str, batch_id: int) -> DataFrame | None:
    path = f"{root.rstrip('/')}/{table}/batch_id={batch_id}"
    return spark.read.parquet(path) if folder_exists(spark, path) else None
