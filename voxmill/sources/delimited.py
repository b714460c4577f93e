"""Delimited text files to typed JSON-lines records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coercion

# The extensions taken, in any case.
GLOB = "*.{[cC][sS][vV],[lL][oO][gG][sS],[tT][xX][tT]}"


def base_name(file_name: Column) -> Column:
    """File name without its last extension."""
    return F.when(file_name.rlike(r"^.+\.[^.]+$"), F.regexp_extract(file_name, r"^(.*)\.[^.]*$", 1)).otherwise(file_name)


def scope_of_file(file_name: Column) -> Column:
    """Stream and dataset from ``<stream>-<dataset>.<ext>``; null for a bad name."""
    parts = F.split(base_name(file_name), "-")
    return F.when(
        (F.size(parts) >= 2), F.struct(F.get(parts, 0).alias("streamID"), F.get(parts, 1).alias("dataSetKey"))
    )


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all eligible files below ``path``."""
    return (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", GLOB).text(path)
        .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("file_name"),
                F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_modification_time").alias("ts"))
    )


def headers(spark: SparkSession, path: str) -> DataFrame:
    """(file, file_name, header) per file: the first line, if not blank.

    Files are opened for their first line only.
    """
    lines = scan(spark, path).where("block = 0")
    # The header comes first in the first block, so its row has the smallest id.
    return (
        lines.withColumn("_i", F.monotonically_increasing_id()).groupBy("file", "file_name")
        .agg(F.min_by("value", "_i").alias("header"))
    )


def rejected_files(spark: SparkSession, path: str) -> DataFrame:
    """Files skipped for their name or an empty header."""
    found = headers(spark, path)
    reason = F.when(scope_of_file(F.col("file_name")).isNull(), F.lit("bad file name")).when(
        F.trim(F.coalesce("header", F.lit(""))) == "", F.lit("no header")
    )
    return found.select("file", "file_name", reason.alias("reason")).where("reason IS NOT NULL")


def read_delimited(spark: SparkSession, path: str, mode: str = "prediction") -> DataFrame:
    """Records of all eligible files below ``path``.

    Cells are trimmed; a short row's missing cells and empty cells are null,
    surplus cells are dropped. Prediction records get a deterministic id from
    file and content position; training records the empty id.
    """
    files = headers(spark, path).where("trim(header) <> ''")
    files = files.select("file", "header", scope_of_file(F.col("file_name")).alias("s")).where("s IS NOT NULL")
    names = F.transform(F.split("header", ","), lambda h: F.trim(h))
    described = files.select("file", "header", "s.streamID", "s.dataSetKey", names.alias("names"))
    lines = scan(spark, path).withColumn("_i", F.monotonically_increasing_id())
    first = lines.where("block = 0").groupBy("file").agg(F.min("_i").alias("_head"))
    rows = lines.join(first, "file").where((F.col("_i") != F.col("_head"))).join(described, "file")
    cells = F.split("value", ",", -1)
    pairs = F.transform(
        "names",
        lambda n, i: F.struct(n.alias("key"), F.nullif(F.trim(F.coalesce(F.get(cells, i), F.lit(""))), F.lit("")).alias("value")),
    )
    unique = F.aggregate(
        pairs, F.expr("CAST(map() AS map<string,string>)"),
        lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["key"]), F.map_from_entries(F.array(p))),
    )
    record_id = F.lit("") if mode == "training" else F.sha2(F.concat_ws("|", "file", F.col("_i").cast("string")), 256)
    return rows.select(
        "streamID", "dataSetKey", record_id.alias("recordID"), unique.alias("fields"), F.col("_i").alias("seq"), "ts"
    )


def typed_json(records: DataFrame) -> DataFrame:
    """Records as JSON lines whose field values carry their inferred type."""
    typed = F.to_variant_object(F.transform_values("fields", lambda _, v: coercion.infer_value(v)))
    body = F.struct("streamID", "dataSetKey", "recordID", typed.alias("fields"))
    return records.select(F.to_json(body, {"ignoreNullFields": "false"}).alias("value"))


def convert(spark: SparkSession, path: str, out: str, mode: str = "prediction") -> None:
    """Write all eligible files below ``path`` as typed JSON-lines records."""
    typed_json(read_delimited(spark, path, mode)).write.mode("overwrite").text(out)
