"""Record and request readers, batch and streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..session import broadcast_within
from . import arrival

CORRUPT = "_corrupt"


def _with_corrupt(shape: T.StructType) -> T.StructType:
    return T.StructType([*shape.fields, T.StructField(CORRUPT, T.StringType())])


def read_records(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """JSON-lines records of a file or folder tree; numbers keep their text.

    Undecodable lines stay in ``_corrupt`` for :func:`split_rejects`.
    """
    return (
        spark.read.schema(_with_corrupt(schema.RECORD))
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
        .option("recursiveFileLookup", True).option("pathGlobFilter", glob)
        .json(path)
    )


def stream_records(spark: SparkSession, path: str, glob: str = "*.json", files_per_trigger: int | None = None) -> DataFrame:
    """The same records as an unbounded source, from the earliest file on."""
    reader = (
        spark.readStream.schema(_with_corrupt(schema.RECORD))
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
        .option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    )
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return arrival.marked(reader.json(path))


def stream_topic(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Records of a message topic from the earliest offset.

    Needs the Kafka connector on the class path. Order is message time, then
    partition and offset, which the engine turns into ``seq``.
    """
    raw = (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic).option("startingOffsets", "earliest").load()
    )
    return decode(raw.select(F.col("value").cast("string").alias("value"), F.col("timestamp").alias("ts"),
                             F.col("partition").alias("_partition"), F.col("offset").alias("_offset")))


def decode(payloads: DataFrame) -> DataFrame:
    """Text payloads (``value``) to record columns; bad ones in ``_corrupt``."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parsed = payloads.withColumn("r", F.from_json("value", _with_corrupt(schema.RECORD), options))
    rest = [c for c in payloads.columns if c != "value"]
    return parsed.select("r.*", *rest)


def split_rejects(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable records and rejected payloads."""
    bad = F.col(CORRUPT).isNotNull() | F.col("fields").isNull() | F.col("dataSetKey").isNull()
    return records.where(~bad).drop(CORRUPT), records.where(bad)


def ordered(records: DataFrame, seq: str | None = None, ts: str | None = None) -> DataFrame:
    """Add ``seq`` and ``ts`` where the source does not bring them.

    ``seq`` and ``ts`` name fields of the payload that hold them. Without a
    field, ``seq`` follows file time, file path and position in the file,
    unique but sparse, and ``ts`` is the file's modification time. A row whose
    ``seq`` field is no integer keeps a null; see :func:`split_unordered`.
    """
    out = records
    if not seq and "seq" not in records.columns:
        out = arrival.marked(out)
    if ts:
        out = out.withColumn("ts", F.try_to_timestamp(F.try_element_at("fields", F.lit(ts))))
    elif "ts" not in records.columns:
        out = out.withColumn("ts", F.col("_file_time") if "_file_time" in out.columns else F.col("_metadata.file_modification_time"))
    if seq:
        return out.withColumn("seq", F.try_element_at("fields", F.lit(seq)).try_cast("long"))
    return arrival.in_order(out) if "seq" not in records.columns else out


def split_unordered(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with an order, and rows without one, which no learner may take."""
    return records.where("seq IS NOT NULL"), records.where("seq IS NULL")


def _request_files(spark: SparkSession, path: str) -> DataFrame:
    texts = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True)
    parsed = F.from_json("value", T.ArrayType(schema.REQUEST), {"mode": "PERMISSIVE"})
    return texts.select(F.col("_metadata.file_path").alias("file"), "value", parsed.alias("r"))


def _unreadable() -> Column:
    return F.col("r").isNull() | F.exists("r", lambda x: x.isNull()) | (F.try_parse_json("value").isNull())


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Requests from JSON-array files, a file or a whole folder, in file order.

    ``seq`` numbers requests by file name and position inside the array. Files
    that do not parse are listed by :func:`rejected_request_files`.
    """
    named = _request_files(spark, path).where(~_unreadable()).select("file", "r")
    listed = named.select("file", F.posexplode("r").alias("pos", "c"))
    numbered = named.select("file").distinct().withColumn("_f", F.row_number().over(W.orderBy("file")))
    return listed.join(broadcast_within(numbered), "file").select(
        "c.*", (F.col("_f").cast("long") * F.lit(1 << 32) + F.col("pos")).alias("seq")
    )


def rejected_request_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, value) of request files that are no JSON array of requests."""
    return _request_files(spark, path).where(_unreadable()).select("file", "value")
