"""Throughput and progress tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.coercion import ratio
from ..functions.scans import rank_in_order, running
from ..session import cut

BUCKET = 10_000


def throughput_buckets(stream: DataFrame, keys: list[str], order: str = "seq", ts: str = "ts", bucket: int = BUCKET) -> DataFrame:
    """Records per second for every ``bucket`` records of a stage, and overall so far.

    A bucket's time runs from the previous bucket's last record to its own.
    """
    ranked = rank_in_order(stream.select(*keys, order, ts), keys, order, "_rank")
    per = ranked.withColumn("bucket", F.floor((F.col("_rank") - 1) / F.lit(bucket)).cast("long")).groupBy(*keys, "bucket").agg(
        F.count(F.lit(1)).alias("records"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")
    )
    per = cut(per)
    # Sliced running aggregates: a stage has one row per bucket, which may be many.
    until = running(per, keys, "bucket", {"total_records": ("sum", F.col("records")), "_origin": ("min", F.struct("bucket", "first_ts"))})
    before = running(until, keys, "bucket", {"_previous": ("max", F.struct("bucket", "last_ts"))}, inclusive=False)
    start, origin, total = F.coalesce("_previous.last_ts", "first_ts"), F.col("_origin.first_ts"), F.col("total_records")
    micros = lambda a, b: (F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / F.lit(1e6)
    return before.select(
        *keys, "bucket", "records", "total_records",
        ratio(F.col("records"), micros(F.col("last_ts"), start)).alias("rate"),
        ratio(total, micros(F.col("last_ts"), origin)).alias("total_rate"),
    )


def progress_rollup(progress: DataFrame, period: str = "5 seconds") -> DataFrame:
    """Summed process rate and mean batch latency per tumbling period."""
    return (
        progress.groupBy("stage", F.window("ts", period).alias("w"))
        .agg(F.sum("rate").alias("process_rate"), F.avg("latency_ms").alias("latency_avg"), F.count(F.lit(1)).alias("samples"))
        .select("stage", F.col("w.start").alias("period_start"), "process_rate", "latency_avg", "samples")
    )


def progress_row(spark, batch_id: int, stage: str, rows: int, millis: float) -> DataFrame:
    """One progress sample, as the streaming loop appends it."""
    rate = rows / (millis / 1000.0) if millis > 0 else 0.0
    return spark.createDataFrame(
        [(batch_id, stage, rows, float(millis), float(rate))],
        "batch_id long, stage string, rows long, latency_ms double, rate double",
    ).withColumn("ts", F.current_timestamp())
