"""Arrival order of records read from files or topics.

Spark packs file splits into partitions by size, so a row id that follows partitions
does not follow time. Here the splits themselves are ranked by (file time, file path,
start in the file), and a row's place is (rank of its split, position within it).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import broadcast_within

# A split has fewer rows than 2^33, the bound of a partition's row ids.
ROW_BITS = 33
SPLIT = ("_file_time", "_file", "_start")


def marked(records: DataFrame) -> DataFrame:
    """Add the split of each row; works on batch and streaming file sources."""
    return records.select(
        "*", F.col("_metadata.file_modification_time").alias("_file_time"), F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
    )


def row_in_partition() -> Column:
    return F.monotonically_increasing_id().bitwiseAND(F.lit((1 << ROW_BITS) - 1))


def ranked_splits(marked_rows: DataFrame) -> DataFrame:
    """Splits with their rank; as many rows as the input has splits."""
    splits = marked_rows.select(*SPLIT).distinct()
    return splits.withColumn("_rank", F.row_number().over(W.orderBy(*SPLIT)).cast("long"))


def in_order(marked_rows: DataFrame, name: str = "seq") -> DataFrame:
    """Add ``name``, increasing with arrival and unique; drops the split columns.

    Rows of one split keep their order, rows of different splits follow file
    time, then path, then position in the file.
    """
    numbered = marked_rows.withColumn("_row", row_in_partition())
    ranks = broadcast_within(ranked_splits(marked_rows))
    placed = numbered.join(ranks, list(SPLIT))
    seq = F.shiftleft(F.col("_rank"), ROW_BITS).bitwiseOR(F.col("_row"))
    return placed.withColumn(name, seq).drop(*SPLIT, "_rank", "_row")


def sorted_by(records: DataFrame, *order: str) -> DataFrame:
    """Rows in the global order of some columns, e.g. (time, topic partition, offset)."""
    return records.repartitionByRange(*order).sortWithinPartitions(*order)
