"""As-of lookup of model versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scans import SLICE_WIDTH, running


def version_as_of(records: DataFrame, versions: DataFrame, keys: list[str], order: str = "seq", width: int = SLICE_WIDTH) -> DataFrame:
    """Latest version at or before each record; null when there is none yet.

    Versions and records are merged into one ordered series and the last
    version is carried forward by a sliced running maximum, so neither side is
    collected and no record-version pairs are formed. At equal order values
    the version comes first.
    """
    slot = F.col(order).cast("long") * 2
    v = versions.select(*keys, slot.alias("_slot"), F.struct(F.col(order).alias("at"), "version").alias("_version"))
    r = records.withColumn("_slot", slot + 1).withColumn("_row", F.lit(True))
    both = r.unionByName(v, allowMissingColumns=True)
    carried = running(both, keys, "_slot", {"_asof": ("max", F.col("_version"))}, width=width)
    return carried.where("_row").select(*records.columns, F.col("_asof.version").alias("version"))
