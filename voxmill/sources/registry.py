"""Model store: versioned state tables, saved models, load on request."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..learners import FAMILIES, State
from .sinks import folder_exists

SAVE_EVERY = 50_000


def _path(root: str, family: str, table: str, version: int | str) -> str:
    return f"{root.rstrip('/')}/{family}/{table}/version={version}"


def save(state: State, root: str, family: str, version: int) -> State:
    """Write a family's state as one version; replays overwrite themselves.

    The returned state reads the written files, which also ends its lineage.
    """
    out = {}
    for table, df in state.items():
        path = _path(root, family, table, version)
        df.write.mode("overwrite").parquet(path)
        out[table] = df.sparkSession.read.schema(df.schema).parquet(path)
    marker = _path(root, family, "_complete", version)
    next(iter(out.values())).sparkSession.range(1).write.mode("overwrite").parquet(marker)
    return out


def load(spark: SparkSession, root: str, family: str, version: int) -> State | None:
    """A complete version, or None."""
    if not folder_exists(spark, _path(root, family, "_complete", version)):
        return None
    return {t: spark.read.parquet(_path(root, family, t, version)) for t in FAMILIES[family].tables}


def due_for_save(counts: DataFrame, every: int = SAVE_EVERY) -> DataFrame:
    """Models whose training count crossed a multiple of ``every``.

    ``counts`` has model_id, before, after.
    """
    return counts.where(F.floor(F.col("after") / every) > F.floor(F.col("before") / every)).select("model_id")


def replace_models(state: State, saved: State, models: DataFrame) -> State:
    """State where ``models`` (model_id) come from ``saved`` instead."""
    ids = models.select("model_id").distinct()
    return {
        t: state[t].join(ids, "model_id", "left_anti").unionByName(
            saved[t].select(*state[t].columns).join(ids, "model_id", "left_semi")
        )
        for t in state
    }


def renamed(state: State, names: DataFrame) -> State:
    """State of the models in ``names`` (old_id, model_id) under their new ids."""
    return {t: df.withColumnRenamed("model_id", "old_id").join(names, "old_id").select(*df.columns) for t, df in state.items()}


def only(state: State, models: DataFrame) -> State:
    """State without the rows of models that are not in ``models``."""
    ids = models.select("model_id").distinct()
    return {t: df.join(ids, "model_id", "left_semi") for t, df in state.items()}


def loadable(saved: State, models: DataFrame, family: str) -> tuple[DataFrame, DataFrame]:
    """Requested models that exist in the saved state, and those that do not."""
    have = FAMILIES[family].trained(saved)
    return models.join(have, "model_id", "left_semi"), models.join(have, "model_id", "left_anti")
