"""The contract between the dataflow and a learner family."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

State = dict[str, DataFrame]

# instances: model_id, scope, target, task_type, seq, recordID, x, label, y
PREDICTION = ("model_id", "scope", "target", "seq", "recordID", "prediction")


class Learner(Protocol):
    """A family of learners whose state is a set of tables keyed by model_id.

    ``update`` folds training instances into the state and ``predict`` answers
    instances from it; both work on all models of the family at once.
    ``models`` is the active-model table restricted to the family.
    """

    family: str
    tables: tuple[str, ...]

    def update(self, state: State | None, instances: DataFrame, models: DataFrame, chunks: int = 1) -> State: ...

    def predict(self, state: State, instances: DataFrame, models: DataFrame) -> DataFrame: ...

    def trained(self, state: State) -> DataFrame:
        """Models that can answer (one ``model_id`` column, distinct)."""
        ...


def argmax_label(scores: Column) -> Column:
    """Label of the best entry of an array<struct<score, order, label>>.

    ``order`` is the negated rank, so equal scores go to the first label.
    """
    return F.array_max(scores)["label"]


def with_chunks(instances: DataFrame, chunks: int) -> DataFrame:
    """Number instances 0 .. chunks-1 by equal ranges of ``seq`` per model.

    Ranges need only the smallest and largest ``seq`` of a model, not a sort.
    """
    if chunks <= 1:
        return instances.withColumn("chunk", F.lit(0))
    from ..session import broadcast_within, cut

    bounds = cut(instances.groupBy("model_id").agg(F.min("seq").alias("_lo"), F.max("seq").alias("_hi")))
    width = F.col("_hi") - F.col("_lo") + 1
    chunk = F.floor((F.col("seq") - F.col("_lo")) * F.lit(chunks) / width).cast("int")
    return instances.join(broadcast_within(bounds), "model_id").withColumn("chunk", chunk).drop("_lo", "_hi")
