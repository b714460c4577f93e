"""k-nearest neighbours over each model's last ``limit`` training rows."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import coercion
from ..functions.scans import newest
from ..schema import BY_NAME
from ..session import broadcast_within
from .base import PREDICTION, State

# The task-side helpers travel with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DEFAULTS = BY_NAME["knn"].defaults
BROADCAST_CELLS = 4_000_000
ROWS_PER_GROUP = 50_000
BLOCK = 512

OUT = "model_id string, scope string, target string, seq long, recordID string, prediction string"
ROWS = ["seq", "x", "label", "y"]


def buffer_limits(models: DataFrame) -> DataFrame:
    return models.select(
        "model_id",
        coercion.param_int(F.col("hyper_params"), ("limitOption", "limit"), DEFAULTS["limitOption"]).alias("limit"),
    )


def buffer(instances: DataFrame, models: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Newest ``limit`` rows per model (model_id, seq, x, label, y)."""
    rows = instances.select("model_id", *ROWS)
    if previous is not None:
        rows = rows.unionByName(previous)
    limited = rows.join(broadcast_within(buffer_limits(models)), "model_id")
    return newest(limited, ["model_id"], "seq", F.col("limit")).select("model_id", *ROWS)


def _matrix(rows: pd.Series) -> np.ndarray:
    """Stack vectors of possibly different lengths, NaN where missing."""
    if not len(rows):
        return np.zeros((0, 0))
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    flat = np.concatenate(rows.to_list())
    if flat.dtype == object:
        flat = pd.to_numeric(pd.Series(flat), errors="coerce").to_numpy(dtype=float)
    width = int(sizes.max())
    if (sizes == width).all():
        return flat.astype(float).reshape(len(rows), width)
    out = np.full((len(rows), width), np.nan)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def _dense(rows: pa.ListArray) -> np.ndarray:
    """As :func:`_matrix`, of a list column."""
    sizes = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
    width = int(sizes.max()) if len(sizes) else 0
    out = np.full((len(sizes), width), np.nan)
    out[np.arange(width)[None, :] < sizes[:, None]] = rows.flatten().to_numpy(zero_copy_only=False)
    return out


class _Memory:
    """A model's buffer, sorted by seq so that stable sorting breaks ties.

    One matrix product grades a block of queries against the whole buffer up to rounding. Only
    entries that its error leaves as possible neighbours are computed by the definition, so the
    answers are those of the definition; values too large for a product take it for all entries.
    """

    def __init__(self, rows: pd.DataFrame, k: int, regression: bool):
        rows = rows.sort_values("seq", kind="stable")
        self.x = _matrix(rows["x"])
        self.names, code = np.unique(rows["label"].to_numpy().astype(str), return_inverse=True)
        self.member = np.eye(len(self.names), dtype=np.float32)[code]
        self.y = rows["y"].to_numpy(dtype=float)
        self.k, self.regression = min(k, len(rows)), regression
        with np.errstate(all="ignore"):
            seen = ~np.isnan(self.x)
            high = np.max(np.where(seen, self.x, -np.inf), axis=0, initial=-np.inf)
            low = np.min(np.where(seen, self.x, np.inf), axis=0, initial=np.inf)
            self.span = np.where(high > low, high - low, 0.0)
            self.low = np.where(self.span > 0, low, 0.0)
            there = seen.astype(float)
            unit = np.where(seen, self._scaled(self.x), 0.0)
        self.factors = np.concatenate([there, unit * unit - there, unit], axis=1).T.copy()
        self.plain = self.k > 0 and bool(np.isfinite(self.factors).all() and np.isfinite(self.span).all())
        self.graded = 0  # pairs computed by the definition

    def _scaled(self, rows: np.ndarray) -> np.ndarray:
        return np.where(self.span > 0, (rows - self.low) / np.where(self.span > 0, self.span, 1.0), rows * 0.0)

    def answer(self, queries: np.ndarray) -> list:
        width = self.x.shape[1]
        if queries.shape[1] < width:
            queries = np.pad(queries, ((0, 0), (0, width - queries.shape[1])), constant_values=np.nan)
        queries, out = queries[:, :width], []
        for start in range(0, len(queries), BLOCK):
            q = queries[start : start + BLOCK]
            out.extend(self._vote(self._possible(q) if self.plain else self._all(q)))
        return out

    def _all(self, q: np.ndarray) -> np.ndarray:
        """Mask of the k nearest by all distances."""
        row, at = np.divmod(np.arange(len(q) * len(self.x)), len(self.x))
        return self._nearest(self._distance(q, row, at).reshape(len(q), len(self.x)))

    def _distance(self, q: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Distances of the pairs (query ``row``, buffer row ``at``)."""
        self.graded += len(row)
        total = np.zeros(len(row))
        with np.errstate(all="ignore"):
            for j in range(self.x.shape[1]):
                diff = q[row, j] - self.x[at, j]
                term = np.zeros_like(diff) if self.span[j] == 0 else (diff / self.span[j]) ** 2
                total += np.where(np.isnan(diff), 1.0, term)
            return np.round(np.sqrt(total), 9)

    def _possible(self, q: np.ndarray) -> np.ndarray:
        """Mask of the k nearest by the distances of entries that may be among them."""
        n, width = self.x.shape
        with np.errstate(all="ignore"):
            there = ~np.isnan(q)
            unit = np.where(there, self._scaled(q), 0.0)
            size = np.square(np.abs(unit) + 1.0).sum(axis=1) + 1.0
        fit = np.isfinite(size) & (size < 1e150)
        if not fit.all():
            mask = np.zeros((len(q), n), bool)
            mask[~fit] = self._all(q[~fit])
            if fit.any():
                mask[fit] = self._possible(q[fit])
            return mask
        rough = np.concatenate([unit * unit, there, -2.0 * unit], axis=1) @ self.factors + width
        error = 1e-15 * (3 * width + 8) * size
        # The k-th least of the least of k groups or more is no less than the k-th least of all.
        groups = min(n, max(64, 8 * self.k))
        least = rough[:, : n // groups * groups].reshape(len(q), n // groups, groups).min(axis=1)
        edge = np.partition(least, self.k - 1, axis=1)[:, self.k - 1]
        most = (np.sqrt(np.maximum(edge, 0.0) + error) * (1 + 1e-14) + 2e-9) ** 2 + error  # distances are told apart by 9 digits
        row, at = np.nonzero(rough <= most[:, None])
        far = self._distance(q, row, at)
        order = np.lexsort((at, far, row))
        row, at = row[order], at[order]
        first = np.searchsorted(row, np.arange(len(q)))
        kept = np.arange(len(row)) - first[row] < self.k
        mask = np.zeros((len(q), n), bool)
        mask[row[kept], at[kept]] = True
        return mask

    def _nearest(self, distance: np.ndarray) -> np.ndarray:
        """Mask of the k nearest; of equally far ones the earlier in the buffer."""
        edge = np.partition(distance, self.k - 1, axis=1)[:, self.k - 1 : self.k]
        closer, level = distance < edge, distance == edge
        room = self.k - closer.sum(axis=1, keepdims=True)
        return closer | (level & (level.cumsum(axis=1) <= room))

    def _vote(self, nearest: np.ndarray) -> list:
        if self.regression:
            return [repr(v) for v in (nearest @ self.y / self.k).tolist()]
        counts = nearest.astype(np.float32) @ self.member  # names are sorted, so the first best is the smallest
        return self.names[counts.argmax(axis=1)].tolist()


def _answer_frame(pdf: pd.DataFrame, memory: _Memory) -> pd.DataFrame:
    result = pdf[["model_id", "scope", "target", "seq", "recordID"]].copy()
    result["prediction"] = memory.answer(_matrix(pdf["x"])) if len(pdf) else []
    return result


class NearestNeighbours:
    family = "neighbours"
    tables = ("buffer",)

    def update(self, state: State | None, instances: DataFrame, models: DataFrame, chunks: int = 1) -> State:
        return {"buffer": buffer(instances, models, state["buffer"] if state else None)}

    def predict(self, state: State, instances: DataFrame, models: DataFrame) -> DataFrame:
        settings = models.select(
            "model_id",
            coercion.param_int(F.col("hyper_params"), "k", DEFAULTS["k"]).alias("k"),
            (F.col("task_type") == "regression").alias("regression"),
        )
        held = state["buffer"].join(broadcast_within(settings), "model_id")
        cells = held.agg(F.coalesce(F.sum(F.size("x") + 4), F.lit(0)).alias("c")).first()["c"]
        wanted = instances.select("model_id", "scope", "target", "seq", "recordID", "x")
        if cells <= BROADCAST_CELLS:
            return self._map_side(held, wanted)
        return self._shuffled(held, wanted)

    def _map_side(self, held: DataFrame, wanted: DataFrame) -> DataFrame:
        """Buffers of proven size travel to the tasks; rows are not shuffled."""
        shipped = wanted.sparkSession.sparkContext.broadcast(held.toPandas())

        def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            memories = {
                model: _Memory(rows, int(rows["k"].iloc[0]), bool(rows["regression"].iloc[0]))
                for model, rows in shipped.value.groupby("model_id")
            }
            for batch in batches:
                coded = batch.column(0).dictionary_encode()
                for code, model in enumerate(coded.dictionary.to_pylist()):
                    if model in memories:
                        rows = batch.filter(pc.equal(coded.indices, code))
                        made = memories[model].answer(_dense(rows.column(5)))
                        yield pa.RecordBatch.from_arrays([*rows.columns[:5], pa.array(made, pa.string())], [*batch.schema.names[:5], "prediction"])

        return wanted.mapInArrow(answer, OUT).select(*PREDICTION)

    def _shuffled(self, held: DataFrame, wanted: DataFrame) -> DataFrame:
        """Large buffers: rows of a model are split over salted groups.

        Every group holds at most about ``ROWS_PER_GROUP`` rows and one copy of
        its model's buffer (``limit`` rows).
        """
        sizes = wanted.groupBy("model_id").agg(
            F.ceil(F.count(F.lit(1)) / F.lit(ROWS_PER_GROUP)).cast("int").alias("salts")
        )
        salted = wanted.join(sizes, "model_id").withColumn("salt", F.pmod(F.xxhash64("seq", "recordID"), F.col("salts")).cast("int"))
        # Renamed throughout: both sides come from the same model table.
        copies = held.join(sizes, "model_id").select(
            F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("b_salt"),
            *[F.col(c).alias(f"b_{c}") for c in ("model_id", "seq", "x", "label", "y", "k", "regression")],
        )

        def answer(rows: pd.DataFrame, memory: pd.DataFrame) -> pd.DataFrame:
            if not len(rows) or not len(memory):
                return pd.DataFrame(columns=["model_id", "scope", "target", "seq", "recordID", "prediction"])
            memory = memory.rename(columns=lambda c: c[2:])
            m = _Memory(memory, int(memory["k"].iloc[0]), bool(memory["regression"].iloc[0]))
            return _answer_frame(rows, m)

        grouped = salted.drop("salts").groupBy("model_id", "salt").cogroup(copies.groupBy("b_model_id", "b_salt"))
        return grouped.applyInPandas(answer, OUT).select(*PREDICTION)

    def trained(self, state: State) -> DataFrame:
        return state["buffer"].select("model_id").distinct()
