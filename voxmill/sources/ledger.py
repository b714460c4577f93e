"""Tables that change a little with each batch, kept as segments of changes.

A batch writes only what it adds and the keys of what it removes. Segments are merged when
the newer ones hold more than half the rows of the one before, so a row is rewritten about
log2(n) times, a table has about log2(n) segments, and neither reading nor writing depends
on how many batches there were. A batch's manifest lists its segments; what no manifest of
the last two batches lists is deleted, so the last batch can be replayed.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import sinks


@dataclass(frozen=True)
class Segment:
    name: str
    rows: int
    until: datetime | None = None

    @property
    def first(self) -> str:
        return self.name.split("_")[0]


@dataclass(frozen=True)
class Ledger:
    """Rows of ``schema`` below ``root``/``name``; a removed key takes along all its rows of earlier batches.

    Keys compare null-safe. Batches count upward by one. With ``clock``, a timestamp column,
    rows older than the ``floor`` given to :meth:`write` end by themselves.
    """

    spark: SparkSession
    root: str
    name: str
    schema: str
    keys: tuple[str, ...]
    clock: str | None = None

    @property
    def _path(self) -> str:
        return f"{self.root.rstrip('/')}/{self.name}"

    @property
    def columns(self) -> list[str]:
        return StructType.fromDDL(self.schema).names

    def segments(self, batch_id: int) -> list[Segment]:
        """The segments at the end of a batch, oldest first."""
        listed = sinks.read_text(self.spark, self._manifest(batch_id))
        return [Segment(name, rows, until and datetime.fromisoformat(until)) for name, rows, until in json.loads(listed or "[]")]

    def _manifest(self, batch_id: int) -> str:
        return f"{self._path}/manifest/{batch_id}.json"

    def at(self, batch_id: int) -> DataFrame:
        """The rows at the end of a batch; none before the first."""
        return self._live(self.segments(batch_id)).select(*self.columns)

    def write(self, batch_id: int, added: DataFrame, gone: DataFrame | None = None, floor: Column | None = None) -> None:
        """Rows that a batch adds, and keys whose earlier rows it removes; a replay overwrites itself."""
        before = self.segments(batch_id - 1)
        if self.clock and floor is not None:
            added = added.where(F.col(self.clock) >= floor)
            oldest = self.spark.range(1).select(floor.cast("timestamp").alias("t")).first()["t"] if before else None
            listed = [s for s in before if s.until is None or s.until >= oldest]
        else:
            listed = before
        change = added.select(*self.columns).withColumn("_gone", F.lit(False))
        if gone is not None:
            change = change.unionByName(gone.select(*self.keys).distinct().withColumn("_gone", F.lit(True)), allowMissingColumns=True)
        own = self._put(f"{batch_id}_{batch_id}", change)
        if own.rows:
            listed = listed + [own]
            start, rows = len(listed) - 1, own.rows
            while start and listed[start - 1].rows < 2 * rows:
                start -= 1
                rows += listed[start].rows
            if start < len(listed) - 1:
                whole = self._merged(listed[start:], start == 0, floor)
                made = self._put(f"{listed[start].first}_{batch_id}", whole)
                listed = listed[:start] + ([made] if made.rows else [])
        table = [(s.name, s.rows, s.until and s.until.isoformat()) for s in listed]
        sinks.write_text(self.spark, self._manifest(batch_id), json.dumps(table))
        self._retire(batch_id, before, listed)

    def _put(self, name: str, change: DataFrame) -> Segment:
        """Write a segment; its rows and newest time come from the written files."""
        path = f"{self._path}/segments/{name}"
        change.write.mode("overwrite").parquet(path)
        until = F.max(self.clock) if self.clock else F.lit(None)
        seen = self._read([Segment(name, 0)]).agg(F.count(F.lit(1)).alias("rows"), until.cast("timestamp").alias("until")).first()
        return Segment(name, seen["rows"], seen["until"])

    def _read(self, listed: list[Segment]) -> DataFrame:
        schema = f"{self.schema}, _gone boolean"
        parts = [self.spark.read.schema(schema).parquet(f"{self._path}/segments/{s.name}").withColumn("_place", F.lit(k)) for k, s in enumerate(listed)]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], f"{schema}, _place int")

    def _live(self, listed: list[Segment]) -> DataFrame:
        """Added rows whose key no later segment removes."""
        rows = self._read(listed)
        added = rows.where("NOT _gone")
        if len(listed) < 2:
            return added
        ended = rows.where("_gone").groupBy(*[F.col(k).alias(f"_end_{k}") for k in self.keys]).agg(F.max("_place").alias("_ended"))
        same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_end_{k}")) for k in self.keys])
        return added.join(ended, same & (F.col("_ended") > F.col("_place")), "left_anti")

    def _merged(self, listed: list[Segment], oldest: bool, floor: Column | None) -> DataFrame:
        live = self._live(listed).select(*self.columns, "_gone")
        if self.clock and floor is not None:
            live = live.where(F.col(self.clock) >= floor)
        if oldest:
            return live  # nothing earlier is left to remove
        ended = self._read(listed).where("_gone").select(*self.keys).distinct().withColumn("_gone", F.lit(True))
        return live.unionByName(ended, allowMissingColumns=True)

    def _retire(self, batch_id: int, before: list[Segment], listed: list[Segment]) -> None:
        last = [s.name for s in self.segments(batch_id - 2)] + [f"{batch_id - 1}_{batch_id - 1}", f"{batch_id}_{batch_id}"]
        for name in set(last) - {s.name for s in before} - {s.name for s in listed}:
            sinks.remove_folder(self.spark, f"{self._path}/segments/{name}")
        sinks.remove_folder(self.spark, self._manifest(batch_id - 2))
