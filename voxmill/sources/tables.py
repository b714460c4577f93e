"""Relational tables as records and requests.

Any table can feed the dataflow: name the stream, dataset, id and order columns
and the columns that become fields.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def as_records(
    table: DataFrame, *, stream: Column, dataset: str, record_id: Column, seq: Column, fields: Mapping[str, Column], ts: Column | None = None
) -> DataFrame:
    pairs: list[Column] = []
    for name, value in fields.items():
        pairs += [F.lit(name), value.cast("string")]
    return table.select(
        stream.cast("string").alias("streamID"), F.lit(dataset).alias("dataSetKey"), record_id.cast("string").alias("recordID"),
        F.create_map(*pairs).alias("fields"), seq.cast("long").alias("seq"),
        (ts if ts is not None else F.lit(None)).cast("timestamp").alias("ts"),
    )


def order_records(spark: SparkSession, folder: str) -> DataFrame:
    """Orders; class target ``status``, numeric target ``price``."""
    o = load(spark, folder, "orders")
    return as_records(
        o, stream=F.col("o_orderpriority"), dataset="orders", record_id=F.col("o_orderkey"), seq=F.col("o_orderkey"), ts=F.col("o_orderdate"),
        fields={
            "price": F.col("o_totalprice"), "custmod": F.col("o_custkey") % 100, "month": F.month("o_orderdate"),
            "dow": F.dayofweek("o_orderdate"), "status": F.col("o_orderstatus"),
        },
    )


def vector_records(spark: SparkSession, folder: str, dims: int = 64) -> DataFrame:
    """Embedding rows with their ``dims`` components as fields e0, e1, ..."""
    v = load(spark, folder, "embeddings")
    fields = {f"e{i}": F.get("embedding", i).cast("double") for i in range(dims)}
    return as_records(
        v, stream=F.lit("vec"), dataset="embeddings", record_id=F.col("vec_id"), seq=F.col("vec_id"),
        fields={**fields, "label": F.col("label"), "num": F.col("label").cast("double")},
    )


def create_requests(records: DataFrame, wanted: Sequence[tuple[int, str, str, str, Mapping[str, object]]], per_stream: bool = True) -> DataFrame:
    """CREATE requests for the scopes found in ``records``.

    ``wanted`` lists (algorithm id, name, target, task, parameters). Each
    dataset gets the list for its dataset-wide scope and, with ``per_stream``,
    for every stream in it; ``seq`` numbers the wanted entries.
    """
    scopes = records.select("streamID", "dataSetKey").distinct()
    everywhere = scopes.select(F.lit("").alias("streamID"), "dataSetKey").distinct()
    scopes = scopes.unionByName(everywhere) if per_stream else everywhere
    entries = []
    for i, (algorithm, name, target, task, params) in enumerate(wanted):
        text: list[Column] = []
        for k, v in params.items():
            text += [F.lit(k), F.lit(str(v))]
        hyper = F.create_map(*text) if text else F.create_map()
        entries.append(
            F.struct(
                F.lit("Create").alias("commandType"), F.lit(algorithm).alias("algorithmID"), F.lit(name).alias("algorithmType"),
                hyper.cast("map<string,string>").alias("hyperParams"), F.lit(target).alias("target"), F.lit(task).alias("taskType"),
                F.lit(i).cast("long").alias("seq"),
            )
        )
    return scopes.select("streamID", "dataSetKey", F.explode(F.array(*entries)).alias("r")).select(
        "r.commandType", "r.algorithmID", "r.algorithmType", "streamID", "dataSetKey", "r.hyperParams", "r.target", "r.taskType", "r.seq"
    )
