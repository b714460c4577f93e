"""Scope keys, hyper-parameter signatures and model keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scope_key(stream: Column, dataset: Column) -> Column:
    """``stream-dataset``, or the dataset alone for an empty stream."""
    return F.when(F.coalesce(stream, F.lit("")) != "", F.concat_ws("-", stream, dataset)).otherwise(dataset)


def record_scopes(stream: Column, dataset: Column) -> Column:
    """All scopes a record belongs to: its own stream's and the whole dataset's."""
    return F.when(
        F.coalesce(stream, F.lit("")) != "", F.array(F.concat_ws("-", stream, dataset), dataset)
    ).otherwise(F.array(dataset))


def sorted_params(params: Column) -> Column:
    return F.array_sort(F.map_entries(params))


def params_signature(params: Column) -> Column:
    """Order-independent digest of a parameter map; ``defaultParams`` when empty."""
    text = F.to_json(F.map_from_entries(sorted_params(params)))
    return F.when(F.coalesce(F.size(params), F.lit(0)) <= 0, F.lit("defaultParams")).otherwise(F.sha2(text, 256))


def params_text(params: Column) -> Column:
    """Readable form ``{a=1, b=2}`` carried by partial predictions."""
    pairs = F.transform(sorted_params(params), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return F.concat(F.lit("{"), F.coalesce(F.array_join(pairs, ", "), F.lit("")), F.lit("}"))


def model_key(scope: Column, algorithm: Column, target: Column, signature: Column) -> Column:
    return F.concat(scope, F.lit("___"), algorithm, F.lit("#"), target, F.lit("#"), signature)


def model_id(key: Column, created: Column) -> Column:
    """Short identifier of one life of a model, used in joins in place of the long key.

    A model that is deleted and created again is another one: the creating
    request's number is part of the identifier, so no old state is found.
    """
    return F.substring(F.sha2(F.concat_ws("@", key, created.cast("string")), 256), 1, 16)


def scope_of_key(key: Column) -> Column:
    return F.substring_index(key, "___", 1)


def split_scope(scope: Column) -> Column:
    """Stream and dataset of a scope text; the first dash separates them."""
    parts = F.split(scope, "-", 2)
    dashed = F.contains(scope, F.lit("-"))
    return F.struct(
        F.when(dashed, F.get(parts, 0)).otherwise(F.lit("")).alias("streamID"),
        F.when(dashed, F.get(parts, 1)).otherwise(scope).alias("dataSetKey"),
    )
