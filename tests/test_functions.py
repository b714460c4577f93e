import pytest
from pyspark.sql import functions as F

from voxmill.functions import coercion, hashing, keys


@pytest.mark.parametrize(
    "text, kind, number",
    [
        (" 7 ", "int", 7.0), ("2147483648", "double", 2147483648.0), ("1.5", "double", 1.5), ("1e3", "double", 1000.0), ("TRUE", "boolean", None),
        ("false", "boolean", None), ("t", "string", None), ("", "null", None), ("   ", "null", None), (None, "null", None), ("NaN", "double", None),
        ("nan", "string", None), ("Infinity", "double", float("inf")), ("ship-7", "string", None),
    ],
)
def test_inference(spark, text, kind, number):
    df = spark.createDataFrame([(text,)], "t string")
    row = df.select(coercion.infer_kind(F.col("t")).alias("k"), coercion.to_number(F.col("t")).alias("n")).first()
    assert row["k"] == kind
    if text != "nan":
        assert row["n"] == number


def test_typed_numbers(spark):
    df = spark.createDataFrame([("02/01/1970",), ("00:01:05",), ("31/02/2020",), ("24:00:00",)], "t string")
    got = df.select(coercion.date_number(F.col("t")).alias("d"), coercion.time_number(F.col("t")).alias("s")).collect()
    assert [tuple(r) for r in got] == [(1.0, None), (None, 65.0), (None, None), (None, None)]


def test_params(spark):
    df = spark.createDataFrame([({"b": "2", "a": "1"}, {"a": "1", "b": "2"}, {})], "x map<string,string>, y map<string,string>, z map<string,string>")
    r = df.select(
        (keys.params_signature(F.col("x")) == keys.params_signature(F.col("y"))).alias("same"), keys.params_signature(F.col("z")).alias("none"),
        keys.params_text(F.col("x")).alias("text"), keys.params_text(F.col("z")).alias("empty"),
        coercion.param(F.col("x"), ("c", "b"), 9).alias("second"), coercion.param_int(F.col("x"), "q", 9).alias("default"),
    ).first()
    assert tuple(r) == (True, "defaultParams", "{a=1, b=2}", "{}", 2.0, 9)


def test_scopes(spark):
    df = spark.createDataFrame([("s", "d"), ("", "d"), (None, "d")], "s string, d string")
    got = [r[0] for r in df.select(keys.record_scopes(F.col("s"), F.col("d"))).collect()]
    assert got == [["s-d", "d"], ["d"], ["d"]]


def test_poisson_mean(spark):
    r = spark.range(20000).select(hashing.poisson_weight("id", "3").alias("w")).agg(F.avg("w"), F.var_pop("w")).first()
    assert abs(r[0] - 6) < 0.15 and abs(r[1] - 6) < 0.5
