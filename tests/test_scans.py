import random

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxmill.functions.scans import newest, rank_in_order, running


def _series(spark, seed=1, n=600):
    rnd = random.Random(seed)
    rows = [("hot" if rnd.random() < 0.6 else f"k{rnd.randrange(5)}", s, rnd.randrange(1000)) for s in rnd.sample(range(5000), n)]
    return spark.createDataFrame(rows, "k string, seq long, v long")


def test_running_equals_window(spark):
    df = _series(spark)
    for inclusive in (True, False):
        w = W.partitionBy("k").orderBy("seq").rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
        want = df.select("*", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("s"), F.min("v").over(w).alias("lo"), F.max("v").over(w).alias("hi"))
        aggs = {"s": ("sum", F.col("v")), "lo": ("min", F.col("v")), "hi": ("max", F.col("v"))}
        got = running(df, ["k"], "seq", aggs, inclusive=inclusive, width=64)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()), key=lambda t: t)


def test_rank_and_newest(spark):
    df = _series(spark, 2)
    w = W.partitionBy("k").orderBy("seq")
    want = df.withColumn("r", F.row_number().over(w)).collect()
    assert sorted(map(tuple, rank_in_order(df, ["k"], "seq", "r", width=50).collect())) == sorted(map(tuple, want))
    down = W.partitionBy("k").orderBy(F.desc("seq"))
    want = df.withColumn("r", F.row_number().over(down)).where("r <= 17").drop("r").collect()
    assert sorted(map(tuple, newest(df, ["k"], "seq", F.lit(17), width=50).collect())) == sorted(map(tuple, want))
