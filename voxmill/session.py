"""Session helpers: lineage cuts, size-checked broadcasts, local sessions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Upper bound for a broadcast side, counted in scalar cells (about 8 to 32 bytes
# each), so the largest broadcast stays near 64 MB whatever the input size.
BROADCAST_CELLS = 2_000_000


def local_session(cores: int | str = 8, app: str = "voxmill") -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    parallel = "8" if cores == "*" else str(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", parallel)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local master, where driver and executors share one machine, may run
    without the setting; it then gets a temporary folder.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if folder:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(folder)
        return folder
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="voxmill-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably and drop its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Setting under which a query's shuffle files go when it ends, not when the driver happens to collect garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside leave no shuffle files: what they made is written, nobody reads those again."""
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE_SHUFFLES, before)


def stage(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Unlike :func:`cut` the copy is columnar and partitioned, so that a loop over
    chunks reads only its own partition and only the columns it asks for.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    writer = df.write.mode("error")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with shuffles_freed(spark):
        writer.parquet(path)
    back = spark.read.schema(df.schema).parquet(path).select(*df.columns)
    back._staged_at = path
    return back


def discard(df: DataFrame) -> None:
    """Remove a staged copy that no later result reads."""
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(df._staged_at)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


#: Rows of a part that :func:`spread` deals, once there are more parts than cores.
SPREAD_ROWS = 1 << 20


def spread(df: DataFrame, *partition_by: str) -> DataFrame:
    """Stage rows (with ``seq``) dealt evenly, to one part per core at least.

    A loop of passes over rows is as wide as their parts; a small file is one part,
    and so one core would make every pass.
    """
    rows = stage(df)
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // SPREAD_ROWS))
    dealt = stage(rows.repartition(parts, "seq"), *partition_by)
    discard(rows)
    return dealt


def cut_together(frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Materialise several tables by one write: their stages run side by side.

    Columns of the same name must have the same type.
    """
    tagged = [df.withColumn("_table", F.lit(name)) for name, df in frames.items()]
    union = tagged[0]
    for df in tagged[1:]:
        union = union.unionByName(df, allowMissingColumns=True)
    back = stage(union, "_table")
    return {name: back.where(F.col("_table") == name).select(*df.columns) for name, df in frames.items()}


def broadcast_within(df: DataFrame, cells: Column | int | None = None, limit: int = BROADCAST_CELLS) -> DataFrame:
    """Mark ``df`` for broadcast when its measured size allows it.

    ``cells`` is the number of scalars in a row (a number, or a column when
    rows carry arrays). Above ``limit`` the frame comes back unmarked and the
    join runs as a shuffled one, where adaptive execution splits skewed keys.
    """
    if cells is None:
        cells = len(df.columns)
    weight = F.lit(cells) if isinstance(cells, int) else cells
    total = df.agg(F.coalesce(F.sum(weight.cast("double")), F.lit(0.0)).alias("total")).first()["total"]
    return F.broadcast(df) if total <= limit else df
