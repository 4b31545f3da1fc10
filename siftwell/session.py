"""Session helpers: the shared staging folder, written intermediates and their owners, joins by key."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def tune(spark: SparkSession) -> SparkSession:
    """Settings the expressions here rely on; all of them can be changed on a running session.

    A long mapping makes one generated method of more than 8000 bytes, which the JVM never
    compiles: above that size Spark should split it per operator instead. Hot keys that survive
    pre-aggregation are split by the adaptive skew join, also where that costs a shuffle.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the cluster in spark.checkpoint.dir."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="siftwell-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_folder(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that nothing else uses."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def _files(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


class Scope:
    """Owns the folders staged while it is open, and deletes them when it closes."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def close(self) -> None:
        for path in self.paths:
            files, folder = _files(self.spark, path)
            files.delete(folder, True)
        self.paths.clear()


# The scope of the running thread (or task): loads that run side by side never see each other's.
_scope: ContextVar[Scope | None] = ContextVar("staging scope", default=None)


@contextmanager
def staging(spark: SparkSession):
    """Folders staged inside are deleted at the end; nothing that reads them may outlive the block."""
    scope = Scope(spark)
    token = _scope.set(scope)
    try:
        yield scope
    finally:
        _scope.reset(token)
        scope.close()


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write once, read back as columns.

    Cuts lineage, so a lost executor costs a re-read and not a recomputation, and fixes values
    that depend on the scan layout (line positions). Later steps read only the columns they use.
    The open scope owns the folder; without one it belongs to the driver's JVM and goes with it.
    """
    spark, path = df.sparkSession, new_folder(df.sparkSession, label)
    scope = _scope.get()
    if scope is not None:
        scope.paths.append(path)
    else:
        files, folder = _files(spark, path)
        files.deleteOnExit(folder)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *by: str, column: str = "place", start: int = 1) -> DataFrame:
    """The rows with their places in the order of `by`: sorted by ranges, counted per range, and the ranges before added.

    The sizes of the ranges are one short row per task.
    """
    own = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = stage(df.orderBy(*by).withColumns({"_part": F.spark_partition_id(), "_own": own}), "dealt")
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))
    return dealt.join(F.broadcast(before), "_part").withColumn(column, F.lit(start) + F.col("_before") + F.col("_own")).drop("_part", "_own", "_before")


def key_join(
    left: DataFrame, right: DataFrame, on: list[tuple[Column, Column]], how: str = "left", null_safe: bool = False,
) -> DataFrame:
    """Equi-join on pairs of columns, NULL equal to NULL if asked.

    Nothing is hinted: Spark broadcasts a side below the session's threshold, and the adaptive skew join
    that `tune` switches on splits a hot key of the other plans.
    """
    equals = [a.eqNullSafe(b) if null_safe else a == b for a, b in on]
    condition = equals[0]
    for term in equals[1:]:
        condition = condition & term
    return left.join(right, condition, how)
