"""Snapshots of all tables, and restores that prove themselves by row counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.session import stage

MANIFEST = "_manifest"
MANIFEST_SCHEMA = "table string, rows bigint"


def _copy(df: DataFrame, path: str) -> int:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).count()


def take_snapshot(tables: dict[str, DataFrame], folder: str) -> DataFrame:
    """Every table as zstd Parquet under a new folder, with its rows counted while written."""
    spark = next(iter(tables.values())).sparkSession
    counts = [(name, _copy(df, f"{folder}/{name}")) for name, df in tables.items()]
    spark.createDataFrame(counts, MANIFEST_SCHEMA).coalesce(1).write.parquet(f"{folder}/{MANIFEST}")
    return spark.read.schema(MANIFEST_SCHEMA).parquet(f"{folder}/{MANIFEST}")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows); Parquet answers from its footers."""
    return reduce(DataFrame.unionByName, [
        df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows") for name, df in tables.items()])


def compare(expected: DataFrame, restored: DataFrame) -> DataFrame:
    """(table, expected, restored, status): ok, differs, absent or unexpected. Digests count where both sides have them."""
    both = expected.withColumnRenamed("rows", "expected").join(
        restored.select("table", F.col("rows").alias("restored"), *[F.col("digest").alias("_digest") for c in restored.columns if c == "digest"]), "table", "full")
    same = F.col("expected") == F.col("restored")
    if {"digest", "_digest"} <= set(both.columns):
        same = same & (F.col("digest") == F.col("_digest"))
    status = (
        F.when(F.col("restored").isNull(), "absent").when(F.col("expected").isNull(), "unexpected")
        .when(same, "ok").otherwise("differs"))
    return both.select("table", "expected", "restored", status.alias("status"))


def verified(comparison: DataFrame) -> bool:
    """Something was expected and nothing of it is missing or different."""
    row = comparison.agg(F.count("expected").alias("n"), F.count_if(F.col("status").isin("differs", "absent")).alias("bad")).first()
    return row["n"] > 0 and row["bad"] == 0


def restore_snapshot(spark: SparkSession, folder: str, destination: str, names: list[str] | None = None) -> DataFrame:
    """Copy a snapshot to a new place and compare what arrived with the manifest.

    Nothing is overwritten: the write fails when the destination exists.
    """
    expected = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{folder}/{MANIFEST}")
    names = names if names is not None else [r["table"] for r in expected.select("table").collect()]
    for name in names:
        spark.read.parquet(f"{folder}/{name}").write.option("compression", "zstd").parquet(f"{destination}/{name}")
    return compare(expected, row_counts({n: spark.read.parquet(f"{destination}/{n}") for n in names}))


def mirror(source: DataFrame, destination: str) -> dict:
    """Append the contents whose hash the destination lacks; (copied, present, bytes)."""
    from siftwell.operators.documents import mirror_counts, mirror_plan

    spark = source.sparkSession
    try:
        there = spark.read.parquet(destination).select("hash")
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(error):
            raise
        there = source.select("hash").limit(0)
    fixed = stage(there.distinct(), "mirror")
    counts = mirror_counts(source, fixed).first().asDict()
    mirror_plan(source, fixed).write.mode("append").parquet(destination)
    return counts
