"""Run log: status events per run, chains of changes and what a row descends from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.session import key_join, stage

RUNNING, OK, ERROR = "EN_CURSO", "OK", "ERROR"


def current_runs(events: DataFrame, seq_col: str = "seq") -> DataFrame:
    """Latest status of each run; the other columns come from the event that opened it."""
    opened = [c for c in events.columns if c not in ("run_id", "status", seq_col)]
    return events.groupBy("run_id").agg(
        F.max_by("status", seq_col).alias("status"), F.count("*").alias("events"),
        *[F.min_by(c, seq_col).alias(c) for c in opened])


def open_runs(events: DataFrame) -> DataFrame:
    """Opening events of runs that neither ended nor failed: their writer is still at work, or was killed."""
    closed = events.filter(F.col("status") != RUNNING).select(F.col("run_id").alias("_closed")).distinct()
    return key_join(events.filter(F.col("status") == RUNNING), closed, [(F.col("run_id"), F.col("_closed"))], "left_anti")


def latest_ok_runs(runs: DataFrame) -> DataFrame:
    """Latest successful run of each load."""
    return runs.filter(F.col("status") == OK).groupBy("load").agg(F.max("run_id").alias("run_id"))


def latest_runs(runs: DataFrame, n: int = 20) -> DataFrame:
    return runs.orderBy(F.col("run_id").desc()).limit(n)


def with_principal(runs: DataFrame) -> DataFrame:
    """A run without a principal is its own."""
    return runs.withColumn("principal", F.coalesce("principal", "run_id"))


def principal_of_rows(rows: DataFrame, runs: DataFrame, run_col: str = "ejecucion_id") -> DataFrame:
    """Adds the principal of the run that created each row; NULL for rows older than the log.

    Those without a run are not joined: a shuffle would send all of them to one task.
    """
    side = with_principal(runs).select(F.col("run_id").alias("_run"), F.col("principal"))
    written = key_join(rows.filter(F.col(run_col).isNotNull()), side, [(F.col(run_col), F.col("_run"))]).drop("_run")
    older = rows.filter(F.col(run_col).isNull()).select("*", F.lit(None).cast(side.schema["principal"].dataType).alias("principal"))
    return written.union(older)


def history(runs: DataFrame, principal: int) -> DataFrame:
    """One record's runs, creation included, in order."""
    return with_principal(runs).filter(F.col("principal") == principal).orderBy("run_id")


def numbered_histories(runs: DataFrame) -> DataFrame:
    """Every run with its place in its chain.

    A chain is one record's life, yet a mass correction may hang a third of all runs on one principal: the
    runs are dealt by ranges of (principal, run), which cut a long chain, and numbered within each range; the
    runs of a chain in the ranges before are added up from one row per range and chain.
    """
    dealt = with_principal(runs).repartitionByRange("principal", "run_id").withColumn("_range", F.spark_partition_id())
    dealt = stage(dealt, "ranges")
    before = Window.partitionBy("principal").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("principal", "_range").agg(F.count("*").alias("_n")).select(
        F.col("principal").alias("_p"), F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("principal", "_range").orderBy("run_id")
    numbered = dealt.withColumn("_at", F.row_number().over(inside))
    placed = key_join(numbered, offsets, [(F.col("principal"), F.col("_p")), (F.col("_range"), F.col("_r"))], "inner", null_safe=True)
    return placed.withColumn("place", F.col("_before") + F.col("_at")).drop("_range", "_p", "_r", "_before", "_at")
