"""Use of tables and views, from a log of queries.

The log holds (query_id, sql, origin, object, tables array, rows, seconds, status).
"""

from __future__ import annotations

import time

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.session import stage

LOG_SCHEMA = ("query_id string, sql string, origin string, object string, tables array<string>, "
              "rows bigint, seconds double, status string, error string")
SLOWEST = 5
REPEATS = 3


def touched(system_tables: list[str] | None = None) -> Column:
    """Tables of a query without repeats; an export touches the view it exports."""
    tables = F.array_sort(F.array_distinct(F.coalesce("tables", F.array().cast("array<string>"))))
    tables = F.array_except(tables, F.array(*[F.lit(t) for t in system_tables or []]).cast("array<string>"))
    return F.when((F.col("origin") == "export") & F.col("object").isNotNull(), F.array("object")).otherwise(tables)


def usage_by_object(log: DataFrame, system_tables: list[str] | None = None) -> DataFrame:
    ok = log.filter(F.col("status") == "OK")
    return ok.select(F.explode(touched(system_tables)).alias("object")).groupBy("object").agg(F.count("*").alias("uses"))


def unused_objects(existing: DataFrame, log: DataFrame, system_tables: list[str] | None = None) -> DataFrame:
    """Objects no successful query touched; `existing` has one column `object`."""
    return existing.join(usage_by_object(log, system_tables), "object", "left_anti")


def recurring(log: DataFrame, repeats: int = REPEATS, system_tables: list[str] | None = None) -> DataFrame:
    """Sets of tables queried together often, with one example."""
    ok = log.filter((F.col("status") == "OK") & (F.col("origin") == "consulta"))
    signed = ok.select(F.array_join(touched(system_tables), ", ").alias("signature"), "sql").filter("signature <> ''")
    return signed.groupBy("signature").agg(F.count("*").alias("times"), F.min("sql").alias("example")).filter(F.col("times") >= repeats)


def slowest(log: DataFrame, n: int = SLOWEST) -> DataFrame:
    return log.filter((F.col("status") == "OK") & F.col("seconds").isNotNull()).orderBy(F.col("seconds").desc(), "query_id").limit(n)


def log_totals(log: DataFrame) -> DataFrame:
    return log.agg(
        F.count_if(F.col("status") == "OK").alias("recorded"), F.count_if(F.col("status") == "ERROR").alias("errors"))


def logged_query(
    spark: SparkSession, sql: str, args: dict | None, log_path: str, query_id: str, tables: list[str] | None = None,
) -> DataFrame:
    """Run a query once and append its log row; the result is read from where it was written.

    A failing log never fails the query; a failing query is logged.
    """
    started = time.perf_counter()
    try:
        result = stage(spark.sql(sql, args=args or {}), "query")
        rows = result.count()
    except PySparkException as error:
        _log(spark, log_path, (query_id, sql, "consulta", None, tables, None, time.perf_counter() - started, "ERROR", str(error)))
        raise
    _log(spark, log_path, (query_id, sql, "consulta", None, tables, rows, time.perf_counter() - started, "OK", None))
    return result


def _log(spark: SparkSession, path: str, row: tuple) -> None:
    try:
        spark.createDataFrame([row], LOG_SCHEMA).coalesce(1).write.mode("append").parquet(path)
    except Exception as error:  # noqa: BLE001  the caller's result matters more than its log row
        print(f"query log not written: {error}")
