"""Query results and views written as CSV or Parquet folders."""

from __future__ import annotations

import time
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from siftwell.operators.usage import LOG_SCHEMA
from siftwell.session import stage

# Extension -> format.
FORMATS = {".csv": "csv", ".parquet": "parquet"}

CSV_OPTIONS = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def format_of(name: str) -> str:
    extension = name[name.rfind("."):].lower() if "." in name else ""
    if extension not in FORMATS:
        raise ValueError(f"extension {extension!r} is not supported (use {', '.join(sorted(FORMATS))})")
    return FORMATS[extension]


def resolve_name(template: str, values: dict, moment: datetime | None = None) -> str:
    """Date marks and {fields} of the load's values filled in."""
    return (moment or datetime.now()).strftime(template).format(**values)


def write(df: DataFrame, path: str, file_format: str, mode: str = "overwrite") -> int:
    """Write and count. Parquet is counted from the footers written; text is staged first, and counted there."""
    spark, schema = df.sparkSession, df.schema
    if file_format == "csv":
        df = stage(df, "output")
        df.write.mode(mode).options(**CSV_OPTIONS).csv(path)
        return df.count()
    df.write.mode(mode).parquet(path)
    return spark.read.schema(schema).parquet(path).count()


def write_output(
    spark: SparkSession, output: dict, folder: str, values: dict | None = None, moment: datetime | None = None,
) -> dict:
    """One declared output {nombre, fichero, sql}. Values are bound into the SQL by name."""
    values = values or {}
    name = resolve_name(output["fichero"], values, moment)
    file_format = format_of(name)
    path = f"{output.get('carpeta', folder).rstrip('/')}/{name}"
    rows = write(spark.sql(output["sql"], args=values), path, file_format)
    return {"nombre": output["nombre"], "fichero": path, "filas": rows, "formato": file_format}


def views(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables() if t.isTemporary or t.tableType == "VIEW")


def export_view(spark: SparkSession, view: str, folder: str, log_path: str | None = None) -> dict:
    """A view as Parquet and CSV, computed once, and its row in the query log."""
    known = views(spark)
    if view not in known:
        raise ValueError(f"view {view} does not exist (views: {', '.join(known)})")
    started = time.perf_counter()
    rows_once = stage(spark.table(view), "export")
    parquet, csv = f"{folder}/{view}.parquet", f"{folder}/{view}.csv"
    rows = write(rows_once, parquet, "parquet")
    write(rows_once, csv, "csv")
    if log_path:
        row = (f"export-{view}", f"SELECT * FROM {view}", "export", view, [view], rows, time.perf_counter() - started, "OK", None)
        spark.createDataFrame([row], LOG_SCHEMA).coalesce(1).write.mode("append").parquet(log_path)
    return {"vista": view, "filas": rows, "parquet": parquet, "csv": csv}
