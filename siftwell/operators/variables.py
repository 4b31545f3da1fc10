"""Values bound into SQL by name (`:name`), never pasted as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class InvalidVariable(ValueError):
    """A variable query must return exactly one row."""


def context(parameters: dict | None = None, variables: dict | None = None, **system) -> dict:
    """System names as they are, parameters as p_<name>, captured variables as v_<name>."""
    values = {k: v for k, v in system.items() if v is not None}
    values.update({f"p_{k}": v for k, v in (parameters or {}).items()})
    values.update({f"v_{k}": v for k, v in (variables or {}).items()})
    return values


def bound(spark: SparkSession, sql: str, args: dict | None = None) -> DataFrame:
    return spark.sql(sql, args=args or {})


def capture(spark: SparkSession, sql: str, args: dict | None = None) -> dict:
    """Every column of the one row becomes a variable; two rows are enough to know it is wrong."""
    rows = bound(spark, sql, args).take(2)
    if len(rows) != 1:
        raise InvalidVariable(f"a variable query must return one row, not {'none' if not rows else 'several'}: {sql}")
    return rows[0].asDict()
