"""How far proposed values are already present in existing columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.text import is_blank, match_key
from siftwell.session import stage

THRESHOLD = 0.5
SHOWN_MATCHES = 10


def proposed_values(values: DataFrame, column: str) -> DataFrame:
    return values.filter(~is_blank(F.col(column).cast("string"))).select(
        match_key(F.col(column).cast("string")).alias("value")).distinct()


def existing_values(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """(table, column, value) distinct over every listed column of every table: one scan per table."""
    parts = []
    for name, (frame, columns) in tables.items():
        cells = F.array(*[
            F.struct(F.lit(c).alias("column"), match_key(F.col(f"`{c}`").cast("string")).alias("value")) for c in columns])
        parts.append(frame.select(F.lit(name).alias("table"), F.explode(cells).alias("c")).select("table", "c.*"))
    return reduce(DataFrame.unionByName, parts).filter("value IS NOT NULL").distinct()


def overlap(values: DataFrame, column: str, tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Evidence per existing column: matches, proposed total, ratio and the first matching values.

    A value occurs once per column on one side and once on the other, so no key is hot here.
    What several figures are taken from is written once.
    """
    proposed = stage(proposed_values(values, column), "proposed")
    matches = stage(existing_values(tables).join(proposed, "value", "left_semi"), "matches")
    first = Window.partitionBy("table", "column").orderBy("value")
    shown = (
        matches.withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") <= SHOWN_MATCHES)
        .groupBy("table", "column").agg(F.array_sort(F.collect_list("value")).alias("matching_values")))
    counts = matches.groupBy("table", "column").agg(F.count("*").alias("matches"))
    spark = values.sparkSession
    listed = spark.createDataFrame([(t, c) for t, (_, cols) in tables.items() for c in cols], "table string, column string")
    total = proposed.count()  # one number, from the footers of what was written
    found = listed.join(counts, ["table", "column"], "left").join(shown, ["table", "column"], "left").withColumn(
        "total_proposed", F.lit(total).cast("bigint"))
    return found.select(
        "table", "column", F.coalesce("matches", F.lit(0)).cast("bigint").alias("matches"), "total_proposed",
        _ratio(F.coalesce("matches", F.lit(0)), F.col("total_proposed")).alias("ratio"),
        F.coalesce("matching_values", F.array().cast("array<string>")).alias("matching_values"))


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def foreign_key_candidates(
    values: DataFrame, column: str, tables: dict[str, tuple[DataFrame, list[str]]], threshold: float = THRESHOLD,
) -> DataFrame:
    found = overlap(values, column, tables)
    return found.filter((F.col("total_proposed") > 0) & (F.col("ratio") >= threshold)).orderBy(
        F.col("ratio").desc(), "table", "column")
