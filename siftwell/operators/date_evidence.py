"""Which format a date column follows, settled by all of its values, per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.dates import ambiguous_pair, parse_with, parts_above_12, serial_number
from siftwell.functions.text import blank_to_null
from siftwell.session import key_join, stage

CONTRADICTORY = "contradictory evidence: some values can only be day/month and others only month/day"
NO_EVIDENCE = "no evidence in the column to tell day/month from month/day"
NO_CANDIDATE = "no candidate format fits the whole column"


def _all(condition: Column) -> Column:
    return F.coalesce(F.bool_and(condition), F.lit(True))


def _any(condition: Column) -> Column:
    return F.coalesce(F.bool_or(condition), F.lit(False))


def _resolution(mode: str | None, fmt: str | None, error: str | None = None) -> Column:
    return F.struct(
        F.lit(mode).cast("string").alias("mode"),
        F.lit(fmt).cast("string").alias("format"),
        F.lit(error).cast("string").alias("error"))


def _settle(text: Column, formats: list[str], epoch: str) -> Column:
    """Resolution of one column from its stripped texts, NULL where blank."""

    def fits(test: Column) -> Column:
        return _all(F.when(text.isNotNull(), test))

    serial = (F.count(text) > 0) & fits(serial_number(text).isNotNull())
    pair = ambiguous_pair(formats)
    if len(formats) == 1:
        rest = _resolution("format", formats[0])
    elif pair:
        day_first, month_first = (_any(above) for above in parts_above_12(text))
        rest = (
            F.when(day_first & month_first, _resolution(None, None, CONTRADICTORY))
            .when(day_first, _resolution("format", pair[0]))
            .when(month_first, _resolution("format", pair[1]))
            .otherwise(_resolution(None, None, NO_EVIDENCE)))
    else:
        candidates = [F.when(fits(parse_with(text, f).isNotNull()), _resolution("format", f)) for f in formats]
        rest = F.coalesce(*candidates, _resolution(None, None, NO_CANDIDATE))
    return F.when(serial, _resolution("serial", epoch)).otherwise(rest)


def settle_dates(rows: DataFrame, fields: list[dict], file_col: str = "_file") -> DataFrame:
    """One row per file with `_dates`, a struct of (mode, format, error) per date field.

    Counts and booleans only, so each input task sends one small row per file whatever the sizes.
    The texts are stripped in a projection below the aggregation, once for all tests on them. The result is written:
    Spark then knows how small it is and sends it to the rows, which a shuffle by their few files would gather in as few tasks.
    """
    texts = rows.select(
        file_col, *[blank_to_null(F.col(f"`{f['source']}`").cast("string")).alias(f"_t{i}") for i, f in enumerate(fields)])
    settled = [_settle(F.col(f"_t{i}"), f["formats"], f["epoch"]).alias(f["target"]) for i, f in enumerate(fields)]
    return stage(texts.groupBy(file_col).agg(*settled).select(
        F.col(file_col), F.struct(*[f["target"] for f in fields]).alias("_dates")), "dates")


def attach_dates(rows: DataFrame, settled: DataFrame, file_col: str = "_file", every_file: bool = False) -> DataFrame:
    """Rows with the `_dates` of their file. With `every_file`, all rows that count belong to a settled file: where the files agree,
    their one resolution is a constant, no row is looked up and the formats that did not hold are not planned."""
    if every_file:
        agreed = settled.select("_dates").distinct().limit(2).collect()
        if len(agreed) == 1:
            return rows.withColumn("_dates", F.struct(*[_resolution(r["mode"], r["format"], r["error"]).alias(f) for f, r in agreed[0][0].asDict().items()]))
    side = settled.withColumnRenamed(file_col, "_dates_file")
    return key_join(rows, side, [(F.col(file_col), F.col("_dates_file"))]).drop("_dates_file")


def unresolved(settled: DataFrame, fields: list[dict], file_col: str = "_file") -> DataFrame:
    """(file, field, error) of the columns that cannot be read with certainty."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(f["target"]).alias("field"), F.col("_dates")[f["target"]]["error"].alias("error")) for f in fields]))
    return settled.select(file_col, pairs.alias("p")).select(file_col, "p.*").filter("error IS NOT NULL")
