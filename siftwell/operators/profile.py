"""Column profiles: apparent type, blanks, exact cardinality and first values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.casts import INTEGER_RE, parse_float, spanish_number
from siftwell.functions.dates import PARTS_RE
from siftwell.functions.text import blank_to_null, is_blank, strip
from siftwell.session import stage

# Names of the apparent types, in the order they are tried.
UNKNOWN = "desconocido (todo vacío)"
DATE = "fecha (candidato date_format)"
INTEGER = "integer"
DOUBLE = "double"
DOUBLE_ES = "double (formato_numerico: es)"
VARCHAR = "varchar"
SAMPLE_VALUES = 5

# Fixed value: words that make a column name look like an identifier.
IDENTIFIER_NAME_RE = r"(?i)(^|_)(id|codigo|cod|num|numero|ref|nif|cif)($|_)"


def unpivot(rows: DataFrame, columns: list[str], order: Column) -> DataFrame:
    """(position, value, at): one row per cell. `at` is the place of the row."""
    cells = F.array(*[
        F.struct(F.lit(i).alias("position"), F.col(f"`{c}`").cast("string").alias("value")) for i, c in enumerate(columns, start=1)])
    return rows.select(order.alias("at"), F.explode(cells).alias("c")).select("at", "c.*")


def distinct_values(rows: DataFrame, columns: list[str], order: Column) -> DataFrame:
    """(position, value, n, first): distinct cells with their count and first place.

    Summed before the shuffle, so a value that fills a column sends one row per input task.
    All blanks of a column count as one value.
    """
    cells = unpivot(rows, columns, order).withColumn("value", F.when(~is_blank(F.col("value")), F.col("value")))
    return cells.groupBy("position", "value").agg(F.count("*").alias("n"), F.min("at").alias("first"))


def compact_date(text: Column) -> Column:
    """AAAAMMDD or AAAAMMDDHHMMSS with plausible parts."""
    return text.rlike(
        r"^(19[0-9]{2}|20[0-9]{2}|2100)(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])"
        r"(([01][0-9]|2[0-3])[0-5][0-9][0-5][0-9])?$")


def profile_columns(rows: DataFrame, columns: list[str], order: Column) -> DataFrame:
    """One row per column.

    Type tests run once per distinct value. The distinct values are written, since the statistics
    and the samples both read them. Evidence for the schema draft (leading zeros, compact
    dates) is taken from the whole column in the same pass.
    """
    values = stage(distinct_values(rows, columns, order), "values")
    text = strip(F.col("value"))
    filled = F.col("value").isNotNull()

    def every(test: Column) -> Column:
        return F.coalesce(F.bool_and(F.when(filled, F.coalesce(test, F.lit(False)))), F.lit(True))

    digits = text.rlike("^[0-9]+$")
    stats = values.groupBy("position").agg(
        F.sum("n").alias("total_rows"),
        F.sum(F.when(~filled, F.col("n")).otherwise(0)).alias("nulls"),
        F.sum(filled.cast("bigint")).alias("cardinality"),
        every(text.rlike(PARTS_RE)).alias("_date"),
        every(text.rlike(INTEGER_RE)).alias("_integer"),
        every(parse_float(text).isNotNull()).alias("_double"),
        every(parse_float(spanish_number(text)).isNotNull()).alias("_double_es"),
        F.coalesce(F.bool_or(digits & (F.length(text) > 1) & text.startswith("0")), F.lit(False)).alias("leading_zeros"),
        (F.coalesce(F.bool_or(digits), F.lit(False))
         & F.coalesce(F.bool_and(F.when(digits, compact_date(text))), F.lit(False))).alias("compact_dates"),
        F.max(F.when(digits, F.length(text))).alias("digits"),
    )
    kind = (
        F.when(F.col("cardinality") == 0, UNKNOWN).when(F.col("_date"), DATE).when(F.col("_integer"), INTEGER)
        .when(F.col("_double"), DOUBLE).when(F.col("_double_es"), DOUBLE_ES).otherwise(VARCHAR))
    by_place = Window.partitionBy("position").orderBy("first", "value")
    # Literal top-n over row_number: Spark keeps n rows per input task before the shuffle.
    top = values.filter(filled).withColumn("_rn", F.row_number().over(by_place)).filter(F.col("_rn") <= SAMPLE_VALUES)
    samples = top.groupBy("position").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_rn", "value"))), lambda x: x["value"]).alias("sample_values"))
    names = F.array(*[F.lit(c) for c in columns])
    return stats.withColumn("apparent_type", kind).withColumn("column", F.get(names, F.col("position") - 1)).join(samples, "position", "left").select(
        "position", "column", "apparent_type", "total_rows", "nulls", "cardinality",
        F.coalesce("sample_values", F.array().cast("array<string>")).alias("sample_values"),
        "leading_zeros", "compact_dates", "digits")


def sample_rows(rows: DataFrame, limit: int, order: Column) -> tuple[DataFrame, bool]:
    """First rows in order and whether more exist: one top-n with a row more, written, and no sort of everything."""
    held = stage(rows.orderBy(order).limit(limit + 1), "sample")
    return held.orderBy(order).limit(limit), held.count() > limit


def cardinality(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Filled cells, distinct stripped values and their ratio, per column."""
    cells = unpivot(rows, columns, F.lit(0)).withColumn("value", blank_to_null(F.col("value"))).filter("value IS NOT NULL")
    names = F.array(*[F.lit(c) for c in columns])
    counts = cells.groupBy("position", "value").agg(F.count("*").alias("n")).groupBy("position").agg(
        F.sum("n").alias("total"), F.count("*").alias("distinct_values"))
    return counts.select(
        F.get(names, F.col("position") - 1).alias("column"), "total", "distinct_values",
        (F.col("distinct_values") / F.col("total")).alias("uniqueness"))
