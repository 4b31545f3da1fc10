"""Labels to ids: case-insensitive joins and checked resolutions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.text import blank_to_null
from siftwell.session import key_join


def label_join(rows: DataFrame, text: Column, dimension: DataFrame, label: str) -> DataFrame:
    """LEFT join on the label without regard to case; unknown labels keep the row."""
    return key_join(rows, dimension.withColumn("_label", F.lower(F.col(label))), [(F.lower(text), F.col("_label"))]).drop("_label")


def label_index(dimension: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """One row per folded label: how many entries carry it and the id when it is one."""
    return dimension.groupBy(F.lower(F.col(label_col)).alias("_label")).agg(
        F.count("*").alias("_entries"), F.min(F.col(id_col)).alias("_by_label"))


def resolve_labels(
    rows: DataFrame, text_col: str, dimension: DataFrame, id_col: str, label_col: str | None,
    out: str = "resolved_id", status: str = "status",
) -> DataFrame:
    """Adds the id a text stands for and 'ok', 'missing' or 'ambiguous'.

    An id is taken as it is; any other text must name exactly one entry. Blank text is a NULL id.
    """
    text = blank_to_null(F.col(text_col).cast("string"))
    keyed = rows.withColumn("_text", text)
    ids = dimension.select(F.col(id_col).alias("_by_id")).distinct()
    found = key_join(keyed, ids, [(F.col("_text"), F.col("_by_id").cast("string"))])
    if label_col is None:
        found = found.withColumn("_entries", F.lit(0)).withColumn("_by_label", F.lit(None).cast(dimension.schema[id_col].dataType))
    else:
        found = key_join(found, label_index(dimension, id_col, label_col), [(F.lower(F.col("_text")), F.col("_label"))]).drop("_label")
    entries = F.coalesce(F.col("_entries"), F.lit(0))
    known = F.col("_text").isNull() | F.col("_by_id").isNotNull()
    return (
        found.withColumn(out, F.coalesce(F.col("_by_id"), F.when(entries == 1, F.col("_by_label"))))
        .withColumn(status, F.when(known | (entries == 1), "ok").when(entries == 0, "missing").otherwise("ambiguous"))
        .drop("_text", "_by_id", "_by_label", "_entries"))
