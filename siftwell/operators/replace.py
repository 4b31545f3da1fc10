"""Block replacement: the incoming rows take the place of the keys they carry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.operators.mapping import common_columns
from siftwell.session import key_join


def _keys_of(incoming: DataFrame, keys: list[str]) -> DataFrame:
    return incoming.select(*[F.col(k).alias(f"_k_{k}") for k in keys]).distinct()


def _matches(target: DataFrame, incoming: DataFrame, keys: list[str], how: str) -> DataFrame:
    pairs = [(F.col(k), F.col(f"_k_{k}")) for k in keys]
    return key_join(target, _keys_of(incoming, keys), pairs, how, null_safe=True)


def within_range(target: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Target rows between the smallest and the largest incoming value of every key, a filter that reaches the footers of files.

    One row with the bounds comes back. Keys of types without bounds in footers, or whose text is not their value, are not looked at.
    """
    ranged = [k for k in keys if isinstance(target.schema[k].dataType, (T.IntegralType, T.StringType, T.DateType, T.DecimalType))]
    if not ranged:
        return target
    kinds = {k: target.schema[k].dataType for k in ranged}
    found = incoming.select(*[F.col(k).cast(kinds[k]).alias(k) for k in ranged]).agg(*[
        c for i, k in enumerate(ranged) for c in (
            F.min(k).cast("string").alias(f"low{i}"), F.max(k).cast("string").alias(f"high{i}"), F.bool_or(F.col(k).isNull()).alias(f"null{i}"))]).first()
    for i, k in enumerate(ranged):
        within = F.col(k).between(F.lit(found[f"low{i}"]).cast(kinds[k]), F.lit(found[f"high{i}"]).cast(kinds[k]))
        target = target.filter(within | F.col(k).isNull() if found[f"null{i}"] else within)
    return target


def replaced_rows(target: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Target rows whose key occurs among the incoming rows; NULL keys equal each other."""
    return _matches(target, incoming, keys, "left_semi") if keys else target.limit(0)


def kept_rows(target: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    return _matches(target, incoming, keys, "left_anti") if keys else target


def append_rows(target: DataFrame, incoming: DataFrame) -> DataFrame:
    """All rows of both; a column the incoming rows lack is NULL, one the target lacks is dropped."""
    rows = common_columns(incoming, target.columns)
    return target.unionByName(rows, allowMissingColumns=True).select(*target.columns)


def bulk_union(first: DataFrame, second: DataFrame) -> DataFrame:
    """All rows of both under the sorted union of their columns."""
    both = first.unionByName(second, allowMissingColumns=True)
    return both.select(*sorted(both.columns))


def replace_block(target: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """New content of the target: rows of other keys, then every incoming row (repeats kept).

    The keys are made distinct before the shuffle (map-side first), and the target is read once.
    Without keys the load only adds.
    """
    return append_rows(kept_rows(target, incoming, keys), incoming)


def replace_counts(target: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows promoted and rows they replaced."""
    promoted = incoming.agg(F.count("*").alias("promoted"))
    replaced = replaced_rows(target, incoming, keys).agg(F.count("*").alias("replaced"))
    return promoted.select("promoted", F.lit(None).cast("bigint").alias("replaced")).unionByName(
        replaced.select(F.lit(None).cast("bigint").alias("promoted"), "replaced")
    ).agg(F.max("promoted").alias("promoted"), F.max("replaced").alias("replaced"))


def full_photo(incoming: DataFrame, hall_columns: dict[str, str]) -> DataFrame:
    """Content of a staging table: the incoming rows in its columns, whatever it held before."""
    return incoming.select(*[
        (F.col(c).cast(kind) if c in incoming.columns else F.lit(None).cast(kind)).alias(c)
        for c, kind in hall_columns.items()])


def crossed_parameters(target: DataFrame, incoming: DataFrame, keys: list[str], parameter_col: str) -> DataFrame:
    """Rows of other parameter values that a reload would replace, counted per value.

    Not empty when a mandatory parameter is missing from the replacement key.
    """
    own = incoming.select(F.col(parameter_col).alias("_own")).distinct()
    hit = replaced_rows(target, incoming, keys)
    others = key_join(hit, own, [(F.col(parameter_col), F.col("_own"))], "left_anti", null_safe=True)
    return others.groupBy(parameter_col).agg(F.count("*").alias("rows_at_risk"))
