"""Table contracts: NOT NULL, CHECK, closed lists and references, reported instead of raised."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.session import key_join


@dataclass
class Contract:
    not_null: list[str] = field(default_factory=list)
    checks: dict[str, str] = field(default_factory=dict)
    allowed: dict[str, list] = field(default_factory=dict)
    references: dict[str, tuple[DataFrame, str]] = field(default_factory=dict)


def row_violations(contract: Contract) -> list[tuple[str, Column]]:
    """(rule name, row breaks it). As in SQL, a check that is NULL passes."""
    rules = [(f"not_null:{c}", F.col(c).isNull()) for c in contract.not_null]
    rules += [(f"check:{name}", ~F.coalesce(F.expr(text), F.lit(True))) for name, text in contract.checks.items()]
    rules += [(f"allowed:{c}", ~F.coalesce(F.col(c).isin(values), F.lit(True))) for c, values in contract.allowed.items()]
    return rules


def violations(rows: DataFrame, contract: Contract, keep: list[str]) -> DataFrame:
    """One row per broken rule and input row: `rule` and the columns to show.

    All row-level rules share one scan; each reference is an anti join on its own column.
    """
    broken = F.array(*[F.when(bad, F.lit(name)) for name, bad in row_violations(contract)]).cast("array<string>")
    found = rows.select(*keep, F.explode(F.array_compact(broken)).alias("rule"))
    for column, (dimension, key) in contract.references.items():
        known = dimension.select(F.col(key).alias("_ref")).distinct()
        orphans = key_join(rows.filter(F.col(column).isNotNull()), known, [(F.col(column), F.col("_ref"))], "left_anti")
        found = found.unionByName(orphans.select(*keep, F.lit(f"references:{column}").alias("rule")))
    return found


def violation_counts(rows: DataFrame, contract: Contract) -> DataFrame:
    return violations(rows, contract, []).groupBy("rule").agg(F.count("*").alias("violations"))
