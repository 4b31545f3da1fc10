"""Table contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queries import Tables, query
from siftwell.operators.contracts import Contract, violation_counts, violations


def lines(t: Tables) -> DataFrame:
    """Lines with their supplier left out when returned and their part moved beyond the catalogue when open and taxed most."""
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") != "R", F.col("l_suppkey")).alias("l_suppkey"),
        F.when(F.col("l_tax") >= 0.08, -F.col("l_partkey") - 1).otherwise(F.col("l_partkey")).alias("l_partkey"),
        "l_quantity", "l_discount", "l_linestatus", "l_returnflag")


def contract(t: Tables) -> Contract:
    return Contract(
        not_null=["l_suppkey"], checks={"few_units": "l_quantity < 40", "discount": "l_discount BETWEEN 0 AND 0.08"},
        allowed={"l_returnflag": ["A", "R"]},
        references={"l_partkey": (t.part, "p_partkey"), "l_suppkey": (t.supplier, "s_suppkey")})


VIOLATIONS_SQL = """
WITH found AS (SELECT l_orderkey, l_linenumber, 'not_null:l_suppkey' AS rule FROM lineitem WHERE l_returnflag = 'R'
  UNION ALL SELECT l_orderkey, l_linenumber, 'check:few_units' FROM lineitem WHERE l_quantity >= 40
  UNION ALL SELECT l_orderkey, l_linenumber, 'check:discount' FROM lineitem WHERE l_discount > 0.08
  UNION ALL SELECT l_orderkey, l_linenumber, 'allowed:l_returnflag' FROM lineitem WHERE l_returnflag = 'N'
  UNION ALL SELECT l_orderkey, l_linenumber, 'references:l_partkey' FROM lineitem WHERE l_tax >= 0.08)"""


@query(VIOLATIONS_SQL + " SELECT * FROM found")
def contract_violations(t: Tables) -> DataFrame:
    return violations(lines(t), contract(t), ["l_orderkey", "l_linenumber"])


@query(VIOLATIONS_SQL + " SELECT rule, count(*) AS violations FROM found GROUP BY rule")
def contract_counts(t: Tables) -> DataFrame:
    return violation_counts(lines(t), contract(t))
