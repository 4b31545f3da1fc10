"""Data-quality rules: a SELECT that returns rows fires; 'stop' blocks the write, 'alarma' records."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STOP, ALARM = "stop", "alarma"
DETAIL_LIMIT = 5


@dataclass(frozen=True)
class Rule:
    name: str
    kind: str
    message: str
    sql: str
    detail_limit: int = DETAIL_LIMIT

    @classmethod
    def from_dict(cls, d: dict) -> "Rule":
        return cls(d["nombre"], d["tipo"], d["mensaje"], d["sql"], d.get("limite_detalle", DETAIL_LIMIT))


class InvalidRule(ValueError):
    """A rule that cannot run does not count as passed."""


class StopError(ValueError):
    def __init__(self, message: str, results: list[dict]):
        super().__init__(message)
        self.results = results


def rule_rows(spark: SparkSession, rule: Rule, args: dict | None = None) -> DataFrame:
    try:
        return spark.sql(rule.sql, args=args or {})
    except PySparkException as error:
        raise InvalidRule(f"rule {rule.name} cannot run: {error}") from error


# A rule that looks at one row at a time: plain columns of one table, a condition, and at most an order of plain columns.
# What does not look like that, or might not, is run as it stands.
_BY_ROW = re.compile(
    r"\s*SELECT\s+(?P<columns>[^()]+?)\s+FROM\s+(?P<table>\w+)\s+WHERE\s+(?P<condition>.+?)(?:\s+ORDER\s+BY\s+(?P<order>[^()'\"]+?))?\s*\Z", re.I | re.S)
_ORDER = re.compile(r"\s*(?P<column>.+?)(?P<way>(?:\s+(?:ASC|DESC))?(?:\s+NULLS\s+(?:FIRST|LAST))?)\s*\Z", re.I | re.S)
_CLAUSE = re.compile(
    r"\b(SELECT|FROM|DISTINCT|ALL|GROUP|ORDER|HAVING|LIMIT|OFFSET|UNION|EXCEPT|MINUS|INTERSECT|WINDOW|QUALIFY|CLUSTER|DISTRIBUTE|SORT|LATERAL)\b|--|/\*|;|\|>", re.I)


@dataclass(frozen=True)
class ByRow:
    columns: str
    table: str
    condition: str
    order: tuple[tuple[str, str], ...] = ()  # columns, and which way


def by_row(sql: str) -> ByRow | None:
    """The parts of a rule that is a filter over one table, none for any other."""
    found = _BY_ROW.match(sql)
    if not found or any(_CLAUSE.search(found[part] or "") for part in ("columns", "condition", "order")):
        return None
    depth, quoted = 0, re.sub(r"'[^']*'|\"[^\"]*\"", "''", found["condition"])
    for sign in quoted:
        depth += (sign == "(") - (sign == ")")
        if depth < 0:
            return None
    if depth or "'" in quoted.replace("''", ""):
        return None
    order = [_ORDER.match(part) for part in found["order"].split(",")] if found["order"] else []
    return ByRow(found["columns"], found["table"], found["condition"], tuple((o["column"], o["way"]) for o in order)) if all(order) else None


def _counted_rows(spark: SparkSession, table: str, own: list[tuple[Rule, ByRow]], args: dict) -> dict[str, int]:
    """Rows that fire, of all rules over one table: one aggregation over one scan."""
    counts = ", ".join(f"count_if({part.condition}) AS r{i}" for i, (_, part) in enumerate(own))
    row = spark.sql(f"SELECT {counts} FROM {table}", args=args).first()
    return {rule.name: row[i] for i, (rule, _) in enumerate(own)}


def fired_rows(spark: SparkSession, source: str, own: list[tuple[Rule, ByRow]], args: dict, *by: str) -> DataFrame:
    """(by, _rule, detail): the first rows of each rule that fires as a JSON list, in its order, else in that of the scan.

    One scan for all rules over a table: a row comes once per rule it breaks, and a top-n in each task cuts them before the shuffle.
    """
    each = ", ".join(
        f"CASE WHEN {part.condition} THEN named_struct('rule', {i}, 'row', to_json(struct({part.columns}), map('ignoreNullFields', 'false'))) END"
        for i, (_, part) in enumerate(own))
    ordered = [(f"_o{i}_{j}", column, way, i) for i, (_, part) in enumerate(own) for j, (column, way) in enumerate(part.order)]
    columns = [*by, *[f"{column} AS {name}" for name, column, _, _ in ordered], "monotonically_increasing_id() AS _at", f"array_compact(array({each})) AS _fired"]
    fired = spark.sql(f"SELECT {', '.join(columns)} FROM {source}", args=args).withColumn("_f", F.explode("_fired")).withColumn("_rule", F.col("_f.rule"))
    order = ", ".join([*[f"CASE WHEN _rule = {i} THEN {name} END {way}" for name, _, way, i in ordered], "_at"])
    limits = [max(rule.detail_limit, 0) for rule, _ in own]
    top = fired.withColumn("_rn", F.expr(f"row_number() OVER (PARTITION BY {', '.join([*by, '_rule'])} ORDER BY {order})")).filter(
        F.col("_rn") <= max(limits)).filter(F.col("_rn") <= F.get(F.array(*[F.lit(n) for n in limits]), F.col("_rule")))
    told = F.transform(F.array_sort(F.collect_list(F.struct("_rn", F.col("_f.row").alias("_row")))), lambda x: x["_row"])
    return top.groupBy(*by, "_rule").agg(F.concat(F.lit("["), F.array_join(told, ","), F.lit("]")).alias("detail"))


def _detail(rows: DataFrame, rule: Rule) -> DataFrame:
    """First rows of a fired rule as JSON: a top-n, so nothing unbounded is gathered."""
    members = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    # The limit keeps the order the rule asks for; the position makes the gathered list follow it.
    sample = rows.limit(rule.detail_limit).select(F.monotonically_increasing_id().alias("_at"), members.alias("_row"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_at", "_row"))), lambda x: x["_row"])
    return sample.agg(F.to_json(ordered, {"ignoreNullFields": "false"}).alias("detail")).select(F.lit(rule.name).alias("_rule"), "detail")


def evaluate(spark: SparkSession, rules: list[Rule], args: dict | None = None) -> DataFrame:
    """(name, kind, message, fired, affected, detail), one row per rule.

    Rules that look at one row at a time are counted together, by one scan per table, and the first rows of those
    that fired are taken by one more. All others are counted by one job, each by a scan of its own.
    """
    empty = "name string, kind string, message string, fired boolean, affected bigint, detail string"
    if not rules:
        return spark.createDataFrame([], empty)
    found = {r.name: rule_rows(spark, r, args) for r in rules}
    tables: dict[str, list[tuple[Rule, ByRow]]] = {}
    others = []
    for rule in rules:
        part = by_row(rule.sql)
        if part:
            tables.setdefault(part.table, []).append((rule, part))
        else:
            others.append(rule)
    try:
        affected, details = {}, {}
        for table, own in tables.items():
            affected |= _counted_rows(spark, table, own, args or {})
            fired = [(r, p) for r, p in own if affected[r.name] and r.detail_limit > 0]
            if fired:
                details |= {fired[row["_rule"]][0].name: row["detail"] for row in fired_rows(spark, table, fired, args or {}).collect()}
        if others:
            counted = reduce(DataFrame.unionByName, [
                found[r.name].agg(F.count("*").alias("affected")).select(F.lit(r.name).alias("name"), "affected") for r in others])
            affected |= {row["name"]: row["affected"] for row in counted.collect()}
        fired = [r for r in others if affected[r.name]]
        if fired:
            parts = reduce(DataFrame.unionByName, [_detail(found[r.name], r) for r in fired])
            details |= {row["_rule"]: row["detail"] for row in parts.collect()}
    except PySparkException as error:
        raise InvalidRule(f"a rule cannot run: {error}") from error
    return spark.createDataFrame(
        [(r.name, r.kind, r.message, affected[r.name] > 0, affected[r.name], details.get(r.name)) for r in rules], empty)


def results(spark: SparkSession, rules: list[Rule], args: dict | None = None) -> list[dict]:
    """The same on the driver: one short row per declared rule."""
    return [r.asDict() for r in evaluate(spark, rules, args).collect()]


def has_stop(found: list[dict]) -> bool:
    return any(r["fired"] and r["kind"] == STOP for r in found)


def fired_log(found: DataFrame, run_id: int, origin: str) -> DataFrame:
    """Rows for the log of fired rules."""
    return found.filter("fired").select(
        F.lit(run_id).cast("bigint").alias("run_id"), F.lit(origin).alias("origin"),
        "name", "kind", "message", "affected", "detail")


def guard_write(candidate: DataFrame, table: str, rules: list[Rule]) -> tuple[DataFrame, list[dict]]:
    """Invariants checked on what the table would hold; a stop keeps it from being published."""
    candidate.createOrReplaceTempView(table)
    found = results(candidate.sparkSession, rules)
    if has_stop(found):
        stops = [r for r in found if r["fired"] and r["kind"] == STOP]
        raise StopError("; ".join(f"{r['name']}: {r['message']}" for r in stops), found)
    return candidate, found
