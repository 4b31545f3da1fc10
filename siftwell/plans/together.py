"""The SQL of a load evaluated for every file of a delivery by one plan.

The files are a table, and each query is a lateral subquery beside it: in it `_entrante` and the staging table hold the
rows of that file alone, and `:ejecucion_id`, `:fichero`, `:hash_fichero`, `:promovidas` and captured variables are
columns of the file's row. Spark turns that into joins and aggregations by file, so a folder of many files costs
a few jobs and not a few jobs per file.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.operators import rules
from siftwell.operators.rules import STOP, InvalidRule, Rule
from siftwell.operators.variables import InvalidVariable
from siftwell.session import key_join, stage

FILES, LOT = "_ficheros", "_lote"
# Quoted text, names and comments are left as they are; what remains with a colon before it is a bound value.
_BOUND = re.compile(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|(?<!:):(?P<name>[A-Za-z_]\w*)", re.S)
_NESTED = re.compile(r"(?P<before>\w*)\s*\(\s*(?:SELECT|WITH)\b", re.I)


def names_bound(sql: str) -> set[str]:
    return {m["name"] for m in _BOUND.finditer(sql) if m["name"]}


def words(sql: str) -> set[str]:
    return {w.lower() for w in re.findall(r"\w+", sql)}


def can_go_together(sql: str, written: set[str]) -> bool:
    """Whether a query gives each file the same when the files go together as when they go in turn.

    It does unless it names a table that the load writes, or the rows replaced so far. A query inside an
    expression of another is not evaluated per file either.
    """
    return not ({t.lower() for t in written} & words(sql)) and "borradas" not in names_bound(sql) and all(
        m["before"].upper() in ("FROM", "JOIN") for m in _NESTED.finditer(sql))


class Delivery:
    """The files of a delivery (id, name, hash), their rows (`_run` and the incoming columns), and values that hold for all."""

    def __init__(self, spark: SparkSession, files: DataFrame, lot: DataFrame, values: dict):
        self.spark, self.values = spark, values
        self.state = files.select(F.col("id").alias("_v_ejecucion_id"), F.col("name").alias("_v_fichero"), F.col("hash").alias("_v_hash_fichero"))
        self.lots = {"_entrante": lot}

    def narrowed(self, runs: DataFrame) -> Delivery:
        """The same for some of the files only (run)."""
        other = object.__new__(Delivery)
        other.spark, other.values, other.lots = self.spark, self.values, self.lots
        other.state = stage(self.state.join(runs, F.col("_v_ejecucion_id") == F.col("run"), "left_semi"), "files")
        return other

    def add(self, values: DataFrame, run: str) -> None:
        """A column of values by run becomes `:column` of each file."""
        named = values.select(F.col(run).alias("_own_run"), *[F.col(c).alias(f"_v_{c}") for c in values.columns if c != run])
        joined = key_join(self.state, named, [(F.col("_v_ejecucion_id"), F.col("_own_run"))])
        self.state = stage(joined.drop("_own_run"), "files")

    def _bound(self, sql: str) -> tuple[str, dict]:
        """The SQL with the files' own values as columns, and the other values it names."""
        own = {c.removeprefix("_v_") for c in self.state.columns}
        text = _BOUND.sub(lambda m: f"_f._v_{m['name']}" if m["name"] in own else m[0], sql)
        return text, {k: v for k, v in self.values.items() if k in names_bound(text)}

    def _register(self) -> None:
        self.state.createOrReplaceTempView(FILES)
        for name, lot in self.lots.items():
            lot.createOrReplaceTempView(LOT + name)

    def rows(self, sql: str) -> DataFrame:
        """(_run, columns of the query): its rows for every file."""
        self._register()
        text, args = self._bound(sql)
        lots = ", ".join(
            f"{name} AS (SELECT {', '.join(f'`{c}`' for c in lot.columns if c != '_run')} FROM {LOT + name} WHERE _run = _f._v_ejecucion_id)"
            for name, lot in self.lots.items())
        try:
            return self.spark.sql(
                f"SELECT _f._v_ejecucion_id AS _run, _r.* FROM {FILES} AS _f, LATERAL (WITH {lots} SELECT * FROM ({text})) AS _r", args=args)
        except AnalysisException as error:
            if "SUBQUERY" not in (error.getCondition() or ""):
                raise
            return self._in_turn(sql)  # a file's value inside an aggregation, say, has no lateral form

    def _in_turn(self, sql: str) -> DataFrame:
        """The same, file by file."""
        found = []
        for file in self.state.orderBy("_v_ejecucion_id").toLocalIterator():
            own = self.values | {c.removeprefix("_v_"): v for c, v in file.asDict().items() if v is not None}
            for name, lot in self.lots.items():
                lot.filter(F.col("_run") == file["_v_ejecucion_id"]).drop("_run").createOrReplaceTempView(name)
            rows = self.spark.sql(sql, args=own)
            found.append(stage(rows.select(F.lit(file["_v_ejecucion_id"]).alias("_run"), "*"), "rows"))
        return reduce(DataFrame.unionByName, found)

    def capture(self, sql: str) -> None:
        """The one row of a variable query becomes variables of each file."""
        found = stage(self.rows(sql), "variables")
        counts = key_join(self.state.select("_v_ejecucion_id"), found.groupBy("_run").agg(F.count(F.lit(1)).alias("n")), [(F.col("_v_ejecucion_id"), F.col("_run"))])
        wrong = counts.filter(F.coalesce("n", F.lit(0)) != 1).orderBy("_v_ejecucion_id").limit(1).collect()
        if wrong:
            raise InvalidVariable(f"a variable query must return one row, not {'several' if wrong[0]['n'] else 'none'}, as for run {wrong[0][0]}: {sql}")
        self.add(found.select("_run", *[F.col(c).alias(f"v_{c}") for c in found.columns if c != "_run"]), "_run")

    def evaluate(self, declared: list[Rule]) -> DataFrame:
        """(run, name, kind, message, affected, detail) of the rules that fired, by file.

        Rules that look at one incoming row at a time are counted by one aggregation over one scan; others are
        run in the lateral form, each by a plan for all files.
        """
        empty = "run bigint, name string, kind string, message string, affected bigint, detail string"
        if not declared:
            return self.spark.createDataFrame([], empty)
        self._register()
        parts, others = [], []
        for rule in declared:
            text, args = self._bound(rule.sql)
            part = rules.by_row(text)
            (parts if part and part.table.lower() == "_entrante" else others).append((rule, part, args))
        found = []
        try:
            if parts:
                found.append(self._by_row([(rule, part) for rule, part, _ in parts], reduce(lambda a, b: a | b, [args for _, _, args in parts], {})))
            for rule, _, _ in others:
                rows = stage(self.rows(rule.sql), "rule")  # what fired: read for its count and for its first rows
                shown = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns if c != "_run"]), {"ignoreNullFields": "false"})
                counted = rows.groupBy("_run").agg(F.count(F.lit(1)).alias("affected"))
                placed = rows.select("_run", shown.alias("_row"), F.monotonically_increasing_id().alias("_at"))
                placed.createOrReplaceTempView("_regla")
                top = self.spark.sql(f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY _run ORDER BY _at) AS _rn FROM _regla) WHERE _rn <= {max(rule.detail_limit, 0)}")
                told = F.transform(F.array_sort(F.collect_list(F.struct("_rn", "_row"))), lambda x: x["_row"])
                details = top.groupBy(F.col("_run").alias("_drun")).agg(F.concat(F.lit("["), F.array_join(told, ","), F.lit("]")).alias("detail"))
                found.append(key_join(counted, details, [(F.col("_run"), F.col("_drun"))]).select(
                    F.col("_run").alias("run"), F.lit(rule.name).alias("name"), F.lit(rule.kind).alias("kind"), F.lit(rule.message).alias("message"), "affected", "detail"))
            return stage(reduce(DataFrame.unionByName, found), "fired")
        except PySparkException as error:
            raise InvalidRule(f"a rule cannot run: {error}") from error

    def _by_row(self, own: list[tuple[Rule, rules.ByRow]], args: dict) -> DataFrame:
        lot = LOT + "_entrante"
        uses_file = any("_f._v_" in part.condition + part.columns for _, part in own)
        # a column of the lot and a value of its file may share a name: the file's values are all prefixed
        source = f"{lot} AS _entrante JOIN {FILES} AS _f ON _entrante._run = _f._v_ejecucion_id" if uses_file else f"{lot} AS _entrante"
        columns = ", ".join(f"`{c}`" for c in self.lots["_entrante"].columns if c != "_run")
        shown = [(rule, rules.ByRow(columns if part.columns.strip() == "*" else part.columns, part.table, part.condition, part.order)) for rule, part in own]
        counts = ", ".join(f"count_if({part.condition}) AS r{i}" for i, (_, part) in enumerate(own))
        counted = stage(self.spark.sql(f"SELECT _run, {counts} FROM {source} GROUP BY _run", args=args), "counted")
        each = F.array(*[F.struct(F.lit(i).alias("rule"), F.col(f"r{i}").alias("affected")) for i in range(len(own))])
        fired = counted.select("_run", F.explode(F.filter(each, lambda x: x["affected"] > 0)).alias("f")).select("_run", "f.*")
        details = rules.fired_rows(self.spark, source, shown, args, "_run").select(F.col("_run").alias("_drun"), F.col("_rule").alias("_drule"), "detail")
        named = [F.element_at(F.array(*[F.lit(getattr(rule, what)) for rule, _ in own]), F.col("rule") + 1).alias(what) for what in ("name", "kind", "message")]
        return key_join(fired, details, [(F.col("_run"), F.col("_drun")), (F.col("rule"), F.col("_drule"))]).select(
            F.col("_run").alias("run"), *named, "affected", "detail")

    @staticmethod
    def stopped(fired: DataFrame) -> DataFrame:
        return fired.filter(F.col("kind") == STOP).select("run").distinct()
