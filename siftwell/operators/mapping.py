"""Declared mapping: a chain of column operations per field, then valid rows and rejects.

A mapping is a list of {"origen"?, "destino", "operaciones": [{"tipo": ...}, ...]}. Every
operation gives a value and an error as columns, so a mapping is a few projections and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.functions.casts import cast_finish, cast_parse, cast_text
from siftwell.functions.dates import parse_resolved, resolved_error
from siftwell.functions.text import blank_to_null, strip
from siftwell.session import key_join

REJECT_TYPE = T.StructType([T.StructField("field", T.StringType()), T.StructField("reason", T.StringType())])


class RowContext:
    """What an operation may use besides the value: parameters, header cells, settled dates."""

    def __init__(self, parameters: dict | None = None, resolution: Column | None = None):
        self.parameters = parameters or {}
        self.resolution = resolution


def _no_error() -> Column:
    return F.lit(None).cast("string")


class Operation:
    """Three steps, each a projection of its own so that no step is computed twice.

    text(value) prepares the input, parse(text) reads it, finish(text, parsed) gives the value and
    the error. All of them must be built from column expressions.
    """

    def text(self, value: Column, op: dict, ctx: RowContext) -> Column:
        return value

    def parse(self, text: Column, op: dict, ctx: RowContext) -> Column:
        return text

    def finish(self, text: Column, parsed: Column, op: dict, ctx: RowContext) -> tuple[Column, Column]:
        return parsed, _no_error()


class Trim(Operation):
    def text(self, value, op, ctx):
        return strip(value.cast("string"))


class Cast(Operation):
    def text(self, value, op, ctx):
        return cast_text(value.cast("string"), op["tipo_destino"], op.get("formato_numerico", "en"))

    def parse(self, text, op, ctx):
        return cast_parse(text, op["tipo_destino"])

    def finish(self, text, parsed, op, ctx):
        return cast_finish(text, parsed, op["tipo_destino"])


class Const(Operation):
    def text(self, value, op, ctx):
        return F.lit(op["valor"])


class Parameter(Operation):
    def text(self, value, op, ctx):
        return F.lit(ctx.parameters.get(op["nombre"]))


class Cell(Operation):
    def text(self, value, op, ctx):
        return F.try_element_at(F.col("_cells"), F.lit(op["referencia"]))

    def finish(self, text, parsed, op, ctx):
        present = F.coalesce(F.map_contains_key(F.col("_cells"), F.lit(op["referencia"])), F.lit(False))
        return parsed, F.when(~present, F.lit(f"header cell {op['referencia']} could not be read"))


class DateFormat(Operation):
    def text(self, value, op, ctx):
        return blank_to_null(value.cast("string"))

    def parse(self, text, op, ctx):
        return parse_resolved(text, ctx.resolution, op["formatos"])

    def finish(self, text, parsed, op, ctx):
        return parsed, resolved_error(text, parsed, ctx.resolution)


# The closed vocabulary of operations.
OPERATIONS: dict[str, Operation] = {
    "rename": Operation(), "trim": Trim(), "cast": Cast(), "const": Const(),
    "parametro": Parameter(), "celda": Cell(), "date_format": DateFormat(),
}


def register_operation(name: str, operation: Operation) -> None:
    """Extension point."""
    OPERATIONS[name] = operation


def check_mapping(mapping: list[dict]) -> None:
    unknown = [op["tipo"] for field in mapping for op in field.get("operaciones", []) if op["tipo"] not in OPERATIONS]
    if unknown:
        raise ValueError(f"operations not in the vocabulary: {', '.join(unknown)}")


def cell_references(mapping: list[dict]) -> list[str]:
    refs = [op["referencia"] for f in mapping for op in f.get("operaciones", []) if op["tipo"] == "celda"]
    return list(dict.fromkeys(refs))


def date_fields(mapping: list[dict]) -> list[dict]:
    """Date operations whose format the column itself has to settle."""
    return [
        {"target": f["destino"], "source": f["origen"], "formats": op["formatos"], "epoch": op.get("epoch_excel", "1900")}
        for f in mapping if "origen" in f
        for op in f.get("operaciones", []) if op["tipo"] == "date_format"
    ]


def attach_cells(rows: DataFrame, cells: DataFrame, refs: list[str], file_col: str = "_file") -> DataFrame:
    """Header values, one (file, ref, value) row each, repeated on every row of their file.

    Only the declared references are gathered, so each file's map is as small as the mapping.
    """
    maps = (
        cells.filter(F.col("ref").isin(refs))
        .groupBy(F.col("file").alias("_cell_file"))
        .agg(F.map_from_entries(F.collect_set(F.struct("ref", "value"))).alias("_cells"))
    )
    return key_join(rows, maps, [(F.col(file_col), F.col("_cell_file"))]).drop("_cell_file")


def _run_chains(rows: DataFrame, mapping: list[dict], parameters: dict | None) -> DataFrame:
    """Adds `_v<i>` (value) and `_e<i>` (first error) for every field, one projection per step.

    Fields advance together: the k-th operation of every field shares its projections.
    """
    chains = [f.get("operaciones", []) for f in mapping]
    values = [F.col(f"`{f['origen']}`") if "origen" in f else F.lit(None).cast("string") for f in mapping]
    contexts = [
        RowContext(parameters, F.col("_dates")[f["destino"]] if any(o["tipo"] == "date_format" for o in c) else None)
        for f, c in zip(mapping, chains)]
    rows = rows.withColumns({f"_v{i}": v for i, v in enumerate(values)})
    rows = rows.withColumns({f"_e{i}": _no_error() for i in range(len(mapping))})
    for k in range(max((len(c) for c in chains), default=0)):
        live = [(i, c[k], OPERATIONS[c[k]["tipo"]], contexts[i]) for i, c in enumerate(chains) if k < len(c)]
        rows = rows.withColumns({f"_t{i}": o.text(F.col(f"_v{i}"), op, x) for i, op, o, x in live})
        rows = rows.withColumns({f"_p{i}": o.parse(F.col(f"_t{i}"), op, x) for i, op, o, x in live})
        step = {}
        for i, op, o, x in live:
            value, error = o.finish(F.col(f"_t{i}"), F.col(f"_p{i}"), op, x)
            step[f"_v{i}"] = value
            step[f"_e{i}"] = F.coalesce(F.col(f"_e{i}"), error) if k else error
        rows = rows.withColumns(step)
    return rows


def map_rows(
    rows: DataFrame,
    mapping: list[dict],
    parameters: dict | None = None,
    run_id: Column | None = None,
) -> DataFrame:
    """Target fields, `extra_fields`, `_reject` (first failing field) and `_raw`; no shuffle.

    Columns that start with an underscore are row metadata and travel along untouched.
    `_split` names the input partition. Being non-deterministic to the optimizer, it keeps a filter
    on `_reject` above the projections; pushed below them it would repeat every conversion.
    A row that the scan marked `_unclosed` is rejected as a whole, without a field.
    """
    check_mapping(mapping)
    sources = [c for c in rows.columns if not c.startswith("_")]
    meta = [c for c in rows.columns if c.startswith("_") and c not in ("_dates", "_cells", "_split", "_unclosed")]
    declared = {f["origen"] for f in mapping if "origen" in f}
    undeclared = sorted(c for c in sources if c not in declared)

    chained = _run_chains(rows, mapping, parameters)
    fields = [F.col(f"_v{i}").alias(f["destino"]) for i, f in enumerate(mapping)]
    rejects = [
        F.when(F.col(f"_e{i}").isNotNull(), F.struct(F.lit(f["destino"]).alias("field"), F.col(f"_e{i}").alias("reason")))
        for i, f in enumerate(mapping)]
    if "_unclosed" in rows.columns:
        rejects.insert(0, F.when(F.col("_unclosed"), F.struct(F.lit(None).cast("string").alias("field"), F.lit("quote not closed").alias("reason"))))
    if undeclared and "extra_fields" not in {f["destino"] for f in mapping}:
        fields.append(as_json(undeclared).alias("extra_fields"))
    if run_id is not None:
        fields.append(run_id.alias("ejecucion_id"))

    reject = F.coalesce(*rejects) if rejects else F.lit(None).cast(REJECT_TYPE)
    raw = F.when(reject.isNotNull(), as_json(sources))
    return chained.select(*meta, *fields, reject.alias("_reject"), raw.alias("_raw"), F.spark_partition_id().alias("_split"))


def as_json(columns: list[str]) -> Column:
    """JSON object text of the named columns; NULL members are kept."""
    return F.to_json(F.struct(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns]), {"ignoreNullFields": "false"})


def valid_rows(mapped: DataFrame) -> DataFrame:
    return mapped.filter(F.col("_reject").isNull() & (F.col("_split") >= 0)).drop("_reject", "_raw", "_split")


def rejected_rows(mapped: DataFrame) -> DataFrame:
    """Rejects with their place in the file, the failing field, the reason and the whole raw row."""
    meta = [c for c in mapped.columns if c.startswith("_") and c not in ("_reject", "_raw", "_split")]
    return mapped.filter(F.col("_reject").isNotNull() & (F.col("_split") >= 0)).select(
        *meta, F.col("_reject.field").alias("field"), F.col("_reject.reason").alias("reason"), F.col("_raw").alias("raw"))


def row_counts(mapped: DataFrame, by: str = "_file") -> DataFrame:
    """Rows read, accepted and rejected per file."""
    bad = F.col("_reject").isNotNull().cast("bigint")
    return mapped.groupBy(by).agg(
        F.count("*").alias("rows_read"), F.sum(1 - bad).alias("rows_ok"), F.sum(bad).alias("rows_rejected"))


def common_columns(frame: DataFrame, target_columns: list[str]) -> DataFrame:
    """Only the columns the target knows, in the target's order."""
    return frame.select(*[c for c in target_columns if c in frame.columns])
