"""Batches of creations, edits and deletions over a table kept as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.casts import FIELD_TYPES, field_value
from siftwell.operators.listing import field_named, is_system, references, vocabulary
from siftwell.operators.lookup import resolve_labels
from siftwell.operators.replace import append_rows
from siftwell.session import key_join, stage


def typed_fields(
    rows: DataFrame, names: list[str], entity: dict, catalogue: dict[str, dict], tables: dict[str, DataFrame],
) -> tuple[DataFrame, dict[str, Column], dict[str, Column], dict[str, Column]]:
    """Text columns under the fields' own names -> the rows with what was looked up, and per field its typed value, its
    error and the text an error may show. A reference is resolved by label or id; blank text is NULL."""
    refs = references(entity, catalogue)
    values, errors, shown = {}, {}, {}
    for name in names:
        if name in refs:
            rows = resolve_labels(rows, name, tables[refs[name].table], "id", refs[name].label, f"_id_{name}", f"_st_{name}")
            values[name], status = F.col(f"_id_{name}"), F.col(f"_st_{name}")
            errors[name], shown[name] = F.when(status != "ok", F.concat(status, F.lit(f" {refs[name].table}"))), F.col(name)
            continue
        meta = entity["campos"][name]
        value, error = field_value(F.col(name).cast("string"), meta["tipo"])
        allowed = meta.get("validacion", {}).get("lista_valores")
        outside = F.lit(False) if not allowed else value.isNotNull() & ~value.isin(allowed)
        values[name], errors[name] = value, F.coalesce(error, F.when(outside, F.lit("not an allowed value")))
        shown[name] = F.when(error.isNull() & outside, value.cast("string"))
    return rows, values, errors, shown


def normalise_requests(
    requests: DataFrame, entity: dict, catalogue: dict[str, dict], tables: dict[str, DataFrame],
) -> DataFrame:
    """Text requests -> typed columns under their real names, plus `_error` (first failing field).

    Columns may be called by field name, reference alias or synonym; references are resolved by
    label or id. Columns that start with an underscore are kept as they are.
    """
    named = {c: field_named(entity, catalogue, c) for c in requests.columns if not c.startswith("_")}
    for name in named.values():
        if is_system(name, entity["campos"][name]):
            raise ValueError(f"{name} is managed by the system")
    rows, values, errors, shown = typed_fields(requests.withColumnsRenamed(named), list(named.values()), entity, catalogue, tables)
    first = F.coalesce(*[
        F.when(errors[n].isNotNull(), F.concat(F.lit(f"{n}: "), errors[n], F.coalesce(F.concat(F.lit(": "), shown[n]), F.lit("")))) for n in errors])
    meta = [c for c in requests.columns if c.startswith("_")]
    return rows.select(*meta, *[values[n].alias(n) for n in values], first.alias("_error"))


def row_id(*parts: Column) -> Column:
    """Identifier that a retried task computes again, unlike a random one."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def new_rows(
    requests: DataFrame, entity: dict, catalogue: dict[str, dict], tables: dict[str, DataFrame],
    run_id: int, request_id: str = "_request", now: Column | None = None, defaults: dict[str, Column] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(rows the valid requests become, stamped with id, run and time; rejected requests with their error).

    `defaults` fill fields that the requests do not name; a field asked for as blank stays NULL.
    """
    checked = stage(normalise_requests(requests, entity, catalogue, tables), "requests")
    stamps = {"id": row_id(F.lit(run_id), F.col(request_id)), "ejecucion_id": F.lit(run_id).cast("bigint")}
    if now is not None:
        stamps |= {c: now for c in ("created_at", "updated_at") if c in entity["campos"]}
    stamps = {c: v for c, v in (defaults or {}).items() if c not in checked.columns} | stamps
    return checked.filter("_error IS NULL").withColumns(stamps), checked.filter("_error IS NOT NULL").select(request_id, "_error")


def create_rows(
    target: DataFrame, requests: DataFrame, entity: dict, catalogue: dict[str, dict],
    tables: dict[str, DataFrame], run_id: int, request_id: str = "_request",
) -> tuple[DataFrame, DataFrame]:
    """(target with the new rows, rejected requests with their error)."""
    good, refused = new_rows(requests, entity, catalogue, tables, run_id, request_id)
    return append_rows(target, good), refused


def latest_changes(changes: DataFrame, fields: list[str], known: dict[str, str], id_col: str = "id", seq_col: str = "seq") -> DataFrame:
    """One row per id: per field the struct of its last value (NULL: not named), and `_unknown`, the names that are no field.

    `changes` holds (id, seq, fields map of name -> text); `known` tells the field behind a folded name.
    """
    pairs = changes.select(id_col, seq_col, F.explode("fields").alias("_name", "value"))
    spoken = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    pairs = pairs.withColumn("_field", F.try_element_at(spoken, F.lower(F.trim("_name"))))
    last = [F.max_by(F.struct("value"), F.when(F.col("_field") == n, F.col(seq_col))).alias(f"_{n}") for n in fields]
    unknown = F.collect_set(F.when(F.col("_field").isNull() | ~F.col("_field").isin(fields), F.col("_name")))
    return pairs.groupBy(id_col).agg(*last, F.array_join(F.array_sort(unknown), ", ").alias("_unknown"))


def edit_rows(
    target: DataFrame, changes: DataFrame, entity: dict, now: Column, id_col: str = "id",
    catalogue: dict[str, dict] | None = None, tables: dict[str, DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(edited target, refused changes).

    A change names fields as a creation does: by name, alias or synonym, references by label or id. Only the
    fields it names are touched; blank text empties a field; `updated_at` moves and `ejecucion_id` stays. A
    change with an invalid value or an unknown id is refused as a whole.
    """
    catalogue = catalogue or {}
    editable = [n for n, m in entity["campos"].items() if n in target.columns and not is_system(n, m)]
    last = latest_changes(changes, editable, vocabulary(entity, catalogue), id_col)
    given = last.select(F.col(id_col).alias("_change_id"), "_unknown", *[F.col(f"_{n}").isNotNull().alias(f"_given_{n}") for n in editable],
                        *[F.col(f"_{n}.value").alias(n) for n in editable])
    rows, values, errors, _ = typed_fields(given, editable, entity, catalogue, tables or {})
    problems = [F.when(F.col("_unknown") != "", F.concat(F.lit("unknown field: "), F.col("_unknown")))]
    problems += [F.when(errors[n].isNotNull(), F.concat(F.lit(f"{n}: "), errors[n])) for n in editable]
    typed = [F.struct(F.col(f"_given_{n}").alias("given"), values[n].alias("value")).alias(f"_{n}") for n in editable]
    checked = stage(rows.select("_change_id", *typed, F.coalesce(*problems).alias("_error")), "changes")

    good = checked.filter("_error IS NULL")
    joined = key_join(target, good, [(F.col(id_col), F.col("_change_id"))])
    touched = F.col("_change_id").isNotNull()
    out = {n: F.when(touched & F.col(f"_{n}.given"), F.col(f"_{n}.value").cast(target.schema[n].dataType)).otherwise(F.col(n)) for n in editable}
    if "updated_at" in target.columns:
        out["updated_at"] = F.when(touched, now).otherwise(F.col("updated_at"))
    ids = target.select(F.col(id_col).alias("_known"))
    missing = key_join(good, ids, [(F.col("_change_id"), F.col("_known"))], "left_anti")
    refused = checked.filter("_error IS NOT NULL").select(F.col("_change_id").alias(id_col), F.col("_error").alias("error")).unionByName(
        missing.select(F.col("_change_id").alias(id_col), F.lit("no such row").alias("error")))
    return joined.select(*[out[c].alias(c) if c in out else F.col(c) for c in target.columns]), refused


def delete_rows(target: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    gone = ids.select(F.col(id_col).alias("_gone")).distinct()
    return key_join(target, gone, [(F.col(id_col), F.col("_gone"))], "left_anti")


def undo_run(target: DataFrame, run_id: int, run_col: str = "ejecucion_id") -> DataFrame:
    """Everything but the rows one run wrote; rows without a run stay."""
    return target.filter(~F.col(run_col).eqNullSafe(F.lit(run_id)))


def rows_of_run(target: DataFrame, run_id: int, run_col: str = "ejecucion_id") -> DataFrame:
    """What one run wrote, to feed an accumulating history."""
    return target.filter(F.col(run_col) == F.lit(run_id))
