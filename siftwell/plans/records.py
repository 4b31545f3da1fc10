"""Batches of record changes as recorded, guarded and published writes.

Every write leaves a run. A creation is its own principal; an edit, a deletion or an attachment is
chained to the run that created the row. A run is published as begun before its work, and as ended together
with what it wrote; when an invariant stops a write, the table stays as it was and the run is kept as failed.
A writer that is killed leaves its run open: `open_runs` lists such runs, `give_up` marks them as failed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.operators import changes, documents, rules, runs
from siftwell.operators.contracts import Contract
from siftwell.operators.listing import is_system
from siftwell.operators.replace import append_rows
from siftwell.operators.rules import Rule
from siftwell.plans.load import LINKS, RUNS, SYSTEM_TABLES, check_contract, prepare, register_documents
from siftwell.plans.store import Entry, Store
from siftwell.session import key_join, stage

_RUN_COLUMNS = [c.split()[0] for c in SYSTEM_TABLES[RUNS].split(", ")]


def _next_run(store: Store) -> int:
    return store.read(RUNS).agg(F.coalesce(F.max("id"), F.lit(0)) + 1).first()[0]


def _open_runs(store: Store, principals: DataFrame) -> DataFrame:
    """(id, principal), one run per distinct principal; NULL stands for rows without a creating run.

    Numbers come from the written rows' positions: unique and rising, without one task numbering all.
    """
    base = _next_run(store)
    distinct = principals.select("principal").distinct()
    return stage(distinct.select((F.lit(base) + F.monotonically_increasing_id()).alias("id"), "principal"), "runs")


def _run_rows(opened: DataFrame, operation: str | Column, status: str) -> DataFrame:
    """The event of each run that opens or closes it."""
    operation = F.lit(operation) if isinstance(operation, str) else operation
    known = {"id": F.col("id"), "seq": F.lit(1 if status == runs.RUNNING else 2), "ejecucion_id_principal": F.coalesce("principal", "id"),
             "carga": operation, "tipo": F.lit("cli"), "estado": F.lit(status),
             "fecha": F.current_timestamp().cast("timestamp_ntz"), "usuario": F.lit(opened.sparkSession.sparkContext.sparkUser())}
    return opened.select(*[known.get(c, F.lit(None)).alias(c) for c in _RUN_COLUMNS])


def _recorded(
    store: Store, entity: dict, operation: str, opened: DataFrame, candidate: DataFrame,
    write: Callable[[], list[Entry]], invariants: list[Rule] | None, changed: DataFrame | None = None,
    contract: Contract | None = None, fired: list[dict] | None = None,
) -> None:
    """Publish the runs as begun, check the changed rows and the candidate, then publish what `write` wrote with the ended runs;
    else only the failed ones."""
    name = f"{entity['entidad']}.{operation}"
    store.publish(store.append(RUNS, _run_rows(opened, name, runs.RUNNING)))
    try:
        if contract is not None and changed is not None:
            check_contract(changed, contract)
        if invariants:
            store.register_views()
            found = rules.guard_write(candidate, entity["tabla"], invariants)[1]
            if fired is not None:
                fired += [r for r in found if r["fired"]]
        written = write()
    except Exception:
        store.publish(store.append(RUNS, _run_rows(opened, name, runs.ERROR)))
        raise
    finally:
        store.register_views()
    store.publish(written + store.append(RUNS, _run_rows(opened, name, runs.OK)))


def open_runs(store: Store, before: Column | None = None) -> DataFrame:
    """(run_id, status, principal, operation, opened): runs begun, before a moment if one is given, that are not closed."""
    events = store.read(RUNS).select(
        F.col("id").alias("run_id"), F.col("estado").alias("status"), F.col("ejecucion_id_principal").alias("principal"),
        F.col("carga").alias("operation"), F.col("fecha").alias("opened"))
    found = runs.open_runs(events)
    return found if before is None else found.filter(F.col("opened") < before)


def give_up(store: Store, orphans: DataFrame) -> None:
    """Close open runs as failed; their tables are as they were, since nothing was published."""
    opened = stage(orphans.select(F.col("run_id").alias("id"), "principal", "operation"), "orphans")
    store.publish(store.append(RUNS, _run_rows(opened, F.col("operation"), runs.ERROR)))


def create(
    spark: SparkSession, store: Store, entity: dict, catalogue: dict[str, dict], requests: DataFrame,
    invariants: list[Rule] | None = None, contract: Contract | None = None, now: Column | None = None,
    defaults: dict[str, Column] | None = None, fired: list[dict] | None = None,
) -> DataFrame:
    """Add the valid requests under one run; returns the refused ones with their error.

    New rows carry the time in created_at and updated_at and `defaults` in fields not asked for. Rows that break
    the table's `contract` are never published. Alarms that fired are added to `fired`.
    """
    prepare(store)
    table = entity["tabla"]
    opened = _open_runs(store, spark.range(1).select(F.lit(None).cast("bigint").alias("principal")))
    run_id = opened.first()["id"]
    now = F.current_timestamp() if now is None else now
    added, refused = changes.new_rows(
        requests, entity, catalogue, {t: store.read(t) for t in store.tables()}, run_id, now=now, defaults=defaults)
    added = store.conform(table, added)
    candidate = append_rows(store.read(table), added)
    _recorded(store, entity, "crear", opened, candidate, lambda: store.append(table, added), invariants, added, contract, fired)
    return refused


def _principals(rows: DataFrame) -> DataFrame:
    return rows.select((F.col("ejecucion_id") if "ejecucion_id" in rows.columns else F.lit(None)).cast("bigint").alias("principal"))


def edit(
    spark: SparkSession, store: Store, entity: dict, asked: DataFrame, now: Column,
    invariants: list[Rule] | None = None, id_col: str = "id", catalogue: dict[str, dict] | None = None,
    contract: Contract | None = None, fired: list[dict] | None = None,
) -> DataFrame:
    """Apply (id, seq, fields) changes, named and resolved as in creations; returns the refused ones."""
    prepare(store)
    table = entity["tabla"]
    rows = store.read(table)
    tables = {t: store.read(t) for t in store.tables()}
    edited, refused = changes.edit_rows(rows, asked, entity, now, id_col, catalogue, tables)
    refused = stage(refused, "refused")
    done = asked.select(F.col(id_col).alias("_asked")).distinct().join(refused, F.col("_asked") == F.col(id_col), "left_anti")
    touched = key_join(rows, done, [(F.col(id_col), F.col("_asked"))], "left_semi")

    part_meta = entity["campos"].get(store.part_col(table))
    moves = part_meta is not None and not is_system(store.part_col(table), part_meta)
    write = lambda: store.rewrite(
        table, touched, lambda part: changes.edit_rows(part, asked, entity, now, id_col, catalogue, tables)[0], keys=[id_col], moves=moves)
    changed = key_join(edited, done, [(F.col(id_col), F.col("_asked"))], "left_semi")
    _recorded(store, entity, "editar", _open_runs(store, _principals(touched)), edited, write, invariants, changed, contract, fired)
    return refused


def delete(spark: SparkSession, store: Store, entity: dict, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Delete by id, without checking invariants; returns the ids that do not exist."""
    prepare(store)
    table = entity["tabla"]
    rows = store.read(table)
    asked = stage(ids.select(F.col(id_col).alias("_asked")).distinct(), "ids")
    gone = key_join(rows, asked, [(F.col(id_col), F.col("_asked"))], "left_semi")
    opened = _open_runs(store, _principals(gone))
    missing = stage(asked.join(rows.select(id_col), F.col("_asked") == F.col(id_col), "left_anti"), "missing")
    write = lambda: store.rewrite(table, gone, lambda part: changes.delete_rows(part, ids, id_col), keys=[id_col])
    _recorded(store, entity, "borrar", opened, rows, write, None)
    return missing.withColumnRenamed("_asked", id_col)


def attach(spark: SparkSession, store: Store, entity: dict, requests: DataFrame, id_col: str = "id") -> DataFrame:
    """Link documents (row_id, hash, tag, name, bytes) to rows; returns the refused requests.

    The run of each attachment is chained to the run that created the row; the rows stay untouched.
    """
    prepare(store)
    rows = store.read(entity["tabla"]).select(F.col(id_col).alias("row_id"), F.col("ejecucion_id").alias("run_id"))
    checked = stage(documents.attach_requests(requests, rows), "attach")
    good = checked.filter("status = 'ok'")
    opened = _open_runs(store, good)
    links = key_join(good, opened.withColumnRenamed("principal", "_p"), [(F.col("principal"), F.col("_p"))], "inner").select(
        F.col("id").alias("run_id"), "hash", "tag").distinct().withColumn("fecha", F.current_timestamp().cast("timestamp_ntz"))
    arrived = requests.join(good.select("hash").distinct(), "hash", "left_semi").select("hash", "name", "bytes")
    store.publish(store.append(RUNS, _run_rows(opened, f"{entity['tabla']}.adjuntar", runs.RUNNING)))
    entries: list[Entry] = store.append(LINKS, links)
    entries += register_documents(store, arrived)
    entries += store.append(RUNS, _run_rows(opened, f"{entity['tabla']}.adjuntar", runs.OK))
    store.publish(entries)
    return checked.filter("status <> 'ok'")
