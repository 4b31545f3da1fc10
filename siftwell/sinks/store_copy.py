"""Snapshots of a whole store as of one moment, and restores that give a store again.

A snapshot is a folder of copies and a manifest with one row per folder of the store's tables. Folders of a store
are never changed once written, so a snapshot that builds on an earlier one names what that one has copied and
copies the rest. The earlier ones must be kept as long as a later one names them (`named`).
"""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.plans.store import NO_PART, Store
from siftwell.sinks.snapshot import MANIFEST, compare

SCHEMA = "seq bigint, table string, schema string, part_col string, part string, source string, path string, rows bigint, digest decimal(38,0)"
_WRITE = r"/([0-9a-f]{32})(/_part=[^/]*)?"


def row_digest(schema: T.StructType) -> Column:
    """64 bits of a row, in which a NULL has a place of its own. Maps count in the order they are kept in."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    seen = []
    for field in schema:
        cell = F.col(f"`{field.name}`")
        seen += [cell.isNull(), F.to_json(F.struct(cell.alias("v"))) if isinstance(field.dataType, nested) else cell]
    return F.xxhash64(*seen)


def _figures(schema: T.StructType) -> list[Column]:
    """Rows and the sum of their digests, which no order or split of the rows changes."""
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(row_digest(schema).cast("decimal(28,0)")), F.lit(0)).cast("decimal(38,0)").alias("digest")]


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row per table (no source) and one per folder of it: where it was, where its copy is, its rows and digest."""
    return spark.read.schema(SCHEMA).parquet(f"{folder}/{MANIFEST}")


def _copy(store: Store, table: str, sources: list[str], folder: str) -> dict[str, tuple[str | None, int, Decimal]]:
    """Copies of folders of one table: (path, rows, digest) by source. One job copies all of them without a shuffle."""
    schema = store.schema(table)
    part = store.part(table)[0]
    rows = store.spark.read.schema(schema).parquet(*sources).withColumn("_write", F.regexp_extract("_metadata.file_path", _WRITE + "/[^/]+$", 1))
    by = ["_write"] if part is None else ["_write", "_part"]
    rows = rows if part is None else rows.withColumn("_part", part)
    named = rows if part is None else rows.withColumn("_part", F.coalesce(F.nullif("_part", F.lit("")), F.lit(NO_PART)))
    counted = {tuple(r[c] for c in by): (r["rows"], r["digest"]) for r in named.groupBy(*by).agg(*_figures(schema)).collect()}
    rows.write.option("compression", "zstd").partitionBy(*by).parquet(f"{folder}/{table}")
    made = {}
    for source, part_name in [(e.path, e.part) for e in store._live(table) if e.path in set(sources)]:
        write, below = re.search(_WRITE + "$", source).groups()
        count, digest = counted.get((write,) if part is None else (write, part_name), (0, Decimal(0)))
        made[source] = (f"{folder}/{table}/_write={write}{below or ''}" if count else None, count, digest)
    return made


def take(store: Store, folder: str, base: str | None = None) -> DataFrame:
    """The store as its log was at one moment, in a new folder; the manifest is written last and returned.

    What is published meanwhile is in it as a whole or not at all, since a publication is one file of the log and the log
    is read once. `base` is an earlier snapshot of the same store: folders it has are named and not copied again.
    An empty table is its declaration alone. A snapshot that breaks off has no manifest.
    """
    spark, moment = store.spark, Store(store.spark, store.root)
    known = {} if base is None else {r["source"]: r for r in manifest(spark, base).filter("source IS NOT NULL").collect()}  # folders, not rows
    seq, out = moment.moment(), []
    for table in moment.tables():
        declared = moment.declared(table)
        live = moment._live(table)
        fresh = [e.path for e in live if e.path not in known]
        made = _copy(moment, table, fresh, folder) if fresh else {}
        out.append((seq, table, declared["schema"], declared["part_col"], None, None, None, 0, Decimal(0)))
        for e in live:
            path, rows, digest = made[e.path] if e.path in made else (known[e.path]["path"], known[e.path]["rows"], known[e.path]["digest"])
            out.append((seq, table, None, None, e.part, e.path, path, rows, digest))
    spark.createDataFrame(out, SCHEMA).coalesce(1).write.parquet(f"{folder}/{MANIFEST}")
    return manifest(spark, folder)


def named(spark: SparkSession, folder: str) -> DataFrame:
    """(table, path): the copies that a snapshot leaves to earlier ones."""
    return manifest(spark, folder).filter(F.col("path").isNotNull() & ~F.startswith("path", F.lit(f"{folder}/"))).select("table", "path")


def _totals(spark: SparkSession, folder: str) -> DataFrame:
    return manifest(spark, folder).groupBy("table").agg(F.sum("rows").alias("rows"), F.sum("digest").cast("decimal(38,0)").alias("digest"))


def _tables(spark: SparkSession, folder: str) -> dict[str, tuple[T.StructType, str | None, DataFrame]]:
    """Schema, parts and copied rows of every table of a snapshot."""
    listed = manifest(spark, folder).collect()  # folders, not rows
    found = {}
    for r in listed:
        if r["schema"] is not None:
            schema = T._parse_datatype_json_string(r["schema"])
            paths = [p["path"] for p in listed if p["table"] == r["table"] and p["path"] is not None]
            rows = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
            found[r["table"]] = (schema, r["part_col"], rows)
    return found


def _measured(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for table, rows in tables.items():
        one = rows.agg(*_figures(rows.schema)).select(F.lit(table).alias("table"), "rows", "digest")
        out = one if out is None else out.unionByName(one)
    return spark.createDataFrame([], "table string, rows bigint, digest decimal(38,0)") if out is None else out


def verify(spark: SparkSession, folder: str) -> DataFrame:
    """(table, expected, restored, status) of the copies as they are now; a changed value differs where the counts agree.

    A copy that is gone is an error of the reader.
    """
    return compare(_totals(spark, folder), _measured(spark, {t: rows for t, (_, _, rows) in _tables(spark, folder).items()}))


def restore(spark: SparkSession, folder: str, destination: str) -> DataFrame:
    """A store at a new place with the tables of a snapshot; what was written is compared with the manifest, then published at once.

    Returns the comparison. If something differs, nothing is published and the error names the tables. Each part
    comes back as one folder. A destination that holds rows is refused.
    """
    store = Store(spark, destination)
    if any(store._live(t) for t in store.tables()):
        raise ValueError(f"{destination} is a store with rows")
    tables = _tables(spark, folder)
    for table, (schema, part_col, _) in tables.items():
        store.create_all({table: schema}, part_col)
    entries = [e for table, (_, _, rows) in tables.items() for e in store.append(table, rows)]
    compared = compare(_totals(spark, folder), _measured(spark, {t: store.read(t, pending=entries) for t in tables}))
    wrong = [r["table"] for r in compared.filter("status <> 'ok'").orderBy("table").collect()]
    if wrong:
        raise ValueError(f"restored tables differ from the snapshot: {', '.join(wrong)}")
    store.publish(entries)
    return compared
