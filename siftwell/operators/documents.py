"""Documents addressed by content and their links to runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.session import key_join

AVAILABLE, PURGED = "disponible", "purgado"
ORIGIN_TAG = "crear"


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def not_loaded(files: DataFrame, runs: DataFrame) -> DataFrame:
    """Files whose (load, hash) has no successful run yet."""
    done = runs.filter(F.col("status") == "OK").select(F.col("load").alias("_load"), F.col("hash").alias("_hash")).distinct()
    return key_join(files, done, [(F.col("load"), F.col("_load")), (F.col("hash"), F.col("_hash"))], "left_anti")


def first_of_content(files: DataFrame) -> DataFrame:
    """Of files of one load with equal content the first, in order of the other columns."""
    others = [c for c in files.columns if c not in ("load", "hash")]
    first = files.groupBy("load", "hash").agg(F.min(F.struct(*others)).alias("_first"))
    return first.select(*[F.col(c) if c not in others else F.col(f"_first.{c}").alias(c) for c in files.columns])


def register(registry: DataFrame, incoming: DataFrame) -> DataFrame:
    """Registry after archiving: new content enters, purged content becomes available again.

    `registry` (hash, name, bytes, status, purged_at); `incoming` (hash, name, bytes), where one
    content may come many times under many names: made one row per hash before it is joined.
    """
    arrivals = incoming.groupBy("hash").agg(F.min(F.struct("name", "bytes")).alias("a"))
    known = registry.withColumn("_known", F.lit(True))
    both = known.join(arrivals, "hash", "full")
    arrived = F.col("a").isNotNull()
    return both.select(
        "hash",
        F.coalesce(F.col("name"), F.col("a.name")).alias("name"),
        F.coalesce(F.col("bytes"), F.col("a.bytes")).alias("bytes"),
        F.when(arrived, AVAILABLE).otherwise(F.col("status")).alias("status"),
        F.when(~arrived, F.col("purged_at")).alias("purged_at"))


def link_once(links: DataFrame, incoming: DataFrame) -> DataFrame:
    """Links after adding those whose (run, hash, tag) is not there yet."""
    keys = ["run_id", "hash", "tag"]
    fresh = incoming.select(*keys).distinct().join(links.select(*keys), keys, "left_anti")
    return links.unionByName(fresh, allowMissingColumns=True)


def listing(documents: DataFrame, links: DataFrame) -> DataFrame:
    """Documents with their number of links and their tags.

    Links are counted per (hash, tag) before the hash meets, so a document linked a billion times
    sends one row per tag.
    """
    per_tag = links.groupBy("hash", "tag").agg(F.count("*").alias("n"))
    per_hash = per_tag.groupBy("hash").agg(
        F.sum("n").alias("links"), F.array_join(F.array_sort(F.collect_list("tag")), ", ").alias("tags"))
    return documents.join(per_hash, "hash", "left").withColumn("links", F.coalesce("links", F.lit(0)))


def of_run(links: DataFrame, documents: DataFrame, run_id: int | None = None) -> DataFrame:
    """Documents of one run, or of every run."""
    wanted = links if run_id is None else links.filter(F.col("run_id") == run_id)
    side = documents.withColumnRenamed("hash", "_hash")
    return key_join(wanted, side, [(F.col("hash"), F.col("_hash"))], "inner").drop("_hash")


def of_rows(rows: DataFrame, runs: DataFrame, links: DataFrame, documents: DataFrame) -> DataFrame:
    """Every document in the life of each row: its creating run and the runs chained to it.

    `rows` (row_id, run_id), the rows asked for. Only their chains are followed; the documents of a chain are
    put together first and the rows come last, since one load may have created a third of all rows.
    """
    asked = rows.select(F.col("run_id").alias("_asked")).distinct()
    chain = key_join(runs.select(
        F.coalesce("principal", "run_id").alias("_principal"), F.col("run_id").alias("link_run"), F.col("operation")),
        asked, [(F.col("_principal"), F.col("_asked"))], "left_semi")
    used = links.select(F.col("run_id").alias("_link_run"), "hash", "tag")
    linked = chain.join(used, F.col("link_run") == F.col("_link_run")).drop("_link_run")
    files = key_join(linked, documents.withColumnRenamed("hash", "_hash"), [(F.col("hash"), F.col("_hash"))], "inner").drop("_hash")
    return key_join(rows, files, [(F.col("run_id"), F.col("_principal"))], "inner").drop("_principal")


def attach_requests(requests: DataFrame, rows: DataFrame) -> DataFrame:
    """Requests to add a document to a row, checked: ok, no such row, or a row without a run.

    `requests` (row_id, hash, tag); `rows` (row_id, run_id). The principal is the run to chain to.
    """
    side = rows.select(F.col("row_id").alias("_row"), F.col("run_id").alias("principal"))
    joined = key_join(requests, side, [(F.col("row_id"), F.col("_row"))])
    status = F.when(F.col("_row").isNull(), "missing_row").when(F.col("principal").isNull(), "no_run").otherwise("ok")
    return joined.select(
        "row_id", "hash", F.coalesce("tag", F.lit(ORIGIN_TAG)).alias("tag"), "principal", status.alias("status"))


def mirror_plan(source: DataFrame, destination: DataFrame) -> DataFrame:
    """Contents absent at the destination, by hash."""
    return source.join(destination.select("hash").distinct(), "hash", "left_anti")


def mirror_counts(source: DataFrame, destination: DataFrame) -> DataFrame:
    """(copied, present, bytes) of an incremental mirror."""
    there = destination.select(F.col("hash").alias("_there")).distinct()
    flagged = source.join(there, F.col("hash") == F.col("_there"), "left")
    absent = F.col("_there").isNull()
    return flagged.agg(
        F.count_if(absent).alias("copied"), F.count_if(~absent).alias("present"),
        F.coalesce(F.sum(F.when(absent, F.col("bytes"))), F.lit(0)).alias("bytes"))
