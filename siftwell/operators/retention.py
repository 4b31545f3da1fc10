"""What is worth keeping: documents per process, and snapshots by day, week and month."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.operators.documents import AVAILABLE, PURGED
from siftwell.session import stage

ALWAYS = "siempre"


def process_of(load: Column, kind: Column) -> Column:
    """A load is its own process; a command 'table.verb' belongs to its table."""
    return F.when(kind == "carga", load).otherwise(F.split_part(load, F.lit("."), F.lit(1)))


def last_uses(uses: DataFrame, policies: dict[str, dict | str]) -> DataFrame:
    """(process, hash, last, exempt): last use and whether any use carries an exempt tag.

    `uses` (load, kind, hash, tag, used_at). Maxima and booleans only, hence summed before the
    shuffle and no set of tags is gathered.
    """
    process = process_of(F.col("load"), F.col("kind"))
    exempt = F.lit(False)
    for name, policy in policies.items():
        tags = policy.get("tags_exentos", []) if isinstance(policy, dict) else []
        if tags:
            exempt = exempt | ((process == name) & F.col("tag").isin(tags))
    return uses.groupBy(process.alias("process"), "hash").agg(
        F.max("used_at").alias("last"), F.bool_or(exempt).alias("exempt"))


def kept_per_process(uses: DataFrame, policies: dict[str, dict | str], now: Column) -> DataFrame:
    """(process, hash) pairs some policy keeps; a process without a policy keeps everything.

    The last uses are written once, for every policy reads them.
    Policies are {"tipo": "ficheros" | "anios", "cantidad": n, "tags_exentos"?: [...]}.
    """
    last = stage(last_uses(uses, policies), "uses")
    limited = {n: p for n, p in policies.items() if isinstance(p, dict)}
    kept = [last.filter(~F.col("process").isin(list(limited)) | F.col("exempt"))] if limited else [last]
    for name, policy in limited.items():
        own = last.filter(F.col("process") == name)
        if policy["tipo"] == "ficheros":
            # A literal top-n: each input task sends at most n rows.
            kept.append(own.orderBy(F.col("last").desc(), "hash").limit(policy["cantidad"]))
        else:
            kept.append(own.filter(F.col("last") >= years_before(now, policy["cantidad"])))
    return reduce(DataFrame.unionByName, kept).select("process", "hash").distinct()


def years_before(moment: Column, years: int) -> Column:
    """Same day and time some years earlier; 29 February becomes 28 February."""
    day = F.add_months(moment.cast("date"), -12 * years).cast("timestamp_ntz")
    start = F.date_trunc("day", moment).cast("timestamp_ntz")
    return day + (moment - start)


def kept_documents(uses: DataFrame, policies: dict, now: Column) -> DataFrame:
    """Hashes that any process keeps."""
    return kept_per_process(uses, policies, now).select("hash").distinct()


def purgeable(documents: DataFrame, uses: DataFrame, policies: dict, now: Column) -> DataFrame:
    """Available documents nobody keeps, largest first."""
    keep = kept_documents(uses, policies, now)
    return documents.filter(F.col("status") == AVAILABLE).join(keep, "hash", "left_anti").orderBy(F.col("bytes").desc(), "hash")


def purge(documents: DataFrame, doomed: DataFrame, now: Column) -> DataFrame:
    """Registry after a purge: the rows stay, their state changes."""
    gone = doomed.select(F.col("hash").alias("_gone")).distinct()
    marked = documents.join(gone, F.col("hash") == F.col("_gone"), "left")
    hit = F.col("_gone").isNotNull()
    return marked.withColumn("status", F.when(hit, PURGED).otherwise(F.col("status"))).withColumn(
        "purged_at", F.when(hit, now).otherwise(F.col("purged_at"))).drop("_gone")


def _week(moment: Column) -> Column:
    """Monday of the ISO week, which names the week across year ends."""
    return F.date_trunc("week", moment)


def kept_snapshots(
    snapshots: DataFrame, daily: int, weekly: int, monthly: int,
    entity: str = "entity", taken_at: str = "taken_at", name: str = "name",
) -> DataFrame:
    """(entity, name): the newest of each of the last days, weeks and months with snapshots.

    Reduced to one row per entity and day by a map-side maximum first. The newest of a week or
    month is the newest of its days, so the later steps see days however many snapshots there are.
    """
    newest = F.max(F.struct(F.col(taken_at).alias("at"), F.col(name).alias("name"))).alias("newest")
    days = stage(snapshots.groupBy(F.col(entity).alias("entity"), F.date_trunc("day", F.col(taken_at)).alias("bucket")).agg(newest), "days")

    def regroup(bucket: Column) -> DataFrame:
        return days.groupBy("entity", bucket.alias("bucket")).agg(F.max("newest").alias("newest"))

    branches = [(days, daily), (regroup(_week(F.col("bucket"))), weekly), (regroup(F.date_trunc("month", F.col("bucket"))), monthly)]
    recent = Window.partitionBy("entity").orderBy(F.col("bucket").desc())
    kept = [
        buckets.withColumn("_rn", F.row_number().over(recent)).filter(F.col("_rn") <= n).select("entity", "newest.name")
        for buckets, n in branches if n > 0]
    if not kept:
        return days.select("entity", "newest.name").limit(0)
    return reduce(DataFrame.unionByName, kept).distinct()
