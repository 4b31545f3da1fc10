"""Retention on the store: what no process keeps is marked as purged and published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.operators import retention
from siftwell.plans.load import DOCUMENTS, LINKS, current_runs, prepare
from siftwell.plans.store import Store
from siftwell.session import key_join, stage


def uses(store: Store) -> DataFrame:
    """Uses of contents as the links and runs of the store tell them: (load, kind, hash, tag, used_at)."""
    runs = current_runs(store).select(F.col("id").alias("_run"), F.col("carga").alias("load"), F.col("tipo").alias("kind"))
    linked = key_join(store.read(LINKS), runs, [(F.col("run_id"), F.col("_run"))], "inner")
    return linked.select("load", "kind", "hash", "tag", F.col("fecha").alias("used_at"))


def purge_documents(store: Store, policies: dict[str, dict | str], now: Column) -> DataFrame:
    """Mark the available documents nobody keeps as purged, in the parts of the registry that hold them; returns them."""
    prepare(store)
    registry = store.read(DOCUMENTS)
    doomed = stage(retention.purgeable(registry, uses(store), policies, now), "doomed")
    store.publish(store.rewrite(DOCUMENTS, doomed, lambda part: retention.purge(part, doomed, now)))
    return doomed
