"""Keyed changes: rows that update, insert or delete by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.session import key_join

# What an action may do with the rows of its SELECT besides appending and overwriting.
UPDATE, DELETE, MERGE = "actualizar", "borrar", "fusionar"
KEYED = (UPDATE, DELETE, MERGE)


class SeveralSources(ValueError):
    """Two source rows for one target row: which of them should win is not said."""


def check_sources(target: DataFrame, source: DataFrame, keys: list[str]) -> None:
    """Refuse a source with several rows for a key the target holds, or would hold twice after an insert.

    NULL keys equal each other. The keys are counted before they meet anything, so a key of a third of the rows is one row per task.
    """
    twice = source.groupBy(*keys).count().filter("count > 1").limit(1).collect()
    if twice:
        raise SeveralSources("several rows for " + ", ".join(f"{k} = {twice[0][k]!r}" for k in keys))


def merge_rows(target: DataFrame, source: DataFrame, keys: list[str], mode: str = MERGE) -> DataFrame:
    """The target after the source's rows: matched rows updated (`actualizar`), too, others inserted (`fusionar`), or matched rows
    deleted (`borrar`).

    An update sets the source's other columns and leaves those it lacks; columns the target lacks are dropped, an
    insert's missing ones are NULL. Repeated target rows of a key are all changed. NULL keys equal each other.
    The same change twice gives the same rows. `check_sources` tells whether it is well defined.
    """
    if mode not in KEYED:
        raise ValueError(f"not a keyed change: {mode} (one of {', '.join(KEYED)})")
    missing = [k for k in keys if k not in source.columns or k not in target.columns]
    if missing or not keys:
        raise ValueError(f"keys of both sides are needed: {', '.join(missing) or 'none given'}")
    kinds = {f.name: f.dataType for f in target.schema}
    named = source.select(*[F.col(c).cast(kinds[c]).alias(f"_s_{c}") for c in source.columns if c in kinds], F.lit(True).alias("_met"))
    pairs = [(F.col(k), F.col(f"_s_{k}")) for k in keys]
    if mode == DELETE:
        return key_join(target, named.select(*[f"_s_{k}" for k in keys]).distinct(), pairs, "left_anti", null_safe=True)
    how = "full" if mode == MERGE else "left"
    both = key_join(target.withColumn("_held", F.lit(True)), named, pairs, how, null_safe=True)
    return both.select(*[
        (F.when(F.col("_met"), F.col(f"_s_{c}")).otherwise(F.col(c)) if f"_s_{c}" in named.columns else F.col(c)).alias(c) for c in target.columns])
