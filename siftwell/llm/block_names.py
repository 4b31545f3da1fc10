"""Exact dedup by deterministic block naming: equal texts, and only they, end with the same integer name.

Each normalised text is cut into blocks of a fixed number of bytes. The distinct blocks are sorted and named by their
places, 0, 1, 2, ... Then the names of adjacent blocks are paired; the distinct pairs are sorted and named by their
places in turn, until each document has one name. By induction a name of level k stands for one sequence of up to
2**k blocks and no other (a last block without a neighbour is paired with -1), so (level, name) is an identity
without collisions. There are as many levels as the longest text has doublings, each with half the rows.

Only DataFrame expressions. Blocks and pairs are made distinct before they are sorted, with a partial aggregation
before the shuffle, so a block of a third of all rows is one row per task. Distinct blocks are told apart by their
whole content; two 64-bit hashes then stand for each, in the sort behind its first bytes and on the way from an
occurrence back to its name. That no two distinct blocks share them is checked, and with another seed they are taken
anew if it does not hold, so no name rests on a hash alone.
"""

from __future__ import annotations

import string
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftwell.llm.common import Work, whole_text

HEAD = 16  # bytes by which blocks are sorted first: what is sampled and sorted stays short
ROW = (1 << 33) - 1  # the lower bits of monotonically_increasing_id: a row's place in its partition


def folded(text: str | Column) -> Column:
    """The text with A-Z lower-cased and nothing else; null as empty."""
    whole = whole_text(text)
    return F.when(F.octet_length(whole) == F.char_length(whole), F.lower(whole)).otherwise(
        F.translate(whole, string.ascii_uppercase, string.ascii_lowercase))


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """One row per block of the binary column `raw`, with its place and the number of blocks; an empty one has one empty block."""
    number = F.greatest(F.ceil(F.octet_length("raw") / size), F.lit(1)).cast("int")
    cut = rows.withColumn("n", number).withColumn("pos", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return cut.withColumn("block", F.substring("raw", F.col("pos") * size + 1, F.lit(size))).drop("raw")


def marks(seed: int) -> list[Column]:
    return [F.xxhash64(F.lit(2 * seed), "block").alias("h"), F.xxhash64(F.lit(2 * seed + 1), "block").alias("g")]


def ranked(work: Work, distinct: DataFrame, by: list[str], *keep: Column | str) -> DataFrame:
    """The distinct rows in the order of `by`, with `name`: their places from 0 on.

    Sorted by ranges, so no task sees them all; a row's place is its place within its range and the sizes of the
    ranges before, which are one short row per task.
    """
    placed = work.stage(distinct.orderBy(*by).select(
        *keep, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit(ROW)).alias("row")), "ranked")
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    return placed.join(F.broadcast(before), "part").withColumn("name", F.col("before") + F.col("row")).drop("part", "row", "before")


def first_names(work: Work, docs: DataFrame, key: str, text: str, size: int) -> tuple[DataFrame, DataFrame]:
    """(uid, key, raw_hash, sha256) per row, and (uid, n, pos, name) per block of a row."""
    for seed in count():
        rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(key).alias("key"), F.xxhash64(whole_text(text)).alias("raw_hash"),
                           folded(text).cast("binary").alias("raw"))
        whole = rows.withColumn("sha256", F.sha2("raw", 256))
        head = [F.when(F.col("pos") == 0, F.col(c)).alias(c) for c in ("key", "raw_hash", "sha256")]
        placed = work.stage(blocks(whole, size).select("uid", "n", "pos", *head, *marks(seed)), "blocks")
        distinct = blocks(docs.select(folded(text).cast("binary").alias("raw")), size).select("block").distinct()
        names = ranked(work, distinct.select(F.substring("block", 1, HEAD).alias("head"), *marks(seed)), ["head", "h", "g"], "h", "g")
        if names.groupBy("h", "g").count().where("count > 1").isEmpty():
            break
        work.drop(placed)
    return placed.where("pos = 0").select("uid", "key", "raw_hash", "sha256"), work.stage(
        placed.select("uid", "n", "pos", "h", "g").join(names, ["h", "g"]).select("uid", "n", "pos", "name"), "named")


def identities(work: Work, docs: DataFrame, key: str, text: str, size: int) -> tuple[DataFrame, DataFrame]:
    """(uid, key, raw_hash, sha256) and (uid, level, name) per row."""
    rows, named = first_names(work, docs, key, text, size)
    done = named.where("n = 1").select("uid", F.lit(0).alias("level"), "name")
    for level in count(1):
        left = named.where("n > 1")
        if left.isEmpty():
            return rows, done
        side = [F.max(F.when(F.col("pos") % 2 == k, F.col("name"))) for k in (0, 1)]
        pairs = work.stage(
            left.groupBy("uid", F.shiftright("pos", 1).alias("pos"), F.ceil(F.col("n") / 2).cast("int").alias("n"))
            .agg(side[0].alias("a"), F.coalesce(side[1], F.lit(-1)).alias("b")), "pairs")
        names = ranked(work, pairs.select("a", "b").distinct(), ["a", "b"], "a", "b")
        named = work.stage(pairs.join(names, ["a", "b"]).select("uid", "n", "pos", "name"), "named")
        done = done.unionByName(named.where("n = 1").select("uid", F.lit(level).alias("level"), "name"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 2048) -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256, level, name), one row per given row, dropped ones too.

    Texts are equal when they are identical after lower-casing A-Z; the row with the largest key stays. Of rows that
    share that key exactly one stays (the one of the larger text hash, then of the later place), so `kept` is true
    once a group. Null and empty texts are equal; a null key is smaller than any other; texts of any length are cut
    whole; an empty table gives none; other columns are not read, whatever their names.
    """
    work = Work(docs.sparkSession, "names")
    rows, done = identities(work, docs, key, text, size)
    told = work.stage(rows.join(done, "uid"), "identities")
    own = F.struct("key", "raw_hash", "uid")
    groups = told.groupBy("level", "name").agg(F.max(own).alias("stays"), F.count(F.lit(1)).alias("group_size"))
    out = told.join(groups, ["level", "name"]).select(
        F.col("key").alias(key), F.col("stays.key").alias("keep_id"), "group_size", (F.col("uid") == F.col("stays.uid")).alias("kept"),
        F.col("sha256").alias("text_sha256"), "level", "name")
    return work.last(out, "result")
