"""N-gram Jaccard join: the product of the document by n-gram incidence matrix, in blocks, for the linked pairs only.

Documents with equal sets are one row of the matrix. Its columns are ordered from rare to frequent, so that
two rows can only reach the similarity if they share a column among the first n - ceil(t n) + 1 of each: all
other columns need no product. The order comes from counts over all documents, in a table of fixed size that
maps a column to its count by hash; any table gives right results, a good one few meetings.

Rows that meet in a column are not paired with each other at once. Each is first held against one central row
of the column, which joins most of a group of near copies. Only columns whose rows are still in different
groups are multiplied out in blocks of rows, and there a pair goes on if bounds allow it: the sizes, and the
least difference that two folded parity bitmaps show. What remains is counted exactly.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siftwell.llm.common import WordHasher, Work, components, map_rows, mix, text_column, whole_text

COLUMNS = 1 << 22  # counters of the table of frequencies: 16 MB in each task, whatever the input
PART = 1 << 18
BITMAP = 1024
SPREAD = np.uint64(0xD6E8FEB86659FD93)


def gram_sets(texts: list[str], size: int, hasher: WordHasher) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's runs of `size` words; with fewer words, of all of them as one."""
    with np.errstate(over="ignore"):
        for words, bounds in hasher.texts([t.encode().lower() for t in texts]):
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                n = int(b - a)
                span = min(size, n)
                if not n:
                    yield np.empty(0, np.uint64)
                    continue
                h = np.full(n - span + 1, span, np.uint64)
                for k in range(span):
                    h = mix(h * SPREAD + words[a + k:a + k + n - span + 1])
                yield np.unique(h)


def counter_of(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - COLUMNS.bit_length() + 1)).astype(np.int64)


def bitmap(grams: np.ndarray) -> bytes:
    """The parity of the set's members by bit: two bitmaps differ in at most as many bits as the sets in members."""
    odd = np.bincount((grams & np.uint64(BITMAP - 1)).astype(np.int64), minlength=BITMAP) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def node_of(grams: np.ndarray) -> int | None:
    """The name of a set: 64 bits of a digest of its members; an empty set has none."""
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True) if len(grams) else None


def first_pass(rows: DataFrame, size: int) -> DataFrame:
    """(id, n, node) per document, and per task the counts of its grams in packed parts of the table."""
    schema = StructType([rows.schema["id"], *StructType.fromDDL("n long, node long, part int, counts binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, counts, held, waiting, kind = WordHasher(), np.zeros(COLUMNS, np.uint32), [], 0, None

        def flush() -> None:
            nonlocal counts, held, waiting
            if held:
                counts += np.bincount(counter_of(np.concatenate(held)), minlength=COLUMNS).astype(np.uint32)
            held, waiting = [], 0

        for batch in batches:
            kind = batch.schema.field(0).type
            n, nodes = [], []
            for grams in gram_sets(text_column(batch, "text"), size, hasher):
                n.append(len(grams))
                nodes.append(node_of(grams))
                held.append(grams)
                waiting += len(grams)
                if waiting > COLUMNS:
                    flush()
            empty = [None] * len(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(nodes, pa.int64()), pa.array(empty, pa.int32()), pa.array(empty, pa.binary())], schema.names)
        flush()
        if kind is not None and counts.any():
            parts = range(COLUMNS // PART)
            none = [None] * len(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(none, kind), pa.array(none, pa.int64()), pa.array(none, pa.int64()), pa.array(list(parts), pa.int32()),
                 pa.array([packed(counts[p * PART:(p + 1) * PART]) for p in parts], pa.binary())], schema.names)

    return map_rows(rows, run, schema)


def packed(counts: np.ndarray) -> bytes:
    return zlib.compress(counts.astype(np.uint32).tobytes(), 1)


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), np.uint32)


def frequencies(counted: DataFrame) -> np.ndarray:
    """The tasks' counts added up: within each task that reads some, then per part. The result has a fixed size;
    a sum stops at what 32 bits hold, which leaves the order of the columns a valid one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0), batch.column(1), strict=True):
                part = part.as_py()
                sums[part] = np.minimum(sums.get(part, np.uint64(0)) + unpacked(counts.as_py()).astype(np.uint64), np.uint64(2**32 - 1))
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([packed(s) for s in sums.values()], pa.binary())], ["part", "counts"])

    schema = "part int, counts binary"
    once = map_rows(counted.where("part IS NOT NULL").select("part", "counts"), run, schema)
    table = np.zeros(COLUMNS, np.uint32)
    for row in map_rows(once.repartition("part"), run, schema).collect():
        table[row["part"] * PART:(row["part"] + 1) * PART] = unpacked(row["counts"])
    return table


def needed(n: int, percent: int) -> int:
    """The least overlap that a set of n members needs with any other to be linked."""
    return -(-percent * n // 100)


def second_pass(rows: DataFrame, size: int, percent: int, table: np.ndarray) -> DataFrame:
    """(node, n, grams, bits): the rarest columns of each row, as many as one of a linked row must be among."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            nodes, n, first, bits = [], [], [], []
            for grams in gram_sets(text_column(batch, "text"), size, hasher):
                if len(grams):
                    nodes.append(node_of(grams))
                    n.append(len(grams))
                    order = np.lexsort((grams, table[counter_of(grams)]))[:len(grams) - needed(len(grams), percent) + 1]
                    first.append(grams[order].view(np.int64))
                    bits.append(bitmap(grams))
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.int64()), pa.array(n, pa.int64()), pa.array(first, pa.list_(pa.int64())), pa.array(bits, pa.binary())], ["node", "n", "grams", "bits"])

    return map_rows(rows.select("text"), run, "node long, n long, grams array<long>, bits binary")


def full_sets(rows: DataFrame, size: int) -> DataFrame:
    """(node, grams): all columns of the given rows, as sorted bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            sets = list(gram_sets(text_column(batch, "text"), size, hasher))
            yield pa.RecordBatch.from_arrays([pa.array([node_of(g) for g in sets], pa.int64()), pa.array([g.tobytes() for g in sets], pa.binary())], ["node", "grams"])

    return map_rows(rows.select("text"), run, "node long, grams binary")


def differ_little(bits: np.ndarray, others: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes n and m with these bitmaps can reach the similarity: not if they differ in too many members."""
    least = -(-percent * (n + m) // (100 + percent))
    return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (np.bitwise_count(bits ^ others).sum(axis=-1) <= n + m - 2 * least)


def bitmaps(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), BITMAP // 64)


def possible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and bitmaps allow."""
    one, two = (nodes.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("bits").alias(f"bits_{k}")) for k in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keep = differ_little(bitmaps(batch.column("bits_a")), bitmaps(batch.column("bits_b")), batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy(), percent)
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return map_rows(pairs.join(one, "a").join(two, "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b"), run, "a long, b long")


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose exact similarity reaches the bound."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                common = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * common >= percent * (len(p) + len(q) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return map_rows(both, run, "a long, b long").distinct()


def block_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b) of rows (gram, i, j, side, node, n, component, bits), sorted by block (gram, i, j): every pair of
    different components of a block, one row of side i and one of side j, that sizes and bitmaps allow."""
    def block(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        side, node, n, group = (part.column(c).to_numpy() for c in ("side", "node", "n", "component"))
        bits = bitmaps(part.column("bits"))
        left, right = np.flatnonzero(side <= 0), np.flatnonzero(side >= 0)
        a, b = [], []
        for p in left:
            others = right[right > p] if side[p] == 0 else right  # side 0 marks a block with itself: each pair once
            others = others[group[others] != group[p]]
            found = others[differ_little(bits[others], bits[p], n[others], n[p], percent)]
            a.append(np.full(len(found), node[p]))
            b.append(node[found])
        return np.concatenate(a) if a else node[:0], np.concatenate(b) if b else node[:0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("gram", "i", "j")], axis=1)
            ends = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), batch.num_rows]
            for x, y in zip(ends[:-1], ends[1:], strict=True):
                if held and tuple(keys[x]) != last:
                    yield done(held)
                    held = []
                held, last = [*held, batch.slice(x, y - x)], tuple(keys[x])
        if held:
            yield done(held)

    def done(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b = block(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return map_rows(rows, run, "a long, b long")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4, percent: int = 85, block_rows: int = 1000) -> DataFrame:
    """(key, n_shingles, component_id) per row: linked are documents of which 100 * |intersection| >= percent * |union|.

    A document's set: its distinct runs of `size` words, ASCII letters in lower case; with fewer words all as
    one. component_id is the smallest key reachable by links, its own included. Without words, or with a null
    text, the set is empty and linked with nothing; a null key gives a null component and links with nothing;
    rows of one key are one document with several sets; repeated rows give repeated rows; an empty table gives
    none; other columns are not read. Grams and whole sets are told apart by 64-bit hashes.
    """
    work = Work(docs.sparkSession, "jaccard")
    rows = docs.select(F.col(key).alias("id"), whole_text(text).alias("text"))
    first = work.stage(first_pass(rows, size), "sets")
    table = frequencies(first)
    members = first.where("part IS NULL").select("id", "n", "node")
    # documents with equal sets are one row of the matrix, named by the digest of the set
    columns = work.stage(second_pass(rows, size, percent, table), "columns")
    nodes = work.stage(columns.select("node", "n", "bits").dropDuplicates(["node"]), "nodes")
    met = columns.select("node", F.explode("grams").alias("gram"))
    shared = met.groupBy("gram").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("gram")
    cells = work.stage(met.join(shared, "gram").select("gram", "node").distinct(), "cells")
    work.drop(columns)
    # the row with the fewest columns of its own is the most central of those that meet
    alone = cells.groupBy("node").agg(F.count(F.lit(1)).alias("met")).join(nodes.select("node", "n"), "node").select("node", (F.col("n") - F.col("met")).alias("alone"))
    ranked = cells.join(alone, "node")
    centre = work.stage(ranked.groupBy("gram").agg(F.min(F.struct("alone", "node")).alias("best"), F.count(F.lit(1)).alias("rows")).select(
        "gram", F.col("best.node").alias("centre"), "rows"), "centres")
    star = cells.join(centre, "gram").where("node <> centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
    star = work.stage(possible(star, nodes, percent), "star")
    reps = work.stage(members.where("id IS NOT NULL AND node IS NOT NULL").groupBy("node").agg(F.min("id").alias("id")), "representatives")

    def sets_of(wanted: DataFrame, label: str) -> DataFrame:
        ids = work.stage(reps.join(wanted, "node", "left_semi").select("id").distinct(), "wanted")
        given = rows.join(ids.hint("merge") if label == "star" else ids, "id", "left_semi")
        return work.stage(full_sets(given, size).join(wanted, "node", "left_semi"), f"{label}-sets")

    ends = star.select(F.col("a").alias("node")).unionByName(star.select(F.col("b").alias("node"))).distinct()
    sets = sets_of(ends, "star")
    links = work.stage(linked(star, sets, percent), "links")
    groups = work.stage(components(work, links), "groups")
    # columns whose rows are not all in one group yet; two rows have met already, one of them as the centre
    placed = cells.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    split = placed.groupBy("gram").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("rows")).where(
        "low < high AND rows > 2").select("gram", F.ceil(F.col("rows") / block_rows).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    tiles = placed.join(split, "gram").join(nodes, "node").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.select("gram", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                         F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), -1).otherwise(1).alias("side"), "node", "n", "component", "bits")
    tiles = tiles.repartition("gram", "i", "j").sortWithinPartitions("gram", "i", "j")
    more = block_pairs(tiles, percent).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = work.stage(more.join(star, ["a", "b"], "left_anti"), "more")
    if not more.isEmpty():
        ends = more.select(F.col("a").alias("node")).unionByName(more.select(F.col("b").alias("node"))).distinct()
        lacking = work.stage(ends.join(sets.select("node"), "node", "left_anti"), "lacking")
        if not lacking.isEmpty():
            sets = sets.unionByName(sets_of(lacking, "more"))
        links = work.stage(links.unionByName(linked(more, sets, percent)), "links")
        groups = work.stage(components(work, links), "groups")
    # rows of one key are one document: their sets are joined, too
    several = members.where("id IS NOT NULL AND node IS NOT NULL").groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("far")).where("a < far").select("id", "a")
    same = work.stage(members.where("node IS NOT NULL").join(several, "id").select("a", F.col("node").alias("b")).distinct(), "same")
    if not same.isEmpty():
        groups = components(work, links.unionByName(same))
    of_node = reps.join(groups, "node", "left").select("node", "id", F.coalesce("component", "node").alias("component"))
    smallest = of_node.groupBy("component").agg(F.min("id").alias("component_id"))
    labelled = work.stage(of_node.join(smallest, "component").select("node", "component_id"), "labelled")
    out = members.join(labelled, "node", "left")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
