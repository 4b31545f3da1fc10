"""Ranked lexical search: one Aho-Corasick automaton of all item terms counts their occurrences in the texts themselves.

Every term is guarded by a boundary on both sides, and the texts are brought to lower-case terms parted by one
space, so the automaton reports whole terms only. Its output is the number of a term, which maps to the items that
ask for it. No index of the documents is made: a first scan leaves each document's number of terms and the counts
of the asked ones, which gives the statistics of the corpus; then every task scores its documents against the items
that share a term with them, and keeps the best of each item.

The items are the stated query set. They are taken in blocks of at most `block_bytes` of text, so that what goes to
the tasks (terms, weights, the items of each term) has a bound; each block is a search of its own over all documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from siftwell.llm.common import Work, map_rows, text_column, whole_text

# digits, a-z and every byte of a character beyond ASCII are kept, A-Z lower-cased, all else parts terms
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
CELLS = 1 << 20  # documents times items that are scored at once
UNIT = 1_000_000_000


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(PLAIN).split()


@dataclass
class Asked:
    """The terms of one block of items, and for each term the items that ask for it (from `first[t]` to `first[t + 1]`)."""

    ids: pa.Array
    terms: list[bytes]
    first: np.ndarray
    items: np.ndarray
    most: int  # terms of the longest item
    weights: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_automaton"}

    def automaton(self) -> ahocorasick.Automaton:
        if "_automaton" not in self.__dict__:
            made = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for number, term in enumerate(self.terms):
                made.add_word(f" {term.decode('latin-1')} ", number)
            if self.terms:
                made.make_automaton()
            self._automaton = made
        return self._automaton

    def count(self, text: str) -> tuple[int, Counter]:
        """(terms of the text with repeats, occurrences by number of the asked ones)."""
        words = terms_of(text)
        if not words or not self.terms:
            return len(words), Counter()
        line = (b" " + b" ".join(words) + b" ").decode("latin-1")
        return len(words), Counter(number for _, number in self.automaton().iter(line))

    def scores(self, n: np.ndarray, rows: np.ndarray, terms: np.ndarray, tf: np.ndarray, documents: int, total: int) -> np.ndarray:
        """Scores of len(n) documents (rows) by item (columns); one entry of rows, terms and tf per asked term of a document."""
        if len(n) and 90 * int(n.max()) * documents < 1 << 63:
            m = 10 + (90 * n * documents) // total
        else:  # beyond 64 bits on the way, not in the result
            m = np.array([10 + (90 * int(x) * documents) // total for x in n], np.int64)
        part = self.weights[terms] * ((UNIT * tf) // (1000 * tf + 8 * m[rows]))
        width = self.first[terms + 1] - self.first[terms]
        ends = np.cumsum(width)
        place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - width, width) + np.repeat(self.first[terms], width)
        cell = np.repeat(rows, width) * len(self.ids) + self.items[place]
        size = len(n) * len(self.ids)
        if self.most * int(self.weights.max(initial=0)) * (UNIT // 1000) < 1 << 53:  # sums of integers that doubles hold exactly
            found = np.bincount(cell, weights=np.repeat(part, width), minlength=size).astype(np.int64)
        else:
            found = np.zeros(size, np.int64)
            np.add.at(found, cell, np.repeat(part, width))
        return found.reshape(len(n), len(self.ids))


def asked(rows: pa.Table) -> Asked:
    """The items of a block: rows of one id (null is one, too) are one item with the terms of all its texts."""
    own: dict = {}
    for key, text in zip(rows.column("item").to_pylist(), rows.column("text").to_pylist(), strict=True):
        own.setdefault(key, set()).update(terms_of(text))
    terms = sorted(set().union(*own.values()))
    number = {t: i for i, t in enumerate(terms)}
    by_term: list[list[int]] = [[] for _ in terms]
    for place, words in enumerate(own.values()):
        for word in words:
            by_term[number[word]].append(place)
    first = np.concatenate([[0], np.cumsum([len(x) for x in by_term], dtype=np.int64)]).astype(np.int64)
    items = np.array([i for x in by_term for i in sorted(x)], np.int64)
    return Asked(pa.array(list(own), rows.schema.field("item").type), terms, first, items, max(map(len, own.values()), default=0))


def item_blocks(benchmark: DataFrame, item: str, text: str, limit: int) -> Iterator[Asked]:
    """The items dealt by the hash of their ids into blocks of about `limit` bytes; the driver holds one at a time."""
    given = benchmark.select(F.col(item).alias("item"), whole_text(text).alias("text")).distinct()
    size = given.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()[0]
    number = max(1, -(-size // limit))
    for block in range(number):
        yield asked(given.where(F.pmod(F.xxhash64("item"), F.lit(number)) == block).orderBy("item", "text").toArrow())


def counted(docs: DataFrame, block: Asked) -> DataFrame:
    """(id, n, terms, tf) of each row of (id, text)."""
    schema = StructType([docs.schema["id"], *StructType.fromDDL("n long, terms array<int>, tf array<int>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [block.count(t) for t in text_column(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([list(c) for _, c in found], pa.list_(pa.int32())),
                 pa.array([list(c.values()) for _, c in found], pa.list_(pa.int32()))], schema.names)

    return map_rows(docs, run, schema)


def best_of(table: pa.Table, top: int) -> pa.Table:
    """The first `top` rows of each item: highest score, then smallest id, null before any other."""
    order = pc.sort_indices(table, sort_keys=[("item", "ascending"), ("score", "descending"), ("id", "ascending")], null_placement="at_start")
    table = table.take(order)
    item = table.column("item").to_numpy()
    place = np.arange(len(item)) - np.searchsorted(item, item)
    return table.filter(pa.array(place < top))


def best(counts: DataFrame, block: Asked, documents: int, total: int, top: int) -> DataFrame:
    """(item_id, id, score): of each task's documents the best of each item, never more than `top` of one."""
    made = StructType.fromDDL("item long, score long")
    schema = StructType([made["item"], counts.schema["id"], made["score"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, least = None, np.ones(len(block.ids), np.int64)
        rows_at_once = max(1, CELLS // max(1, len(block.ids)))
        for batch in batches:
            for at in range(0, batch.num_rows, rows_at_once):
                some = batch.slice(at, rows_at_once)
                terms, tf = some.column(2), some.column(3).flatten().to_numpy().astype(np.int64)
                rows = np.repeat(np.arange(len(some)), pc.list_value_length(terms).to_numpy())
                scores = block.scores(some.column(1).to_numpy(), rows, terms.flatten().to_numpy().astype(np.int64), tf, documents, total)
                bound = least if len(scores) <= top else np.maximum(least, np.partition(scores, len(scores) - top, axis=0)[len(scores) - top])
                row, item = np.nonzero(scores >= bound)
                if not len(row):
                    continue
                new = pa.table([pa.array(item, pa.int64()), some.column(0).take(pa.array(row)), pa.array(scores[row, item], pa.int64())], schema.names)
                held = best_of(pa.concat_tables([held, new]) if held else new, top)
                item, score = held.column("item").to_numpy(), held.column("score").to_numpy()
                full = np.flatnonzero(np.bincount(item, minlength=len(block.ids)) == top)
                least[full] = score[np.searchsorted(item, full, side="right") - 1]
        if held:
            yield from held.combine_chunks().to_batches()

    return map_rows(counts, run, schema)


def search(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
           top: int = 10, block_bytes: int = 1 << 20) -> DataFrame:
    """(item, rank, key, score): the `top` highest-scoring documents of each item with a score above 0, all if fewer.

    Equal scores come by ascending key, null first. Every row of docs is a document of its own, repeated ones too;
    null and empty texts have no terms and are found by none. Rows of one item id, null included, are one item with
    the terms of all its texts; an item without terms finds none. Texts of any length are scanned whole. An empty
    table on either side gives none. Other columns are not read, whatever their names.
    """
    work = Work(docs.sparkSession, "terms")
    rows = docs.select(F.col(key).alias("id"), whole_text(text).alias("text"))
    found = []
    for block in item_blocks(benchmark, item, item_text, block_bytes):
        counts = work.stage(counted(rows, block), "counts")
        documents, total = counts.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).head()
        held = dict(counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect())  # a number per asked term of a block
        block.weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * held.get(t, 0) + 1))) for t in range(len(block.terms))], np.int64)
        ids = docs.sparkSession.createDataFrame(pa.table({"item": pa.array(range(len(block.ids)), pa.int64()), "__item": block.ids}))
        found.append(best(counts, block, documents, max(total, 1), top).join(F.broadcast(ids), "item").select(F.col("__item").alias(item), "id", "score"))
    union = found[0]
    for part in found[1:]:
        union = union.unionByName(part)
    order = Window.partitionBy(item).orderBy(F.desc("score"), F.asc("id"))
    return union.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(item, "rank", F.col("id").alias(key), "score")
