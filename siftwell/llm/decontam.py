"""Benchmark decontamination: one Aho-Corasick automaton over all windows of the benchmark's words.

Texts are normalised to lower-case words parted by one space, scanned once, and every hit is mapped back to
its place in the original text. The benchmark is the stated query set: it is read in blocks of bounded size,
each an automaton of its own, and the documents pass one after the other through them. A few blocks make one
plan; the documents and their hits are written before the next few, so that no plan holds the whole benchmark.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siftwell.llm.common import Work, map_rows, text_column, whole_text

# [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z: digits, letters and every byte of a character beyond ASCII
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
CHAIN = 4  # blocks, each a Python step, in one plan
FOUND = "__n long, __hits array<struct<first:long,last:long>>, __items array<string>, __spans array<struct<start:long,`end`:long>>"


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(NORMAL).split()


@dataclass
class Windows:
    """The windows of one block of items: `size` consecutive words, or a whole item of fewer."""

    items: list[tuple[str, str]]
    size: int

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_automaton"}

    def automaton(self) -> ahocorasick.Automaton:
        if "_automaton" not in self.__dict__:
            windows: dict[str, tuple[int, set[int]]] = {}
            for number, (_, text) in enumerate(self.items):
                words = words_of(text)
                span = min(self.size, len(words))
                for i in range(len(words) - span + 1 if words else 0):
                    key = (b" " + b" ".join(words[i:i + span]) + b" ").decode("latin-1")
                    windows.setdefault(key, (span, set()))[1].add(number)
            made = ahocorasick.Automaton()
            for key, value in windows.items():
                made.add_word(key, value)
            if windows:
                made.make_automaton()
            self._automaton = made
        return self._automaton

    def scan(self, text: str) -> tuple[int, list[tuple[int, int]], set[str]]:
        """(words, [first and last word of each merged run of hits], items with an occurring window)."""
        words = words_of(text)
        if not words or not len(self.automaton()):
            return len(words), [], set()
        line = b" " + b" ".join(words) + b" "
        found = [(end, span, items) for end, (span, items) in self.automaton().iter(line.decode("latin-1"))]
        if not found:
            return len(words), [], set()
        spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        last = np.searchsorted(spaces, [end for end, _, _ in found]) - 1
        runs = merged([(int(b) - span + 1, int(b)) for b, (_, span, _) in zip(last, found, strict=True)])
        return len(words), runs, {self.items[i][0] for _, _, items in found for i in items}


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint runs in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def original(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs of words as (start, end) code points of the text as it was given."""
    raw = text.encode()
    inside = np.frombuffer(raw.translate(NORMAL), np.uint8) != 32
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    point = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return [(int(point[start[a]]), int(point[end[b]])) for a, b in runs]


def blocks(benchmark: DataFrame, item: str, text: str, limit: int) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of about `limit` bytes of text; the driver reads one at a time, and holds those of a plan until it is written."""
    given = benchmark.select(F.col(item).cast("string").alias("item"), whole_text(text).alias("text")).where("item IS NOT NULL").distinct()
    total = given.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()[0]
    count = max(1, -(-total // limit))
    for block in range(count):
        yield [tuple(r) for r in given.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == block).orderBy("item", "text").collect()]


def scan(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", size: int = 13,
    words_per_hit: int = 20, block_bytes: int = 1 << 18,
) -> DataFrame:
    """All columns of the documents and n_words, n_hit, items (ids as strings, sorted), spans, contaminated.

    A word inside any occurrence of a window is hit; spans are the hit runs as (start, end) code points of the
    original text; contaminated: a word is hit and there are at most `words_per_hit` words for each that is. Null and empty
    texts have no words and are not contaminated; items without words and null item ids are not looked for;
    equal item ids are one item; repeated documents are judged alike; an empty table gives none, an empty
    benchmark no hit. Given columns of the new names are replaced, other columns are kept whatever their names, but
    for names that begin with two underscores. A text of any length is scanned whole, in one task's memory.
    """
    new = ("n_words", "n_hit", "items", "spans", "contaminated")
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in new], whole_text(text).alias("__whole"))
    kept = rows.columns
    rows = rows.selectExpr("*", "CAST(0 AS bigint) AS __n", "CAST(array() AS array<struct<first:bigint,last:bigint>>) AS __hits", "CAST(array() AS array<string>) AS __items")
    schema = StructType(rows.schema.fields[:-3] + StructType.fromDDL(FOUND).fields)
    runs_of = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
    work = held = None
    for number, block in enumerate(blocks(benchmark, item, item_text, block_bytes)):
        if number and number % CHAIN == 0:
            work = work or Work(docs.sparkSession, "decontam")
            rows, before_it = work.stage(rows, "hits"), held
            held = rows
            if before_it is not None:
                work.drop(before_it)
        windows = Windows(block, size)

        def run(batches: Iterator[pa.RecordBatch], windows: Windows = windows) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n, hits, items, spans = [], [], [], []
                for whole, before, named in zip(text_column(batch, "__whole"), batch.column("__hits").to_pylist(), batch.column("__items").to_pylist(), strict=True):
                    words, found, held = windows.scan(whole)
                    found = merged(found + [(h["first"], h["last"]) for h in before])
                    n.append(words)
                    hits.append([{"first": a, "last": b} for a, b in found])
                    items.append(sorted(held.union(named)))
                    spans.append([{"start": a, "end": b} for a, b in original(whole, found)] if found else [])
                columns = [pa.array(n, pa.int64()), pa.array(hits, runs_of), pa.array(items, pa.list_(pa.string())),
                           pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:len(schema) - 4], *columns], schema.names)

        rows = map_rows(rows, run, schema)
    hit = F.aggregate("__hits", F.lit(0).cast("long"), lambda n, h: n + h["last"] - h["first"] + 1)
    placed = rows.withColumn("__hit", hit)
    spans = F.col("__spans") if "__spans" in rows.columns else F.array().cast("array<struct<start:bigint,`end`:bigint>>")
    return placed.select(
        *[F.col(f"`{c}`") for c in kept if c != "__whole"], F.col("__n").alias("n_words"), F.col("__hit").alias("n_hit"), F.col("__items").alias("items"),
        spans.alias("spans"), ((F.col("__hit") > 0) & (F.col("__hit") * words_per_hit >= F.col("__n"))).alias("contaminated"))
