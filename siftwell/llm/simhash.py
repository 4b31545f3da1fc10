"""SimHash fingerprints and the search of all fingerprints within a Hamming radius.

Every distinct word of a text votes with the weight 1 + ln(its count) on each bit of the fingerprint, for or
against as the bits of its hash say. Fingerprints are hexadecimal strings of 128 bits. The search cuts them
into eight blocks and keeps one table per choice of two. Two fingerprints within 12 bits meet in at least one
table after a bit or none is changed in each of its blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from siftwell.llm.common import WordHasher, Work, map_rows, mix, text_column, whole_text

BITS = 128
SALT = np.uint64(0x632BE59BD9B4E019)
ROWS = 1 << 13  # words whose bits are spread out at once


def votes(words: np.ndarray) -> np.ndarray:
    """The fingerprint of a text's word hashes, as bits. Without words all bits are 0, and so is a bit with a tie."""
    unique, count = np.unique(words, return_counts=True)
    weight = (1 + np.log(count)).astype(np.float64)
    total = np.zeros(BITS)
    for at in range(0, len(unique), ROWS):
        first = unique[at:at + ROWS]
        spread = np.stack([first, mix(first ^ SALT)], axis=1)
        bits = np.unpackbits(spread.view(np.uint8).reshape(len(first), BITS // 8), axis=1)
        w = weight[at:at + ROWS]
        total += 2 * (w @ bits) - w.sum()
    return total > 0


def fingerprints(texts: list[str], hasher: WordHasher) -> list[np.ndarray]:
    out = []
    with np.errstate(over="ignore"):
        for words, bounds in hasher.texts([t.encode().lower() for t in texts]):
            out += [votes(words[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return out


def hexed(bits: np.ndarray) -> str:
    return np.packbits(bits).tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of bits that agree."""
    return float((a == b).mean())


def fingerprint(docs: DataFrame, text: str = "text", column: str = "fingerprint") -> DataFrame:
    """All columns and the fingerprint of each whole text (null as empty); a given column of that name is replaced."""
    from pyspark.sql.types import StringType

    given = docs.select(*[c for c in docs.columns if c != column], whole_text(text).alias("__whole"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            found = [hexed(f) for f in fingerprints(text_column(batch, "__whole"), hasher)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.string())], [*batch.schema.names[:-1], column])

    return map_rows(given, run, given.drop("__whole").schema.add(column, StringType()))


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as many first code points of the following one, or all it has."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def row_of(key, text: str, bits: np.ndarray, new: str, new_bits: np.ndarray, following: np.ndarray) -> dict:
    return {"id": key, "n_chars": len(text), "edited_sha256": hashlib.sha256(new.encode()).hexdigest(), "fingerprint": hexed(bits),
            "edited_fingerprint": hexed(new_bits), "near_edited": likeness(bits, new_bits), "near_next": likeness(bits, following)}


MADE = ("n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, "
        "part long, head string, tail string")


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each whole text against an edit of itself that takes its last half from the next one, in order of the key.

    Columns: key, n_chars (code points), edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next
    (shares of agreeing bits). The last row is followed by the first, a single row by itself. Null keys come
    first, rows of one key in order of their texts; null texts are empty; an empty table gives none.

    The rows are dealt by ranges of the key and read as a stream, so that a row meets its next one where it
    is; of each range the first and last text are kept aside and matched with the neighbouring ranges.
    """
    work = Work(docs.sparkSession, "simhash")
    rows = docs.select(F.col(key).alias("id"), whole_text(text).alias("text"))
    schema = StructType(rows.schema.fields[:1] + StructType.fromDDL(MADE).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, first = WordHasher(), None, True
        part = TaskContext.get().partitionId()
        kinds = None
        for batch in batches:
            kinds = kinds or arrow(batch.schema.field(0).type)
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                texts, keys, out = text_column(piece, "text"), piece.column(0).to_pylist(), []
                bits = fingerprints(texts, hasher)
                if first:
                    out.append({"id": keys[0], "fingerprint": hexed(bits[0]), "part": part, "head": texts[0]})
                    first = False
                run_of = ([held] if held else []) + list(zip(keys, texts, bits, strict=True))
                new = [edited(a[1], b[1]) for a, b in zip(run_of, run_of[1:], strict=False)]
                out += [row_of(a[0], a[1], a[2], e, f, b[2])
                        for a, b, e, f in zip(run_of, run_of[1:], new, fingerprints(new, hasher), strict=False)]
                held = run_of[-1]
                yield pa.RecordBatch.from_pylist(out, schema=kinds)
        if held:
            yield pa.RecordBatch.from_pylist([{"id": held[0], "fingerprint": hexed(held[2]), "part": part, "tail": held[1]}], schema=kinds)

    made = work.stage(map_rows(rows.repartitionByRange("id").sortWithinPartitions("id", "text"), run, schema), "made")
    # one row per range: which range comes next; texts are not moved for it
    ranges = made.where("head IS NOT NULL").select("part")
    order = Window.orderBy("part")
    follows = ranges.withColumn("next", F.lead("part").over(order)).withColumn(
        "next", F.coalesce("next", F.min("part").over(Window.partitionBy(F.lit(0)))))
    heads = made.where("head IS NOT NULL").select(F.col("part").alias("next"), "head", F.col("fingerprint").alias("head_print"))
    ends = made.where("tail IS NOT NULL").select("id", "part", "tail", "fingerprint").join(follows, "part").join(heads, "next").select(
        "id", "tail", "fingerprint", "head", "head_print")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                new = edited(r["tail"], r["head"])
                own, following = (np.unpackbits(np.frombuffer(bytes.fromhex(r[c]), np.uint8)).astype(bool) for c in ("fingerprint", "head_print"))
                out.append(row_of(r["id"], r["tail"], own, new, fingerprints([new], hasher)[0], following))
            yield pa.RecordBatch.from_pylist(out, schema=arrow(batch.schema.field(0).type))

    closed = map_rows(ends, close, schema)
    wanted = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return made.where("head IS NULL AND tail IS NULL").select(*wanted).unionByName(closed.select(*wanted)).withColumnRenamed("id", key)


def arrow(kind: pa.DataType) -> pa.Schema:
    text, number = pa.string(), pa.float64()
    return pa.schema([("id", kind), ("n_chars", pa.int64()), ("edited_sha256", text), ("fingerprint", text), ("edited_fingerprint", text),
                      ("near_edited", number), ("near_next", number), ("part", pa.int64()), ("head", text), ("tail", text)])


def halves(print_: Column | str) -> list[Column]:
    """The two 64-bit numbers of a hexadecimal fingerprint."""
    part = [F.conv(F.substring(print_, at, 8), 16, 10).cast("long") for at in range(1, BITS // 4 + 1, 8)]
    return [F.shiftleft(part[i], 32).bitwiseOR(part[i + 1]) for i in (0, 2)]


def written(high: Column, low: Column) -> Column:
    return F.lower(F.concat(*[F.lpad(F.hex(half), 16, "0") for half in (high, low)]))


def distance(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Bits in which two fingerprints differ."""
    return F.bit_count(a[0].bitwiseXOR(b[0])) + F.bit_count(a[1].bitwiseXOR(b[1]))


BLOCKS, WIDTH, FARTHEST = 8, 16, 12
TABLES = list(combinations(range(BLOCKS), 2))


def block(number: int, high: str, low: str) -> str:
    """SQL of one of the eight blocks of a fingerprint."""
    return f"(shiftrightunsigned({(high, low)[number // 4]}, {48 - WIDTH * (number % 4)}) & 65535L)"


def keys(high: str, low: str) -> str:
    """SQL of a fingerprint's keys, one per table: the table's number and its two blocks."""
    return ", ".join(f"({t << 2 * WIDTH}L | shiftleft({block(i, high, low)}, {WIDTH}) | {block(j, high, low)})" for t, (i, j) in enumerate(TABLES))


def changes(i: int, j: int) -> tuple[bool, bool]:
    """Whether the table of blocks i and j is probed with a bit changed in one of them, and with one in each."""
    return j != i + 4, i // 3 == j // 3


def probes() -> list[int]:
    """What to change in an asked fingerprint's keys to meet all within 12 bits: table number and changed bits.

    Twelve differing bits leave, of eight blocks, (a) two that agree, or (b) one that agrees and two with a single
    differing bit, or (c) four with a single one. So all tables are probed as they are; all but four without a
    common block with a bit changed in either block, since (b) offers two tables; and with a bit changed in both
    blocks only the tables within the groups 0-2, 3-5 and 6-7, of which any four blocks have two in one.
    """
    found = []
    for t, (i, j) in enumerate(TABLES):
        first, second = [1 << (WIDTH + bit) for bit in range(WIDTH)], [1 << bit for bit in range(WIDTH)]
        one, both = changes(i, j)
        masks = [0, *(first + second if one else []), *([a | b for a in first for b in second] if both else [])]
        found += [t << 2 * WIDTH | mask for mask in masks]
    return found


def first_table(high: str, low: str) -> str:
    """SQL of the first table in which two fingerprints meet that differ in these bits."""
    off = [f"bit_count({block(i, high, low)})" for i in range(BLOCKS)]
    cases = []
    for t, (i, j) in enumerate(TABLES):
        one, both = changes(i, j)
        meets = f"{off[i]} <= 1 AND {off[j]} <= 1" if one and both else f"{off[i]} + {off[j]} <= 1" if one else f"{off[i]} + {off[j]} = 0"
        if both and not one:
            meets += f" OR {off[i]} = 1 AND {off[j]} = 1"
        cases.append(f"WHEN {meets} THEN {t}L")
    return f"CASE {' '.join(cases)} END"


def within(prints: DataFrame, queries: DataFrame, radius: int = FARTHEST, column: str = "fingerprint") -> DataFrame:
    """(query, found, distance): for each distinct query fingerprint all distinct fingerprints within the radius, itself too.

    Both sides are made distinct first, so copies cost one row. Every fingerprint stands in 28 tables under two of its
    eight blocks, and only the asked ones are looked up under changed keys, too (see `probes`); the search is exact up to
    12 bits. A pair comes out of the first table in which it meets and of no other, which the join itself sees to.
    Keys and fingerprints travel as integers. Null fingerprints are found by none.
    """
    if not 0 <= radius <= FARTHEST:
        raise ValueError(f"the tables find all within {FARTHEST} bits, not within {radius}")
    work = Work(prints.sparkSession, "within")
    high, low = halves(F.col(column))
    sides = [side.where(F.col(column).isNotNull()).select(high.alias("high"), low.alias("low")).distinct() for side in (prints, queries)]
    asked = work.stage(sides[1].select(F.col("high").alias("q_high"), F.col("low").alias("q_low")), "asked")
    whole, changed = f"{(1 << 2 * WIDTH) - 1}L", ", ".join(f"{p}L" for p in probes())
    looked = asked.selectExpr("*", f"array({keys('q_high', 'q_low')}) AS own").selectExpr(
        "q_high", "q_low", f"explode(transform(array({changed}), p -> get(own, cast(shiftright(p, {2 * WIDTH}) AS int)) ^ (p & {whole}))) AS looked")
    tables = sides[0].selectExpr("high", "low", f"explode(array({keys('high', 'low')})) AS key")
    apart = distance((F.col("high"), F.col("low")), (F.col("q_high"), F.col("q_low")))
    first = F.expr(f"shiftright(key, {2 * WIDTH}) = {first_table('(high ^ q_high)', '(low ^ q_low)')}")
    # both sides grow with the documents; Spark would judge the looked-up keys by the few rows they are made from
    met = tables.join(looked.hint("merge"), (F.col("key") == F.col("looked")) & (apart <= radius) & first)
    return met.select(written(F.col("q_high"), F.col("q_low")).alias("query"), written(F.col("high"), F.col("low")).alias("found"), apart.alias("distance"))
