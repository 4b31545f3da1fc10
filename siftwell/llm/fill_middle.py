"""Fill-in-middle: texts cut at two token borders into prefix, middle and suffix, and put together in another order.

A wavelet matrix over the classes of the characters answers, for any place, how many characters of a class come
before it. A character's symbol is its class (white space, letter, digit, other) and whether a token ends with it;
the ranks of the ending symbols add up to the number of borders before a place, and bisection on that number finds
the place of the k-th border. One matrix holds the texts of a whole batch, so that all cuts are found together.

Tokens are `[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+`: each run of other characters with the white space
before it, and white space at the end of a text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siftwell.llm.common import batches as ranges
from siftwell.llm.common import map_rows, text_column, whole_text

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
WHITE, LETTER, DIGIT, OTHER = range(4)
CLASS = np.array([WHITE if c == 32 or 9 <= c <= 13 else DIGIT if 48 <= c <= 57 else LETTER if chr(c).isalpha() else OTHER for c in range(128)], np.uint8)
ENDING = tuple(2 * c + 1 for c in range(4))
TOGETHER = 1 << 20  # characters of a matrix, unless one text is longer


class Bits:
    """A bit vector with the number of ones before any place: counts per word of 64 bits and the bits of one word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(8 + -len(packed) % 8, np.uint8)]).view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.zeros = len(bits) - int(self.before[-1])

    def ones(self, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))


class WaveletMatrix:
    """Ranks of the symbols of a sequence, for many places at once; a quarter of a byte per character and level."""

    def __init__(self, symbols: np.ndarray, depth: int):
        self.levels, self.depth = [], depth
        for level in range(depth):
            ones = (symbols >> (depth - 1 - level) & 1).astype(bool)
            self.levels.append(Bits(ones))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How often the symbol occurs before each of the places."""
        start, end = np.zeros(1, np.int64), at
        for level, bits in enumerate(self.levels):
            if symbol >> (self.depth - 1 - level) & 1:
                start, end = bits.zeros + bits.ones(start), bits.zeros + bits.ones(end)
            else:
                start, end = start - bits.ones(start), end - bits.ones(end)
        return end - start

    def borders(self, at: np.ndarray) -> np.ndarray:
        """How many tokens end before each of the places."""
        return sum(self.rank(symbol, at) for symbol in ENDING)

    def border(self, k: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Within [low, high] the first places with k borders before them."""
        while (low < high).any():
            middle = (low + high) >> 1
            enough = self.borders(middle) >= k
            low, high = np.where(enough, low, np.minimum(middle + 1, high)), np.where(enough, middle, high)
        return low


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts in a row, and where each text begins (one more at the end)."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    start = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)
    kind = np.where(points < 128, CLASS[np.minimum(points, 127)], np.uint8(LETTER))
    last = np.zeros(len(points), bool)
    last[start[1:][start[1:] > start[:-1]] - 1] = True
    white = kind == WHITE
    ends = last.copy()
    ends[:-1] |= ~white[:-1] & white[1:]
    return (2 * kind + ends).astype(np.uint8), start


def draws(key, seed: int) -> list[int]:
    """Four numbers of 32 bits from the SHA-256 of seed and key; a null key counts as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return [int.from_bytes(digest[i:i + 4], "big") for i in (0, 4, 8, 12)]


def arranged(keys: list, texts: list[str], seed: int, rate: int, spm: int) -> list[tuple]:
    """(n, form, prefix_chars, middle_chars, output) of each text."""
    sequence, start = symbols(texts)
    matrix = WaveletMatrix(sequence, 3)
    before, after = matrix.borders(start[:-1]), matrix.borders(start[1:])
    drawn = [draws(key, seed) for key in keys]
    two = np.array([h[:2] for h in drawn], np.int64).reshape(-1, 2) % (after - before + 1)[:, None]
    cut = [matrix.border(before + k, start[:-1], start[1:]) - start[:-1] for k in (two.min(axis=1), two.max(axis=1))]
    out = []
    for text, n, a, b, h in zip(texts, (after - before).tolist(), cut[0].tolist(), cut[1].tolist(), drawn, strict=True):
        if not text or h[2] % 100 >= rate or PREFIX in text or SUFFIX in text or MIDDLE in text:
            out.append((n, "plain", None, None, text))
        elif h[3] % 100 < spm:
            out.append((n, "spm", a, b - a, f"{SUFFIX}{text[b:]}{PREFIX}{text[:a]}{MIDDLE}{text[a:b]}"))
        else:
            out.append((n, "psm", a, b - a, f"{PREFIX}{text[:a]}{SUFFIX}{text[b:]}{MIDDLE}{text[a:b]}"))
    return out


MADE = "n long, form string, prefix_chars long, middle_chars long, output string"


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """All columns and n (tokens), form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output.

    `rate` of 100 texts are cut, `spm` of 100 of these begin with the suffix; the numbers drawn depend on seed and
    key alone, so rows of one key are drawn alike and a null key like an empty one. Null and empty texts, and texts
    that hold a marker, stay plain. Texts of any length are cut whole. An empty table gives none; given columns of
    the new names are replaced, also where one of them is the key or text.
    """
    made = StructType.fromDDL(MADE)
    keep = [c for c in docs.columns if c not in made.names]
    given = docs.select(*keep, F.col(key).cast("string").alias("__key"), whole_text(text).alias("__whole"))
    schema = StructType([*given.schema.fields[:-2], *made.fields])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts, keys, out = text_column(batch, "__whole"), batch.column(batch.num_columns - 2).to_pylist(), []
            for a, b in ranges(texts, TOGETHER):
                out += arranged(keys[a:b], texts[a:b], seed, rate, spm)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            columns = [pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *columns], schema.names)

    return map_rows(given, run, schema)


def restored(output: str | Column = "output", form: str | Column = "form") -> Column:
    """The text that was cut, from output and form: each marker stands once in a text that is not plain."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)
