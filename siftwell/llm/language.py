"""Language by compression: the language whose dictionary makes a text smallest.

Texts are reduced to lower-case letters and compressed in blocks, each with the raw-content dictionary of
every language, so that the end of a long text counts like its start. A narrow margin between the best two
is not accepted as an answer (`accepted` is false); the best is named all the same.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType

from siftwell.llm.common import Work, map_rows, sampled, text_column, whole_text

OTHER = re.compile(r"[\W\d_]+")
BLOCK = 4096
TEMPER = 0.25  # neighbouring bytes are not independent evidence


def letters(text: str) -> bytes:
    """The lower-case letters of a text, runs of anything else as one space. Numerals that are no digits are no letters either."""
    plain = OTHER.sub(" ", text.lower()).strip()
    if not plain.replace(" ", "a").isalpha():
        plain = " ".join("".join(c if c.isalpha() else " " for c in plain).split())
    return plain.encode()


class Model:
    """Dictionaries by language, in order of their names."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = 5):
        self.names = sorted(dictionaries)
        self.raw = [dictionaries[n] for n in self.names]
        self.level = level

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_packers"}

    def packers(self) -> list[zstandard.ZstdCompressor]:
        if "_packers" not in self.__dict__:
            self._packers = []
            for raw in self.raw:
                words = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                words.precompute_compress(level=self.level)
                self._packers.append(zstandard.ZstdCompressor(level=self.level, dict_data=words, write_content_size=False, write_checksum=False))
        return self._packers

    def predict(self, text: str) -> tuple[str, float, float]:
        """(language, score, margin). `und` without a letter or a learned language; ties go to the first name."""
        plain = letters(text)
        if not plain or not self.names:
            return "und", 0.0, 0.0
        blocks = [plain[i: i + BLOCK] for i in range(0, len(plain), BLOCK)]
        sizes = np.array([sum(len(p.compress(b)) for b in blocks) for p in self.packers()], float)
        best = int(sizes.argmin())
        odds = np.exp(-np.minimum((sizes - sizes[best]) * (8 * np.log(2) * TEMPER), 700))
        others = np.delete(sizes, best)
        margin = float((others.min() - sizes[best]) / sizes[best]) if len(others) else 1.0
        return self.names[best], float(1 / odds.sum()), margin


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = 1200, piece: int = 400) -> Model:
    """A dictionary per language from a bounded sample: at most `rows` texts, a piece of `piece` characters of each.

    Rows with a null key, language or text teach nothing, nor do texts without a letter.
    """
    work = Work(docs.sparkSession, "language")
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(key, F.col(lang).cast("string").alias("lang"))
    chosen = work.stage(sampled(known, key, "lang", rows, seed=7), "chosen")
    at = F.pmod(F.xxhash64("text"), F.greatest(F.char_length("text") - piece, F.lit(1)).cast("long")).cast("int") + 1
    names = F.col(lang).cast("string") == F.col("__lang")
    found = docs.select(key, lang, whole_text(text).alias("text")).join(
        F.broadcast(chosen.select(F.col(key).alias("__key"), F.col("lang").alias("__lang"), "rank")), (F.col(key) == F.col("__key")) & names)
    found = found.select(F.col("__lang").alias("lang"), "rank", F.substring(F.col("text"), at, F.lit(piece)).alias("piece"))
    pieces: dict[str, list[bytes]] = {}
    for row in found.dropDuplicates(["lang", "rank"]).orderBy("lang", "rank").collect():
        if plain := letters(row["piece"]):
            pieces.setdefault(row["lang"], []).append(plain)
    return Model({name: b" ".join(given) for name, given in pieces.items()})


def identify(docs: DataFrame, model: Model, text: str = "text", narrow: float = 0.02) -> DataFrame:
    """All columns and lang_pred, score (0 to 1), margin and accepted (margin at least `narrow`).

    Null texts and texts without a letter are `und`, score 0, not accepted. Given columns of these names are
    replaced; repeated rows are judged alike; an empty table gives none. Texts of any length are compressed whole, block by block.
    """
    new = ("lang_pred", "score", "margin", "accepted")
    given = docs.select(*[c for c in docs.columns if c not in new], whole_text(text).alias("__whole"))
    schema = given.drop("__whole").schema.add("lang_pred", StringType()).add("score", DoubleType()).add("margin", DoubleType()).add("accepted", BooleanType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t) for t in text_column(batch, "__whole")]
            columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.float64()),
                       pa.array([f[0] != "und" and f[2] >= narrow for f in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*batch.schema.names[:-1], *new])

    return map_rows(given, run, schema)
