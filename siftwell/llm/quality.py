"""Quality by compression: zstandard with a dictionary of good text against one with a dictionary of bad text.

The difference of the two compressed sizes, over the larger, tells which dictionary explains a text better.
It is taken twice, of the text and of its shape (letters, capitals and digits as one byte each), and turned
into a probability by a logistic regression together with how far the text compresses by itself and how long
it is, since a long text explains itself and leaves less to a dictionary.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from siftwell.llm.common import Work, logistic, map_rows, sampled, sigmoid, text_column, whole_text

SHAPE = bytes(
    ord("a") if 97 <= b <= 122 or b >= 128 else ord("A") if 65 <= b <= 90 else ord("0") if 48 <= b <= 57 else b for b in range(256))


@dataclass
class Model:
    """Dictionaries of label 0 and 1 (text and shape) and the calibration; without both labels only a constant."""

    texts: tuple[bytes, bytes]
    shapes: tuple[bytes, bytes]
    weights: list[float]
    level: int = 3

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def _packers(self):
        if "_made" not in self.__dict__:
            def packer(raw: bytes) -> zstandard.ZstdCompressor:
                words = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                words.precompute_compress(level=self.level)
                return zstandard.ZstdCompressor(level=self.level, dict_data=words, write_content_size=False, write_checksum=False)

            self._made = [packer(raw) for raw in (*self.texts, *self.shapes)]
            self._made.append(zstandard.ZstdCompressor(level=1, write_content_size=False, write_checksum=False))
        return self._made

    def features(self, text: str) -> list[float]:
        bad, good, bad_shape, good_shape, plain = self._packers()
        raw = text.encode()
        shape = raw.translate(SHAPE)
        b, g = len(bad.compress(raw)), len(good.compress(raw))
        bs, gs = len(bad_shape.compress(shape)), len(good_shape.compress(shape))
        n = len(raw) + 8
        return [(b - g) / max(b, g), (bs - gs) / max(bs, gs), math.log((len(plain.compress(raw)) + 1) / n), math.log((gs + 1) / n), math.log(n)]

    def scores(self, texts: list[str]) -> np.ndarray:
        if len(self.weights) == 1:
            return np.array([self.weights[0] if t else 0.0 for t in texts])
        x = np.array([self.features(t) for t in texts]).reshape(len(texts), 5)
        return np.where([bool(t) for t in texts], sigmoid(self.weights[0] + x @ np.array(self.weights[1:])), 0.0)


def per_text(docs: DataFrame, text: str, column: str, function) -> DataFrame:
    """All columns but one of that name, and `column`: function of a list of whole texts, as doubles."""
    keep = [c for c in docs.columns if c != column]
    given = docs.select(*keep, whole_text(text).alias("__whole"))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            values = pa.array(np.asarray(function(text_column(batch, "__whole")), np.float64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], values], [*batch.schema.names[:-1], column])

    return map_rows(given, run, given.drop("__whole").schema.add(column, DoubleType()))


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
    dictionary_rows: int = 900, piece: int = 600, calibration_rows: int = 4000,
) -> Model:
    """Learn from a bounded sample of labelled rows: per label at most `dictionary_rows` texts give a piece of
    `piece` characters each to the dictionary, and at most `calibration_rows` others calibrate it.

    Labels other than 0 and 1, null labels and null keys are not learned from. A key with both labels counts
    for both. Without rows of both labels the model scores every text with the share of label 1.
    """
    work = Work(docs.sparkSession, "quality")
    known = labels.where(F.col(label).isin(0, 1)).select(F.col(key), F.col(label).cast("int").alias("label"))
    known = known.join(docs.select(F.col(key).alias("__key")).distinct(), F.col(key) == F.col("__key"), "left_semi")
    counts = dict(known.groupBy("label").count().collect())
    if len(counts) < 2:
        return Model((b"", b""), (b"", b""), [(counts.get(1, 0) + 1) / (sum(counts.values()) + 2)])
    chosen = work.stage(sampled(known, key, "label", dictionary_rows + calibration_rows, seed=6), "chosen")
    # at most two labels of that many short rows: their size is bounded whatever the tables hold
    rows = docs.select(key, whole_text(text).alias("text")).join(F.broadcast(chosen), key)
    at = F.pmod(F.xxhash64("text"), F.greatest(F.char_length("text") - piece, F.lit(1)).cast("long")).cast("int") + 1
    told = (F.col("rank") % 2 == 1) & (F.col("rank") < 2 * dictionary_rows)  # by turns, so that few labels serve both ends
    pieces = rows.where(told).select("label", "rank", F.substring(F.col("text"), at, F.lit(piece)).alias("piece"))
    found = pieces.dropDuplicates(["label", "rank"]).orderBy("label", "rank").collect()
    texts = tuple("\n".join(r["piece"] for r in found if r["label"] == k).encode() for k in (0, 1))
    model = Model(texts, tuple(t.translate(SHAPE) for t in texts), [])
    rest = rows.where(~told)
    if {r["label"] for r in rest.select("label").distinct().collect()} != {0, 1}:
        rest = rows  # few labels: the same texts serve for both

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [model.features(t) for t in text_column(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["label", "x"])

    measured = map_rows(rest.where("text <> ''").select("label", "text"), measure, "label int, x array<double>").toPandas().sort_values(
        "x", key=lambda s: s.map(tuple))
    y = measured["label"].to_numpy(float)
    if len(set(y)) < 2:
        return Model((b"", b""), (b"", b""), [(counts[1] + 1) / (sum(counts.values()) + 2)])
    share = {k: counts[k] / max((y == k).sum(), 1) for k in (0, 1)}  # the sample holds the labels alike: back to their shares
    weight = np.where(y == 1, share[1], share[0])
    weight *= len(y) / weight.sum()
    model.weights = logistic(np.array(measured["x"].tolist()), y, weight).tolist()
    return model


def score(docs: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """All columns and the probability of label 1 of each whole text. Null and empty texts score 0; repeated rows
    score alike; texts of any length are compressed whole; an empty table gives none; a given column of that name is replaced."""
    return per_text(docs, text, column, model.scores)
