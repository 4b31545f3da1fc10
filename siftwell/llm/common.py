"""Shared helpers: written intermediates, text columns, connected components, hashing of words in bulk."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.session import new_folder

BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of a few megabytes: a worker holds one, its texts and its results at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def released(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's results; at its end the worker, which lives on for other stages, gives back the memory it no longer uses."""
    try:
        yield from rows
    finally:
        gc.collect()
        pa.default_memory_pool().release_unused()
        with suppress(AttributeError, OSError):  # a C library without it keeps its own counsel
            ctypes.CDLL(None).malloc_trim(0)


def map_rows(rows: DataFrame, function, schema) -> DataFrame:
    """mapInArrow in small batches, with the worker's memory given back after each task."""
    bound_batches(rows.sparkSession)
    return rows.mapInArrow(lambda batches: released(function(batches)), schema)


class Work:
    """The written intermediates of one call, in a folder of their own below the cluster's shared folder.

    A written table cuts the lineage and survives the loss of executors. `drop` frees one early; the
    rest goes when the driver's JVM ends, since the returned frame may still read it until then.
    """

    def __init__(self, spark: SparkSession, label: str):
        bound_batches(spark)
        self.spark = spark
        self.folder = new_folder(spark, label)
        self._hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._files().deleteOnExit(self._hadoop(self.folder))
        self.written = 0

    def _files(self):
        return self._hadoop(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def path(self, label: str) -> str:
        self.written += 1
        return f"{self.folder}/{self.written:03d}-{label}"

    def new_folder(self, label: str) -> str:
        """An empty folder, for files that tasks write themselves."""
        path = self.path(label)
        self._files().mkdirs(self._hadoop(path))
        return path

    def stage(self, df: DataFrame, label: str) -> DataFrame:
        path = self.path(label)
        df.write.parquet(path)
        staged = self.spark.read.schema(df.schema).parquet(path)
        staged._work_path = path
        return staged

    def drop(self, *staged: DataFrame) -> None:
        """Delete tables that no later step reads."""
        for df in staged:
            self._files().delete(self._hadoop(df._work_path), True)

    def last(self, df: DataFrame, label: str) -> DataFrame:
        """Write the result, and delete all other tables and files of the call."""
        out = self.stage(df, label)
        files = self._files()
        for status in files.listStatus(self._hadoop(self.folder)):
            if not out._work_path.endswith("/" + status.getPath().getName()):
                files.delete(status.getPath(), True)
        return out


def whole_text(column: str | Column) -> Column:
    """The text, null as empty."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit(""))


def fold_of(column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; null for a null id, which belongs to no fold."""
    return F.crc32(F.col(column).cast("string")) % folds


def batches(texts: list[bytes], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of about `limit` bytes together, at least one text each."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > limit:
            yield start, i
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)


MIX1, MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every input bit over all 64."""
    h = h ^ (h >> np.uint64(33))
    h = h * MIX1
    h ^= h >> np.uint64(33)
    h *= MIX2
    h ^= h >> np.uint64(33)
    return h


class WordHasher:
    """64-bit hashes of all words of many texts at once.

    A word's hash is a polynomial of its bytes modulo 2**64, read from one running sum over the whole
    buffer and shifted back by the inverse power of its place, then mixed with its length. The tables of
    powers grow with the longest buffer only; buffers are cut between words at about `limit` bytes.
    """

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, limit: int = 1 << 21):
        self.limit = limit
        self._powers(1 << 16)

    def _powers(self, size: int) -> None:
        inverse = pow(self.BASE, -1, 1 << 64)
        self.power = np.ones(size, np.uint64)
        self.inverse = np.ones(size, np.uint64)
        with np.errstate(over="ignore"):
            self.power[1:] = self.BASE
            np.multiply.accumulate(self.power, out=self.power)
            self.inverse[1:] = inverse
            np.multiply.accumulate(self.inverse, out=self.inverse)

    def words(self, buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(hash, start) of each word of a buffer whose words are parted by ASCII white space."""
        raw = np.frombuffer(buffer, np.uint8)
        if not len(raw):
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        if len(raw) > len(self.power):
            self._powers(max(len(raw), 2 * len(self.power)))
        inside = (raw != 32) & ((raw < 9) | (raw > 13))
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        with np.errstate(over="ignore"):
            total = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum((raw + np.uint64(1)) * self.power[: len(raw)], out=total[1:])
            h = (total[end] - total[start]) * self.inverse[start]
            return mix(h + (end - start).astype(np.uint64) * MIX2), start

    def pieces(self, text: bytes) -> Iterator[bytes]:
        """A long text cut between words."""
        at = 0
        while len(text) - at > self.limit:
            cut = text.rfind(b" ", at, at + self.limit)
            if cut <= at:
                cut = text.find(b" ", at + self.limit)
                if cut < 0:
                    break
            yield text[at:cut]
            at = cut + 1
        yield text[at:]

    def texts(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For ranges of texts in order: all word hashes, and where each text's words begin (one more at the end)."""
        for a, b in batches(texts, self.limit):
            if b == a + 1 and len(texts[a]) > self.limit:
                h = np.concatenate([self.words(piece)[0] for piece in self.pieces(texts[a])])
                yield h, np.array([0, len(h)])
                continue
            h, start = self.words(b"\n".join(texts[a:b]) + b"\n")
            size = np.fromiter((len(t) + 1 for t in texts[a:b]), np.int64, b - a)
            yield h, np.concatenate([[0], np.searchsorted(start, np.cumsum(size))])


def text_column(batch: pa.RecordBatch, name: str) -> list[str]:
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def components(work: Work, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over edges (a, b); nodes without an edge do not occur.

    Every round each node takes the smallest label among its neighbours' and its own, then the label of
    that label (pointer jumping), so long chains shrink by half. Minima combine before each shuffle; a
    round's table is written, and the labels only fall, so the rounds end. An edge table without rows
    gives none.
    """
    both = work.stage(
        edges.select("a", "b").where("a <> b").unionByName(edges.selectExpr("b AS a", "a AS b").where("a <> b")).distinct(), "edges")
    labels = work.stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("component")), "labels")
    while True:
        seen = both.join(labels, both.b == labels.node).select(both.a.alias("node"), "component")
        # a label's own label is at most itself: tell it what its members saw, and take its label back
        told = both.join(labels, both.a == labels.node).join(
            labels.select(F.col("node").alias("peer"), F.col("component").alias("peer_label")), both.b == F.col("peer")
        ).where("peer_label < component").select(F.col("component").alias("node"), F.col("peer_label").alias("component"))
        lowest = labels.unionByName(seen).unionByName(told).groupBy("node").agg(F.min("component").alias("component"))
        top = lowest.select(F.col("node").alias("root"), F.col("component").alias("jumped"))
        moved = work.stage(
            lowest.join(top, lowest.component == top.root, "left")
            .select("node", F.least("component", F.coalesce("jumped", "component")).alias("component")), "labels")
        changed = moved.join(labels.withColumnRenamed("component", "was"), "node").where("component <> was").limit(1).count()
        work.drop(labels)
        labels = moved
        if not changed:
            work.drop(both)
            return labels


def sampled(rows: DataFrame, key: str, label: str, per_label: int, seed: int, parts: int = 256) -> DataFrame:
    """(key, label, rank) of at most `per_label` rows per label: those of the smallest hashes of their keys.

    A label's keys are ranked in `parts` parts by hash first, and only that many of each part are ranked together,
    so the last task of a label gets at most parts * per_label short rows, whatever the table.
    """
    from pyspark.sql.window import Window

    known = rows.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(key, label).distinct()
    hashed = known.withColumn("__hash", F.xxhash64(F.lit(seed), F.col(key).cast("string"))).withColumn("__part", F.pmod("__hash", F.lit(parts)))
    for group in ([label, "__part"], [label]):
        order = Window.partitionBy(*group).orderBy("__hash", key)
        hashed = hashed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_label)
    return hashed.select(key, label, "rank")


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1, steps: int = 100) -> np.ndarray:
    """Weights (intercept first) of a ridged logistic regression over a small fitted sample, by damped Newton steps.

    Columns are brought to mean 0 and deviation 1 for the fit, so that the ridge treats them alike.
    """
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 0, scale, 1.0)
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    penalty = np.array([1e-6] + [ridge] * x.shape[1])
    w = np.zeros(z.shape[1])

    def loss(v: np.ndarray) -> float:
        return float((weight * np.logaddexp(0, np.where(y == 1, -(z @ v), z @ v))).sum() + (penalty * v * v).sum() / 2)

    for _ in range(steps):
        p = sigmoid(z @ w)
        curve = np.maximum(p * (1 - p), 1e-9) * weight
        step = np.linalg.solve((z * curve[:, None]).T @ z + np.diag(penalty), z.T @ (weight * (y - p)) - penalty * w)
        size, now = 1.0, loss(w)
        while size > 1e-6 and loss(w + size * step) > now:
            size /= 2
        w = w + size * step
        if size <= 1e-6 or np.abs(size * step).max() < 1e-8:
            break
    slopes = w[1:] / scale
    return np.concatenate([[w[0] - slopes @ mean], slopes])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))
