"""Documents to training text: poor ones go, repeated runs go, near copies go, benchmark passages go, the rest is encoded.

Every stage takes (spark, docs, sf_dir) and returns a frame; all but the last return the columns of documents.
Each works on all that its predecessor kept, and its decisions take effect. Null and empty texts are poor;
rows of one doc_id are one document; an empty table passes as one; columns beyond those of documents are kept,
whatever their names, since operators only see doc_id and text under their own names; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import decontam, jaccard, line_runs, pieces, quality
from siftwell.llm.common import Work
from siftwell.llm.queries import held_out, piece_model


def guarded(docs: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows an operator leaves, with its doc_id and text: other columns pass it under names that none of its own can clash with."""
    hidden = {c: f"__given{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    out = operator(docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(h) for c, h in hidden.items()]))
    return out.select(*[F.col(hidden[c]).alias(c) if c in hidden else F.col(c) for c in docs.columns])


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier gives at least 0.7, learned from the labels of three folds of four."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = quality.fit(docs.where(~held_out(2, 4)), labels)
    return guarded(docs, lambda rows: quality.score(rows, model, column="__score").where("__score >= 0.7"))


def drop_repeated_runs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the runs of lines that stand earlier; documents of which no word is left go."""
    left = (F.col("n_removed") == 0) | F.col("text").rlike(r"\S")
    out = guarded(docs, lambda rows: line_runs.dedup(rows).where(left))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies: five-word shingles, a similarity of 0.8 or more."""
    groups = jaccard.join(docs.select("doc_id", "text"), size=5, percent=80)
    others = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(Work(spark, "near").stage(others, "others"), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no or little of the benchmark's passages."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return guarded(docs, lambda rows: decontam.scan(rows, benchmark).where("NOT contaminated"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and round_trip: whether the ids decode to the text again."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = pieces.encode(rows, piece_model(), decoded="decoded")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.col("text")).alias("round_trip"))


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_repeated_runs),
    ("n-gram Jaccard join", keep_one_of_each),
    ("benchmark decontamination", drop_benchmark),
    ("SentencePiece encoding", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    work = Work(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = work.stage(docs, f"stage-{number}")
    return docs
