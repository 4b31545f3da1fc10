"""Identity of files by content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.session import key_join


def _binary(spark: SparkSession, folder: str | list[str], pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)


def _place() -> list[Column]:
    """`file` is the path to open; `uri` is how a row's metadata spells it."""
    return [F.col("path").alias("file"), F.col("_metadata.file_path").alias("uri"), F.col("length").alias("bytes")]


def list_files(spark: SparkSession, folder: str | list[str], pattern: str = "*") -> DataFrame:
    """(file, uri, bytes) without reading any content."""
    return _binary(spark, folder, pattern).select(*_place())


# Fixed values of the identity: changing one changes every hash. Primes below 2**31, so that products fit 64 bits; one base each.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (1318926727, 982451653, 1597334677, 1150833019)
DIGIT = 6  # bits of an exponent that one table of powers covers


def _power(exponent: str, base: int, prime: int, digits: int) -> str:
    """SQL of base ** exponent modulo the prime, from one table of powers per digit of the exponent."""
    result = ""
    for place in range(digits):
        step = pow(base, 1 << (DIGIT * place), prime)
        table = ", ".join(f"{pow(step, n, prime)}L" for n in range(1 << DIGIT))
        found = f"get(array({table}), cast(shiftright({exponent}, {DIGIT * place}) & {(1 << DIGIT) - 1} AS int))"
        result = f"({result} * {found}) % {prime}L" if result else found
    return f"({result})"


def digest_lines(lines: DataFrame) -> DataFrame:
    """(_file, hash) of lines (_file, _block, _at, value): polynomials of the lines' hashes, put together from those of the splits.

    A file's digest is the sum of hash * base ** (line number) modulo four primes. A split does not know the number
    of its first line, but its own sum, over positions from anywhere on, is multiplied by the power that is missing
    once the splits before it are counted. So one aggregation reads the lines, one short row per split goes through
    the shuffle, and neither the size of the splits nor their order of reading shows in the result.
    """
    fields = list(enumerate(zip(PRIMES, BASES, strict=True)))
    placed = lines.selectExpr("_file", "_block", f"_at & {(1 << 33) - 1}L AS _place", "xxhash64(1, value) AS h0", "xxhash64(2, value) AS h1")
    sums = [F.expr(f"sum((pmod(h{i // 2}, {p}L) * {_power('_place', b, p, 6)}) % {p}L) % {p}L AS s{i}") for i, (p, b) in fields]
    splits = placed.groupBy("_file", "_block").agg(F.min("_place").alias("first"), F.count(F.lit(1)).alias("n"), *sums)
    in_file = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("before", F.coalesce(F.sum("n").over(in_file), F.lit(0)))
    moved = [f"(s{i} * (({_power('first', pow(b, -1, p), p, 6)} * {_power('before', b, p, 8)}) % {p}L)) % {p}L AS m{i}" for i, (p, b) in fields]
    whole = splits.selectExpr("_file", "n", *moved).groupBy("_file").agg(F.sum("n").alias("n"), *[F.expr(f"sum(m{i}) % {p}L AS m{i}") for i, (p, _) in fields])
    return whole.select("_file", F.sha2(F.concat_ws("|", "n", *[f"m{i}" for i, _ in fields]), 256).alias("hash"))


def hash_files(spark: SparkSession, folder: str | list[str], pattern: str = "*") -> DataFrame:
    """(file, uri, bytes, hash): one identity of the content for files of every size.

    The bytes between line feeds are digested with their order, so carriage returns count, and the length of the file
    tells a final line feed. The content is read once, by as many tasks as there are splits, and written nowhere.
    """
    found = list_files(spark, folder, pattern)
    lines = spark.read.option("pathGlobFilter", pattern).text(folder, lineSep="\n").select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"),
        F.col("value").cast("binary").alias("value"))
    digests = digest_lines(lines).withColumnRenamed("_file", "_uri")
    joined = key_join(found, digests, [(F.col("uri"), F.col("_uri"))])
    return joined.select("file", "uri", "bytes", F.sha2(F.concat_ws("|", F.col("bytes"), F.coalesce("hash", F.lit(""))), 256).alias("hash"))
