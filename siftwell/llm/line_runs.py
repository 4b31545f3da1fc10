"""Line dedup by winnowing: runs of lines that were seen before are deleted, whatever document they stand in.

A run counts from `least` words on. Every run of that length holds a fingerprint that is selected in it alike
wherever it stands: the lines from each line on until `gram` words are hashed, and of all such grams that
start within `window` words the smallest hash is selected (gram + window - 1 <= least). Each selected gram is
then grown both ways, line by line, to the shortest runs of at least `least` words around it, and of equal runs
the first, in order of document and place, stays while the lines of the later ones go. A line is so deleted
exactly if it lies in a run of whole lines of at least `least` words that stands earlier, too; lines without a
word go with the shortest run around them.

Only DataFrame expressions. Lines travel as hashes; per document the work is windows over its lines, and equal
runs meet by their hash with one row for the first, so that no pairs within a group are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftwell.llm.common import Work, whole_text

WORD = r"[^ \t\x0B\f\r]+"


def lines_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, th, pos, n, h, g): the lines with words of each document, with two independent hashes; repeated rows count once."""
    whole = docs.select(F.col(key).alias("id"), whole_text(text).alias("text"))
    lines = whole.select("id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.select("id", "th", "pos", F.regexp_count("line", F.lit(WORD)).alias("n"), F.xxhash64("line").alias("h"),
                         F.xxhash64(F.lit("second"), "line").alias("g"))
    return lines.where("n > 0").repartition("id", "th").dropDuplicates(["id", "th", "pos"])


def end_of(line: Column) -> Column:
    return line["c"] + line["n"]


def runs(lines: DataFrame, least: int, gram: int, window: int) -> DataFrame:
    """(key, proof, place, id, th, from, to): the shortest runs of at least `least` words around selected grams."""
    by_doc = Window.partitionBy("id", "th")
    ordered = by_doc.orderBy("c")
    placed = lines.withColumn("e", F.sum("n").over(by_doc.orderBy("pos"))).withColumn("c", F.col("e") - F.col("n")).withColumn("total", F.sum("n").over(by_doc))
    here = placed.withColumn("lines", F.collect_list("h").over(ordered.rangeBetween(0, gram - 1))).withColumn(
        "last", F.max("c").over(ordered.rangeBetween(0, gram - 1))).withColumn(
        "print", F.when(F.col("c") + gram <= F.col("total"), F.struct(F.xxhash64("lines").alias("hash"), (-F.col("c")).alias("at")))).drop("lines")
    here = here.withColumn("least", F.min("print").over(ordered.rangeBetween(0, window - 1)))
    # a line is selected if one of the windows that hold it picked it
    here = here.withColumn("picked", F.collect_list(F.col("least.at")).over(ordered.rangeBetween(-(window - 1), 0)))
    # the lines that begin within `least` words before or end within `least` words after, and the next one on either side
    line, by_end = F.struct("c", "n", "pos", "h", "g"), by_doc.orderBy("e")
    here = here.withColumns({
        "before": F.last(line).over(ordered.rangeBetween(Window.unboundedPreceding, -least)),
        "left": F.collect_list(line).over(ordered.rangeBetween(1 - least, -1)),
        "right": F.collect_list(line).over(by_end.rangeBetween(0, least - 1)),
        "beyond": F.last(line).over(by_doc.orderBy(F.desc("e")).rangeBetween(Window.unboundedPreceding, -least))})
    around = F.filter(F.concat(F.array("before"), "left", "right", F.array("beyond")), lambda x: x.isNotNull())
    chosen = here.where(F.array_contains("picked", -F.col("c"))).select("id", "th", "c", "n", "last", around.alias("around"))
    # from each line before, the first end that makes the run long enough; to each line after, the last such start
    starts = F.filter("around", lambda a: (a["c"] <= F.col("c")) & (F.col("last") - a["c"] < least))
    ends = F.filter("around", lambda b: (b["c"] >= F.col("last")) & (end_of(b) - (F.col("c") + F.col("n")) < least))
    to_right = F.transform(starts, lambda a: F.struct(
        a["c"].alias("s"), F.array_min(F.transform(F.filter("around", lambda b: end_of(b) >= a["c"] + least), end_of)).alias("e")))
    to_left = F.transform(ends, lambda b: F.struct(
        F.array_max(F.transform(F.filter("around", lambda a: a["c"] + least <= end_of(b)), lambda a: a["c"])).alias("s"), end_of(b).alias("e")))
    grown = F.filter(F.array_distinct(F.concat(to_right, to_left)), lambda r: r["s"].isNotNull() & r["e"].isNotNull())
    each = chosen.select("id", "th", "around", F.explode(grown).alias("run"))
    held = F.filter("around", lambda x: (x["c"] >= F.col("run.s")) & (x["c"] < F.col("run.e")))
    cut = each.select("id", "th", F.col("run.s").alias("s"), held.alias("held"))
    return cut.select(
        F.xxhash64(F.transform("held", lambda x: x["h"])).alias("key"), F.xxhash64(F.transform("held", lambda x: x["g"])).alias("proof"),
        F.struct("id", "th", "s").alias("place"), F.element_at("held", 1)["pos"].alias("from"), F.element_at("held", -1)["pos"].alias("to"))


def repeated(work: Work, docs: DataFrame, key: str, text: str, least: int, gram: int, window: int) -> DataFrame:
    """(id, th, dead): per document with deleted lines their places, as disjoint ranges (from, to) in order."""
    found = work.stage(runs(lines_of(docs, key, text), least, gram, window), "runs")
    first = work.stage(
        found.groupBy("key", "proof").agg(F.min("place").alias("first"), F.max("place").alias("final")).where("first < final").drop("final"), "first")
    later = found.join(first, ["key", "proof"]).where("place > first").select("place.id", "place.th", "from", "to")
    by_doc = Window.partitionBy("id", "th").orderBy("from", "to")
    so_far = F.max("to").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    islands = later.withColumn("new", F.when(so_far.isNull() | (F.col("from") > so_far + 1), 1).otherwise(0)).withColumn("island", F.sum("new").over(by_doc))
    merged = islands.groupBy("id", "th", "island").agg(F.min("from").alias("from"), F.max("to").alias("to"))
    dead = work.stage(merged.groupBy("id", "th").agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("dead")), "dead")
    work.drop(found, first)
    return dead


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 50, gram: int = 25, window: int = 26) -> DataFrame:
    """All rows and columns with the text without its repeated runs, and n_lines, n_removed (lines, blank ones inside a run too).

    Order of documents: by key (null first), then by text hash. Null texts stay null and have no lines, empty
    texts have one blank line; rows repeated with key and text are one document, and are changed alike; an
    empty table gives none; given columns n_lines and n_removed are replaced.
    """
    if gram + window - 1 > least or gram < 1 or window < 1:
        raise ValueError("a run of `least` words must hold a whole window of grams")
    work = Work(docs.sparkSession, "lines")
    dead = repeated(work, docs, key, text, least, gram, window).select(F.col("id").alias("__id"), F.col("th").alias("__th"), F.col("dead").alias("__dead"))
    given = docs.drop("n_lines", "n_removed").withColumn("__hash", F.xxhash64(whole_text(text)))
    # the ranges grow with the documents: merged at every size, and not broadcast while they happen to be few
    joined = given.join(dead.hint("merge"), F.col(key).eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__th")), "left")
    rows = F.split(F.col(text), "\n")
    count = F.size(F.col("__dead"))
    # the lines between one deleted range and the next, each cut out whole
    between = F.transform(F.sequence(F.lit(0), count), lambda k: F.slice(
        rows, F.when(k == 0, 1).otherwise(F.element_at("__dead", F.greatest(k, F.lit(1)))["to"] + 2),
        F.when(k == count, F.size(rows)).otherwise(F.element_at("__dead", F.least(k + 1, count))["from"])
        - F.when(k == 0, 0).otherwise(F.element_at("__dead", F.greatest(k, F.lit(1)))["to"] + 1)))
    removed = F.aggregate("__dead", F.lit(0).cast("long"), lambda n, r: n + r["to"] - r["from"] + 1)
    kept = joined.withColumns({
        "n_lines": F.when(F.col(text).isNull(), 0).otherwise(F.size(rows)).cast("long"), "n_removed": F.coalesce(removed, F.lit(0).cast("long")),
        text: F.when(F.col("__dead").isNull(), F.col(text)).otherwise(F.array_join(F.flatten(between), "\n"))})
    return kept.select(*given.drop("__hash").columns, "n_lines", "n_removed")
