"""Delimited text files: every cell is text, rows know their file and line."""

from __future__ import annotations

import codecs
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.session import key_join, stage

UTF8 = {"utf-8", "utf-8-sig"}


@dataclass
class Scan:
    """Rows of the files (`_file`, `_row_num`, one text column per header), and the numbered lines."""

    rows: DataFrame
    lines: DataFrame
    columns: list[str]


def _decoded(value: Column, encoding: str) -> Column:
    """Text in a single-byte encoding. The bytes above ASCII differ by a table the codec itself gives."""
    name = codecs.lookup(encoding).name
    if name in UTF8 or name == "ascii":
        return value
    high = bytes(range(128, 256))
    meant = high.decode(name, errors="replace")
    if len(meant) != 128:
        raise ValueError(f"encoding {encoding} is not a single-byte one")
    latin = F.decode(value.cast("binary"), "ISO-8859-1")
    return F.translate(latin, high.decode("latin-1"), meant)


def read_lines(
    spark: SparkSession, paths: str | list[str], pattern: str | None = None, encoding: str = "utf-8-sig",
    only: DataFrame | None = None,
) -> DataFrame:
    """Lines with their file, split and running position, written once; of the files in `only` (uri), if given.

    The position is only contiguous within one split of one scan, so it is fixed by writing it;
    every later step then reads the same numbers, whatever the executors or retries.
    """
    reader = spark.read
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    lines = reader.text(paths).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"), _decoded(F.col("value"), encoding).alias("value"))
    lines = lines if only is None else of_files(lines, only)
    return stage(lines.withColumn("_split", F.xxhash64("_file", "_block")), "lines")


ENTRIES = 1 << 23  # files whose hashes are sent to every task: 64 MB of them


def of_files(rows: DataFrame, only: DataFrame, file: str = "_file") -> DataFrame:
    """Rows whose file is one of `only` (uri). Tasks are sent eight bytes per file up to a bound, and rows move beyond it only;
    a file that shares its hash is told apart by who joins the rows with its files."""
    marks = only.select(F.xxhash64("uri").alias("_mark")).distinct()
    marks = F.broadcast(marks) if marks.count() <= ENTRIES else marks
    return rows.join(marks, F.xxhash64(file) == F.col("_mark"), "left_semi")


def split_places(lines: DataFrame, told: DataFrame | None = None) -> DataFrame:
    """One written row per file split: its first position, its lines, the lines in the splits before it, and what is `told` of its file.

    `told` (uri, columns) also says which files count: splits of others are left out.
    """
    splits = lines.groupBy("_split", "_file", "_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    if told is not None:
        splits = key_join(splits, told, [(F.col("_file"), F.col("uri"))], "inner").drop("uri")
    return stage(splits, "splits")


def number_lines(lines: DataFrame, places: DataFrame) -> DataFrame:
    """Adds `_line`, the line number within the file, and what is told of the file, whenever the written lines are read.

    The rows of `places` are written, the numbered lines are not. A line finds its split by eight bytes, not by the name of its file,
    which is compared only if two splits share their hash.
    """
    hashes = places.groupBy("_split").count()
    place = places.drop("_n").withColumnsRenamed({"_split": "_s", "_file": "_f", "_block": "_b"})
    on = [(F.col("_split"), F.col("_s"))]
    if not hashes.filter("count > 1").isEmpty():
        on += [(F.col("_file"), F.col("_f")), (F.col("_block"), F.col("_b"))]
    number = F.col("_before") + F.col("_at") - F.col("_first") + 1
    told = [c for c in place.columns if c not in ("_s", "_f", "_b", "_first", "_before")]
    return key_join(lines, place, on, "inner").select(F.col("_f").alias("_file"), F.col("_b").alias("_block"), number.alias("_line"), "value", *told)


def line_of_files(lines: DataFrame, places: DataFrame, number: int) -> DataFrame:
    """(_file, value): one line of every file that has it in its first split, found by its position."""
    wanted = places.filter((F.col("_block") == 0) & (F.col("_n") >= number)).select(
        F.col("_file").alias("_f"), (F.col("_first") + number - 1).alias("_place"))
    return key_join(lines, wanted, [(F.col("_at"), F.col("_place"))], "inner").select(F.col("_f").alias("_file"), "value")


@dataclass(frozen=True)
class _Quoting:
    """Patterns of cells parted by one delimiter. A quote counts only where a cell begins; doubled, it stands for itself.

    All repeated groups are possessive: they are loops without a way back, whatever the length of a line.
    """

    delimiter: str

    @property
    def _other(self) -> str:
        return f"[^{re.escape(self.delimiter)}]*+"

    body = r'[^"]*+(?:""[^"]*+)*+'

    @property
    def _cells(self) -> str:
        """Whole cells, each with the delimiter after it."""
        mark = re.escape(self.delimiter)
        return f'(?:(?:"{self.body}"{self._other}|(?!"){self._other}){mark})*+'

    @property
    def opens(self) -> str:
        """A line that begins outside a quoted cell and ends inside one."""
        return f'^{self._cells}"{self.body}\\z'

    @property
    def stays(self) -> str:
        """A line that begins inside a quoted cell and ends inside it or another one."""
        return f'^{self.body}(?:"{self._other}{re.escape(self.delimiter)}{self._cells}"{self.body})?+\\z'

    @property
    def cell(self) -> str:
        """One cell after a delimiter; an unclosed quote runs to the end."""
        return f'{re.escape(self.delimiter)}("{self.body}"{self._other}|"{self.body}\\z|{self._other})'


def parse_cells(value: Column, delimiter: str, quotes: bool = True) -> Column:
    """Cells of a record as an array, as short as the record; an empty cell is ''. An empty record has none.

    A record without quotes is simply split; without `quotes` all are, and nothing keeps the plan from being compiled as a whole.
    In a quoted cell, text after the closing quote is kept.
    """
    plain = F.split(value, re.escape(delimiter), -1)
    none = F.array().cast("array<string>")
    if not quotes:
        return F.when(value == "", none).otherwise(plain)
    quoting = _Quoting(delimiter)
    found = F.regexp_extract_all(F.concat(F.lit(delimiter), value), F.lit(quoting.cell), F.lit(1))
    inner = f'^"({quoting.body})"?'

    def unquoted(cell: Column) -> Column:
        body = F.regexp_extract(cell, inner, 1)
        tail = F.regexp_replace(cell, inner, "")
        return F.when(F.startswith(cell, F.lit('"')), F.concat(F.replace(body, F.lit('""'), F.lit('"')), tail)).otherwise(cell)

    return (
        F.when(value == "", none)
        .when(F.contains(value, F.lit('"')), F.transform(found, unquoted)).otherwise(plain))


def _closed_within(marks: DataFrame, bound: int) -> DataFrame:
    """Marks in which a line opens a record only if that is closed within `bound` lines.

    From inside a cell, the next line that does not stay inside closes it, whoever opened it. So the length of what a line
    would open follows from the first closing line after it, in its split or, by one row per split, in a later one.
    """
    closing = F.when(F.col("_in") == 0, F.col("_line"))
    behind = Window.partitionBy("_file", "_block").orderBy(F.desc("_line")).rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("_file").orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    splits = marks.groupBy("_file", "_block").agg(F.min(closing).alias("_first")).select(
        F.col("_file").alias("_f"), F.col("_block").alias("_b"), F.last("_first", True).over(later).alias("_next"))
    ahead = marks.withColumn("_close", F.last(closing, True).over(behind))
    placed = key_join(ahead, splits, [(F.col("_file"), F.col("_f")), (F.col("_block"), F.col("_b"))], "inner")
    short = F.coalesce(F.coalesce("_close", "_next") - F.col("_line") < bound, F.lit(False))
    out = F.when(short, F.col("_out")).otherwise(0)
    return placed.select("_file", "_block", "_line", out.alias("_out"), "_in").filter("NOT (_out = 0 AND _in = 1)")


def join_records(lines: DataFrame, delimiter: str, bound: int | None = None) -> DataFrame:
    """Lines (_file, _block, _line, value) put together to records, each under the number of its first line.

    With a `bound`, a quote that is not closed within so many lines opens nothing: its line is a record of its own that
    `_unclosed` tells apart, and the next line begins a new one. Without it, one stray quote takes the rest of a file.

    A line break inside a quoted cell does not end a record. What a line does to the state of being inside
    a cell is one of four things: it keeps it, turns it, or sets it to either. So the state before every
    quoted line follows from the last line that sets it and the turns since, within its split, and from one
    row per split for the splits before. Where no line opens a cell and leaves it open, lines are records.
    """
    quoting = _Quoting(delimiter)
    quoted = lines.filter(F.contains("value", F.lit('"'))).select(
        "_file", "_block", "_line", F.col("value").rlike(quoting.opens).cast("int").alias("_out"), F.col("value").rlike(quoting.stays).cast("int").alias("_in"))
    marks = stage(quoted.filter("NOT (_out = 0 AND _in = 1)"), "quotes")
    unclosed = [] if bound is None else [(F.contains("value", F.lit('"')) & F.col("value").rlike(quoting.opens)).alias("_unclosed")]
    whole = [F.lit(False).alias("_unclosed") for _ in unclosed]
    if marks.filter("_out = 1").limit(1).count() == 0:
        return lines.select("*", *whole)
    if bound is not None:
        marks = stage(_closed_within(marks, bound), "closed")
    in_split = Window.partitionBy("_file", "_block").orderBy("_line")
    before = in_split.rowsBetween(Window.unboundedPreceding, -1)
    marks = marks.withColumn("_turn", F.when(F.col("_out") > F.col("_in"), 1).otherwise(0)).withColumn("_turns", F.sum("_turn").over(in_split))
    marks = marks.withColumn("_set", F.when(F.col("_out") == F.col("_in"), F.col("_out").bitwiseXOR((F.col("_turns") % 2).cast("int"))))
    splits = marks.groupBy("_file", "_block").agg(
        F.max_by("_set", F.when(F.col("_set").isNotNull(), F.col("_line"))).alias("_set"), F.sum("_turn").alias("_turns"))
    in_file = Window.partitionBy("_file").orderBy("_block")
    splits = splits.withColumn("_all", F.sum("_turns").over(in_file)).withColumn(
        "_set", F.col("_set").bitwiseXOR(((F.col("_turns") + F.col("_all")) % 2).cast("int")))
    earlier = in_file.rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select(F.col("_file").alias("_f"), F.col("_block").alias("_b"), F.coalesce(F.last("_set", True).over(earlier), F.lit(0)).bitwiseXOR(
        ((F.col("_all") - F.col("_turns")) % 2).cast("int")).alias("_start"))
    state = F.coalesce(F.last("_set", True).over(before), F.col("_start")).bitwiseXOR(((F.col("_turns") - F.col("_turn")) % 2).cast("int"))
    placed = key_join(marks, starts, [(F.col("_file"), F.col("_f")), (F.col("_block"), F.col("_b"))], "inner").withColumn("_inside", state)
    ends = F.when(F.col("_inside") == 1, F.col("_in")).otherwise(F.col("_out"))
    events = stage(placed.withColumn("_ends", ends).filter("_inside <> _ends").select(
        F.col("_file").alias("_f"), F.col("_block").alias("_b"), F.col("_line").alias("_l"), F.col("_ends").alias("_opened")), "events")

    # the last event up to each line tells whether the line is inside a record, and which line opened it
    told = key_join(lines, events, [(F.col("_file"), F.col("_f")), (F.col("_block"), F.col("_b")), (F.col("_line"), F.col("_l"))])
    last = events.groupBy("_f", "_b").agg(F.max_by("_opened", "_l").alias("_was"), F.max(F.when(F.col("_opened") == 1, F.col("_l"))).alias("_from"))
    sizes = lines.groupBy("_file", "_block").agg(F.count("*").alias("_n"))
    known = key_join(sizes, last, [(F.col("_file"), F.col("_f")), (F.col("_block"), F.col("_b"))])
    carried = known.select(F.col("_file").alias("_cf"), F.col("_block").alias("_cb"), F.last("_was", True).over(earlier).alias("_was"), F.last("_from", True).over(earlier).alias("_from"))
    told = key_join(told, carried, [(F.col("_file"), F.col("_cf")), (F.col("_block"), F.col("_cb"))], "inner")
    now = F.coalesce(F.last("_opened", True).over(in_split), F.col("_was"), F.lit(0))
    opener = F.coalesce(F.last(F.when(F.col("_opened") == 1, F.col("_line")), True).over(in_split), F.col("_from"))
    owned = told.select("_file", "_block", "_line", "value", F.when((now == 1) | (F.col("_opened") == 0), opener).alias("_record"))
    owned = stage(owned, "owned")
    single = owned.filter("_record IS NULL").select("_file", "_block", "_line", "value", *unclosed)
    parts = F.sort_array(F.collect_list(F.struct("_line", "value")))
    several = owned.filter("_record IS NOT NULL").groupBy("_file", "_record").agg(F.min("_block").alias("_block"), parts.alias("_parts")).select(
        "_file", "_block", F.col("_record").alias("_line"), F.array_join(F.col("_parts.value"), "\n").alias("value"), *whole)
    return single.unionByName(several)


def _names(header: str, delimiter: str) -> list[str]:
    import csv

    return next(csv.reader([header.removeprefix("\ufeff")], delimiter=delimiter), [])


def scan_csv(
    spark: SparkSession, paths: str | list[str], delimiter: str, header_line: int = 1,
    encoding: str = "utf-8-sig", pattern: str | None = None, only: DataFrame | None = None, record_lines: int | None = None,
    told: DataFrame | None = None,
) -> Scan:
    """Files of a folder in one scan; line `header_line` of each file names its columns.

    Files may order their columns differently: columns are found by name, the last one winning
    when a file repeats a name. Lines above the header are not rows. A blank line is a row of NULLs.
    A quoted cell may hold line breaks, which are read as line feeds. A file without the header line is an error;
    one without a byte is not listed by Spark's readers and so not seen. `only` (uri) leaves the other files unread.
    With `record_lines`, rows have `_unclosed`: a quote that is not closed within so many lines, which the mapping rejects;
    the row has the cells of that line, and the next line begins a new row.
    Rows carry the columns of `told` (uri, columns that begin with an underscore), and files that are not in it have none.
    """
    written = read_lines(spark, paths, pattern, encoding, only)
    places = split_places(written, told)
    lines = number_lines(written, places)
    headers = stage(line_of_files(written, places, header_line).select("_file", F.col("value").alias("_header")), "headers")
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern or "*").load(paths).select(F.col("_metadata.file_path").alias("_found"))
    found = found if only is None else found.join(only, F.col("_found") == F.col("uri"), "left_semi")
    short = found.join(headers, F.col("_found") == F.col("_file"), "left_anti").orderBy("_found").take(1)
    if short:
        raise ValueError(f"{short[0][0]} has fewer than {header_line} lines")
    layouts = [r[0] for r in headers.select("_header").distinct().collect()]  # header texts: schema, not data
    if not layouts:
        raise ValueError("no file found")
    named = {layout: _names(layout, delimiter) for layout in layouts}
    columns = [c for c in dict.fromkeys(n for names in named.values() for n in names) if c]

    below = lines.filter(F.col("_line") > header_line)
    flags = [] if record_lines is None else ["_unclosed"]
    also = [] if told is None else [c for c in told.columns if c != "uri"]
    quotes = not written.filter(F.contains("value", F.lit('"'))).isEmpty()
    body = join_records(below, delimiter, record_lines) if quotes else below.select("*", *[F.lit(False).alias(c) for c in flags])
    if not set(also) <= set(body.columns):  # records of several lines were put together by the names of their files
        body = key_join(body, told, [(F.col("_file"), F.col("uri"))], "inner").drop("uri")
    flags += also
    cells = parse_cells(F.col("value"), delimiter, quotes)
    if len(layouts) == 1:
        place = {name: i for i, name in enumerate(named[layouts[0]])}
        parsed = body.select("_file", F.col("_line").alias("_row_num"), *flags, cells.alias("_cell"))
        rows = parsed.select("_file", "_row_num", *flags, *[F.get("_cell", F.lit(place[c])).alias(c) for c in columns])
        return Scan(rows, lines, columns)

    known = spark.createDataFrame(
        [(text, {name: i for i, name in enumerate(names) if name}) for text, names in named.items()],
        "_layout string, _place map<string,int>")
    places = headers.join(known, F.col("_header") == F.col("_layout")).select(F.col("_file").alias("_f"), "_place")
    placed = key_join(body, places, [(F.col("_file"), F.col("_f"))], "inner")
    parsed = placed.select("_file", F.col("_line").alias("_row_num"), *flags, "_place", cells.alias("_cell"))
    rows = parsed.select("_file", "_row_num", *flags, *[F.get("_cell", F.try_element_at("_place", F.lit(c))).alias(c) for c in columns])
    return Scan(rows, lines, columns)


_REFERENCE_RE = re.compile(r"^([A-Za-z]{1,3})([1-9][0-9]{0,6})$")


def cell_position(reference: str) -> tuple[int, int]:
    """'B5' -> (line 5, second cell)."""
    match = _REFERENCE_RE.match(reference)
    if not match:
        raise ValueError(f"not a cell reference: {reference}")
    column = 0
    for letter in match.group(1).upper():
        column = column * 26 + ord(letter) - ord("A") + 1
    return int(match.group(2)), column


def header_cells(lines: DataFrame, references: list[str], delimiter: str) -> DataFrame:
    """(file, ref, value) of cells above the rows; a cell beyond the end of its line is NULL."""
    places = {ref: cell_position(ref) for ref in references}
    wanted = lines.filter((F.col("_block") == 0) & F.col("_line").isin([line for line, _ in places.values()]))
    parsed = wanted.select("_file", "_line", parse_cells(F.col("value"), delimiter).alias("_cell"))
    found = F.array_compact(F.array(*[
        F.when(F.col("_line") == line, F.struct(F.lit(ref).alias("ref"), F.get("_cell", F.lit(column - 1)).alias("value")))
        for ref, (line, column) in places.items()]))
    return parsed.select(F.col("_file").alias("file"), F.explode(found).alias("c")).select("file", "c.*")
