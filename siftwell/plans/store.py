"""Tables as sets of Parquet folders, published together by one appended log row set.

A change is written to new folders first. It becomes visible when a single small file is added to
the log, for all its tables at once, so a run that dies before that leaves the tables as they were.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.operators import merge, replace

LOG_SCHEMA = "seq bigint, table string, part string, full boolean, path string, schema string, part_col string, origin string"
NO_PART = "__HIVE_DEFAULT_PARTITION__"


class StoreMoved(RuntimeError):
    """What was written builds on a content that is no longer the current one."""


@dataclass(frozen=True)
class Entry:
    """One folder of a table. A full entry replaces the earlier ones of its part; one that is neither full nor not (None) takes
    the folder away."""

    table: str
    part: str | None
    full: bool | None
    path: str | None


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.log_path = f"{self.root}/_log"
        self._entries: list[dict] | None = None

    def _log(self) -> list[dict]:
        """The log names folders, not rows: it is as long as the number of writes."""
        if self._entries is None:
            try:
                log = self.spark.read.schema(LOG_SCHEMA).parquet(self.log_path)
                self._entries = [r.asDict() for r in log.orderBy("seq").collect()]
            except Exception as error:  # noqa: BLE001
                if "PATH_NOT_FOUND" not in str(error):
                    raise
                self._entries = []
        return self._entries

    def _append_log(self, rows: list[tuple]) -> None:
        """One file named by the first number in it. Of two writers that know the same log, both want the same name, and one gets it."""
        known = self._log()
        draft = f"{self.root}/_drafts/{uuid.uuid4().hex}"
        self.spark.createDataFrame(rows, LOG_SCHEMA).coalesce(1).write.parquet(draft)
        if not _claim(self.spark, draft, f"{self.log_path}/{rows[0][0]:020d}.parquet"):
            raise StoreMoved(f"{self.root} has changed since it was read: refresh and write again")
        names = [c.split()[0] for c in LOG_SCHEMA.split(", ")]
        self._entries = known + [dict(zip(names, row)) for row in rows]

    def refresh(self) -> None:
        """Forget the log as last seen, to see what others have published since."""
        self._entries = None

    def tables(self) -> list[str]:
        return sorted({e["table"] for e in self._log()})

    def create(
        self, table: str, schema: str | T.StructType, part_col: str | None = None, bucket_keys: list[str] | None = None, buckets: int = 64,
    ) -> None:
        """Declare a table; `part_col` names a coarse replacement key it is kept apart by.

        Without a coarse key, `bucket_keys` keep the rows apart by a hash of these columns, so that a change of few
        keys reads and writes few buckets.
        """
        if bucket_keys:
            part_col = json.dumps({"keys": bucket_keys, "buckets": buckets})
        self.create_all({table: schema}, part_col)

    def create_all(self, schemas: dict[str, str | T.StructType], part_col: str | None = None) -> None:
        known, seq, rows = self.tables(), self._next(), []
        for table, schema in schemas.items():
            if table not in known:
                parsed = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
                rows.append((seq, table, None, False, None, parsed.json(), part_col, None))
        if rows:
            self._append_log(rows)

    def _next(self) -> int:
        return max((e["seq"] for e in self._log()), default=0) + 1

    def moment(self) -> int:
        """Number of the last entry of the log as last read; 0 without any."""
        return self._next() - 1

    def declared(self, table: str) -> dict:
        """The log's entry that declares a table."""
        for entry in self._log():
            if entry["table"] == table and entry["schema"]:
                return entry
        raise ValueError(f"no table {table} (tables: {', '.join(self.tables())})")

    def schema(self, table: str) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.declared(table)["schema"]))

    def part_col(self, table: str) -> str | None:
        """The column a table is kept apart by, if it is one."""
        kept = self.declared(table)["part_col"]
        return None if kept and kept.startswith("{") else kept

    def part(self, table: str) -> tuple[Column | None, list[str]]:
        """The part of a row as text, and the columns that tell it; NULL without parts."""
        kept = self.declared(table)["part_col"]
        if kept is None:
            return None, []
        if not kept.startswith("{"):
            return F.col(kept).cast("string"), [kept]
        declared = json.loads(kept)
        types = {f.name: f.dataType for f in self.schema(table)}
        keys = [F.col(k).cast(types[k]) for k in declared["keys"]]
        return F.pmod(F.xxhash64(*keys), F.lit(declared["buckets"])).cast("string"), declared["keys"]

    def _live(self, table: str, pending: list[Entry] | None = None) -> list[Entry]:
        """The folders that are the content of a table, as of the log as last read."""
        entries = [Entry(e["table"], e["part"], e["full"], e["path"]) for e in self._log() if e["table"] == table and (e["path"] or e["full"])]
        live: dict[str | None, dict[str | None, Entry]] = {}
        for e in entries + [p for p in pending or [] if p.table == table]:
            if e.full is None:
                live.get(e.part, {}).pop(e.path, None)
            elif e.full:
                live[e.part] = {e.path: e}
            else:
                live.setdefault(e.part, {})[e.path] = e
        return [e for part in live.values() for e in part.values() if e.path]

    def read(self, table: str, parts: list[str] | None = None, pending: list[Entry] | None = None) -> DataFrame:
        """Current content, or that of some parts only; `pending` entries count as published."""
        return self._rows(table, [e for e in self._live(table, pending) if parts is None or e.part in parts])

    def _rows(self, table: str, folders: list[Entry]) -> DataFrame:
        schema = self.schema(table)
        return self.spark.read.schema(schema).parquet(*[e.path for e in folders]) if folders else self.spark.createDataFrame([], schema)

    def _holding(self, table: str, incoming: DataFrame, keys: list[str], pending: list[Entry] | None = None) -> list[Entry]:
        """The folders that hold a row with a key of `incoming`; NULL keys equal each other.

        Only the key columns are read, and of these what the footers do not rule out by the range of the incoming keys.
        The names of the folders come back, like a listing.
        """
        live = self._live(table, pending)
        if not live:
            return []
        file = F.parse_url(F.col("_metadata.file_path"), F.lit("PATH"))
        folder = F.regexp_extract(F.url_decode(F.replace(file, F.lit("+"), F.lit("%2B"))), "(?s)^(.*)/[^/]*$", 1)
        rows = self._rows(table, live).select(*keys, folder.alias("_folder"))
        found = replace.replaced_rows(replace.within_range(rows, incoming, keys), incoming, keys).select("_folder").distinct().collect()
        names, held = {r[0] for r in found}, {_plain(self.spark, e.path): e for e in live}
        if names - held.keys():
            raise ValueError(f"files outside the folders of {table}: {', '.join(sorted(names - held.keys()))}")
        return [e for path, e in held.items() if path in names]

    def _change(self, table: str, folders: list[Entry], rows: DataFrame) -> tuple[list[Entry], int]:
        """`rows` in new folders in the place of some folders; all others stay as they are."""
        written, now = self._write(table, rows, full=False)
        return [Entry(table, e.part, None, e.path) for e in folders] + written, now

    def conform(self, table: str, df: DataFrame, *also: str) -> DataFrame:
        """The table's columns in its types; columns it lacks are dropped but for `also`, missing ones are NULL."""
        return df.select(*also, *[
            (F.col(f"`{f.name}`").cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in self.schema(table)])

    def _write(self, table: str, df: DataFrame, full: bool, touched: list[str] | None = None) -> tuple[list[Entry], int]:
        """Folders written and their rows, counted from the footers of what was written."""
        path = f"{self.root}/{table}/{uuid.uuid4().hex}"
        part = self.part(table)[0]
        if part is None:
            df.write.parquet(path)
            return [Entry(table, None, full, path)], self.spark.read.schema(df.schema).parquet(path).count()
        # Rows of a part go to few tasks, and a part too large for one task is split again.
        parted = df.withColumn("_part", part).hint("rebalance", "_part")
        parted.write.partitionBy("_part").parquet(path)
        # An empty part leaves no folder: a replacement that empties one must still hide the old rows.
        written = {_unescape(p) for p in _subfolders(self.spark, path)}
        entries = [Entry(table, p, full, f"{path}/_part={_escape(p)}") for p in sorted(written)]
        if full:
            entries += [Entry(table, p, True, None) for p in sorted(set(touched or []) - written)]
        rows = self.spark.read.schema(df.schema).parquet(path).count() if written else 0
        return entries, rows

    def append(self, table: str, df: DataFrame) -> list[Entry]:
        """New folders beside the old ones; nothing is rewritten."""
        return self._write(table, self.conform(table, df), full=False)[0]

    def overwrite(self, table: str, df: DataFrame, pending: list[Entry] | None = None) -> list[Entry]:
        return self._write(table, self.conform(table, df), full=True, touched=self._parts(table, pending))[0]

    def rewrite(
        self, table: str, touched: DataFrame, change: Callable[[DataFrame], DataFrame], pending: list[Entry] | None = None,
        keys: list[str] | None = None, moves: bool = False,
    ) -> list[Entry]:
        """Rows changed in place. Only the parts that hold a touched row are read and written.

        Where the touched rows do not tell the parts, or a change may move rows to another one (`moves`), the folders that
        hold a touched row's `keys` are; without keys the whole table is.
        """
        part, told_by = self.part(table)
        if part is not None and set(told_by) <= set(touched.columns) and not moves:
            found = touched.select(part).distinct().collect()  # part names, like a listing
            parts = [NO_PART if r[0] is None else r[0] for r in found]
            if not parts:
                return []
            rows = self.conform(table, change(self.read(table, parts=parts, pending=pending)))
            return self._write(table, rows, full=True, touched=parts)[0]
        if keys:
            held = self._holding(table, touched, keys, pending)
            return self._change(table, held, self.conform(table, change(self._rows(table, held))))[0] if held else []
        return self._write(table, self.conform(table, change(self.read(table, pending=pending))), full=True, touched=self._parts(table, pending))[0]

    def merge(self, table: str, source: DataFrame, keys: list[str], mode: str, pending: list[Entry] | None = None) -> list[Entry]:
        """Rows updated, inserted or deleted by key (see operators.merge). `source` should be staged.

        A table kept apart by its keys is read and written in the parts that a source key falls in, any other in the
        folders that hold one; there rows may move to another part.
        """
        merge.check_sources(self.read(table, pending=pending), source, keys)
        told_by = self.part(table)[1]
        typed = self.conform(table, source).select(*[c for c in source.columns if c in self.schema(table).names])
        if told_by and set(told_by) <= set(keys):
            return self.rewrite(table, typed.select(*told_by), lambda rows: merge.merge_rows(rows, typed, keys, mode), pending)
        held = self._holding(table, typed, keys, pending)
        if not held and mode != merge.MERGE:
            return []
        return self._change(table, held, self.conform(table, merge.merge_rows(self._rows(table, held), typed, keys, mode)))[0]

    def replace(
        self, table: str, incoming: DataFrame, keys: list[str], promoted: int, pending: list[Entry] | None = None,
    ) -> tuple[list[Entry], int]:
        """Block replacement: (written folders, replaced rows).

        A table kept apart by its keys reads and rewrites the touched parts only, any other the folders that hold
        an incoming key. `incoming` should be staged: it is read for its parts, for its keys and for its rows.
        `promoted` is its row count.
        """
        if not keys:
            return self.append(table, incoming), 0
        rows = self.conform(table, incoming)
        part, told_by = self.part(table)
        if part is not None and set(told_by) <= set(keys):
            found = rows.select(part).distinct().collect()  # part names, like a listing
            touched = [NO_PART if r[0] is None else r[0] for r in found]
            target = self.read(table, parts=touched, pending=pending)
            entries, now = self._write(table, replace.replace_block(target, rows, keys), full=True, touched=touched)
        else:
            held = self._holding(table, rows, keys, pending)
            target = self._rows(table, held)
            entries, now = self._change(table, held, replace.replace_block(target, rows, keys))
        return entries, target.count() + promoted - now

    def _parts(self, table: str, pending: list[Entry] | None = None) -> list[str]:
        return [e.part for e in self._live(table, pending) if e.part is not None]

    def published(self, origin: str) -> bool:
        """Whether something was published under this origin."""
        return any(e["origin"] == origin for e in self._log())

    def publish(self, entries: list[Entry], origin: str | None = None) -> None:
        """Make written folders the content of their tables, all at once; refused if others have published since the log was read.

        `origin` names what they came from, like a batch of a stream; it becomes visible with them and not without them.
        """
        if entries:
            seq = self._next()
            if Store(self.spark, self.root)._next() != seq:
                raise StoreMoved(f"{self.root} has changed since it was read: refresh and write again")
            self._append_log([(seq + i, e.table, e.part, e.full, e.path, None, None, origin) for i, e in enumerate(entries)])

    def sweep(self, older_than: float) -> list[str]:
        """Delete the folders of the tables that are no longer content and have not changed for `older_than` seconds; their paths.

        The age must exceed the longest write or read that may be under way: a folder being written is not named yet,
        and one replaced a moment ago may still be read. The log is read anew and keeps its entries.
        """
        self.refresh()
        before = (time.time() - older_than) * 1000
        gone = []
        for table in self.tables():
            live = {e.path for e in self._live(table)}
            for name, changed in _listed(self.spark, f"{self.root}/{table}"):
                path = f"{self.root}/{table}/{name}"
                parts = [(f"{path}/{part}", at) for part, at in _listed(self.spark, path) if part.startswith("_part=")]
                if path not in live and changed < before:
                    if not any(p in live or at >= before for p, at in parts):
                        gone.append(path)
                    else:
                        gone += [p for p, at in parts if p not in live and at < before]
        for path in gone:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
        return gone

    def register_views(self, pending: list[Entry] | None = None) -> None:
        for table in self.tables():
            self.read(table, pending=pending).createOrReplaceTempView(table)


def _claim(spark: SparkSession, draft: str, name: str) -> bool:
    """The one file of a draft moved to a name that nobody has yet; False if somebody has. The draft goes either way."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    folder, target = hadoop.Path(draft), hadoop.Path(name)
    files = folder.getFileSystem(conf)
    files.mkdirs(target.getParent())
    written = next(f.getPath() for f in files.listStatus(folder) if f.getPath().getName().startswith("part-"))
    keep = spark._sc._gateway.new_array(hadoop.Options.Rename, 1)
    keep[0] = hadoop.Options.Rename.NONE
    try:
        hadoop.FileContext.getFileContext(files.getUri(), conf).rename(files.makeQualified(written), files.makeQualified(target), keep)
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" not in str(error.java_exception):
            raise
        return False
    finally:
        files.delete(folder, True)
    return True


def _listed(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(name, last change in ms) of the folders directly below a path, none if it is absent."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return [(f.getPath().getName(), f.getModificationTime()) for f in files.listStatus(folder) if f.isDirectory()] if files.exists(folder) else []


def _plain(spark: SparkSession, path: str) -> str:
    """A path without scheme and host."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toUri().getPath()


def _subfolders(spark: SparkSession, path: str) -> list[str]:
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    names = [f.getPath().getName() for f in files if f.isDirectory()]
    return [n[len("_part="):] for n in names if n.startswith("_part=")]


def _unescape(name: str) -> str:
    from urllib.parse import unquote

    return unquote(name)


def _escape(name: str) -> str:
    """Folder spelling of a partition value. The characters Spark escapes in it."""
    special = set("\"#%'*/:=?\\\x7f{[]^") | {chr(i) for i in range(1, 32)}
    return "".join(f"%{ord(c):02X}" if c in special else c for c in name)
