"""Files written from the given tables and read back: identities, quoted cells, layouts, outputs, stops, hooks."""

from __future__ import annotations

import csv
import io

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from queries import Tables, query
from siftwell.operators import listing, usage
from siftwell.plans import load
from siftwell.plans.store import Store
from siftwell.session import new_folder, stage
from siftwell.sinks import outputs
from siftwell.sources.files import hash_files
from siftwell.sources.text_files import header_cells, scan_csv

PLAIN = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def order_lines(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("at"), F.concat_ws(";", "o_orderkey", "o_custkey", "o_orderstatus").alias("line"))


KEYS_A_FILE = 20_000


def write_parts(rows: DataFrame, path: str, separator: str = "\n") -> None:
    """Lines (part, at, line) in one file per part, ordered by `at`; the number of files follows the rows."""
    rows.select("part", "at", "line").repartition("part").sortWithinPartitions("part", "at").select("part", "line").write.option(
        "lineSep", separator).partitionBy("part").text(path)


@query("""SELECT * FROM (VALUES ('other row', 'differs'), ('other separator', 'differs'), ('same', 'equal'), ('shorter', 'differs')) AS v(variant, identity)
WHERE (SELECT count(*) FROM orders) > 1""")
def file_identity(t: Tables) -> DataFrame:
    """All orders written five ways, a file per range of keys: only the same bytes have the same identity."""
    lines, last = order_lines(t), t.orders.agg(F.max("o_orderkey")).first()[0]
    folder = new_folder(t.spark, "identity")
    variants = {"first": (lines, "\n"), "same": (lines, "\n"), "other separator": (lines, "\r\n"), "shorter": (lines.filter(F.col("at") < last), "\n"),
                "other row": (lines.withColumn("line", F.when(F.col("at") == last, F.reverse("line")).otherwise(F.col("line"))), "\n")}
    for name, (rows, separator) in variants.items():
        write_parts(rows.withColumn("part", F.floor(F.col("at") / KEYS_A_FILE)), f"{folder}/variant={name}", separator)
    place = r"/variant=([^/]+)/part=([^/]+)/part-[^/]*$"
    found = hash_files(t.spark, folder, "part-*").select(
        F.url_decode(F.regexp_extract("uri", place, 1)).alias("variant"), F.regexp_extract("uri", place, 2).alias("part"), "hash")
    first = found.filter("variant = 'first'").select("part", "hash", F.lit(True).alias("met"))
    parts = first.agg(F.count("*").alias("parts"))
    compared = found.filter("variant <> 'first'").join(first, ["part", "hash"], "left").groupBy("variant").agg(F.count("*").alias("n"), F.count("met").alias("met"))
    return compared.crossJoin(parts).select(
        "variant", F.when((F.col("n") == F.col("parts")) & (F.col("met") == F.col("parts")), "equal").otherwise("differs").alias("identity"))


@query("""SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '') || ';"' || lang AS body, lang FROM documents""")
def csv_quoted(t: Tables) -> DataFrame:
    """Texts with delimiters, quotes and line breaks in quoted cells, written and read back."""
    folder = new_folder(t.spark, "quoted")
    body = F.concat(F.coalesce("text", F.lit("")), F.lit(';"'), F.col("lang"))
    rows = t.documents.select(F.col("doc_id").cast("string").alias("doc_id"), body.alias("body"), "lang")
    rows.write.options(header=True, sep=";", quoteAll=True, escape='"', **PLAIN).csv(folder)
    return scan_csv(t.spark, folder, ";", pattern="part-*").rows.select("doc_id", "body", "lang")


@query("""
SELECT CASE WHEN o_orderkey % 100 = 0 THEN 'unclosed' WHEN o_orderkey % 100 = 50 THEN 'two lines' ELSE 'plain' END AS kind,
       count(*) AS rows, sum(o_orderkey) AS keys, sum(length(o_orderstatus || o_orderpriority)) AS chars
FROM orders GROUP BY 1""")
def csv_stray_quotes(t: Tables) -> DataFrame:
    """All orders as text, of each hundred one with a quote that nothing closes and one with a line break in a cell: no quote takes
    the lines after it."""
    path, key = new_folder(t.spark, "stray"), F.col("o_orderkey")
    quote = F.when(key % 100 == 0, F.lit('"')).when(key % 100 == 50, F.lit('"')).otherwise("")
    cell = F.concat("o_orderstatus", F.when(key % 100 == 50, F.lit("\n")).otherwise(""), "o_orderpriority", F.when(key % 100 == 50, F.lit('"')).otherwise(""))
    body = t.orders.select(F.floor(key / KEYS_A_FILE).alias("part"), key.alias("at"), F.concat(key.cast("string"), F.lit(";"), quote, cell).alias("line"))
    top = body.select("part").distinct().select("part", F.lit(-1).cast("bigint").alias("at"), F.lit("key;cell").alias("line"))
    write_parts(top.unionByName(body), path)
    rows = scan_csv(t.spark, path, ";", pattern="part-*", record_lines=3).rows
    kind = F.when(F.col("_unclosed"), "unclosed").when(F.contains("cell", F.lit("\n")), "two lines").otherwise("plain")
    return rows.groupBy(kind.alias("kind")).agg(
        F.count("*").alias("rows"), F.sum(F.col("key").cast("bigint")).alias("keys"), F.sum(F.char_length(F.replace("cell", F.lit("\n"), F.lit("")))).alias("chars"))


def columns_as_csv(rows: DataFrame, path: str) -> None:
    rows.write.options(header=True, sep=";", **PLAIN).csv(path)


def inbox(t: Tables, label: str, **frames: DataFrame) -> list[str]:
    """One folder of CSV files per frame."""
    folder = new_folder(t.spark, label)
    for name, rows in frames.items():
        columns_as_csv(rows, f"{folder}/{name}")
    return [f"{folder}/{name}" for name in frames]


def store_of(t: Tables, **tables: str) -> Store:
    store = load.prepare(Store(t.spark, new_folder(t.spark, "store")))
    store.create_all(tables)
    return store


BALANCES = {"nombre": "balances", "patron": "*.csv", "delimitador": ";", "fila_cabecera": 1, "tabla_destino": "balance", "mapping": [
    {"origen": "key", "destino": "key", "operaciones": [{"tipo": "cast", "tipo_destino": "integer"}]},
    {"origen": "name", "destino": "name", "operaciones": [{"tipo": "trim"}]},
    {"origen": "amount", "destino": "amount", "operaciones": [{"tipo": "cast", "tipo_destino": "double"}]}]}
BALANCE = "key bigint, name string, amount double, kind string, extra_fields string, ejecucion_id bigint"


def parties(t: Tables) -> dict[str, DataFrame]:
    """Customers, suppliers and nations as files with other columns each; nations have no amount."""
    return {
        "a_customers": t.customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("amount")).coalesce(1),
        "b_suppliers": t.supplier.select(F.col("s_acctbal").alias("amount"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("name")).coalesce(1),
        "c_nations": t.nation.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("key")).coalesce(1)}


@query("""
SELECT c_custkey AS key, c_name AS name, c_acctbal AS amount FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier
UNION ALL SELECT n_nationkey, n_name, NULL FROM nation""")
def csv_layouts(t: Tables) -> DataFrame:
    """Three files with columns in other orders, one lacking a declared column."""
    store = store_of(t, balance=BALANCE)
    load.run_load(t.spark, store, {**BALANCES, "carpeta": inbox(t, "layouts", **parties(t))})
    return store.read("balance").select("key", "name", "amount")


@query("SELECT c_custkey AS key, count(*) AS n FROM customer GROUP BY ALL UNION ALL SELECT -1, 1")
def skip_same_batch(t: Tables) -> DataFrame:
    """Two equal files in one folder are loaded once, under one run."""
    store = store_of(t, balance=BALANCE)
    one = parties(t)["a_customers"].orderBy("key")
    load.run_load(t.spark, store, {**BALANCES, "carpeta": inbox(t, "same", first=one.coalesce(1), second=one.coalesce(1))})
    rows = store.read("balance").groupBy("key").agg(F.count("*").alias("n"))
    return rows.unionByName(load.current_runs(store).agg(F.lit(-1).cast("bigint").alias("key"), F.count("*").alias("n")))


@query("""
SELECT 1 AS run, count(*) AS n, CAST(round(sum(c_acctbal) * 100) AS BIGINT) AS cents FROM customer
UNION ALL SELECT 2, count(*), CAST(round(sum(s_acctbal) * 100) AS BIGINT) FROM supplier UNION ALL SELECT 3, count(*), NULL FROM nation""")
def load_outputs(t: Tables) -> DataFrame:
    """Each of three files has an output of its own rows."""
    store, out = store_of(t, balance=BALANCE), new_folder(t.spark, "outputs")
    output = {"nombre": "own", "fichero": "{ejecucion_id}.parquet", "sql": "SELECT :ejecucion_id AS run, amount FROM balance WHERE ejecucion_id = :ejecucion_id"}
    done = load.run_load(t.spark, store, {**BALANCES, "carpeta": inbox(t, "outputs-in", **parties(t)), "salidas": [output]}, export_folder=out)
    written = t.spark.read.schema("run bigint, amount double").parquet(*[o["fichero"] for r in done for o in r.outputs])
    return written.groupBy("run").agg(F.count("*").alias("n"), F.round(F.sum("amount") * 100).cast("bigint").alias("cents"))


@query("""
SELECT 'a_customers' AS file, CASE WHEN min(c_acctbal) < 0 THEN 'ERROR' ELSE 'OK' END AS status, CASE WHEN min(c_acctbal) < 0 THEN 0 ELSE count(*) END AS n FROM customer
UNION ALL SELECT 'b_suppliers', CASE WHEN min(s_acctbal) < 0 THEN 'ERROR' ELSE 'OK' END, CASE WHEN min(s_acctbal) < 0 THEN 0 ELSE count(*) END FROM supplier
UNION ALL SELECT 'c_nations', 'OK', count(*) FROM nation""")
def load_stop(t: Tables) -> DataFrame:
    """A stop rule looks at every file by itself: those that break it leave the target as it was."""
    store = store_of(t, balance=BALANCE)
    rule = {"nombre": "debt", "tipo": "stop", "mensaje": "a balance below zero", "sql": "SELECT key FROM _entrante WHERE amount < 0"}
    folders = inbox(t, "stop", **parties(t))
    load.run_load(t.spark, store, {**BALANCES, "carpeta": folders, "validaciones": [rule]})
    names = t.spark.createDataFrame([(i + 1, f.rsplit("/", 1)[1]) for i, f in enumerate(folders)], "id bigint, file string")
    counts = store.read("balance").groupBy(F.col("ejecucion_id").alias("id")).agg(F.count("*").alias("n"))
    runs = load.current_runs(store).select("id", F.col("estado").alias("status"))
    return runs.join(names, "id").join(counts, "id", "left").select("file", "status", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


@query("""
SELECT 1 AS run, 'before' AS moment, 0 AS n UNION ALL SELECT 2, 'before', 0 UNION ALL SELECT 3, 'before', 0
UNION ALL SELECT 1, 'after', count(*) FROM customer UNION ALL SELECT 2, 'after', count(*) FROM supplier UNION ALL SELECT 3, 'after', count(*) FROM nation""")
def load_hooks(t: Tables) -> DataFrame:
    """Actions before and after the promotion of each file see that file's run and its rows."""
    store = store_of(t, balance=BALANCE, diary="run bigint, moment string, n bigint")
    told = "SELECT :ejecucion_id AS run, '{m}' AS moment, (SELECT count(*) FROM balance WHERE ejecucion_id = :ejecucion_id) AS n"
    actions = [{"momento": when, "tabla": "diary", "sql": told.format(m=name)} for when, name in (("antes", "before"), ("tras_promover", "after"))]
    load.run_load(t.spark, store, {**BALANCES, "carpeta": inbox(t, "hooks", **parties(t)), "acciones": actions})
    return store.read("diary")


@query("""
WITH p AS (SELECT 1 AS run, c_acctbal AS amount FROM customer UNION ALL SELECT 2, s_acctbal FROM supplier UNION ALL SELECT 3, NULL FROM nation)
SELECT run, 'before' AS moment, count(*) AS n FROM p GROUP BY run
UNION ALL SELECT run, 'after', CASE WHEN coalesce(min(amount), 0) < -999.5 THEN 0 ELSE count(*) END FROM p GROUP BY run""")
def delivery_hooks(t: Tables) -> DataFrame:
    """Three files by one plan: a rule, a variable and two actions that look at each file by itself."""
    store = store_of(t, balance=BALANCE, diary="run bigint, moment string, n bigint")
    rule = {"nombre": "debt", "tipo": "stop", "mensaje": "a balance far below zero", "sql": "SELECT key FROM _entrante WHERE amount < -999.5"}
    actions = [{"momento": "antes", "tabla": "diary", "sql": "SELECT :ejecucion_id AS run, 'before' AS moment, count(*) AS n FROM _entrante"},
               {"momento": "tras_promover", "tabla": "diary", "sql": "SELECT :ejecucion_id AS run, 'after' AS moment, least(:promovidas, :v_n) AS n"},
               {"momento": "al_fallar", "tabla": "diary", "sql": "SELECT :ejecucion_id AS run, 'after' AS moment, 0 AS n"}]
    counted = {"momento": "antes", "sql": "SELECT count(*) AS n FROM _entrante"}
    changes = {"acciones": actions, "validaciones": [rule], "variables": [counted]}
    load.run_load(t.spark, store, {**BALANCES, "carpeta": inbox(t, "delivery", **parties(t)), **changes}, unit="each")
    return store.read("diary")


@query("""
SELECT c_custkey AS key, c_name AS name, CASE WHEN o.n IS NOT NULL THEN CAST(o.n AS DOUBLE) ELSE c_acctbal END AS amount FROM customer
LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey WHERE c_mktsegment <> 'BUILDING'""")
def keyed_changes(t: Tables) -> DataFrame:
    """Customers' balances set to their numbers of orders and one segment deleted, both by key, and both twice."""
    store = store_of(t)
    store.create("account", "key bigint, name string, amount double", bucket_keys=["key"], buckets=16)
    store.publish(store.append("account", t.customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("amount"))))
    known = t.customer.select(F.col("c_custkey").alias("key"))
    counts = t.orders.groupBy(F.col("o_custkey").alias("key")).agg(F.count("*").alias("amount")).join(known, "key", "left_semi")
    gone = t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("key"))
    for mode, rows in (("actualizar", counts), ("borrar", gone)) * 2:
        store.publish(store.merge("account", stage(rows, "changes"), ["key"], mode))
    return store.read("account")


@query("""
SELECT n_name AS query, CASE WHEN n_nationkey < 2 THEN 'ERROR' ELSE 'OK' END AS status,
  CASE WHEN n_nationkey >= 2 THEN (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) END AS rows FROM nation""")
def query_log_nations(t: Tables) -> DataFrame:
    """The log of one query per nation, two of which fail."""
    return nation_log(t, t.nation)


@query("""
SELECT 1 AS run, 'c' AS side, c_custkey AS key FROM customer UNION ALL SELECT 2, 's', s_suppkey FROM supplier UNION ALL SELECT 3, 'n', n_nationkey FROM nation""")
def run_stamp(t: Tables) -> DataFrame:
    """Rows carry the run of the file they came from."""
    store = store_of(t, balance=BALANCE)
    load.run_load(t.spark, store, {**BALANCES, "carpeta": inbox(t, "stamp", **parties(t))})
    side = F.when(F.col("name").startswith("Customer"), "c").when(F.col("name").startswith("Supplier"), "s").otherwise("n")
    return store.read("balance").select(F.col("ejecucion_id").alias("run"), side.alias("side"), "key")


@query("""
SELECT v.format, c_custkey AS id, c_name AS name, c_mktsegment || ', "' || c_mktsegment || '"' AS segment FROM customer, (VALUES ('csv'), ('parquet')) AS v(format)""")
def view_export(t: Tables) -> DataFrame:
    """A view exported once as CSV and Parquet, both read back."""
    folder = new_folder(t.spark, "export")
    t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.concat("c_mktsegment", F.lit(', "'), "c_mktsegment", F.lit('"')).alias("segment")).createOrReplaceTempView("exported_customers")
    done = outputs.export_view(t.spark, "exported_customers", folder)
    schema = "id bigint, name string, segment string"
    text = t.spark.read.options(header=True, escape='"').schema(schema).csv(done["csv"])
    return text.select(F.lit("csv").alias("format"), "*").unionByName(t.spark.read.schema(schema).parquet(done["parquet"]).select(F.lit("parquet").alias("format"), "*"))


@query("""
SELECT n_name AS query, CASE WHEN n_nationkey < 2 THEN 'ERROR' ELSE 'OK' END AS status,
  CASE WHEN n_nationkey >= 2 THEN (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) END AS rows FROM nation WHERE n_nationkey < 5""")
def query_log(t: Tables) -> DataFrame:
    """Queries with a bound value, some of which fail, and what the log says of them."""
    return nation_log(t, t.nation.filter("n_nationkey < 5"))


def nation_log(t: Tables, nations: DataFrame) -> DataFrame:
    path = new_folder(t.spark, "log")
    t.customer.createOrReplaceTempView("logged_customers")
    for row in nations.select("n_nationkey", "n_name").collect():
        sql = f"SELECT * FROM logged_customers WHERE {'absent' if row[0] < 2 else 'c_nationkey'} = :nation"
        try:
            usage.logged_query(t.spark, sql, {"nation": row[0]}, path, row[1], ["customer"])
        except Exception:  # noqa: BLE001  what the log holds of it is the result
            pass
    return t.spark.read.schema(usage.LOG_SCHEMA).parquet(path).select(F.col("query_id").alias("query"), "status", "rows")


@query("SELECT row_number() OVER (ORDER BY o_orderdate DESC) AS place, strftime(o_orderdate, '%Y-%m-%d') AS day FROM (SELECT DISTINCT o_orderdate FROM orders)")
def listing_order(t: Tables) -> DataFrame:
    """A listing with a date comes newest first: the place of each day in the written order."""
    entity = {"entidad": "day", "tabla": "day", "campos": {"id": {"tipo": "uuid"}, "fecha": {"tipo": "date"}}}
    days = t.orders.select(F.col("o_orderdate").cast("date").alias("fecha")).distinct().withColumn("id", F.col("fecha").cast("string"))
    listed = listing.listing(entity, {}, {"day": days})
    path = new_folder(t.spark, "listed")
    listed.withColumn("at", F.monotonically_increasing_id()).write.parquet(path)  # positions rise with the order of the rows
    return numbered(t.spark.read.parquet(path)).select("place", F.date_format("fecha", "yyyy-MM-dd").alias("day"))


def numbered(rows: DataFrame) -> DataFrame:
    """Rows with their place by `at`: counted per range, and the ranges before added."""
    dealt = stage(rows.repartitionByRange("at").withColumn("_part", F.spark_partition_id()), "dealt")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy("at"))
    return dealt.withColumn("_own", own).join(parts, "_part").withColumn("place", F.col("_before") + F.col("_own"))


def quoted(values: list) -> str:
    out = io.StringIO()
    csv.writer(out, delimiter=";", lineterminator="").writerow(values)
    return out.getvalue()


@query("""
SELECT 'A1' AS ref, min(n_name) AS value FROM nation UNION ALL SELECT 'B2', CAST(count(*) AS VARCHAR) || ';' FROM nation UNION ALL SELECT 'C2', NULL""")
def file_header_cells(t: Tables) -> DataFrame:
    """Cells above the header of written files with all customers, one quoted and one beyond the end of its line."""
    row = t.nation.agg(F.min("n_name"), F.count("*")).first()
    lines = [quoted([row[0]]), quoted(["n", f"{row[1]};"]), "key;name"]
    path = new_folder(t.spark, "cells")
    body = t.customer.select(F.floor(F.col("c_custkey") / KEYS_A_FILE).alias("part"), F.col("c_custkey").alias("at"), F.concat_ws(";", "c_custkey", "c_name").alias("line"))
    top = t.spark.createDataFrame([(i - 3, line) for i, line in enumerate(lines)], "at bigint, line string")
    write_parts(body.select("part").distinct().crossJoin(F.broadcast(top)).unionByName(body), path)
    scan = scan_csv(t.spark, path, ";", header_line=3, pattern="part-*")
    return header_cells(scan.lines, ["A1", "B2", "C2"], ";").select("ref", "value").distinct()
