"""Replacement of blocks, staging tables, rules, variables and whole loads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queries import Tables, query
from queries.mapping import SPANISH_CENTS
from siftwell.operators import date_evidence, lookup, mapping, replace, rules, variables
from siftwell.plans import load
from siftwell.plans.store import Store
from siftwell.session import new_folder, stage
from siftwell.sinks import snapshot, store_copy
from siftwell.sources.text_files import scan_csv
from siftwell.streaming.folder import watch_folder

SALES_MAPPING = [
    {"origen": "fecha", "destino": "sale_date", "operaciones": [{"tipo": "date_format", "formatos": ["%d/%m/%Y", "%m/%d/%Y"]}]},
    {"origen": "socio", "destino": "party", "operaciones": [{"tipo": "cast", "tipo_destino": "integer"}]},
    {"origen": "importe", "destino": "amount", "operaciones": [{"tipo": "cast", "tipo_destino": "double", "formato_numerico": "es"}]},
    {"destino": "origin", "operaciones": [{"tipo": "const", "valor": "lineas"}]},
]
SALES_KEYS = ["sale_date", "party"]


def raw_sales(t: Tables) -> DataFrame:
    """lineitem as two text files, one per line status; returned lines carry no amount."""
    cents = t.lineitem.withColumn("c", F.expr("cast(round(l_extendedprice * 100) as bigint)"))  # once, for all that the text takes from it
    return cents.selectExpr(
        "l_linestatus as _file", "date_format(l_shipdate, 'dd/MM/yyyy') as fecha", "concat(' ', l_suppkey, ' ') as socio",
        f"case l_returnflag when 'R' then 'pendiente' else {SPANISH_CENTS.format(c='c')} end as importe")


def sales(t: Tables) -> DataFrame:
    """The valid typed rows of those files, written once: their keys and the rows themselves are read."""
    raw = raw_sales(t)
    settled = date_evidence.settle_dates(raw, mapping.date_fields(SALES_MAPPING))
    mapped = mapping.map_rows(date_evidence.attach_dates(raw, settled), SALES_MAPPING)
    return stage(mapping.valid_rows(mapped).drop("_file"), "sales")


def sales_target(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_orderdate").cast("date").alias("sale_date"), F.col("o_custkey").alias("party"),
        F.col("o_totalprice").alias("amount"), F.lit("pedidos").alias("origin"))


SALES_SQL = """
WITH incoming AS (SELECT strftime(l_shipdate, '%Y-%m-%d') AS sale_date, l_suppkey AS party,
    CAST(round(l_extendedprice * 100) AS BIGINT) / 100.0::DOUBLE AS amount, 'lineas' AS origin
  FROM lineitem WHERE l_returnflag <> 'R'),
target AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS sale_date, o_custkey AS party, o_totalprice AS amount, 'pedidos' AS origin FROM orders)"""


@query(SALES_SQL + """
SELECT * FROM target t WHERE NOT EXISTS (SELECT 1 FROM incoming i
  WHERE i.sale_date IS NOT DISTINCT FROM t.sale_date AND i.party IS NOT DISTINCT FROM t.party)
UNION ALL SELECT * FROM incoming""")
def replace_block(t: Tables) -> DataFrame:
    """Flagship: text rows typed, dates settled by evidence, their keys replaced in the target."""
    result = replace.replace_block(sales_target(t), sales(t), SALES_KEYS)
    return result.withColumn("sale_date", F.col("sale_date").cast("string"))


@query(SALES_SQL + """
SELECT (SELECT count(*) FROM incoming) AS promoted, (SELECT count(*) FROM target t WHERE EXISTS (SELECT 1 FROM incoming i
  WHERE i.sale_date IS NOT DISTINCT FROM t.sale_date AND i.party IS NOT DISTINCT FROM t.party)) AS replaced""")
def replace_counts(t: Tables) -> DataFrame:
    return replace.replace_counts(sales_target(t), sales(t), SALES_KEYS)


def accounts(t: Tables) -> DataFrame:
    """Customers per segment and nation; the first nation is unknown."""
    return t.customer.select(
        F.col("c_mktsegment").alias("segment"), F.nullif("c_nationkey", F.lit(0)).alias("nation"),
        F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))


def supplier_accounts(t: Tables) -> DataFrame:
    return t.supplier.select(
        F.lit("BUILDING").alias("segment"), F.nullif("s_nationkey", F.lit(0)).alias("nation"),
        F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))


@query("""
WITH target AS (SELECT c_mktsegment AS segment, nullif(c_nationkey, 0) AS nation, c_name AS name, c_acctbal AS balance FROM customer),
incoming AS (SELECT 'BUILDING' AS segment, nullif(s_nationkey, 0) AS nation, s_name AS name, s_acctbal AS balance FROM supplier)
SELECT segment, CAST(nation AS VARCHAR) AS nation, name, balance FROM (
SELECT * FROM target t WHERE NOT EXISTS (SELECT 1 FROM incoming i
  WHERE i.segment IS NOT DISTINCT FROM t.segment AND i.nation IS NOT DISTINCT FROM t.nation)
UNION ALL SELECT * FROM incoming)""")
def replace_null_key(t: Tables) -> DataFrame:
    """NULL is a key value like any other."""
    result = replace.replace_block(accounts(t), supplier_accounts(t), ["segment", "nation"])
    return result.withColumn("nation", F.col("nation").cast("string"))


@query("""
SELECT c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer
UNION ALL SELECT s_name, s_acctbal, NULL FROM supplier""")
def append_only(t: Tables) -> DataFrame:
    """No keys: the load adds; columns only one side has are NULL or dropped."""
    target = accounts(t).select("name", "balance", "segment")
    return replace.replace_block(target, supplier_accounts(t).drop("segment").withColumn("work", F.lit(1)), [])


@query("""
SELECT NULL AS brand, c_name AS name, c_mktsegment AS segment FROM customer
UNION ALL SELECT p_brand, p_name, NULL FROM part""")
def bulk_union(t: Tables) -> DataFrame:
    return replace.bulk_union(
        t.customer.select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")),
        t.part.select(F.col("p_name").alias("name"), F.col("p_brand").alias("brand")))


@query("""
SELECT o_orderpriority AS priority, count(*) AS rows_at_risk FROM orders o
WHERE o_orderpriority <> '1-URGENT' AND EXISTS (SELECT 1 FROM orders i WHERE i.o_orderpriority = '1-URGENT'
  AND i.o_orderdate = o.o_orderdate AND i.o_orderstatus = o.o_orderstatus)
GROUP BY 1""")
def crossed_parameters(t: Tables) -> DataFrame:
    """The priority is a mandatory parameter, yet the key is only day and status."""
    columns = {"o_orderdate": "day", "o_orderstatus": "status", "o_orderpriority": "priority"}
    target = t.orders.select(*[F.col(c).alias(a) for c, a in columns.items()])
    return replace.crossed_parameters(target, target.filter("priority = '1-URGENT'"), ["day", "status"], "priority")


HALL = {"day": "date", "supplier": "string", "nation": "string", "units": "int", "amount": "double", "extra_fields": "string"}


def hall(t: Tables) -> DataFrame:
    """Staging rows: names instead of ids, upper case, with a buyer nobody knows for returned lines."""
    incoming = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"), "left").select(
        F.col("l_shipdate").cast("date").alias("day"),
        F.when(F.col("l_returnflag") == "R", F.concat("s_name", F.lit(" bis"))).otherwise(F.upper("s_name")).alias("supplier"),
        F.concat(F.lit("Nation_"), F.col("s_nationkey").cast("string")).alias("nation"),
        F.col("l_quantity").alias("units"), F.col("l_extendedprice").alias("amount"), F.lit("x").alias("work"))
    return replace.full_photo(incoming, HALL)


TRANSFORM = """
SELECT h.day, s.s_suppkey AS supplier_id, n.n_nationkey AS nation_id, h.units, h.amount
FROM hall_lines h LEFT JOIN supplier s ON lower(s.s_name) = lower(h.supplier)
LEFT JOIN nation n ON lower(n.n_name) = lower(h.nation) WHERE h.units IS NOT NULL"""


@query("""
SELECT strftime(l_shipdate, '%Y-%m-%d') AS day, CASE WHEN l_returnflag <> 'R' THEN CAST(l_suppkey AS VARCHAR) END AS supplier_id,
       s_nationkey AS nation_id, CAST(l_quantity AS INT) AS units, l_extendedprice AS amount
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""")
def hall_transform(t: Tables) -> DataFrame:
    """Staging rows turned into target rows by a SELECT with label joins."""
    hall(t).createOrReplaceTempView("hall_lines")
    t.supplier.createOrReplaceTempView("supplier")
    t.nation.createOrReplaceTempView("nation")
    result = variables.bound(t.spark, TRANSFORM)
    return result.withColumn("day", F.col("day").cast("string")).withColumn("supplier_id", F.col("supplier_id").cast("string"))


@query("""
SELECT strftime(l_shipdate, '%Y-%m-%d') AS day, CASE WHEN l_returnflag <> 'R' THEN CAST(l_suppkey AS VARCHAR) END AS supplier_id,
       l_extendedprice AS amount FROM lineitem""")
def label_left_join(t: Tables) -> DataFrame:
    """The same lookup through the DataFrame API."""
    dimension = t.supplier.select(F.col("s_suppkey").alias("supplier_id"), "s_name")
    found = lookup.label_join(hall(t), F.col("supplier"), dimension, "s_name")
    return found.select(F.col("day").cast("string").alias("day"), F.col("supplier_id").cast("string").alias("supplier_id"), "amount")


LINE_RULES = [
    rules.Rule("negative_amount", rules.STOP, "A line amount is below zero.", "SELECT line_id, cents FROM _entrante WHERE cents < 0"),
    rules.Rule("huge_amount", rules.STOP, "A line amount is above the limit.",
               "SELECT line_id, cents FROM _entrante WHERE cents > :p_limit ORDER BY cents DESC, line_id, part"),
    rules.Rule("full_box", rules.ALARM, "Lines of exactly one full box.",
               "SELECT line_id, part FROM _entrante WHERE units = 50 ORDER BY line_id, part, cents", 3),
]


def entrante(t: Tables) -> DataFrame:
    lines = t.lineitem.selectExpr(
        "concat(l_orderkey, '-', l_linenumber) as line_id", "l_partkey as part", "cast(l_quantity as int) as units",
        "cast(round(l_extendedprice * 100) as bigint) as cents")
    lines.createOrReplaceTempView("_entrante")
    return lines


RULES_SQL = """
WITH inc AS (SELECT l_orderkey || '-' || l_linenumber AS line_id, l_partkey AS part, CAST(l_quantity AS INT) AS units,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem),
counts AS (SELECT 'negative_amount' AS name, 'stop' AS kind, count(*) AS affected FROM inc WHERE cents < 0
  UNION ALL SELECT 'huge_amount', 'stop', count(*) FROM inc WHERE cents > 10000000
  UNION ALL SELECT 'full_box', 'alarma', count(*) FROM inc WHERE units = 50)"""


@query(RULES_SQL + " SELECT name, kind, CAST(affected > 0 AS VARCHAR) AS fired, affected FROM counts")
def rule_results(t: Tables) -> DataFrame:
    entrante(t)
    found = rules.evaluate(t.spark, LINE_RULES, variables.context({"limit": 10_000_000}))
    return found.select("name", "kind", F.col("fired").cast("string").alias("fired"), "affected")


@query(RULES_SQL + """,
details AS (
  SELECT 'huge_amount' AS name, CAST(to_json(list(d ORDER BY cents DESC, line_id, part)) AS VARCHAR) AS detail FROM (
    SELECT {'line_id': line_id, 'cents': cents} AS d, cents, line_id, part FROM inc WHERE cents > 10000000 ORDER BY cents DESC, line_id, part LIMIT 5)
  UNION ALL SELECT 'full_box', CAST(to_json(list(d ORDER BY line_id, part, cents)) AS VARCHAR) FROM (
    SELECT {'line_id': line_id, 'part': part} AS d, line_id, part, cents FROM inc WHERE units = 50 ORDER BY line_id, part, cents LIMIT 3))
SELECT CAST(7 AS BIGINT) AS run_id, 'carga:lineas' AS origin, c.name, c.kind, CASE c.name WHEN 'huge_amount'
  THEN 'A line amount is above the limit.' ELSE 'Lines of exactly one full box.' END AS message, c.affected, d.detail
FROM counts c JOIN details d USING (name) WHERE c.affected > 0""")
def rule_log(t: Tables) -> DataFrame:
    entrante(t)
    found = rules.evaluate(t.spark, LINE_RULES, variables.context({"limit": 10_000_000}))
    return rules.fired_log(found, 7, "carga:lineas")


@query("""
SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance FROM supplier""")
def invariant_guard(t: Tables) -> DataFrame:
    """A candidate that breaks a stop is not published: the table stays as it was."""
    current = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    candidate = current.withColumn("name", F.when(F.col("balance") < 0, F.lit(None)).otherwise(F.col("name")))
    invariant = rules.Rule("named", rules.STOP, "Every supplier has a name.", "SELECT id FROM proveedor WHERE name IS NULL")
    try:
        return rules.guard_write(candidate, "proveedor", [invariant])[0]
    except rules.StopError:
        return current


@query("""
SELECT o_orderstatus AS status, count(*) AS orders, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents
FROM orders, (SELECT max(o_orderdate) AS last_day, CAST(avg(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS mean_cents FROM orders) v
WHERE o_orderdate >= v.last_day - INTERVAL 365 DAY AND CAST(round(o_totalprice * 100) AS BIGINT) > v.mean_cents GROUP BY 1""")
def scalar_variables(t: Tables) -> DataFrame:
    """Variables captured from a one-row query and bound into the next one."""
    t.orders.createOrReplaceTempView("pedido")
    captured = variables.capture(t.spark, """SELECT cast(max(o_orderdate) as date) AS last_day,
        cast(round(avg(cast(round(o_totalprice * 100) as bigint))) as bigint) AS mean_cents FROM pedido""")
    return variables.bound(t.spark, """SELECT o_orderstatus AS status, count(*) AS orders, sum(cast(round(o_totalprice * 100) as bigint)) AS cents
        FROM pedido WHERE o_orderdate >= date_sub(:v_last_day, :p_days) AND cast(round(o_totalprice * 100) as bigint) > :v_mean_cents
        GROUP BY o_orderstatus""", variables.context({"days": 365}, captured))


@query("""
SELECT p_type AS genre, CAST(sum(l_quantity) AS BIGINT) AS units,
       CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) / 100.0::DOUBLE AS amount
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type""")
def report_by_group(t: Tables) -> DataFrame:
    """Units and amount per genre, largest first. Lines are summed per part before they meet the parts."""
    per_part = t.lineitem.groupBy("l_partkey").agg(
        F.sum("l_quantity").alias("q"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("c"))
    return per_part.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_type").alias("genre")).agg(
        F.sum("q").cast("bigint").alias("units"), (F.sum("c") / 100).alias("amount")).orderBy(F.col("amount").desc())


@query("""
SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, c_name AS customer, n_name AS nation, r_name AS region, o_totalprice AS amount
FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey
LEFT JOIN region ON r_regionkey = n_regionkey""")
def star_view(t: Tables) -> DataFrame:
    """The consumption view: facts with the labels of their dimensions."""
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left").join(
        t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(
        t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return rows.select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("c_name").alias("customer"),
        F.col("n_name").alias("nation"), F.col("r_name").alias("region"), F.col("o_totalprice").alias("amount"))


SALES_LOAD = {
    "nombre": "lineas", "patron": "*.csv", "delimitador": ";", "encoding": "utf-8", "fila_cabecera": 1, "tabla_destino": "venta",
    "campos_singularidad": SALES_KEYS, "mapping": SALES_MAPPING,
    "validaciones": [{"nombre": "sin_importe", "tipo": "alarma", "mensaje": "A sale without an amount.", "sql": "SELECT party FROM _entrante WHERE amount IS NULL"}],
}


AS_WRITTEN = {"header": True, "sep": ";", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def sales_files(t: Tables) -> str:
    """The raw sales written as delimited files with a header, one folder level below the shared one."""
    folder = new_folder(t.spark, "sales")
    raw_sales(t).drop("_file").write.options(**AS_WRITTEN).csv(folder)
    return folder


def sales_store(t: Tables) -> Store:
    store = load.prepare(Store(t.spark, new_folder(t.spark, "store")))
    store.create("venta", "sale_date date, party bigint, amount double, origin string", bucket_keys=SALES_KEYS, buckets=8)
    store.publish(store.append("venta", sales_target(t)))
    return store


@query("""
SELECT strftime(l_shipdate, '%d/%m/%Y') AS fecha, ' ' || l_suppkey || ' ' AS socio,
       CAST(l_returnflag = 'R' AS VARCHAR) AS pending, count(*) AS n
FROM lineitem GROUP BY 1, 2, 3""")
def csv_scan(t: Tables) -> DataFrame:
    """Text files of a folder read back by header name, cells as they were written."""
    rows = scan_csv(t.spark, sales_files(t), ";", pattern="*.csv").rows
    return rows.groupBy("fecha", "socio", (F.col("importe") == "pendiente").cast("string").alias("pending")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS rows, 'true' AS numbered FROM lineitem")
def line_numbers(t: Tables) -> DataFrame:
    """Line numbers are those of the file: from the header on, without a gap, in every file."""
    rows = scan_csv(t.spark, sales_files(t), ";", pattern="*.csv").rows
    per_file = rows.groupBy("_file").agg(
        F.count("*").alias("n"), F.min("_row_num").alias("lo"), F.max("_row_num").alias("hi"), F.sum("_row_num").alias("s"))
    gapless = (F.col("lo") == 2) & (F.col("hi") == F.col("n") + 1) & (F.col("s") * 2 == F.col("n") * (F.col("n") + 3))
    return per_file.agg(F.sum("n").alias("rows"), F.bool_and(gapless).cast("string").alias("numbered"))


@query(SALES_SQL + """
SELECT * FROM target t WHERE NOT EXISTS (SELECT 1 FROM incoming i WHERE i.sale_date = t.sale_date AND i.party = t.party)
UNION ALL SELECT * FROM incoming""")
def declared_load(t: Tables) -> DataFrame:
    """The whole cycle from one file set: hash, scan, evidence, mapping, rules, replacement, publication."""
    store = sales_store(t)
    load.run_load(t.spark, store, {**SALES_LOAD, "carpeta": sales_files(t)}, unit="folder")
    return store.read("venta").withColumn("sale_date", F.col("sale_date").cast("string"))


@query("""
SELECT CASE WHEN l_returnflag = 'R' THEN 'ERROR' ELSE 'OK' END AS outcome, count(*) AS n,
       CASE WHEN l_returnflag = 'R' THEN 'amount' END AS field FROM lineitem GROUP BY ALL""")
def dry_run(t: Tables) -> DataFrame:
    """Counts of a load that writes no table."""
    found = load.dry_run(t.spark, {**SALES_LOAD, "carpeta": sales_files(t)})
    totals = found["counts"].agg(F.sum("rows_ok").alias("ok"), F.sum("rows_rejected").alias("bad"))
    split = totals.select(F.expr("stack(2, 'OK', ok, 'ERROR', bad) AS (outcome, n)")).filter("n > 0")
    fields = found["rejected"].select(F.lit("ERROR").alias("outcome"), "field").distinct()
    return split.join(fields, "outcome", "left")


@query("""
SELECT strftime(l_shipdate, '%Y-%m-%d') AS sale_date, l_suppkey AS party,
    CAST(round(l_extendedprice * 100) AS BIGINT) / 100.0::DOUBLE AS amount, 'lineas' AS origin
FROM lineitem WHERE l_returnflag <> 'R'""")
def folder_stream(t: Tables) -> DataFrame:
    """Files taken up by Structured Streaming, each content once; a second pass over the folder adds nothing."""
    store = load.prepare(Store(t.spark, new_folder(t.spark, "store")))
    store.create("venta", "sale_date date, party bigint, amount double, origin string")
    definition = {**SALES_LOAD, "carpeta": sales_files(t), "campos_singularidad": []}
    checkpoint = new_folder(t.spark, "checkpoint")
    for _ in range(2):
        watch_folder(t.spark, store, definition, checkpoint, unit="folder").awaitTermination()
    return store.read("venta").withColumn("sale_date", F.col("sale_date").cast("string"))


SNAPSHOT_TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


@query(" UNION ALL ".join(f"SELECT '{n}' AS \"table\", count(*) AS expected, count(*) AS restored, 'ok' AS status FROM {n}" for n in SNAPSHOT_TABLES))
def snapshot_verify(t: Tables) -> DataFrame:
    """Every table copied, restored to a new place and compared with the manifest."""
    folder = new_folder(t.spark, "snapshot")
    snapshot.take_snapshot({n: getattr(t, n) for n in SNAPSHOT_TABLES}, folder)
    return snapshot.restore_snapshot(t.spark, folder, new_folder(t.spark, "restored"))


CENTS = "cast(round(o_totalprice * 100) as bigint)"


@query(f"""
SELECT 'pedido' AS "table", o_orderpriority AS part, count(*) AS rows, sum({CENTS}) AS cents, 'named' AS kept, 'ok' AS status
FROM orders WHERE o_orderpriority <> '1-URGENT' GROUP BY ALL
UNION ALL SELECT 'pedido', o_orderpriority, count(*), sum(2 * {CENTS}), 'copied', 'ok'
FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey % 2 = 0 GROUP BY ALL
UNION ALL SELECT 'socio', NULL, count(*), sum(cast(round(c_acctbal * 100) as bigint)), 'named', 'ok' FROM customer""")
def store_snapshot(t: Tables) -> DataFrame:
    """A store as of one moment, on top of an earlier snapshot, restored as a store: one priority changed between the two.

    What the store publishes after the moment is not in it. `kept` tells which folders the second snapshot copied itself.
    """
    store = Store(t.spark, new_folder(t.spark, "store"))
    store.create("pedido", "o_orderkey bigint, o_orderpriority string, cents bigint", part_col="o_orderpriority")
    store.create("socio", "c_custkey bigint, cents bigint")
    orders = t.orders.selectExpr("o_orderkey", "o_orderpriority", f"{CENTS} as cents")
    partners = t.customer.selectExpr("c_custkey", "cast(round(c_acctbal * 100) as bigint) as cents")
    store.publish(store.append("pedido", orders) + store.append("socio", partners))
    first, second, restored = (new_folder(t.spark, label) for label in ("first", "second", "restored"))
    store_copy.take(store, first)
    changed = stage(orders.where("o_orderpriority = '1-URGENT' AND o_orderkey % 2 = 0").withColumn("cents", F.col("cents") * 2), "changed")
    store.publish(store.replace("pedido", changed, ["o_orderpriority"], changed.count())[0])
    made = store_copy.take(store, second, base=first)
    store.publish(store.overwrite("pedido", orders.limit(0)) + store.overwrite("socio", partners.limit(0)))
    status = store_copy.restore(t.spark, second, restored).select("table", "status")
    opened = Store(t.spark, restored)
    rows = opened.read("pedido").select(F.lit("pedido").alias("table"), F.col("o_orderpriority").alias("part"), "cents").unionByName(
        opened.read("socio").select(F.lit("socio").alias("table"), F.lit(None).cast("string").alias("part"), "cents"))
    content = rows.groupBy("table", "part").agg(F.count("*").alias("rows"), F.sum("cents").alias("cents"))
    folders = made.where("path IS NOT NULL").select(
        F.col("table").alias("_t"), F.col("part").alias("_p"), F.when(F.startswith("path", F.lit(f"{second}/")), "copied").otherwise("named").alias("kept"))
    shown = content.join(folders, (F.col("table") == F.col("_t")) & F.col("part").eqNullSafe(F.col("_p")), "left").drop("_t", "_p")
    return shown.join(status, "table")


@query(f"""
SELECT o_orderstatus AS status, o_orderstatus <> 'P' AS stays, count(*) AS rows,
       sum(CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN 2 ELSE 1 END * {CENTS}) AS cents
FROM orders GROUP BY ALL""")
def replace_folders(t: Tables) -> DataFrame:
    """Three deliveries in a table that nothing keeps apart, then a replacement whose keys one of them holds: the others' folders stay."""
    store = Store(t.spark, new_folder(t.spark, "store"))
    store.create("pedido", "o_orderkey bigint, o_orderstatus string, o_orderpriority string, cents bigint")
    orders = t.orders.selectExpr("o_orderkey", "o_orderstatus", "o_orderpriority", f"{CENTS} as cents")
    for status in "FOP":
        store.publish(store.append("pedido", orders.where(F.col("o_orderstatus") == status)))
    before = {e.path for e in store._live("pedido")}
    changed = stage(orders.where("o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'").withColumn("cents", F.col("cents") * 2), "changed")
    store.publish(store.replace("pedido", changed, ["o_orderstatus", "o_orderpriority"], changed.count())[0])
    kept = [e for e in store._live("pedido") if e.path in before]
    new = [e for e in store._live("pedido") if e.path not in before]
    rows = store._rows("pedido", kept).withColumn("stays", F.lit(True)).unionByName(store._rows("pedido", new).withColumn("stays", F.lit(False)))
    return rows.groupBy(F.col("o_orderstatus").alias("status"), "stays").agg(F.count("*").alias("rows"), F.sum("cents").alias("cents"))
