"""Column operations, rejects and date columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queries import Tables, query
from siftwell.functions.casts import cast_to
from siftwell.functions.dates import serial_date
from siftwell.functions.text import identifier
from siftwell.operators import date_evidence, mapping

SPANISH_CENTS = """concat(case when {c} >= 100000
    then concat(cast({c} div 100000 as string), '.', lpad(cast({c} div 100 % 1000 as string), 3, '0'))
    else cast({c} div 100 as string) end, ',', lpad(cast({c} % 100 as string), 2, '0'))"""


def raw_lineitem(t: Tables) -> DataFrame:
    """lineitem as the text a file would hold."""
    cents = "cast(round(l_extendedprice * 100) as bigint)"
    return t.lineitem.selectExpr(
        "cast(l_orderkey as string) as order_ref",
        "cast(l_linenumber as string) as line_ref",
        "concat(' ', cast(cast(l_quantity as bigint) as string), case l_linestatus when 'O' then '.9' else ' ' end) as quantity",
        f"{SPANISH_CENTS.format(c=cents)} as amount",
        "case l_returnflag when 'A' then ' Sí ' when 'N' then 'no' else 'VERDADERO' end as returned",
        "case l_linestatus when 'O' then date_format(l_shipdate, 'yyyy-MM-dd') else date_format(l_shipdate, 'yyyyMMdd') end as shipped",
        "concat(decode(unhex('C2A0'), 'UTF-8'), ' ', l_linestatus, '\\t ') as note")


LINEITEM_MAPPING = [
    {"origen": "order_ref", "destino": "order_key", "operaciones": [{"tipo": "cast", "tipo_destino": "integer"}]},
    {"origen": "line_ref", "destino": "line", "operaciones": [{"tipo": "rename"}, {"tipo": "cast", "tipo_destino": "integer"}]},
    {"origen": "quantity", "destino": "units", "operaciones": [{"tipo": "trim"}, {"tipo": "cast", "tipo_destino": "integer"}]},
    {"origen": "amount", "destino": "amount", "operaciones": [{"tipo": "cast", "tipo_destino": "double", "formato_numerico": "es"}]},
    {"origen": "returned", "destino": "returned", "operaciones": [{"tipo": "cast", "tipo_destino": "boolean"}]},
    {"origen": "shipped", "destino": "shipped", "operaciones": [{"tipo": "cast", "tipo_destino": "date"}]},
    {"origen": "note", "destino": "note", "operaciones": [{"tipo": "trim"}]},
    {"destino": "origen_carga", "operaciones": [{"tipo": "const", "valor": "lineas"}]},
    {"destino": "shop", "operaciones": [{"tipo": "parametro", "nombre": "tienda"}]},
]


@query("""
SELECT l_orderkey AS order_key, CAST(l_linenumber AS BIGINT) AS line, CAST(l_quantity AS BIGINT) AS units,
       CAST(round(l_extendedprice * 100) AS BIGINT) / 100.0::DOUBLE AS amount,
       CASE WHEN l_returnflag = 'N' THEN 'false' ELSE 'true' END AS returned,
       strftime(l_shipdate, '%Y-%m-%d') AS shipped, l_linestatus AS note,
       'lineas' AS origen_carga, 'Gran Via' AS shop
FROM lineitem""")
def typed_mapping(t: Tables) -> DataFrame:
    mapped = mapping.map_rows(raw_lineitem(t), LINEITEM_MAPPING, {"tienda": "Gran Via"})
    return mapping.valid_rows(mapped).withColumn("returned", F.col("returned").cast("string")).withColumn(
        "shipped", F.col("shipped").cast("string"))


def raw_orders(t: Tables) -> DataFrame:
    """orders as text: low-priority rows carry a prefixed customer, pending ones no amount."""
    cents = "cast(round(o_totalprice * 100) as bigint)"
    return t.orders.selectExpr(
        "o_orderpriority as _file",
        "cast(o_orderkey as string) as order_ref",
        "case o_orderpriority when '5-LOW' then concat('C-', o_custkey) else cast(o_custkey as string) end as customer",
        f"case o_orderstatus when 'P' then 'n/d' else {SPANISH_CENTS.format(c=cents)} end as amount",
        "case o_orderstatus when 'O' then 'yes' when 'F' then 'No' else 'quizas' end as open")


ORDERS_MAPPING = [
    {"origen": "order_ref", "destino": "order_key", "operaciones": [{"tipo": "cast", "tipo_destino": "integer"}]},
    {"origen": "customer", "destino": "customer", "operaciones": [{"tipo": "cast", "tipo_destino": "integer"}]},
    {"origen": "amount", "destino": "amount", "operaciones": [{"tipo": "cast", "tipo_destino": "double", "formato_numerico": "es"}]},
    {"origen": "open", "destino": "open", "operaciones": [{"tipo": "cast", "tipo_destino": "boolean"}]},
]

RAW_ORDERS_SQL = """
WITH cents AS (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders),
raw AS (SELECT o_orderpriority AS file, CAST(o_orderkey AS VARCHAR) AS order_ref,
  CASE o_orderpriority WHEN '5-LOW' THEN 'C-' || o_custkey ELSE CAST(o_custkey AS VARCHAR) END AS customer,
  CASE o_orderstatus WHEN 'P' THEN 'n/d' ELSE
    CASE WHEN c >= 100000 THEN (c // 100000) || '.' || lpad(CAST(c // 100 % 1000 AS VARCHAR), 3, '0')
         ELSE CAST(c // 100 AS VARCHAR) END || ',' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') END AS amount,
  CASE o_orderstatus WHEN 'O' THEN 'yes' WHEN 'F' THEN 'No' ELSE 'quizas' END AS open
  FROM cents),
typed AS (SELECT *, TRY_CAST(customer AS BIGINT) AS customer_n,
  TRY_CAST(replace(replace(amount, '.', ''), ',', '.') AS DOUBLE) AS amount_n FROM raw)"""


@query(RAW_ORDERS_SQL + """
SELECT file, CASE WHEN customer_n IS NULL THEN 'customer' WHEN amount_n IS NULL THEN 'amount' ELSE 'open' END AS field,
       CASE WHEN customer_n IS NULL THEN 'could not convert string to float: ''' || customer || ''''
            WHEN amount_n IS NULL THEN 'could not convert string to float: ''' || amount || ''''
            ELSE 'not a boolean: ''' || open || '''' END AS reason,
       CAST(json_object('order_ref', order_ref, 'customer', customer, 'amount', amount, 'open', open) AS VARCHAR) AS raw
FROM typed WHERE customer_n IS NULL OR amount_n IS NULL OR open = 'quizas'""")
def reject_rows(t: Tables) -> DataFrame:
    return mapping.rejected_rows(mapping.map_rows(raw_orders(t), ORDERS_MAPPING)).withColumnRenamed("_file", "file")


@query(RAW_ORDERS_SQL + """
SELECT CAST(order_ref AS BIGINT) AS order_key, customer_n AS customer, amount_n AS amount,
       CASE open WHEN 'yes' THEN 'true' ELSE 'false' END AS open
FROM typed WHERE customer_n IS NOT NULL AND amount_n IS NOT NULL AND open <> 'quizas'""")
def accepted_rows(t: Tables) -> DataFrame:
    valid = mapping.valid_rows(mapping.map_rows(raw_orders(t), ORDERS_MAPPING))
    return valid.select("order_key", "customer", "amount", F.col("open").cast("string").alias("open"))


@query(RAW_ORDERS_SQL + """
SELECT file, count(*) AS rows_read,
       count(*) FILTER (customer_n IS NOT NULL AND amount_n IS NOT NULL AND open <> 'quizas') AS rows_ok,
       count(*) FILTER (customer_n IS NULL OR amount_n IS NULL OR open = 'quizas') AS rows_rejected
FROM typed GROUP BY file""")
def load_counters(t: Tables) -> DataFrame:
    counts = mapping.row_counts(mapping.map_rows(raw_orders(t), ORDERS_MAPPING))
    return counts.withColumnRenamed("_file", "file")


@query("""
SELECT c_custkey AS customer, c_name AS name,
       CAST(json_object('balance', CAST(CAST(round(c_acctbal * 100) AS BIGINT) AS VARCHAR), 'nation',
            CASE WHEN c_nationkey > 0 THEN CAST(c_nationkey AS VARCHAR) END, 'segment', c_mktsegment) AS VARCHAR) AS extra_fields
FROM customer""")
def extra_fields(t: Tables) -> DataFrame:
    raw = t.customer.selectExpr(
        "cast(c_custkey as string) as ref", "c_name as name", "c_mktsegment as segment",
        "case when c_nationkey > 0 then cast(c_nationkey as string) end as nation",
        "cast(cast(round(c_acctbal * 100) as bigint) as string) as balance")
    fields = [
        {"origen": "ref", "destino": "customer", "operaciones": [{"tipo": "cast", "tipo_destino": "integer"}]},
        {"origen": "name", "destino": "name", "operaciones": [{"tipo": "cast", "tipo_destino": "varchar"}]}]
    return mapping.valid_rows(mapping.map_rows(raw, fields))


def raw_order_dates(t: Tables) -> DataFrame:
    """Each priority writes its dates in its own way."""
    return t.orders.selectExpr(
        "o_orderpriority as _file", "o_orderkey as _row_num",
        """case o_orderpriority
             when '1-URGENT' then date_format(o_orderdate, 'dd/MM/yyyy')
             when '2-HIGH' then date_format(o_orderdate, ' MM/dd/yyyy')
             when '3-MEDIUM' then cast(date_diff(cast(o_orderdate as date), date'1899-12-30') as string)
             when '4-NOT SPECIFIED' then date_format(o_orderdate, 'MM/MM/yyyy')
             else case o_orderstatus when 'P' then date_format(o_orderdate, 'dd/MM/yyyy') else date_format(o_orderdate, 'MM/dd/yyyy') end
           end as ordered""")


RAW_DATES_SQL = """
WITH raw AS (SELECT o_orderpriority AS file, o_orderkey AS order_key, CASE o_orderpriority
    WHEN '1-URGENT' THEN strftime(o_orderdate, '%d/%m/%Y') WHEN '2-HIGH' THEN strftime(o_orderdate, ' %m/%d/%Y')
    WHEN '3-MEDIUM' THEN CAST(date_diff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE)) AS VARCHAR)
    WHEN '4-NOT SPECIFIED' THEN strftime(o_orderdate, '%m/%m/%Y')
    ELSE CASE o_orderstatus WHEN 'P' THEN strftime(o_orderdate, '%d/%m/%Y') ELSE strftime(o_orderdate, '%m/%d/%Y') END
  END AS ordered FROM orders),
parts AS (SELECT *, trim(ordered) AS txt, TRY_CAST(split_part(trim(ordered), '/', 1) AS INT) AS p1,
  TRY_CAST(split_part(trim(ordered), '/', 2) AS INT) AS p2 FROM raw),
flags AS (SELECT file, bool_and(coalesce(TRY_CAST(txt AS DOUBLE) BETWEEN 1 AND 60000, false)) AS serial,
  coalesce(bool_or(p1 > 12 AND txt LIKE '%/%'), false) AS dm, coalesce(bool_or(p2 > 12), false) AS md FROM parts GROUP BY file),
settled AS (SELECT file, CASE WHEN serial THEN 'serial' WHEN dm <> md THEN 'format' END AS mode,
  CASE WHEN serial THEN '1900' WHEN dm AND NOT md THEN '%d/%m/%Y' WHEN md AND NOT dm THEN '%m/%d/%Y' END AS format,
  CASE WHEN serial OR dm <> md THEN NULL
    WHEN dm THEN 'contradictory evidence: some values can only be day/month and others only month/day'
    ELSE 'no evidence in the column to tell day/month from month/day' END AS error FROM flags)"""

DATE_MAPPING = [{"origen": "ordered", "destino": "ordered", "operaciones": [
    {"tipo": "date_format", "formatos": ["%d/%m/%Y", "%m/%d/%Y"]}]}]


@query(RAW_DATES_SQL + " SELECT file, mode, format, error FROM settled")
def date_evidence_per_file(t: Tables) -> DataFrame:
    settled = date_evidence.settle_dates(raw_order_dates(t), mapping.date_fields(DATE_MAPPING))
    return settled.select(F.col("_file").alias("file"), "_dates.ordered.*")


@query(RAW_DATES_SQL + " SELECT file, 'ordered' AS field, error FROM settled WHERE error IS NOT NULL")
def date_unresolved(t: Tables) -> DataFrame:
    fields = mapping.date_fields(DATE_MAPPING)
    return date_evidence.unresolved(date_evidence.settle_dates(raw_order_dates(t), fields), fields).withColumnRenamed("_file", "file")


@query(RAW_DATES_SQL + """
SELECT p.order_key, CASE WHEN s.mode = 'serial' THEN strftime(DATE '1899-12-30' + CAST(p.txt AS INT), '%Y-%m-%d')
       WHEN s.format = '%d/%m/%Y' THEN strftime(strptime(p.txt, '%d/%m/%Y'), '%Y-%m-%d')
       WHEN s.format = '%m/%d/%Y' THEN strftime(strptime(p.txt, '%m/%d/%Y'), '%Y-%m-%d') END AS ordered,
       CASE WHEN s.error IS NULL THEN 'ok' ELSE 'rejected' END AS outcome
FROM parts p JOIN settled s USING (file)""")
def date_parse(t: Tables) -> DataFrame:
    rows = raw_order_dates(t)
    settled = date_evidence.settle_dates(rows, mapping.date_fields(DATE_MAPPING))
    mapped = mapping.map_rows(date_evidence.attach_dates(rows, settled), DATE_MAPPING)
    return mapped.select(
        F.col("_row_num").alias("order_key"), F.col("ordered").cast("string").alias("ordered"),
        F.when(F.col("_reject").isNull(), "ok").otherwise("rejected").alias("outcome"))


@query("""
SELECT o_orderkey AS order_key, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS ordered_1900,
       strftime(CAST(o_orderdate AS DATE) + 1462, '%Y-%m-%d') AS ordered_1904 FROM orders""")
def excel_serial(t: Tables) -> DataFrame:
    """The day number counted from the older epoch, read under both epochs."""
    text = F.concat(F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1899-12-30").cast("date")).cast("string"), F.lit(".75"))
    return t.orders.select(
        F.col("o_orderkey").alias("order_key"), serial_date(text).cast("string").alias("ordered_1900"),
        serial_date(text, "1904").cast("string").alias("ordered_1904"))


@query("""
SELECT o_orderkey AS order_key, CASE WHEN o_orderpriority <> '5-LOW' THEN strftime(o_orderdate, '%Y-%m-%d') END AS ordered,
       CASE WHEN o_orderpriority = '5-LOW' THEN 'Invalid isoformat string: ''' || strftime(o_orderdate, '%d/%m/%Y') || '''' END AS error
FROM orders""")
def iso_cast(t: Tables) -> DataFrame:
    """Every ISO spelling; the priority decides which one a row uses."""
    raw = t.orders.selectExpr("o_orderkey as order_key", """case o_orderpriority
        when '1-URGENT' then date_format(o_orderdate, 'yyyy-MM-dd') when '2-HIGH' then date_format(o_orderdate, 'yyyyMMdd')
        when '3-MEDIUM' then concat(date_format(o_orderdate, 'yyyy-MM-dd'), 'T10:30:00.5+02:00 ')
        when '4-NOT SPECIFIED' then concat(extract(YEAROFWEEK from o_orderdate), '-W', lpad(weekofyear(o_orderdate), 2, '0'), '-', weekday(o_orderdate) + 1)
        else date_format(o_orderdate, 'dd/MM/yyyy') end as txt""")
    value, error = cast_to(F.col("txt"), "date")
    return raw.select("order_key", value.cast("string").alias("ordered"), error.alias("error"))


CELLS_SQL = """
WITH cells AS (SELECT o_orderstatus AS file, 'B5' AS ref, max(o_orderpriority) AS value FROM orders GROUP BY 1
  UNION ALL SELECT o_orderstatus, 'B6', CAST(min(year(o_orderdate)) AS VARCHAR) FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)"""

CELL_MAPPING = [
    {"origen": "order_ref", "destino": "order_key", "operaciones": [{"tipo": "cast", "tipo_destino": "integer"}]},
    {"destino": "branch", "operaciones": [{"tipo": "celda", "referencia": "B5"}, {"tipo": "trim"}]},
    {"destino": "first_year", "operaciones": [{"tipo": "celda", "referencia": "B6"}, {"tipo": "cast", "tipo_destino": "integer"}]},
]


@query(CELLS_SQL + """
SELECT CAST(o_orderkey AS VARCHAR) AS order_key, b.value AS branch, y.value AS first_year,
       CASE WHEN y.value IS NULL THEN 'first_year: header cell B6 could not be read' END AS error
FROM orders JOIN cells b ON b.file = o_orderstatus AND b.ref = 'B5' LEFT JOIN cells y ON y.file = o_orderstatus AND y.ref = 'B6'""")
def file_cells(t: Tables) -> DataFrame:
    """Header values of each 'file' (order status); one file lacks a cell, which rejects its rows."""
    rows = t.orders.selectExpr("o_orderstatus as _file", "cast(o_orderkey as string) as order_ref")
    cells = t.orders.groupBy(F.col("o_orderstatus").alias("file")).agg(
        F.max("o_orderpriority").alias("B5"), F.min(F.year("o_orderdate")).cast("string").alias("B6"))
    cells = cells.select("file", F.explode(F.create_map(F.lit("B5"), "B5", F.lit("B6"), "B6")).alias("ref", "value")).filter(
        "NOT (file = 'P' AND ref = 'B6')")
    mapped = mapping.map_rows(mapping.attach_cells(rows, cells, mapping.cell_references(CELL_MAPPING)), CELL_MAPPING)
    return mapped.select(
        F.col("order_key").cast("string").alias("order_key"), "branch", F.col("first_year").cast("string").alias("first_year"),
        F.concat_ws(": ", "_reject.field", "_reject.reason").alias("error")).withColumn("error", F.nullif("error", F.lit("")))


@query("""
SELECT p_partkey AS part, 'part_' || replace(p_name, ' ', '_') || '_size' || '_e_n_fi' AS name,
       'c_' || p_size || '_' || lower(p_type) AS sized FROM part""")
def normalise_identifiers(t: Tables) -> DataFrame:
    """Accents, ligatures and punctuation in the label are folded away."""
    label = F.concat(F.lit("¿Part: "), "p_name", F.lit(" — Size (é/Ñ)  ﬁ! "))
    sized = F.concat(F.col("p_size").cast("string"), F.lit("·"), "p_type")
    return t.part.select(
        F.col("p_partkey").alias("part"), identifier(label, F.lit(1)).alias("name"), identifier(sized, F.lit(2)).alias("sized"))
