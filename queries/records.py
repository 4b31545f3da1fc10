"""Lookups, listings and batches of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queries import Tables, query
from siftwell.operators import changes, listing, lookup
from siftwell.operators.contracts import Contract, violation_counts

CATALOGUE = {
    "nation": {"entidad": "nation", "tabla": "nation", "etiqueta": "label", "campos": {
        "id": {"tipo": "uuid", "sistema": True}, "label": {"tipo": "varchar"}, "region_id": {"tipo": "uuid"}},
        "relaciones": [{"campo": "region_id", "entidad_destino": "region"}]},
    "region": {"entidad": "region", "tabla": "region", "campos": {
        "id": {"tipo": "uuid", "sistema": True}, "nombre": {"tipo": "varchar"}}},
    "client": {"entidad": "client", "tabla": "client", "campos": {
        "id": {"tipo": "uuid", "sistema": True}, "nombre": {"tipo": "varchar", "sinonimos": ["Razon"]},
        "nation_id": {"tipo": "uuid"}, "saldo": {"tipo": "double"},
        "segmento": {"tipo": "varchar", "validacion": {"lista_valores": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]}},
        "ejecucion_id": {"tipo": "integer", "sistema": True}},
        "relaciones": [{"campo": "nation_id", "entidad_destino": "nation"}]},
}


def tables(t: Tables) -> dict[str, DataFrame]:
    """The given tables under the catalogue's names."""
    return {
        "region": t.region.select(F.col("r_regionkey").cast("string").alias("id"), F.col("r_name").alias("nombre")),
        "nation": t.nation.select(
            F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("label"), F.col("n_regionkey").cast("string").alias("region_id")),
        "client": t.customer.select(
            F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("nombre"), F.col("c_nationkey").cast("string").alias("nation_id"),
            F.col("c_acctbal").alias("saldo"), F.col("c_mktsegment").alias("segmento"), F.lit(1).cast("bigint").alias("ejecucion_id")),
    }


@query("""
SELECT c_custkey AS customer, CASE WHEN c_mktsegment = 'FURNITURE' THEN NULL ELSE CAST(c_nationkey AS VARCHAR) END AS nation_id,
       CASE WHEN c_mktsegment = 'FURNITURE' THEN 'missing' ELSE 'ok' END AS status FROM customer""")
def label_lookup(t: Tables) -> DataFrame:
    """Nations asked for by label in any case, by id, and by a name that does not exist."""
    asked = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("customer"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.col("n_nationkey").cast("string"))
        .when(F.col("c_mktsegment") == "FURNITURE", F.concat("n_name", F.lit("?")))
        .otherwise(F.concat(F.lit(" "), F.lower("n_name"))).alias("asked"))
    return lookup.resolve_labels(asked, "asked", tables(t)["nation"], "id", "label", "nation_id").drop("asked")


@query("""
WITH names AS (SELECT lower(p_name) AS name, count(*) AS n, min(p_partkey) AS id FROM part GROUP BY 1),
asked AS (SELECT p_partkey AS part, upper(p_name) AS txt FROM part UNION ALL SELECT -1 - p_partkey, p_name || ' ' || p_type FROM part)
SELECT part, CASE WHEN n = 1 THEN CAST(id AS VARCHAR) END AS found, CASE WHEN n = 1 THEN 'ok' WHEN n > 1 THEN 'ambiguous' ELSE 'missing' END AS status
FROM asked LEFT JOIN names ON lower(txt) = name""")
def lookup_ambiguous(t: Tables) -> DataFrame:
    """Part names repeat, so most name more than one part."""
    asked = t.part.select(F.col("p_partkey").alias("part"), F.upper("p_name").alias("asked")).unionByName(
        t.part.select((-1 - F.col("p_partkey")).alias("part"), F.concat_ws(" ", "p_name", "p_type").alias("asked")))
    found = lookup.resolve_labels(asked, "asked", t.part, "p_partkey", "p_name", "found")
    return found.select("part", F.col("found").cast("string").alias("found"), "status")


@query("""
SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS nombre, n_name AS nation, c_acctbal AS saldo, c_mktsegment AS segmento
FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""")
def list_labels(t: Tables) -> DataFrame:
    return listing.listing(CATALOGUE["client"], CATALOGUE, tables(t))


@query("""
SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS nombre, n_name AS nation, c_acctbal AS saldo, c_mktsegment AS segmento
FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey
WHERE lower(n_name) >= lower('Nation_15') AND c_acctbal >= 1000.5 AND c_mktsegment <> 'BUILDING'""")
def list_filter(t: Tables) -> DataFrame:
    filters = [listing.parse_filter(f) for f in ("nation>=Nation_15", "saldo>=1000,5", "segmento<>BUILDING")]
    return listing.listing(CATALOGUE["client"], CATALOGUE, tables(t), filters)


REQUESTS_SQL = """
WITH asked AS (SELECT s_suppkey AS request, s_name AS razon,
  CASE WHEN s_acctbal < 0 THEN 'Atlantis' ELSE upper(n_name) END AS nation,
  CASE WHEN n_regionkey = 0 THEN 'mucho' ELSE CAST(CAST(round(s_acctbal * 100) AS BIGINT) // 100 AS VARCHAR) || ',5' END AS saldo,
  CASE WHEN n_regionkey = 1 THEN 'FISHING' ELSE ' MACHINERY ' END AS segmento, n_nationkey, s_acctbal, n_regionkey
  FROM supplier JOIN nation ON n_nationkey = s_nationkey)"""


def requests(t: Tables) -> DataFrame:
    """New clients as text, some with an unknown nation, a balance in words or a segment off the list."""
    return t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("_request"), F.col("s_name").alias("Razon"),
        F.when(F.col("s_acctbal") < 0, "Atlantis").otherwise(F.upper("n_name")).alias("nation"),
        F.when(F.col("n_regionkey") == 0, "mucho").otherwise(
            F.concat(F.expr("cast(round(s_acctbal * 100) as bigint) div 100").cast("string"), F.lit(",5"))).alias("saldo"),
        F.when(F.col("n_regionkey") == 1, "FISHING").otherwise(" MACHINERY ").alias("segmento"))


@query(REQUESTS_SQL + """
SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS nombre, CAST(c_nationkey AS VARCHAR) AS nation_id, c_acctbal AS saldo,
       c_mktsegment AS segmento, CAST(1 AS BIGINT) AS ejecucion_id FROM customer
UNION ALL SELECT sha256('9|' || request), razon, CAST(n_nationkey AS VARCHAR), CAST(replace(saldo, ',', '.') AS DOUBLE), 'MACHINERY', 9
FROM asked WHERE s_acctbal >= 0 AND n_regionkey > 1""")
def batch_create(t: Tables) -> DataFrame:
    named = tables(t)
    return changes.create_rows(named["client"], requests(t), CATALOGUE["client"], CATALOGUE, named, 9)[0]


@query(REQUESTS_SQL + """
SELECT request, CASE WHEN s_acctbal < 0 THEN 'nation_id: missing nation: Atlantis'
  WHEN n_regionkey = 0 THEN 'saldo: not a valid double: ''mucho''' ELSE 'segmento: not an allowed value: FISHING' END AS error
FROM asked WHERE s_acctbal < 0 OR n_regionkey <= 1""")
def batch_create_rejects(t: Tables) -> DataFrame:
    named = tables(t)
    refused = changes.create_rows(named["client"], requests(t), CATALOGUE["client"], CATALOGUE, named, 9)[1]
    return refused.select(F.col("_request").alias("request"), F.col("_error").alias("error"))


EDIT_ENTITY = {"entidad": "order", "tabla": "order", "campos": {
    "id": {"tipo": "integer", "sistema": True}, "priority": {"tipo": "varchar"}, "total": {"tipo": "double"},
    "status": {"tipo": "varchar", "validacion": {"lista_valores": ["F", "O", "P", "X"]}},
    "updated_at": {"tipo": "timestamp", "sistema": True}}}


def order_records(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("total"),
        F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("updated_at"))


def order_changes(t: Tables) -> DataFrame:
    """One change per line: its quantity as total, its flag as status (N is not allowed), blank priority when open.

    Line keys reach beyond the orders when shifted, so some changes have no row.
    """
    return t.lineitem.select(
        (F.col("l_orderkey") + F.col("l_suppkey")).alias("id"),
        F.struct(F.col("l_shipdate"), "l_partkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus", "l_extendedprice").alias("seq"),
        F.when(F.col("l_linestatus") == "O", F.create_map(F.lit("priority"), F.lit(" "), F.lit("total"), F.col("l_quantity").cast("string")))
        .otherwise(F.create_map(F.lit("status"), F.when(F.col("l_returnflag") == "N", "N").otherwise("X"))).alias("fields"))


EDIT_SQL = """
WITH ch AS (SELECT l_orderkey + l_suppkey AS id, l_linestatus AS st, l_returnflag AS rf, l_quantity AS q,
  row_number() OVER (PARTITION BY l_orderkey + l_suppkey, l_linestatus ORDER BY l_shipdate DESC, l_partkey DESC, l_linenumber DESC,
    l_quantity DESC, l_returnflag DESC, l_extendedprice DESC) AS rn FROM lineitem),
last AS (SELECT id, max(CASE WHEN st = 'O' THEN q END) AS total, max(CASE WHEN st = 'F' THEN CASE rf WHEN 'N' THEN 'N' ELSE 'X' END END) AS status
  FROM ch WHERE rn = 1 GROUP BY id)"""


@query(EDIT_SQL + """
SELECT o_orderkey AS id, CASE WHEN l.total IS NOT NULL THEN NULL ELSE o_orderpriority END AS priority,
       coalesce(l.total, o_totalprice) AS total, coalesce(l.status, o_orderstatus) AS status,
       CASE WHEN l.id IS NULL THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '2026-01-01' END AS updated
FROM orders LEFT JOIN (SELECT * FROM last WHERE status IS DISTINCT FROM 'N') l ON l.id = o_orderkey""")
def batch_edit(t: Tables) -> DataFrame:
    """Later changes of a field win; a record with one bad value is left as it was."""
    now = F.lit("2026-01-01").cast("timestamp_ntz")
    edited, _ = changes.edit_rows(order_records(t), order_changes(t), EDIT_ENTITY, now)
    return edited.select("id", "priority", "total", "status", F.date_format("updated_at", "yyyy-MM-dd").alias("updated"))


@query(EDIT_SQL + """
SELECT id, CASE WHEN status = 'N' THEN 'status: not an allowed value' ELSE 'no such row' END AS error FROM last
WHERE status = 'N' OR id NOT IN (SELECT o_orderkey FROM orders)""")
def batch_edit_refused(t: Tables) -> DataFrame:
    now = F.lit("2026-01-01").cast("timestamp_ntz")
    return changes.edit_rows(order_records(t), order_changes(t), EDIT_ENTITY, now)[1]


RELABEL_SQL = """
WITH asked AS (SELECT CAST(c_custkey + (CASE WHEN c_custkey % 11 = 0 THEN 1000000 ELSE 0 END) AS VARCHAR) AS id, c_custkey % 7 AS kind, c_mktsegment AS segment,
  (c_nationkey + 1) % 25 AS nation FROM customer WHERE c_mktsegment <> 'BUILDING')"""


def relabelled(t: Tables) -> DataFrame:
    """One change per client outside BUILDING: the next nation by label, alias and id, an unknown one, a synonym, a field that is none; some clients do not exist."""
    following = (F.col("c_nationkey") + 1) % 25
    asked = t.customer.filter("c_mktsegment <> 'BUILDING'").join(t.nation.select(F.col("n_nationkey").alias("_n"), "n_name"), following == F.col("_n"))
    kind = F.col("c_custkey") % 7
    text = lambda name, value: F.create_map(F.lit(name), value)
    fields = (
        F.when(kind == 0, text("nation", F.upper("n_name"))).when(kind == 1, text("nation_id", F.col("_n").cast("string")))
        .when(kind == 2, text("nation", F.concat("n_name", F.lit("?")))).when(kind == 3, text("RAZON", F.concat(F.lit(" new "), F.col("c_name"))))
        .when(kind == 4, text("Nation_ID", F.lit(" "))).when(kind == 5, text("colour", F.lit("red"))).otherwise(text("saldo", F.lit("1000,5"))))
    far = F.when(F.col("c_custkey") % 11 == 0, 1000000).otherwise(0)
    return asked.select((F.col("c_custkey") + far).cast("string").alias("id"), F.lit(1).alias("seq"), fields.alias("fields"))


@query(RELABEL_SQL + """
SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN kind = 3 THEN 'new ' || c_name ELSE c_name END AS nombre,
  CASE WHEN kind IN (0, 1) THEN CAST(nation AS VARCHAR) WHEN kind = 4 THEN NULL ELSE CAST(c_nationkey AS VARCHAR) END AS nation_id,
  CASE WHEN kind = 6 THEN 1000.5 ELSE c_acctbal END AS saldo
FROM customer LEFT JOIN asked ON asked.id = CAST(c_custkey AS VARCHAR)""")
def batch_edit_labels(t: Tables) -> DataFrame:
    named = tables(t)
    now = F.lit("2026-01-01").cast("timestamp_ntz")
    edited, _ = changes.edit_rows(named["client"], relabelled(t), CATALOGUE["client"], now, catalogue=CATALOGUE, tables=named)
    return edited.select("id", "nombre", "nation_id", "saldo")


@query(RELABEL_SQL + """
SELECT id, CASE WHEN kind = 2 THEN 'nation_id: missing nation' WHEN kind = 5 THEN 'unknown field: colour' ELSE 'no such row' END AS error
FROM asked WHERE kind IN (2, 5) OR CAST(id AS BIGINT) >= 1000000""")
def batch_edit_labels_refused(t: Tables) -> DataFrame:
    named = tables(t)
    now = F.lit("2026-01-01").cast("timestamp_ntz")
    return changes.edit_rows(named["client"], relabelled(t), CATALOGUE["client"], now, catalogue=CATALOGUE, tables=named)[1]


@query(REQUESTS_SQL + """,
added AS (SELECT request, razon AS nombre, CAST(n_nationkey AS VARCHAR) AS nation_id, CAST(replace(saldo, ',', '.') AS DOUBLE) AS saldo FROM asked WHERE s_acctbal >= 0 AND n_regionkey > 1)
SELECT 'allowed:ejecucion_id' AS rule, count(*) AS violations FROM added HAVING count(*) > 0
UNION ALL SELECT 'check:saldo', count(*) FROM added WHERE saldo >= 5000 HAVING count(*) > 0
UNION ALL SELECT 'not_null:created_at', count(*) FROM added WHERE false HAVING count(*) > 0""")
def batch_create_contract(t: Tables) -> DataFrame:
    """What the rows of valid requests, stamped and defaulted, break of a contract before they are written."""
    named = tables(t)
    entity = CATALOGUE["client"] | {"campos": CATALOGUE["client"]["campos"] | {"created_at": {"tipo": "timestamp"}}}
    added, _ = changes.new_rows(requests(t), entity, CATALOGUE, named, 9, now=F.lit("2026-01-01").cast("timestamp_ntz"), defaults={"origen": F.lit("batch")})
    contract = Contract(not_null=["created_at", "origen", "ejecucion_id"], checks={"saldo": "saldo < 5000"}, allowed={"ejecucion_id": [1]})
    return violation_counts(added, contract)


@query("SELECT o_orderkey AS id, o_orderpriority AS priority FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def batch_delete(t: Tables) -> DataFrame:
    """Orders with a returned line are deleted."""
    ids = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return changes.delete_rows(order_records(t).select("id", "priority"), ids)


def stamped_events(t: Tables) -> DataFrame:
    """Events as rows written by runs: the user is the run, and error events predate the log."""
    return t.events.select(
        F.col("event_id").alias("id"), F.col("event_type").alias("kind"),
        F.when(F.col("event_type") != "error", F.col("user_id")).alias("ejecucion_id"))


@query("SELECT event_id AS id, event_type AS kind FROM events WHERE event_type = 'error' OR user_id <> 17")
def undo_run(t: Tables) -> DataFrame:
    return changes.undo_run(stamped_events(t), 17).drop("ejecucion_id")


@query("""SELECT event_id AS id, event_type AS kind, user_id AS ejecucion_id FROM events WHERE event_type <> 'error' AND user_id = 17""")
def run_history_feed(t: Tables) -> DataFrame:
    return changes.rows_of_run(stamped_events(t), 17)
