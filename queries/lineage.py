"""Runs, documents, retention and usage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queries import Tables, query
from siftwell.operators import documents, retention, runs, usage
from siftwell.plans import load
from siftwell.plans import retention as plan
from siftwell.plans.store import Store
from siftwell.session import new_folder


def run_events(t: Tables) -> DataFrame:
    """Status events of the runs: one run per user and kind of day, in event order."""
    status = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "purchase", "OK").otherwise("EN_CURSO")
    return t.events.select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), status.alias("status"),
        F.col("event_type").alias("load"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("opened"))


@query("""
SELECT user_id AS run_id, arg_max(CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'OK' ELSE 'EN_CURSO' END, event_id) AS status,
       count(*) AS events, arg_min(event_type, event_id) AS load, strftime(arg_min(ts, event_id), '%Y-%m-%d %H:%M:%S.%f') AS opened
FROM events GROUP BY user_id""")
def run_status(t: Tables) -> DataFrame:
    return runs.current_runs(run_events(t))


@query("""
WITH e AS (SELECT user_id * 100000 + date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS run_id, event_id, event_type FROM events)
SELECT run_id, event_id FROM e WHERE event_type NOT IN ('error', 'purchase')
  AND run_id NOT IN (SELECT run_id FROM e WHERE event_type IN ('error', 'purchase'))""")
def run_orphans(t: Tables) -> DataFrame:
    """A user's day as a run: the opening events of days on which nothing was bought and nothing failed."""
    day = F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date"))
    events = run_events(t).withColumnRenamed("seq", "event_id").join(t.events.select("event_id", (F.col("user_id") * 100000 + day).alias("_day")), "event_id")
    return runs.open_runs(events.withColumn("run_id", F.col("_day"))).select("run_id", "event_id")


def order_runs(t: Tables) -> DataFrame:
    """Orders as runs: the customer number names the run each one is chained to, when it is an earlier one."""
    return t.orders.select(
        F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("load"),
        F.when(F.col("o_orderstatus") == "F", "OK").when(F.col("o_orderstatus") == "P", "ERROR").otherwise("EN_CURSO").alias("status"),
        F.when(F.col("o_custkey") < F.col("o_orderkey"), F.col("o_custkey")).alias("principal"),
        F.concat(F.lower("o_orderpriority"), F.lit(".editar")).alias("operation"))


RUNS_SQL = """
WITH runs AS (SELECT o_orderkey AS run_id, o_orderpriority AS load,
  CASE o_orderstatus WHEN 'F' THEN 'OK' WHEN 'P' THEN 'ERROR' ELSE 'EN_CURSO' END AS status,
  CASE WHEN o_custkey < o_orderkey THEN o_custkey END AS parent, lower(o_orderpriority) || '.editar' AS operation FROM orders),
chained AS (SELECT *, coalesce(parent, run_id) AS principal FROM runs)"""


@query(RUNS_SQL + " SELECT load, max(run_id) AS run_id FROM runs WHERE status = 'OK' GROUP BY load")
def latest_ok_run(t: Tables) -> DataFrame:
    return runs.latest_ok_runs(order_runs(t))


@query(RUNS_SQL + " SELECT run_id, load, status FROM runs ORDER BY run_id DESC LIMIT 20")
def latest_runs(t: Tables) -> DataFrame:
    return runs.latest_runs(order_runs(t)).select("run_id", "load", "status")


@query(RUNS_SQL + " SELECT run_id, principal, row_number() OVER (PARTITION BY principal ORDER BY run_id) AS place FROM chained")
def run_chain(t: Tables) -> DataFrame:
    return runs.numbered_histories(order_runs(t)).select("run_id", "principal", F.col("place").cast("bigint").alias("place"))


@query(RUNS_SQL + " SELECT run_id, load, status FROM chained WHERE principal = 10")
def run_history(t: Tables) -> DataFrame:
    return runs.history(order_runs(t), 10).select("run_id", "load", "status")


@query(RUNS_SQL + """
SELECT l_orderkey AS written_by, l_partkey AS part, CAST(principal AS VARCHAR) AS principal
FROM lineitem LEFT JOIN chained ON run_id = CASE WHEN l_returnflag <> 'R' THEN l_orderkey END""")
def row_principal(t: Tables) -> DataFrame:
    """Lines as rows written by the run of their order; returned lines predate the log."""
    rows = t.lineitem.select(
        F.col("l_orderkey").alias("written_by"), F.col("l_partkey").alias("part"),
        F.when(F.col("l_returnflag") != "R", F.col("l_orderkey")).alias("ejecucion_id"))
    found = runs.principal_of_rows(rows, order_runs(t))
    return found.select("written_by", "part", F.col("principal").cast("string").alias("principal"))


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", documents.content_hash(F.col("text")).alias("hash"))


@query("""
WITH files AS (SELECT doc_id, source AS load, sha256(text) AS hash FROM documents),
done AS (SELECT DISTINCT source AS load, sha256(text) AS hash FROM documents JOIN labels USING (doc_id) WHERE quality = 1)
SELECT doc_id, load, hash FROM files f WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.load = f.load AND d.hash = f.hash)""")
def skip_loaded(t: Tables) -> DataFrame:
    """Files still to load: a labelled document is a past run, good quality a successful one."""
    files = t.documents.select("doc_id", F.col("source").alias("load"), documents.content_hash(F.col("text")).alias("hash"))
    past = files.join(t.labels, "doc_id").select("load", "hash", F.when(F.col("quality") == 1, "OK").otherwise("ERROR").alias("status"))
    return documents.not_loaded(files, past)


def links(t: Tables) -> DataFrame:
    """Every document used by a run, tagged by language."""
    return t.documents.select(
        F.col("doc_id").alias("run_id"), documents.content_hash(F.col("text")).alias("hash"), F.col("lang").alias("tag"))


def registry(t: Tables) -> DataFrame:
    """One row per content; toxic content was purged."""
    labelled = t.documents.join(t.labels, "doc_id", "left")
    return labelled.groupBy(documents.content_hash(F.col("text")).alias("hash")).agg(
        F.min("doc_id").cast("string").alias("name"), F.max(F.octet_length("text")).cast("bigint").alias("bytes"),
        F.max(F.coalesce("toxic", F.lit(0))).alias("t")).select(
        "hash", "name", "bytes", F.when(F.col("t") == 1, "purgado").otherwise("disponible").alias("status"),
        F.when(F.col("t") == 1, F.lit("2026-01-01").cast("timestamp_ntz")).alias("purged_at"))


DOCS_SQL = """
WITH links AS (SELECT doc_id AS run_id, sha256(text) AS hash, lang AS tag FROM documents),
docs AS (SELECT sha256(d.text) AS hash, CAST(min(d.doc_id) AS VARCHAR) AS name, max(octet_length(encode(d.text))) AS bytes,
  CASE WHEN max(coalesce(l.toxic, 0)) = 1 THEN 'purgado' ELSE 'disponible' END AS status FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1)"""


@query(DOCS_SQL + """
SELECT d.hash, d.name, CAST(d.bytes AS BIGINT) AS bytes, d.status, count(l.run_id) AS links, string_agg(DISTINCT l.tag, ', ' ORDER BY l.tag) AS tags
FROM docs d LEFT JOIN links l USING (hash) GROUP BY ALL""")
def doc_list(t: Tables) -> DataFrame:
    return documents.listing(registry(t).drop("purged_at"), links(t))


@query(DOCS_SQL + " SELECT run_id, hash, tag, name, status FROM links JOIN docs USING (hash)")
def doc_of_run(t: Tables) -> DataFrame:
    return documents.of_run(links(t), registry(t)).select("run_id", "hash", "tag", "name", "status")


@query(RUNS_SQL.replace("WITH", DOCS_SQL + ",", 1) + """
SELECT concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS row_id, c.run_id AS link_run, c.operation, k.hash, k.tag, d.name
FROM lineitem JOIN chained c ON c.principal = l_orderkey JOIN links k ON k.run_id = c.run_id JOIN docs d ON d.hash = k.hash""")
def doc_of_row(t: Tables) -> DataFrame:
    """All documents in the life of every line: the runs chained to its order and what they used."""
    rows = t.lineitem.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_id"), F.col("l_orderkey").alias("run_id"))
    found = documents.of_rows(rows, order_runs(t), links(t), registry(t))
    return found.select("row_id", "link_run", "operation", "hash", "tag", "name")


@query(DOCS_SQL + """,
arrivals AS (SELECT sha256(text) AS hash, min(source) AS name, max(octet_length(encode(text))) AS bytes FROM
  (SELECT text, source FROM documents WHERE lang = 'es' UNION ALL SELECT text, role FROM conversations) GROUP BY 1)
SELECT coalesce(d.hash, a.hash) AS hash, coalesce(d.name, a.name) AS name, CAST(coalesce(d.bytes, a.bytes) AS BIGINT) AS bytes,
  CASE WHEN a.hash IS NOT NULL THEN 'disponible' ELSE d.status END AS status,
  CASE WHEN a.hash IS NULL AND d.status = 'purgado' THEN '2026-01-01' END AS purged
FROM docs d FULL JOIN arrivals a ON a.hash = d.hash""")
def doc_registry(t: Tables) -> DataFrame:
    """Spanish documents come again and conversation turns come for the first time."""
    arriving = t.documents.filter("lang = 'es'").select("text", F.col("source").alias("name")).unionByName(
        t.conversations.select("text", F.col("role").alias("name")))
    arriving = arriving.select(
        documents.content_hash(F.col("text")).alias("hash"), "name", F.octet_length("text").cast("bigint").alias("bytes"))
    found = documents.register(registry(t), arriving)
    return found.select("hash", "name", "bytes", "status", F.date_format("purged_at", "yyyy-MM-dd").alias("purged"))


@query("""
WITH links AS (SELECT doc_id AS run_id, sha256(text) AS hash, lang AS tag FROM documents),
incoming AS (SELECT doc_id AS run_id, sha256(text) AS hash, CASE WHEN quality = 1 THEN lang ELSE 'revisado' END AS tag
  FROM documents JOIN labels USING (doc_id))
SELECT * FROM links UNION ALL SELECT DISTINCT * FROM incoming i WHERE NOT EXISTS
  (SELECT 1 FROM links l WHERE l.run_id = i.run_id AND l.hash = i.hash AND l.tag = i.tag)""")
def link_once(t: Tables) -> DataFrame:
    known = links(t)
    incoming = t.documents.join(t.labels, "doc_id").select(
        F.col("doc_id").alias("run_id"), documents.content_hash(F.col("text")).alias("hash"),
        F.when(F.col("quality") == 1, F.col("lang")).otherwise("revisado").alias("tag"))
    return documents.link_once(known, incoming)


@query("""
SELECT l_orderkey + l_suppkey AS row_id, l_returnflag AS hash, CASE WHEN l_linestatus = 'O' THEN 'factura' ELSE 'crear' END AS tag,
       CASE WHEN o_orderstatus <> 'P' THEN CAST(o_custkey AS VARCHAR) END AS principal,
       CASE WHEN o_orderkey IS NULL THEN 'missing_row' WHEN o_orderstatus = 'P' THEN 'no_run' ELSE 'ok' END AS status
FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey + l_suppkey""")
def attach_requests(t: Tables) -> DataFrame:
    """Documents to add to orders, some unknown and some older than the run log."""
    rows = t.orders.select(F.col("o_orderkey").alias("row_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("run_id"))
    asked = t.lineitem.select(
        (F.col("l_orderkey") + F.col("l_suppkey")).alias("row_id"), F.col("l_returnflag").alias("hash"),
        F.when(F.col("l_linestatus") == "O", "factura").alias("tag"))
    found = documents.attach_requests(asked, rows)
    return found.withColumn("principal", F.col("principal").cast("string"))


@query(DOCS_SQL + """,
away AS (SELECT DISTINCT sha256(text) AS hash FROM documents JOIN labels USING (doc_id))
SELECT count(*) FILTER (a.hash IS NULL) AS copied, count(*) FILTER (a.hash IS NOT NULL) AS present,
       CAST(sum(bytes) FILTER (a.hash IS NULL) AS BIGINT) AS bytes FROM docs d LEFT JOIN away a ON a.hash = d.hash""")
def mirror_counts(t: Tables) -> DataFrame:
    """Labelled documents are already at the destination."""
    away = t.documents.join(t.labels, "doc_id").select(documents.content_hash(F.col("text")).alias("hash"))
    return documents.mirror_counts(registry(t), away)


@query(DOCS_SQL + """,
away AS (SELECT DISTINCT sha256(text) AS hash FROM documents JOIN labels USING (doc_id))
SELECT hash, name, CAST(bytes AS BIGINT) AS bytes FROM docs WHERE hash NOT IN (SELECT hash FROM away)""")
def mirror_plan(t: Tables) -> DataFrame:
    away = t.documents.join(t.labels, "doc_id").select(documents.content_hash(F.col("text")).alias("hash"))
    return documents.mirror_plan(registry(t), away).select("hash", "name", "bytes")


def uses(t: Tables) -> DataFrame:
    """Uses of contents: the user stands for the content, the kind of event for the process."""
    return t.events.select(
        F.when(F.col("event_type") == "click", "raton.crear").when(F.col("event_type") == "view", "raton.editar").otherwise(
            F.col("event_type")).alias("load"),
        F.when(F.col("event_type").isin("click", "view"), "cli").otherwise("carga").alias("kind"),
        F.col("user_id").cast("string").alias("hash"), F.when(F.col("value") > 60, "legal").otherwise("normal").alias("tag"), F.col("ts").alias("used_at"))


POLICIES = {
    "raton": {"tipo": "ficheros", "cantidad": 12}, "error": {"tipo": "anios", "cantidad": 2},
    "purchase": {"tipo": "ficheros", "cantidad": 5, "tags_exentos": ["legal"]},
    "signup": {"tipo": "ficheros", "cantidad": 1}}
NOW = "2026-01-29 12:00:00"

USES_SQL = """
WITH uses AS (SELECT CASE WHEN event_type IN ('click', 'view') THEN 'raton' ELSE event_type END AS process,
  CAST(user_id AS VARCHAR) AS hash, value > 60 AS legal, ts FROM events),
last AS (SELECT process, hash, max(ts) AS last, bool_or(legal) AS legal FROM uses GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY process ORDER BY last DESC, hash) AS rn FROM last),
kept AS (SELECT process, hash FROM ranked WHERE (process = 'raton' AND rn <= 12) OR (process = 'purchase' AND (rn <= 5 OR legal))
  OR (process = 'signup' AND rn <= 1) OR (process = 'error' AND last >= TIMESTAMP '2026-01-29 12:00:00' - INTERVAL 2 YEAR))"""


@query(USES_SQL + " SELECT process, hash FROM kept")
def history_keep(t: Tables) -> DataFrame:
    """By number of files, by years and by exempt tag."""
    return retention.kept_per_process(uses(t), POLICIES, F.lit(NOW).cast("timestamp_ntz"))


@query(USES_SQL + """
SELECT CAST(c_custkey AS VARCHAR) AS hash, CAST(round(c_acctbal * 100) AS BIGINT) AS bytes FROM customer
WHERE c_mktsegment <> 'BUILDING' AND CAST(c_custkey AS VARCHAR) NOT IN (SELECT hash FROM kept)""")
def history_purgeable(t: Tables) -> DataFrame:
    """Available documents nobody keeps; customers stand for the documents."""
    return retention.purgeable(customer_documents(t), uses(t), POLICIES, F.lit(NOW).cast("timestamp_ntz")).select("hash", "bytes")


def customer_documents(t: Tables) -> DataFrame:
    return t.customer.select(
        F.col("c_custkey").cast("string").alias("hash"), F.round(F.col("c_acctbal") * 100).cast("bigint").alias("bytes"),
        F.when(F.col("c_mktsegment") == "BUILDING", "purgado").otherwise("disponible").alias("status"),
        F.lit(None).cast("timestamp_ntz").alias("purged_at"))


@query(USES_SQL + """
SELECT CAST(c_custkey AS VARCHAR) AS hash, CASE WHEN c_mktsegment = 'BUILDING' OR k.hash IS NULL THEN 'purgado' ELSE 'disponible' END AS status,
       CASE WHEN c_mktsegment <> 'BUILDING' AND k.hash IS NULL THEN '2026-01-29' END AS purged
FROM customer LEFT JOIN (SELECT DISTINCT hash FROM kept) k ON k.hash = CAST(c_custkey AS VARCHAR)""")
def history_purge(t: Tables) -> DataFrame:
    """The registry after the purge keeps every row."""
    now = F.lit(NOW).cast("timestamp_ntz")
    known = customer_documents(t)
    after = retention.purge(known, retention.purgeable(known, uses(t), POLICIES, now), now)
    return after.select("hash", "status", F.date_format("purged_at", "yyyy-MM-dd").alias("purged"))


@query(USES_SQL + """
SELECT CAST(c_custkey AS VARCHAR) AS hash, CASE WHEN c_mktsegment = 'BUILDING' OR k.hash IS NULL THEN 'purgado' ELSE 'disponible' END AS status,
       CASE WHEN c_mktsegment <> 'BUILDING' AND k.hash IS NULL THEN '2026-01-29' END AS purged
FROM customer LEFT JOIN (SELECT DISTINCT hash FROM kept) k ON k.hash = CAST(c_custkey AS VARCHAR)""")
def store_purge(t: Tables) -> DataFrame:
    """The same retention on a store: every use is a link of a run of its process, and the purge publishes the registry."""
    store = load.prepare(Store(t.spark, new_folder(t.spark, "store")))
    used = uses(t).withColumn("run_id", F.xxhash64("load", "kind"))
    runs_of = used.select(F.col("run_id").alias("id"), F.lit(1).alias("seq"), F.col("load").alias("carga"), F.col("kind").alias("tipo"), F.lit("OK").alias("estado")).distinct()
    registered = customer_documents(t).withColumn("prefix", F.substring(F.sha2("hash", 256), 1, 1))
    store.publish(
        store.append(load.RUNS, runs_of) + store.append(load.LINKS, used.withColumnRenamed("used_at", "fecha")) + store.append(load.DOCUMENTS, registered))
    plan.purge_documents(store, POLICIES, F.lit(NOW).cast("timestamp_ntz"))
    return store.read(load.DOCUMENTS).select("hash", "status", F.date_format("purged_at", "yyyy-MM-dd").alias("purged"))


@query("""
WITH snaps AS (SELECT o_orderpriority AS entity, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS name, o_orderdate AS taken FROM orders),
buckets AS (SELECT *, 'd' AS k, date_trunc('day', taken) AS b, 7 AS n FROM snaps UNION ALL SELECT *, 'w', date_trunc('week', taken), 8 FROM snaps
  UNION ALL SELECT *, 'm', date_trunc('month', taken), 12 FROM snaps),
ranked AS (SELECT *, row_number() OVER (PARTITION BY entity, k, b ORDER BY taken DESC, name DESC) AS rn,
  dense_rank() OVER (PARTITION BY entity, k ORDER BY b DESC) AS dr FROM buckets)
SELECT DISTINCT entity, name FROM ranked WHERE rn = 1 AND dr <= n""")
def gfs_retention(t: Tables) -> DataFrame:
    """Snapshots kept by day, ISO week and month; every order is a snapshot of its priority."""
    snapshots = t.orders.select(
        F.col("o_orderpriority").alias("entity"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("name"),
        F.col("o_orderdate").alias("taken_at"))
    return retention.kept_snapshots(snapshots, 7, 8, 12)


def query_log(t: Tables) -> DataFrame:
    """Events as logged queries: the kind of event and the parity words of its JSON are the tables it touched."""
    key = F.get_json_object("props", "$.k").cast("int")
    return t.events.select(
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("query_id"), F.concat(F.lit("SELECT "), "event_id").alias("sql"),
        F.when(F.col("event_type") == "purchase", "export").otherwise("consulta").alias("origin"),
        F.when(F.col("event_type") == "purchase", F.concat(F.lit("vista_"), F.floor(key / 25).cast("string"))).alias("object"),
        F.array("event_type", F.concat(F.lit("tabla_"), F.floor(key / 10).cast("string")), F.lit("_migraciones"), F.col("event_type")).alias("tables"),
        F.when(F.col("event_type") != "view", F.round("value", 2)).alias("seconds"),
        F.when(F.col("event_type") == "error", "ERROR").otherwise("OK").alias("status"))


LOG_SQL = """
WITH log AS (SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS query_id, 'SELECT ' || event_id AS sql, event_type,
  CAST(json_extract(props, '$.k') AS INT) AS k, CASE WHEN event_type <> 'view' THEN round(value, 2) END AS seconds FROM events),
touched AS (SELECT *, CASE WHEN event_type = 'purchase' THEN 'vista_' || (k // 25) ELSE array_to_string(list_sort([event_type, 'tabla_' || (k // 10)]), ', ') END AS signature
  FROM log WHERE event_type <> 'error')"""


@query(LOG_SQL + """
SELECT object, count(*) AS uses FROM (SELECT unnest(string_split(signature, ', ')) AS object FROM touched) GROUP BY 1""")
def usage_objects(t: Tables) -> DataFrame:
    return usage.usage_by_object(query_log(t), ["_migraciones"])


@query(LOG_SQL + """
SELECT signature, count(*) AS times, min(sql) AS example FROM touched WHERE event_type <> 'purchase' GROUP BY 1 HAVING count(*) >= 200""")
def usage_recurring(t: Tables) -> DataFrame:
    return usage.recurring(query_log(t), 200, ["_migraciones"])


@query(LOG_SQL + " SELECT query_id, seconds FROM touched WHERE seconds IS NOT NULL ORDER BY seconds DESC, query_id LIMIT 5")
def usage_slowest(t: Tables) -> DataFrame:
    return usage.slowest(query_log(t)).select("query_id", "seconds")


@query(LOG_SQL + """
SELECT DISTINCT object FROM (SELECT event_type AS object FROM events UNION ALL SELECT 'tabla_' || n_nationkey FROM nation UNION ALL SELECT 'vista_' || n_nationkey FROM nation)
WHERE object NOT IN (SELECT unnest(string_split(signature, ', ')) FROM touched)""")
def usage_unused(t: Tables) -> DataFrame:
    """Objects that exist and no successful query touched."""
    number = F.col("n_nationkey").cast("string")
    existing = t.events.select(F.col("event_type").alias("object")).unionByName(
        t.nation.select(F.explode(F.array(F.concat(F.lit("tabla_"), number), F.concat(F.lit("vista_"), number))).alias("object"))).distinct()
    return usage.unused_objects(existing, query_log(t), ["_migraciones"])


@query("SELECT count(*) FILTER (event_type <> 'error') AS recorded, count(*) FILTER (event_type = 'error') AS errors FROM events")
def usage_totals(t: Tables) -> DataFrame:
    return usage.log_totals(query_log(t))
