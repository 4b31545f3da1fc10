"""Profiles, overlaps and schema drafts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queries import Tables, query
from siftwell.operators import draft, overlap, profile

PROFILE_COLUMNS = ["Cód Cliente", "Nombre", "MES", "saldo", "alta", "vacía", "tasa"]


def customer_file(t: Tables) -> DataFrame:
    """customer as a file of text columns with a blank column, months with leading zeros and decimal commas."""
    return t.customer.select(
        F.col("c_custkey").alias("_at"),
        F.col("c_custkey").cast("string").alias("Cód Cliente"), F.col("c_name").alias("Nombre"),
        F.lpad((F.col("c_nationkey") + 1).cast("string"), 2, "0").alias("MES"),
        F.when(F.col("c_acctbal") >= 0, F.concat(
            F.expr("cast(round(c_acctbal * 100) as bigint) div 100").cast("string"), F.lit(",5"))).otherwise("  ").alias("saldo"),
        F.concat(F.lit("1/"), F.col("c_nationkey") + 1, F.lit("/2026")).alias("alta"),
        F.lit(" ").alias("vacía"),
        F.concat(F.col("c_nationkey").cast("string"), F.lit("e-1")).alias("tasa"))


def customer_profile(t: Tables) -> DataFrame:
    return profile.profile_columns(customer_file(t), PROFILE_COLUMNS, F.col("_at"))


PROFILE_SQL = """
WITH raw AS (SELECT c_custkey AS pos, CAST(c_custkey AS VARCHAR) AS c1, c_name AS c2, lpad(CAST(c_nationkey + 1 AS VARCHAR), 2, '0') AS c3,
  CASE WHEN c_acctbal >= 0 THEN (CAST(round(c_acctbal * 100) AS BIGINT) // 100) || ',5' ELSE '  ' END AS c4,
  '1/' || (c_nationkey + 1) || '/2026' AS c5, ' ' AS c6, c_nationkey || 'e-1' AS c7 FROM customer),
cells AS (SELECT pos, 1 AS position, 'Cód Cliente' AS col, c1 AS v FROM raw UNION ALL SELECT pos, 2, 'Nombre', c2 FROM raw
  UNION ALL SELECT pos, 3, 'MES', c3 FROM raw UNION ALL SELECT pos, 4, 'saldo', c4 FROM raw UNION ALL SELECT pos, 5, 'alta', c5 FROM raw
  UNION ALL SELECT pos, 6, 'vacía', c6 FROM raw UNION ALL SELECT pos, 7, 'tasa', c7 FROM raw),
filled AS (SELECT * FROM cells WHERE trim(v) <> ''),
firsts AS (SELECT position, v, min(pos) AS f FROM filled GROUP BY 1, 2),
samples AS (SELECT position, string_agg(v, '|' ORDER BY f, v) AS sample FROM
  (SELECT *, row_number() OVER (PARTITION BY position ORDER BY f, v) AS rn FROM firsts) WHERE rn <= 5 GROUP BY 1),
stats AS (SELECT position, col, count(*) AS total_rows, count(*) FILTER (trim(v) = '') AS nulls,
  count(DISTINCT CASE WHEN trim(v) <> '' THEN v END) AS cardinality,
  bool_and(regexp_full_match(trim(v), '[0-9]{1,4}[/.-][0-9]{1,4}[/.-][0-9]{1,4}')) FILTER (trim(v) <> '') AS d,
  bool_and(regexp_full_match(trim(v), '[+-]?[0-9]+')) FILTER (trim(v) <> '') AS i,
  bool_and(TRY_CAST(trim(v) AS DOUBLE) IS NOT NULL) FILTER (trim(v) <> '') AS f,
  bool_and(TRY_CAST(replace(replace(trim(v), '.', ''), ',', '.') AS DOUBLE) IS NOT NULL) FILTER (trim(v) <> '') AS e
  FROM cells GROUP BY 1, 2),
typed AS (SELECT *, CASE WHEN cardinality = 0 THEN 'desconocido (todo vacío)' WHEN d THEN 'fecha (candidato date_format)' WHEN i THEN 'integer'
  WHEN f THEN 'double' WHEN e THEN 'double (formato_numerico: es)' ELSE 'varchar' END AS apparent_type FROM stats)"""


@query(PROFILE_SQL + """
SELECT position, col AS "column", apparent_type, total_rows, CAST(nulls AS BIGINT) AS nulls, cardinality, coalesce(sample, '') AS sample
FROM typed LEFT JOIN samples USING (position)""")
def profile_columns(t: Tables) -> DataFrame:
    return customer_profile(t).select(
        "position", "column", "apparent_type", "total_rows", "nulls", "cardinality", F.array_join("sample_values", "|").alias("sample"))


@query(PROFILE_SQL + ' SELECT col AS "column", apparent_type FROM typed')
def apparent_type(t: Tables) -> DataFrame:
    return customer_profile(t).select("column", "apparent_type")


@query("""
WITH first AS (SELECT * FROM orders ORDER BY o_orderkey LIMIT 200)
SELECT 'o_orderstatus' AS "column", count(*) AS total_rows, count(DISTINCT o_orderstatus) AS cardinality, 'true' AS sampled FROM first
UNION ALL SELECT 'o_orderpriority', count(*), count(DISTINCT o_orderpriority), 'true' FROM first""")
def sampled_profile(t: Tables) -> DataFrame:
    """Profile of the first rows only, which is what a sample is for, flagged as such."""
    first, sampled = profile.sample_rows(t.orders, 200, F.col("o_orderkey"))
    found = profile.profile_columns(first, ["o_orderstatus", "o_orderpriority"], F.col("o_orderkey"))
    return found.select("column", "total_rows", "cardinality", F.lit(str(sampled).lower()).alias("sampled"))


@query("""
SELECT 'p_name' AS "column", count(*) AS total, count(DISTINCT p_name) AS distinct_values, round(count(DISTINCT p_name) / count(*), 9) AS uniqueness FROM part
UNION ALL SELECT 'p_brand', count(*), count(DISTINCT p_brand), round(count(DISTINCT p_brand) / count(*), 9) FROM part
UNION ALL SELECT 'p_partkey', count(*), count(DISTINCT p_partkey), round(count(DISTINCT p_partkey) / count(*), 9) FROM part""")
def cardinality(t: Tables) -> DataFrame:
    found = profile.cardinality(t.part, ["p_name", "p_brand", "p_partkey"])
    return found.withColumn("uniqueness", F.round("uniqueness", 9))


def existing(t: Tables) -> dict:
    return {
        "nation": (t.nation, ["n_name", "n_regionkey"]), "supplier": (t.supplier, ["s_name", "s_nationkey"]),
        "part": (t.part, ["p_name", "p_brand", "p_type"]), "customer": (t.customer, ["c_name", "c_mktsegment"]),
        "orders": (t.orders, ["o_orderkey", "o_orderpriority"])}


def proposed(t: Tables) -> DataFrame:
    """Values of a new column: nation numbers, part sizes and segment names in other case, some blank."""
    return t.part.select(F.when(F.col("p_type") == "PROMO", " ").otherwise(F.concat(F.lit(" "), F.col("p_size").cast("string"))).alias("v")).unionByName(
        t.customer.select(F.initcap("c_mktsegment").alias("v")))


OVERLAP_SQL = """
WITH prop AS (SELECT DISTINCT lower(trim(v)) AS v FROM (
  SELECT CASE WHEN p_type = 'PROMO' THEN ' ' ELSE ' ' || p_size END AS v FROM part UNION ALL SELECT c_mktsegment FROM customer) WHERE trim(v) <> ''),
ex AS (SELECT DISTINCT tab, col, lower(trim(v)) AS v FROM (
  SELECT 'nation' AS tab, 'n_name' AS col, n_name AS v FROM nation UNION ALL SELECT 'nation', 'n_regionkey', CAST(n_regionkey AS VARCHAR) FROM nation
  UNION ALL SELECT 'supplier', 's_name', s_name FROM supplier UNION ALL SELECT 'supplier', 's_nationkey', CAST(s_nationkey AS VARCHAR) FROM supplier
  UNION ALL SELECT 'part', 'p_name', p_name FROM part UNION ALL SELECT 'part', 'p_brand', p_brand FROM part UNION ALL SELECT 'part', 'p_type', p_type FROM part
  UNION ALL SELECT 'customer', 'c_name', c_name FROM customer UNION ALL SELECT 'customer', 'c_mktsegment', c_mktsegment FROM customer
  UNION ALL SELECT 'orders', 'o_orderkey', CAST(o_orderkey AS VARCHAR) FROM orders UNION ALL SELECT 'orders', 'o_orderpriority', o_orderpriority FROM orders)),
hits AS (SELECT tab, col, count(p.v) AS matches, (SELECT count(*) FROM prop) AS total_proposed FROM ex LEFT JOIN prop p USING (v) GROUP BY 1, 2),
shown AS (SELECT tab, col, string_agg(v, '|' ORDER BY v) AS shown FROM
  (SELECT ex.*, row_number() OVER (PARTITION BY tab, col ORDER BY v) AS rn FROM ex WHERE v IN (SELECT v FROM prop)) WHERE rn <= 10 GROUP BY 1, 2)
SELECT tab AS "table", col AS "column", matches, total_proposed, round(matches / total_proposed, 9) AS ratio, coalesce(shown, '') AS matching_values
FROM hits LEFT JOIN shown USING (tab, col)"""


def shown(found: DataFrame) -> DataFrame:
    return found.withColumn("ratio", F.round("ratio", 9)).withColumn("matching_values", F.array_join("matching_values", "|"))


@query(OVERLAP_SQL)
def value_overlap(t: Tables) -> DataFrame:
    return shown(overlap.overlap(proposed(t), "v", existing(t)))


@query(OVERLAP_SQL + " WHERE matches / total_proposed >= 0.5")
def fk_candidates(t: Tables) -> DataFrame:
    return shown(overlap.foreign_key_candidates(proposed(t), "v", existing(t)))


@query(PROFILE_SQL + """
SELECT position, CASE position WHEN 1 THEN 'cod_cliente' WHEN 6 THEN 'vacia' ELSE lower(col) END AS name,
  CASE apparent_type WHEN 'integer' THEN 'INTEGER' WHEN 'double' THEN 'DOUBLE' WHEN 'double (formato_numerico: es)' THEN 'DOUBLE'
    WHEN 'fecha (candidato date_format)' THEN 'DATE' ELSE 'VARCHAR' END AS type,
  CASE position WHEN 3 THEN 'leading_zeros' WHEN 4 THEN 'comma_decimals' WHEN 5 THEN 'needs_format' WHEN 6 THEN 'all_blank' ELSE '' END AS warnings,
  CASE WHEN nulls = 0 THEN 'no nulls seen: NOT NULL candidate' ELSE '' END AS notes
FROM typed""")
def schema_draft(t: Tables) -> DataFrame:
    """Names, types, doubts and notes for a table that would hold the file."""
    found = draft.draft_columns(customer_profile(t))
    return found.select("position", "name", "type", F.array_join("warnings", ",").alias("warnings"), F.array_join("notes", ",").alias("notes"))


@query("""
WITH raw AS (SELECT strftime(o_orderdate, '%Y%m%d') AS c1, strftime(o_orderdate, '%Y%m%d') || '003000' AS c2,
  CAST(86169897 + o_orderkey AS VARCHAR) AS c3 FROM orders)
SELECT 'dia' AS "column", 'compact_date' AS warnings, CAST(max(length(c1)) AS INT) AS digits FROM raw
UNION ALL SELECT 'momento', 'compact_date', max(length(c2)) FROM raw
UNION ALL SELECT 'cod_envio', 'identifier', max(length(c3)) FROM raw""")
def compact_dates(t: Tables) -> DataFrame:
    """Digits that read as a day or a moment, and digits of the same length that do not."""
    day = F.date_format("o_orderdate", "yyyyMMdd")
    rows = t.orders.select(
        F.col("o_orderkey").alias("_at"), day.alias("dia"), F.concat(day, F.lit("003000")).alias("momento"),
        (F.col("o_orderkey") + 86169897).cast("string").alias("cod_envio"))
    found = profile.profile_columns(rows, ["dia", "momento", "cod_envio"], F.col("_at"))
    return found.select("column", F.array_join(draft.warning_codes(), ",").alias("warnings"), "digits")
