"""One query per operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftwell.llm import (
    block_names, chat_trees, decontam, fill_middle, jaccard, language, line_runs, pieces, quality, simhash, term_scan, toxicity, warc,
)
from siftwell.llm.common import Work, fold_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE[function.__name__] = sql
        return function

    return add


@query(r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(12 + length(replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '|', '%7C')) + 1
      + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) + 11) AS BIGINT) AS formatted_chars
FROM rows_ GROUP BY conv_id""")
def op1_chat_trees(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as trees in which each turn answers the one before it, formatted and read back."""
    given = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text")
    marks = "<|im_end|><|im_start|>assistant ok"
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(marks).alias("text"))
    by_turn = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    tree = given.unionByName(probe).withColumn("node_id", F.row_number().over(by_turn)).withColumn(
        "parent_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1))
    out = chat_trees.read_back(chat_trees.format_trees(tree, score=None))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    learned = F.array_join("loss_texts", "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(said, "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length(learned).cast("long").alias("loss_chars"), F.sha2(learned.cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))


@query("""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (payload_digest)""")
def op2_warc_members(spark: SparkSession, folder: str) -> DataFrame:
    """All pages as WARC records: written as whole gzip streams, normalised to members, read back by offset."""
    return warc.archive(spark.read.parquet(f"{folder}/pages.parquet")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def piece_model() -> str:
    """The model file of the installed public tokenizers, which every executor has."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet").select(*(columns or ("doc_id", "text")))


def sha256_of(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


@query()
def op5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """All documents encoded by the table of last tokens and decoded by the library."""
    out = pieces.encode(documents(spark, folder), piece_model(), decoded="decoded")
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), sha256_of(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"),
        sha256_of(F.col("decoded")).alias("decoded_sha256"))


def held_out(fold: int, folds: int) -> Column:
    return F.coalesce(fold_of("doc_id", folds) == fold, F.lit(False))


def quality_model(spark: SparkSession, folder: str, docs: DataFrame) -> quality.Model:
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return quality.fit(docs.where(~held_out(2, 4)), labels.select("doc_id", "quality"))


@query()
def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    """The quality score of all documents, learned from the labels of three folds."""
    docs = documents(spark, folder)
    out = quality.score(docs, quality_model(spark, folder, docs))
    return out.select("doc_id", held_out(2, 4).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query()
def op7_language(spark: SparkSession, folder: str) -> DataFrame:
    """The language of all documents, learned from three folds."""
    docs = documents(spark, folder, "doc_id", "text", "lang")
    out = language.identify(docs.select("doc_id", "text"), language.fit(docs.where(~held_out(2, 4))))
    return out.select("doc_id", held_out(2, 4).alias("held_out"), "lang_pred", "score", "accepted")


@query()
def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """The toxicity of all documents, by a lexicon learned from the labels of four folds."""
    docs = documents(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.fit(docs.where(~held_out(0, 5)), labels.select("doc_id", "toxic"))
    out = toxicity.score(docs, model)
    return out.select("doc_id", held_out(0, 5).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


DECONTAM_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark WHERE item_id IS NOT NULL),
g AS (
  SELECT DISTINCT item_id, least(13, len(ws)) AS k, array_to_string(list_slice(ws, pos, pos + least(13, len(ws)) - 1), ' ') AS win
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS pos FROM i WHERE len(ws) > 0)),
k AS (SELECT DISTINCT k FROM g),
d AS (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS pos FROM w, k WHERE len(ws) >= k),
m AS (SELECT d.doc_id, d.pos, g.k, g.item_id FROM d JOIN g ON g.k = d.k AND g.win = array_to_string(list_slice(d.ws, d.pos, d.pos + d.k - 1), ' ')),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + k)) AS p FROM m) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN s USING (doc_id)"""


@query(DECONTAM_SQL)
def op10_decontam(spark: SparkSession, folder: str) -> DataFrame:
    """All documents scanned for windows of the benchmark's words."""
    out = decontam.scan(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      sha256_of(F.array_join("items", ",")).alias("items_sha256"), "contaminated")


@query()
def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of all documents and of their edits. For each hundredth id, n_near: the other documents
    within 12 bits; near_class: the smallest id among all these and the equals of its own text."""
    work = Work(spark, "op3")
    out = work.stage(simhash.with_next(documents(spark, folder)), "prints")
    copies = work.stage(out.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("class_id")), "copies")
    asked = out.where(F.col("doc_id") % 100 == 0).select(F.col("doc_id").alias("asked"), F.col("fingerprint").alias("query")).distinct()
    near = simhash.within(copies, asked.select(F.col("query").alias("fingerprint"))).join(copies.withColumnRenamed("fingerprint", "found"), "found").groupBy("query").agg(
        (F.sum("copies") - 1).alias("n_near"), F.min("class_id").alias("near_class"))
    told = asked.join(near, "query")
    return out.join(told, (F.col("doc_id") == F.col("asked")) & (F.col("fingerprint") == F.col("query")), "left").drop("asked", "query")


LINES_SQL = r"""
WITH raw AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l0 AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM raw),
l1 AS (SELECT *, len(regexp_extract_all(line, '[^ \t\x0B\f\r]+')) AS n FROM l0),
l AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) - n AS c FROM l1 WHERE n > 0),
right_ AS (SELECT a.doc_id, a.i AS s, min(b.i) AS e FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.c + b.n >= a.c + 50 AND b.c < a.c + 50 GROUP BY a.doc_id, a.i),
left_ AS (SELECT b.doc_id, max(a.i) AS s, b.i AS e FROM l a JOIN l b ON a.doc_id = b.doc_id AND a.i <= b.i AND a.c + 50 <= b.c + b.n AND a.c + a.n + 50 > b.c + b.n GROUP BY b.doc_id, b.i),
r AS (SELECT * FROM right_ UNION SELECT * FROM left_),
k AS (SELECT r.doc_id, r.s, min(l.pos) AS f, max(l.pos) AS t, string_agg(line, chr(10) ORDER BY l.i) AS body FROM r JOIN l ON l.doc_id = r.doc_id AND l.i BETWEEN r.s AND r.e GROUP BY r.doc_id, r.s, r.e),
m AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, s) AS nth FROM k),
dead AS (SELECT DISTINCT doc_id, unnest(range(f, t + 1)) AS pos FROM m WHERE nth > 1),
kept AS (SELECT l0.doc_id, string_agg(line, chr(10) ORDER BY l0.pos) AS text FROM l0 ANTI JOIN dead ON dead.doc_id = l0.doc_id AND dead.pos = l0.pos GROUP BY l0.doc_id),
gone AS (SELECT doc_id, count(*) AS n FROM dead GROUP BY doc_id)
SELECT raw.doc_id, CAST(len(ls) AS BIGINT) AS n_lines, coalesce(gone.n, 0) AS n_removed, coalesce(kept.text, '') AS text
FROM raw LEFT JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)"""


@query(LINES_SQL)
def op4_line_runs(spark: SparkSession, folder: str) -> DataFrame:
    """All documents without the runs of lines of fifty words or more that stand earlier, too."""
    whole = documents(spark, folder).withColumn("text", F.coalesce("text", F.lit("")))
    return line_runs.dedup(whole).select("doc_id", "n_lines", "n_removed", "text")


JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, pos, pos + 3), ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS pos FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS reached FROM w UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reached = e.a)
SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reached) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id"""


@query(JACCARD_SQL)
def op9_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with their group of texts alike."""
    return jaccard.join(documents(spark, folder))


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NAMES_SQL = f"""
WITH t AS (SELECT doc_id, {LOWERED} AS text FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY text) AS kept, sha256(text) AS text_sha256
FROM t"""


@query(NAMES_SQL)
def op11_block_names(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with the one of their equals that stays, by integer names of their blocks."""
    return block_names.dedup(documents(spark, folder)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


TERMS_SQL = rf"""
WITH t AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
s AS (SELECT count(*) FILTER (WHERE len(ws) > 0) AS n_docs, CAST(sum(len(ws)) AS BIGINT) AS n_terms FROM t),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
f AS (SELECT doc_id, term, any_value(n) AS n, count(*) AS tf FROM (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n, unnest(ws) AS term FROM t)
  WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, s GROUP BY term),
p AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))) AS part FROM f JOIN w USING (term), s),
r AS (SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM q JOIN p USING (term) GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM r WHERE score > 0 QUALIFY rank <= 10"""


@query(TERMS_SQL)
def op12_term_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents of each benchmark item, by the counts of its terms in the texts."""
    return term_scan.search(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


MIDDLE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[ 	-
]*[^ 	-
]+|[ 	-
]+') AS ws,
  sha256('42:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
d AS (SELECT doc_id, text, ws, CAST(len(ws) AS BIGINT) AS n, list_transform(range(4), lambda i: CAST('0x' || substr(h, CAST(8 * i + 1 AS BIGINT), 8) AS BIGINT)) AS hs FROM t),
k AS (SELECT *, least(hs[1] % (n + 1), hs[2] % (n + 1)) AS a, greatest(hs[1] % (n + 1), hs[2] % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR hs[3] % 100 >= 50 THEN 'plain'
    WHEN hs[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
c AS (SELECT *, array_to_string(ws[1:a], '') AS prefix, array_to_string(ws[a + 1:b], '') AS middle, array_to_string(ws[b + 1:n], '') AS suffix FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM c"""


@query(MIDDLE_SQL)
def op13_fill_middle(spark: SparkSession, folder: str) -> DataFrame:
    """All documents cut for fill-in-middle, and the texts rebuilt from what was made of them."""
    out = fill_middle.transform(documents(spark, folder))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha256_of(F.col("output")).alias("output_sha256"),
                      sha256_of(fill_middle.restored()).alias("restored_sha256"))
