import pytest
from pyspark.sql import functions as F

from queries import files


class Tables:
    def __init__(self, spark):
        self.spark = spark
        self.orders = spark.range(0, 60_000, 4).select(F.col("id").alias("o_orderkey"), (F.col("id") % 7).alias("o_custkey"), F.lit("O").alias("o_orderstatus"))
        self.customer = spark.range(30_000).select(F.col("id").alias("c_custkey"), F.concat(F.lit("Customer#"), "id").alias("c_name"))
        self.nation = spark.createDataFrame([(0, "A; B"), (1, "C")], "n_nationkey int, n_name string")
        texts = [None, "", 'a "quoted" one; two', "x\r\ny\rz\n", "\\ \\\"", " blank "]
        self.documents = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)


@pytest.fixture
def written(spark, monkeypatch):
    """The number of files in each folder the queries write."""
    folders, given = [], files.new_folder
    monkeypatch.setattr(files, "new_folder", lambda *a: folders.append(given(*a)) or folders[-1])
    return lambda pattern: [spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(f + pattern).count() for f in folders]


def test_identity_of_many_files(spark, written):
    found = {r["variant"]: r["identity"] for r in files.file_identity(Tables(spark)).collect()}
    assert found == {"same": "equal", "other separator": "differs", "shorter": "differs", "other row": "differs"}
    assert written("/variant=first") == [3]


def test_quoted_cells_in_many_files(spark, written):
    t = Tables(spark)
    found = {r["doc_id"]: (r["body"], r["lang"]) for r in files.csv_quoted(t).collect()}
    assert found == {str(r["doc_id"]): ((r["text"] or "").replace("\r\n", "\n").replace("\r", "\n") + ';"en', "en") for r in t.documents.collect()}
    assert written("")[0] > 1


def test_header_cells_of_many_files(spark, written):
    found = sorted((r["ref"], r["value"]) for r in files.file_header_cells(Tables(spark)).collect())
    assert found == [("A1", "A; B"), ("B2", "2;"), ("C2", None)] and written("")[0] == 2
