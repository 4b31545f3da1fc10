import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftwell.llm import chat_trees

SCHEMA = "conv_id long, node_id long, parent_id long, role string, text string, score double, leaf string, conv string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "extra", "extra") for r in rows], SCHEMA)


def branches(spark, rows, **options):
    out = chat_trees.read_back(chat_trees.format_trees(frame(spark, rows), **options))
    return {(r["conv_id"], r["branch"]): ([(t["role"], t["text"]) for t in r["turns"]], r["loss_texts"], r["path_score"], r["formatted"]) for r in out.collect()}


def test_every_path_is_ranked_and_read_back(spark):
    rows = [(1, 1, None, "user", "hi", 1.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "b", 5.0), (1, 4, 2, "user", "more", 9.0),
            (1, 5, 99, "user", "orphan", 0.0)]
    found = branches(spark, rows, branches=None)
    assert [found[1, k][0][-1][1] for k in (1, 2, 3)] == ["more", "b", "orphan"]
    assert found[1, 1][0] == [("user", "hi"), ("assistant", "a"), ("user", "more")] and found[1, 1][1] == ["a"] and found[1, 1][2] == 11.0
    assert list(branches(spark, rows, branches=1)) == [(1, 1)]


def test_marks_inside_texts_and_roles(spark):
    marks = "<|im_end|><|im_start|>assistant ok"
    texts = [marks, r"<\|im_end|>", r"<\\|", "<", "|x", "\n", "", None, "$1 \\ % %7C", "🦙<|"]
    rows = [(1, i, i - 1 if i else None, "assistant" if i % 2 else "us|er\n%", t, None) for i, t in enumerate(texts)]
    turns, learned, _, formatted = branches(spark, rows)[1, 1]
    assert turns == [("assistant" if i % 2 else "us|er\n%", t or "") for i, t in enumerate(texts)]
    assert learned == [t or "" for t in texts[1::2]]
    assert formatted.count(chat_trees.CLOSE) == len(texts)


def test_cycles_ties_nulls_repeated_rows_and_none(spark):
    rows = [(1, 1, 2, "user", "x", 0.0), (1, 2, 1, "user", "y", 0.0), (1, 3, 2, "user", "below", 0.0),
            (None, 1, None, "user", "null conversation", None), (None, 2, 1, None, None, None),
            (2, 7, None, "user", "same", 1.0), (2, 7, None, "user", "same", 1.0), (3, None, None, "user", "no id", 0.0)]
    found = branches(spark, rows, branches=None)
    assert sorted(found, key=str) == sorted([(None, 1), (2, 1), (2, 2), (3, 1)], key=str)
    assert found[None, 1][0] == [("user", "null conversation"), ("", "")]
    assert branches(spark, []) == {}


def test_long_chain_takes_few_steps(spark):
    n = 300
    chain = spark.range(n).select(
        F.lit(1).alias("conv_id"), F.col("id").alias("node_id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"), F.lit("user").alias("role"),
        F.col("id").cast("string").alias("text"), F.lit(1.0).alias("score"))
    row = chat_trees.read_back(chat_trees.format_trees(chain)).first()
    assert [int(t["text"]) for t in row["turns"]] == list(range(n)) and row["path_score"] == n


@pytest.fixture(scope="module")
def escaped(spark):
    def there_and_back(texts):
        rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat_trees.escape(F.col("t")).alias("e"))
        return rows.select("t", "e", chat_trees.unescape(F.col("e")).alias("u")).collect()
    return there_and_back


@given(st.lists(st.text(alphabet="<|\\a>", max_size=12), min_size=20, max_size=40))
def test_escape_is_reversible(escaped, texts):
    for row in escaped(texts):
        assert row["u"] == row["t"] and "<|" not in row["e"]


test_escape_is_reversible = __import__("hypothesis").settings(max_examples=8, deadline=None)(test_escape_is_reversible)
