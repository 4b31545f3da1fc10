import random

import pytest

from siftwell.llm import line_runs
from tests.llm.plain import SCHEMA, awkward, prose, without_runs


def random_docs(seed, n):
    pick = random.Random(seed)
    lines = [prose(seed * 100 + i, pick.choice([1, 2, 3, 5, 8, 13, 30, 60])) for i in range(25)]
    docs = []
    for d in range(n):
        own = [pick.choice(["", " ", *lines, prose(pick.randrange(10**6), pick.randrange(1, 30))]) for _ in range(pick.randrange(1, 14))]
        at = pick.randrange(20)
        own += lines[at:at + pick.randrange(1, 8)]
        docs.append((d, "\n".join(own)))
    return docs


@pytest.mark.parametrize("seed,least,gram,window", [(1, 50, 25, 26), (2, 20, 10, 11), (3, 12, 8, 5), (4, 6, 1, 6)])
def test_against_plain_version(spark, seed, least, gram, window):
    docs = random_docs(seed, 60)
    out = line_runs.dedup(spark.createDataFrame(docs, "doc_id long, text string"), least=least, gram=gram, window=window).collect()
    expected = without_runs(docs, least)
    with_words = {r["doc_id"]: [x for x in r["text"].split("\n") if x.strip()] for r in out}
    assert with_words == {d: [x for x in t.split("\n") if x.strip()] for d, t in expected.items()}
    assert all(len(expected[r["doc_id"]]) <= len(r["text"]) for r in out)  # a blank line goes inside a shortest run only
    assert sum(r["n_removed"] for r in out) > 10


def test_awkward_rows(spark):
    out = line_runs.dedup(spark.createDataFrame(awkward(), SCHEMA)).collect()
    assert len(out) == len(awkward()) and out[0].asDict().keys() == {"doc_id", "text", "n", "digest", "n_lines", "n_removed"}
    by_id = {r["doc_id"]: r for r in out if r["doc_id"] != 5000}
    assert by_id[1]["text"] is None and by_id[1]["n_lines"] == 0 and by_id[4]["text"] == ""
    # the null key comes first, so its copy of the base stays and the later ones go; 40 repeats the run of 5000's text first
    assert by_id[None]["n_removed"] == 0 and by_id[16]["text"] == "" and by_id[19]["text"] == "" and by_id[22]["n_removed"] == 0
    assert [r["text"] for r in out if r["doc_id"] == 5000] == ["", ""]
    assert line_runs.dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_line_in_most_documents(spark):
    line = prose(5, 70)
    docs = [(i, f"{prose(1000 + i, 20)}\n{line}\nend {i}") for i in range(400)]
    out = {r["doc_id"]: r["text"] for r in line_runs.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out[0] == docs[0][1] and all(out[i] == f"{prose(1000 + i, 20)}\nend {i}" for i in range(1, 400))


def test_guarantee_is_checked(spark):
    with pytest.raises(ValueError):
        line_runs.dedup(spark.createDataFrame([], SCHEMA), least=50, gram=30, window=30)
