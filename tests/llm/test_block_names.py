import hashlib
import random
import re

import pytest

from siftwell.llm import block_names
from siftwell.llm.common import Work
from tests.llm.plain import SCHEMA, awkward, prose


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain(rows):
    """keep_id, group_size and digest by row: the slow way, for distinct ids."""
    groups = {}
    for d, t in rows:
        groups.setdefault(lowered(t), []).append(d)
    return {(d, max(groups[lowered(t)]), len(groups[lowered(t)]), max(groups[lowered(t)]) == d, hashlib.sha256(lowered(t).encode()).hexdigest()) for d, t in rows}


@pytest.mark.parametrize("size", [5, 2048])
def test_against_plain_version(spark, size):
    pick = random.Random(size)
    texts = ["", None, "A", "a", "ÄÖ", "äö", "İ", "ab" * 40, "ab" * 41, "aB" * 40, "ab" * 39 + "b", prose(1, 40), prose(1, 41), prose(2, 60), prose(2, 60).upper()]
    texts += ["".join(pick.choice("abXé") for _ in range(pick.randrange(1, 9))) for _ in range(300)]
    rows = list(enumerate(texts))
    pick.shuffle(rows)
    out = block_names.dedup(spark.createDataFrame(rows, "doc_id long, text string"), size=size).collect()
    assert {tuple(r)[:5] for r in out} == plain(rows) and len(out) == len(rows)
    names = {}
    for r in out:  # one name a text, and one text a name
        names.setdefault((r["level"], r["name"]), set()).add(r["text_sha256"])
    assert all(len(x) == 1 for x in names.values()) and len(names) == len({r["text_sha256"] for r in out})


def test_names_do_not_depend_on_the_layout(spark):
    rows = [(i, prose(i % 30, 20 + i % 30)) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [{tuple(r) for r in block_names.dedup(docs.repartition(n), size=32).collect()} for n in (1, 7)]
    assert found[0] == found[1]


def test_awkward_rows(spark):
    out = block_names.dedup(spark.createDataFrame([(*r, 1, 2) for r in awkward()], SCHEMA + ", level int, keep_id int")).collect()
    assert len(out) == len(awkward()) and out[0].asDict().keys() == {"doc_id", "keep_id", "group_size", "kept", "text_sha256", "level", "name"}
    by_id = {r["doc_id"]: r for r in out if r["doc_id"] != 5000}
    base = hashlib.sha256(prose(1, 60).encode()).hexdigest()
    assert {d for d, r in by_id.items() if r["text_sha256"] == base} == {16, 19, 25, None} and by_id[None]["keep_id"] == 25 and not by_id[None]["kept"]
    assert by_id[1]["keep_id"] == 4 and by_id[10]["keep_id"] == 13
    twice = [r for r in out if r["doc_id"] == 5000]
    assert sorted(r["kept"] for r in twice) == [False, True] and all(r["group_size"] == 3 and r["keep_id"] == 5000 for r in twice)
    assert block_names.dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_clash_of_marks_takes_another_seed(spark, monkeypatch):
    asked, honest = [], block_names.marks

    def marks(seed):
        asked.append(seed)
        from pyspark.sql import functions as F
        return [F.lit(1).cast("long").alias("h"), F.lit(1).cast("long").alias("g")] if seed == 0 else honest(seed)

    monkeypatch.setattr(block_names, "marks", marks)
    rows = [(1, "a" * 50), (2, "b" * 50), (3, "A" * 50)]
    out = block_names.dedup(spark.createDataFrame(rows, "doc_id long, text string"), size=8).collect()
    assert {tuple(r)[:5] for r in out} == plain(rows) and set(asked) == {0, 1}


def test_no_intermediate_is_left(spark):
    import os

    out = block_names.dedup(spark.createDataFrame([(1, prose(1, 20))], "doc_id long, text string"), size=64)
    folder = os.path.dirname(out._work_path.removeprefix("file:"))
    assert len([f for f in os.listdir(folder) if not f.startswith(".")]) == 1 and out.count() == 1
    assert Work(spark, "x").folder
