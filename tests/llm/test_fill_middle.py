import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from siftwell.llm import fill_middle
from tests.llm.plain import SCHEMA, awkward, prose

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(key, text, rate=50, spm=80):
    text = text or ""
    tokens = TOKEN.findall(text)
    n, digest = len(tokens), hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[i:i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(tokens[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_ranks_and_borders():
    pick = np.random.default_rng(1)
    for size in (0, 1, 63, 64, 65, 1000):
        symbols = pick.integers(0, 8, size).astype(np.uint8)
        matrix = fill_middle.WaveletMatrix(symbols, 3)
        at = np.arange(size + 1)
        for s in range(8):
            assert matrix.rank(s, at).tolist() == [0, *np.cumsum(symbols == s).tolist()]
        borders = np.concatenate([[0], np.cumsum(symbols & 1)]).astype(np.int64)
        assert matrix.borders(at).tolist() == borders.tolist()
        k = np.arange(borders[-1] + 1)
        assert matrix.border(k, np.zeros_like(k), np.full_like(k, size)).tolist() == np.searchsorted(borders, k).tolist()


def test_against_plain_version(spark, monkeypatch):
    monkeypatch.setattr(fill_middle, "TOGETHER", 500)
    pick = random.Random(3)
    texts = ["", None, " ", "\n\t", "a", " a", "a ", " a  ", "<P>", "x <M> y", "<", "P><S", "a\x1fb\xa0c", "é 漢 🦙🦙  x", prose(1, 5000), "\x0b\x0c\r a\x0b"]
    texts += ["".join(pick.choice(" \n\tab<P>S1é🦙") for _ in range(pick.randrange(0, 40))) for _ in range(800)]
    rows = list(enumerate(texts))
    out = fill_middle.transform(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("again", fill_middle.restored()).collect()
    for r in out:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain(r["doc_id"], r["text"]) and r["again"] == (r["text"] or "")
    assert {r["form"] for r in out} == {"plain", "psm", "spm"} and len(out) == len(rows)


def test_awkward_rows(spark):
    docs = spark.createDataFrame([(*r, "mine", 4) for r in awkward()], SCHEMA + ", form string, output int")
    out = fill_middle.transform(docs, rate=100).collect()
    assert len(out) == len(awkward()) and set(out[0].asDict()) == {"doc_id", "text", "digest", "n", "form", "output", "prefix_chars", "middle_chars"}
    for r in out:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain(r["doc_id"], r["text"], 100)
    renamed = spark.createDataFrame([("k", "some words here")], "n string, output string")
    assert fill_middle.transform(renamed, key="n", text="output", rate=100).select(fill_middle.restored().alias("x")).head()["x"] == "some words here"
    assert fill_middle.transform(spark.createDataFrame([], SCHEMA)).select(F.col("output")).count() == 0
