import math
import random
import re
from collections import Counter

import pytest

from siftwell.llm import term_scan
from tests.llm.plain import SCHEMA, awkward, prose


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, top=10):
    """{item: [(doc, score)]}: by the formula, document by document."""
    counts = [(d, Counter(terms(t))) for d, t in docs]
    documents, total = sum(1 for _, c in counts if c), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = {}
    for item, asked in items.items():
        found = []
        for d, c in counts:
            score = 0
            for t in asked & c.keys():
                m = 10 + (90 * c.total() * documents) // total
                score += math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                found.append((d, score))
        out[item] = sorted(found, key=lambda x: (-x[1], x[0] is not None, x[0]))[:top]
    return {k: v for k, v in out.items() if v}


def by_item(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        out.setdefault(r["item_id"], []).append((r["doc_id"], r["score"]))
    assert all(sorted(r["rank"] for r in rows if r["item_id"] == k) == list(range(1, len(v) + 1)) for k, v in out.items())
    return out


@pytest.mark.parametrize("block_bytes,cells,top", [(1 << 20, 1 << 20, 10), (300, 64, 3)])
def test_against_plain_version(spark, monkeypatch, block_bytes, cells, top):
    monkeypatch.setattr(term_scan, "CELLS", cells)
    pick = random.Random(7)
    words = ["the", "of", "é", "№5", "漢字", *prose(5, 60).split()]
    docs = [(i, " ".join(pick.choice(words + ["The,", "of-the", "other"]) for _ in range(pick.randrange(0, 60)))) for i in range(250)]
    docs += [(1000 + i, "the of é of") for i in range(40)] + [(2000, None), (2001, ""), (2002, "...")]
    items = [(i, " ".join(pick.choice(words) for _ in range(pick.randrange(1, 12)))) for i in range(25)] + [(90, "of"), (91, "unheard"), (92, None), (93, "!"), (94, "the of é of")]
    out = term_scan.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(6), spark.createDataFrame(items, "item_id long, text string"),
                           top=top, block_bytes=block_bytes).collect()
    expected = plain(docs, {i: set(terms(t)) for i, t in items}, top)
    assert by_item(out) == expected and len(expected[94]) == top and 92 not in expected


def test_awkward_rows(spark):
    docs = spark.createDataFrame([(*r, 3, "x") for r in awkward()], SCHEMA + ", item_id int, score string")
    items = [(1, prose(1, 60), 1), (1, "one", 2), (None, "ÉMILE é", 3), (2, None, 4)]
    out = term_scan.search(docs, spark.createDataFrame(items, "item_id long, text string, doc_id int"), top=30).collect()
    asked = {1: {*terms(prose(1, 60)), "one"}, None: {"Émile".lower().replace("é", "É"), "é"}}
    assert by_item(out) == plain([r[:2] for r in awkward()], asked, 30)
    assert term_scan.search(docs.limit(0), spark.createDataFrame(items, "item_id long, text string, doc_id int")).count() == 0
    assert term_scan.search(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_long_sums_stay_exact():
    import numpy as np
    import pyarrow as pa

    one = term_scan.Asked(pa.array([1]), [b"a"], np.array([0, 1]), np.array([0]), 1 << 40, np.array([5000]))
    few = term_scan.Asked(pa.array([1]), [b"a"], np.array([0, 1]), np.array([0]), 1, np.array([5000]))
    given = (np.array([3, 10**8]), np.array([0, 1]), np.array([0, 0]), np.array([2, 7]), 10**12, 10**15)
    m = [10 + 90 * n * 10**12 // 10**15 for n in (3, 10**8)]
    assert one.scores(*given).tolist() == few.scores(*given).tolist() == [[5000 * (10**9 * f // (1000 * f + 8 * x))] for f, x in zip((2, 7), m)]
