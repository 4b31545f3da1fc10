import random

import pytest

from siftwell.llm import jaccard
from siftwell.llm.common import Work, components
from tests.llm.plain import SCHEMA, awkward, groups, prose, shingles


def near_copies(seed, groups_, each):
    pick = random.Random(seed)
    out = []
    for g in range(groups_):
        base = prose(seed * 1000 + g, pick.choice([3, 8, 30, 80, 120])).split()
        for _ in range(each):
            words = list(base)
            for _ in range(pick.choice([0, 0, 1, 1, 2, 3, 4])):
                words[pick.randrange(len(words))] = f"new{pick.randrange(10**6)}"
            out.append(" ".join(words))
    pick.shuffle(out)
    return out


@pytest.mark.parametrize("seed,percent,block", [(1, 85, 1000), (2, 85, 7), (3, 60, 5)])
def test_against_all_pairs(spark, seed, percent, block):
    common = prose(77, 25)
    texts = near_copies(seed, 25, 14) + [f"{prose(5000 + i, 30)} {common}" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    found = jaccard.join(docs, percent=percent, block_rows=block).collect()
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["n_shingles"] for r in found} == {i: len(s) for i, s in sets.items()}
    expected = groups(sets, percent)
    assert {r["doc_id"]: r["component_id"] for r in found} == expected and len(set(expected.values())) < len(texts) - 100


def test_a_chain_whose_ends_are_unlike(spark):
    words = prose(8, 100).split()
    texts = [" ".join(w if i >= 4 * k else f"swap{i}" for i, w in enumerate(words)) for k in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in jaccard.join(docs).collect()}
    assert found == groups({i: shingles(t) for i, t in enumerate(texts)}) == dict.fromkeys(range(12), 0)


def test_awkward_rows(spark):
    out = jaccard.join(spark.createDataFrame(awkward(), SCHEMA)).collect()
    assert len(out) == len(awkward())
    by_id = {r["doc_id"]: r for r in out}
    assert [by_id[k]["n_shingles"] for k in (1, 4, 7)] == [0, 0, 0] and [by_id[k]["component_id"] for k in (1, 4, 7)] == [1, 4, 7]
    assert by_id[10]["component_id"] == by_id[13]["component_id"] == 10 and by_id[None]["component_id"] is None
    assert {by_id[k]["component_id"] for k in (16, 19, 22, 25)} == {16} and by_id[5000]["component_id"] == 40
    assert jaccard.join(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_a_long_chain(spark):
    order = list(range(150))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame([(a, b) for a, b in zip(order, order[1:])] + [(900, 901), (901, 900), (905, 905)], "a long, b long")
    found = {r["node"]: r["component"] for r in components(Work(spark, "test"), edges).collect()}
    assert found == {**dict.fromkeys(range(150), 0), 900: 900, 901: 900}


def test_bitmap_never_tells_too_much():
    import numpy as np

    pick = np.random.default_rng(1)
    for _ in range(200):
        a, b = (np.unique(pick.integers(0, 5000, pick.integers(1, 3000), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(2))
        x, y = (np.frombuffer(jaccard.bitmap(g), np.uint64) for g in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))
