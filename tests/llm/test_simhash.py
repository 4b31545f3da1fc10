import hashlib

from siftwell.llm import queries, simhash
from tests.llm.plain import SCHEMA, awkward, prose


def bits(text):
    return int(text, 16)


def test_next_document_and_edit(spark):
    rows = awkward()
    made = simhash.with_next(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    ordered = sorted(((d, t or "") for d, t, _, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    expected = []
    for i, (d, t) in enumerate(ordered):
        following = ordered[(i + 1) % len(ordered)][1]
        edit = t[:len(t) - len(t) // 2] + following[:len(t) // 2]
        expected.append((str(d), len(t), hashlib.sha256(edit.encode()).hexdigest()))
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in made) == sorted(expected)
    prints = {r["doc_id"]: r["fingerprint"] for r in made}
    assert prints[16] == prints[19] == prints[None] and prints[16] != prints[28] and prints[1] == prints[4] == prints[7]
    for r in made:
        agree = 128 - (bits(r["fingerprint"]) ^ bits(r["edited_fingerprint"])).bit_count()
        assert abs(r["near_edited"] - agree / 128) < 1e-12 and 0 <= r["near_next"] <= 1
    assert simhash.with_next(spark.createDataFrame([], SCHEMA)).count() == 0
    one = simhash.with_next(spark.createDataFrame([(1, "abcd efgh", 0, "")], SCHEMA)).first()
    assert one["near_next"] == 1.0


def test_search_finds_all_within_the_radius(spark):
    texts = [prose(i // 6, 300) + f" tail{i % 6}" * (i % 6) for i in range(240)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    prints = simhash.fingerprint(docs).cache()
    known = [r["fingerprint"] for r in prints.collect()]
    for radius in (3, 6, 12):
        found = {(r["query"], r["found"]): r["distance"] for r in simhash.within(prints, prints.where("doc_id % 10 = 0"), radius).collect()}
        expected = {(q, f): (bits(q) ^ bits(f)).bit_count() for q in known[::10] for f in known if (bits(q) ^ bits(f)).bit_count() <= radius}
        assert found == expected and len(found) > 24


def test_every_place_of_twelve_bits(spark):
    """Fingerprints that differ in chosen bits, spread over the eight blocks in every way that matters."""
    import random

    import pytest

    pick, pairs = random.Random(5), []
    spreads = [(2,) * 6, (1,) * 4 + (2,) * 4, (0,) + (1,) * 2 + (2,) * 5, (0, 0) + (2,) * 6, (12,), (3, 3, 3, 3), (1,) * 8, (1, 1, 1, 1, 1, 1, 1, 5), (0, 1, 1, 1, 1, 1, 1, 6)]
    for spread in spreads:
        for _ in range(60):
            counts = [*spread, *[0] * (8 - len(spread))]
            pick.shuffle(counts)
            change = sum(1 << (16 * b + bit) for b, n in enumerate(counts) for bit in pick.sample(range(16), n))
            base = pick.getrandbits(128)
            pairs.append((f"{base:032x}", f"{base ^ change:032x}"))
    side = [spark.createDataFrame([(x,) for x in one], "fingerprint string") for one in zip(*pairs)]
    found = {(r["query"], r["found"]): r["distance"] for r in simhash.within(side[1], side[0]).collect()}
    assert found == {(a, b): (bits(a) ^ bits(b)).bit_count() for a in side_values(pairs, 0) for b in side_values(pairs, 1) if (bits(a) ^ bits(b)).bit_count() <= 12}
    assert len(found) == len(pairs)
    with pytest.raises(ValueError):
        simhash.within(side[1], side[0], 13)


def side_values(pairs, at):
    return {p[at] for p in pairs}


def test_votes_against_a_plain_version():
    import math

    import numpy as np

    hashed = [3, 3, 3, 2**63 + 5, 77, 77, 12345678901234567890, 1]
    words = np.array(hashed, np.uint64)
    with np.errstate(over="ignore"):
        second = dict(zip(hashed, (int(x) for x in simhash.mix(words ^ simhash.SALT))))
    total = [0.0] * 128
    for word in set(hashed):
        weight = 1 + math.log(hashed.count(word))
        for half, number in enumerate((word, second[word])):
            for at, byte in enumerate(number.to_bytes(8, "little")):
                for bit in range(8):
                    total[64 * half + 8 * at + bit] += weight if byte >> (7 - bit) & 1 else -weight
    assert simhash.votes(words).tolist() == [t > 0 for t in total]


def test_long_text_in_pieces_has_the_same_words():
    from siftwell.llm.common import WordHasher

    text = prose(9, 3000).encode()
    whole = list(WordHasher().texts([text]))[0][0]
    cut = list(WordHasher(limit=500).texts([text]))[0][0]
    assert (whole == cut).all() and len(whole) == 3000


def test_query_on_repeated_ids(spark, tmp_path):
    base = prose(1, 300)
    texts = [(100, base), (100, base), (100, prose(2, 300)), (101, base), (103, f"{base} tail"), (200, prose(3, 300)), (201, prose(4, 300)), (None, base)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    made = queries.op3_simhash(spark, str(tmp_path)).collect()
    prints = [(r["doc_id"], r["fingerprint"]) for r in made]
    assert len(made) == len(texts)
    for r in made:
        near = [(d, f) for d, f in prints if (bits(f) ^ bits(r["fingerprint"])).bit_count() <= 12]
        asked = r["doc_id"] is not None and r["doc_id"] % 100 == 0
        classes = sorted(min(d for d, g in prints if g == f and d is not None) for f in {f for _, f in near})
        assert r["n_near"] == (len(near) - 1 if asked else None) and r["near_class"] == (classes[0] if asked else None)
    assert sorted(r["n_near"] for r in made if r["n_near"] is not None) == [0, 0, 4, 4]
