import re

from siftwell.llm import decontam
from tests.llm.plain import SCHEMA, awkward, prose


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, size=13):
    out = {}
    for d, t in docs:
        ws, hit, held = words(t), set(), set()
        for name, text in items:
            own = words(text)
            k = min(size, len(own))
            windows = {tuple(own[i:i + k]) for i in range(len(own) - k + 1)} if own else set()
            for i in range(len(ws) - k + 1 if own else 0):
                if tuple(ws[i:i + k]) in windows:
                    hit.update(range(i, i + k))
                    held.add(str(name))
        out[d] = (len(ws), len(hit), sorted(held), bool(hit) and 20 * len(hit) >= len(ws))
    return out


ITEMS = [(2, prose(50, 40)), (10, prose(51, 13)), (11, prose(51, 20)), (3, "short item here"), (4, "Émile's, café №5"), (5, None), (6, "..."), (7, prose(51, 13)), (None, "no id")]
DOCS = [(1, prose(50, 40)), (2, f"{prose(60, 200)} {' '.join(prose(50, 40).split()[5:18])} {prose(61, 100)}"), (3, prose(60, 300)),
        (4, f"x-{prose(51, 20).upper().replace(' ', ', ')}!"), (5, "a SHORT, item\nhere"), (6, "short item"), (7, f"{prose(62, 400)} short item here"),
        (8, "… ÉMILE'S"), (9, "é́ émile's CAFÉ №5 x"), (10, "Émile's café №5"), (11, None), (12, ""), (13, " ".join([prose(51, 13)] * 3)), (14, "no id")]


def test_against_plain_version(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    expected = plain(DOCS, [i for i in ITEMS if i[0] is not None])
    assert sum(1 for e in expected.values() if e[1]) >= 7
    for limit in (1 << 18, 200):  # one automaton, and several one after the other
        out = decontam.scan(docs, items, block_bytes=limit).collect()
        assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in out} == expected
        for r in out:
            assert [w for s in r["spans"] for w in words((r["text"] or "")[s["start"]:s["end"]])] == [] or sum(len(words(r["text"][s["start"]:s["end"]])) for s in r["spans"]) == r["n_hit"]
            if r["doc_id"] == 5:
                assert [r["text"][s["start"]:s["end"]] for s in r["spans"]] == ["SHORT, item\nhere"]


def test_awkward_rows(spark):
    items = spark.createDataFrame([(1, prose(1, 60), "x")], "item_id long, text string, doc_id string")
    out = decontam.scan(spark.createDataFrame([(*r, 3) for r in awkward()], SCHEMA + ", n_hit int"), items).collect()
    assert len(out) == len(awkward()) and {r["doc_id"] for r in out if r["contaminated"]} == {16, 19, 22, 25, None}
    named = spark.createDataFrame([(1, prose(1, 60), "mine", 5, "own"), (2, "x", None, 6, "own")], "doc_id long, text string, hits string, ab int, Spans string")
    told = {r["doc_id"]: r for r in decontam.scan(named, items).collect()}
    assert told[1]["hits"] == "mine" and told[2]["ab"] == 6 and told[1]["n_hit"] == 60 and told[2]["spans"] == []
    assert decontam.scan(spark.createDataFrame([], SCHEMA), items).count() == 0
    assert decontam.scan(spark.createDataFrame(awkward(), SCHEMA), items.limit(0)).where("n_hit > 0").count() == 0


def test_many_blocks_in_short_plans(spark):
    items = [(i, prose(7000 + i, 30)) for i in range(40)]
    docs = [(i, f"{prose(7100 + i, 50)} {prose(7000 + i, 30)} {prose(7000 + (i + 7) % 40, 30)}") for i in range(45)]
    out = decontam.scan(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_bytes=500)
    steps = out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")
    assert 1 <= steps <= 4
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in out.collect()} == plain(docs, items)
