import random

import pytest
from pyspark.sql import functions as F

from siftwell.llm import language, quality, toxicity
from siftwell.llm.common import fold_of, sampled
from tests.llm.plain import SCHEMA, awkward

SYLLABLES = {"xx": "ka to mi ra ne su ho".split(), "yy": "brel grun stof plag drem".split(), "zz": "ói éa çu àn ùl".split()}


def speak(lang, seed, words):
    pick = random.Random(f"{lang}{seed}")
    return " ".join("".join(pick.choice(SYLLABLES[lang]) for _ in range(pick.randrange(1, 4))) for _ in range(words)).capitalize() + "."


def auc(pairs):
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))


def test_quality_on_held_out_rows(spark):
    rows = []
    for i in range(400):
        text = speak("xx", i, 40 + i % 60)
        if i % 4 == 0:
            text = text.upper().replace(" ", "!! ") if i % 8 else " | ".join(text.split())
        rows.append((i, text, int(i % 4 != 0)))
    docs, labels = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    learn = fold_of("doc_id", 4) != 2
    model = quality.fit(docs.where(learn), labels)
    scored = quality.score(docs.where(~learn), model).join(labels, "doc_id").collect()
    assert auc([(r["score"], r["quality"]) for r in scored]) > 0.99 and all(0 <= r["score"] <= 1 for r in scored)
    again = quality.fit(docs.where(learn).repartition(7), labels.repartition(3))
    assert again.weights == pytest.approx(model.weights) and again.texts == model.texts
    strange = quality.score(spark.createDataFrame([(*r, 5.0) for r in awkward()], SCHEMA + ", score double"), model).collect()
    assert len(strange) == len(awkward()) and all(0 <= r["score"] <= 1 and (r["score"] == 0) == (not r["text"]) for r in strange)


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    none = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    one = quality.fit(docs, spark.createDataFrame([(1, 1), (None, 0), (2, None), (2, 7)], "doc_id long, quality int"))
    assert {r["score"] for r in quality.score(docs, none).collect()} == {0.5}
    assert {round(r["score"], 6) for r in quality.score(docs, one).collect()} == {round(2 / 3, 6)}
    assert quality.score(docs.limit(0), none).count() == 0


def test_language_on_held_out_rows(spark):
    rows = [(i, speak(lang, i, 30), lang) for i, lang in enumerate(["xx", "yy", "zz", "xx"] * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learn = fold_of("doc_id", 4) != 2
    model = language.fit(docs.where(learn))
    found = language.identify(docs.where(~learn), model).collect()
    assert all(r["lang_pred"] == r["lang"] and 0 <= r["score"] <= 1 for r in found)
    strange = {r["doc_id"]: r for r in language.identify(spark.createDataFrame([(*r, "a") for r in awkward()], SCHEMA + ", margin string"), model).collect()}
    assert all(strange[k]["lang_pred"] == "und" and strange[k]["score"] == 0 and not strange[k]["accepted"] for k in (1, 4, 7))
    assert strange[10]["lang_pred"] in ("xx", "yy", "zz")
    mixed = spark.createDataFrame([(1, speak("xx", 1, 20) + " " + speak("yy", 1, 20))], "doc_id long, text string")
    assert language.identify(mixed, model, narrow=0.9).first()["accepted"] is False
    assert language.identify(docs, language.fit(docs.where("false"))).select("lang_pred").distinct().collect()[0][0] == "und"


def test_toxicity_on_held_out_rows(spark):
    pick = random.Random(4)
    rows = []
    for i in range(600):
        text, bad = speak("xx", i, 40), i % 5 == 0
        if bad:
            words = text.split()
            words.insert(pick.randrange(len(words)), pick.choice(["Frottle", "sl1mbag", "grizz" + pick.choice(SYLLABLES["yy"]), "grizz" + pick.choice(SYLLABLES["xx"])]))
            text = " ".join(words)
        elif i % 7 == 0:
            text += " frottle soup"
        rows.append((i, text, int(bad)))
    docs, labels = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    learn = fold_of("doc_id", 5) != 0
    model = toxicity.fit(docs.where(learn), labels, exceptions=("Frottle soup",))
    scored = toxicity.score(docs.where(~learn), model).join(labels, "doc_id").collect()
    wrong = [r for r in scored if (r["score"] >= 0.5) != bool(r["toxic"])]
    assert len(wrong) <= 0.02 * len(scored)
    hidden = ["a fr0ttle b", "FROTTLE", "fro​ttle", "frоttle", "ｆｒｏｔｔｌｅ", "slimbag!", "frottle frottle soup"]
    clean = ["a b c", "frottler", "unfrottle", "frottle soup", "", None, "Frottle  soup".replace("  ", " ")]
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(list(enumerate(hidden + clean)), "doc_id long, text string"), model).collect()}
    assert [scores[i] >= 0.5 for i in range(len(hidden + clean))] == [True] * len(hidden) + [False] * len(clean)
    assert toxicity.score(spark.createDataFrame(awkward(), SCHEMA), model).where(F.col("score").between(0, 1)).count() == len(awkward())


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.score(docs, model).collect()} == {0.5} and toxicity.score(docs.limit(0), model).count() == 0


def test_a_sample_is_ranked_in_parts_first(spark):
    rows = spark.range(6000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'a', 'b') AS label")
    rows = rows.unionByName(rows.limit(50)).unionByName(spark.createDataFrame([(None, "a"), (7000, None)], "doc_id long, label string"))
    made = sampled(rows, "doc_id", "label", 1500, 6, parts=4)
    hashed = rows.where("doc_id IS NOT NULL AND label IS NOT NULL").distinct().selectExpr("label", "doc_id", "xxhash64(6, CAST(doc_id AS string)) AS h")
    expected = {}
    for r in sorted(hashed.collect(), key=lambda r: (r["h"], r["doc_id"])):
        expected.setdefault(r["label"], []).append(r["doc_id"])
    assert made.columns == ["doc_id", "label", "rank"]
    assert {(r["doc_id"], r["label"], r["rank"]) for r in made.collect()} == {
        (d, name, i + 1) for name, ids in expected.items() for i, d in enumerate(ids[:1500])}
    windows = [line for line in made._jdf.queryExecution().optimizedPlan().toString().splitlines() if "row_number()" in line]
    assert len(windows) == 2 and "[label" in windows[0] and "__part" not in windows[0] and "__part" in windows[1]


def test_numerals_are_no_letters():
    model = language.Model({"xx": b"ka to mi ra", "yy": b"brel grun"})
    for text in ("\u00bd \u00b2", "\u2460\u2461", "\u2167", "12 \u0664", "\u0300", "_", "!?"):
        assert model.predict(text) == ("und", 0.0, 0.0)
    assert language.letters("a\u00bdb \u2460c") == b"a b c" and model.predict("ka\u00b2")[0] == "xx"


def test_sizes_by_language_against_a_plain_version():
    import zstandard

    words = {"xx": speak("xx", 1, 300), "yy": speak("yy", 2, 300)}
    model = language.Model({k: v.lower().encode() for k, v in words.items()})
    for text in (speak("xx", 3, 20), speak("yy", 4, 3000), speak("xx", 5, 8) + speak("yy", 6, 9)):
        sizes = {}
        for name in sorted(words):
            packer = zstandard.ZstdCompressor(level=5, dict_data=zstandard.ZstdCompressionDict(words[name].lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT),
                                              write_content_size=False, write_checksum=False)
            plain = "".join(c if c.isalpha() else " " for c in text.lower()).strip()
            plain = " ".join(plain.split()).encode()
            sizes[name] = sum(len(packer.compress(plain[i:i + 4096])) for i in range(0, len(plain), 4096))
        best = min(sizes, key=lambda k: (sizes[k], k))
        other = next(k for k in sizes if k != best)
        lang, _, margin = model.predict(text)
        assert lang == best and margin == pytest.approx((sizes[other] - sizes[best]) / sizes[best])


def test_lexicon_against_regular_expressions():
    import math
    import re

    model = toxicity.Model({"bad": 2.0, "vile": 3.0}, {"nast": 1.5}, ["not bad", "vile weed of"])
    pick = random.Random(4)
    pieces = ["bad", "B4d", "v\u0456le", "nasty", "nastiest", "not bad", "vile weed of", "vile weed", "badly", "xbad", "plain", "\u00e9", "bad-", "not  bad"]
    for _ in range(300):
        text = " ".join(pick.choice(pieces) for _ in range(pick.randrange(0, 30)))
        folded = toxicity.fold(text)
        edge = r"(?<![^\W_])", r"(?![^\W_])"
        spared = [m.span() for e in map(toxicity.fold, model.exceptions) for m in re.finditer(f"(?={edge[0]}({re.escape(e)}){edge[1]})", folded) for m in [re.compile(re.escape(e)).match(folded, m.start())]]
        found = [(m.start(), m.start() + len(w), x) for w, x in model.words.items() for m in re.finditer(f"(?={edge[0]}{w}{edge[1]})", folded)]
        found += [(m.start(), m.start() + len(s), x) for s, x in model.stems.items() for m in re.finditer(f"(?={edge[0]}{s})", folded)]
        total = sum(x for a, b, x in found if not any(c <= a and b <= d for c, d in spared))
        assert model.feature(text) == pytest.approx(total / (1 + math.log1p(len(folded) / 100)))
