import public_tokenizers
import sentencepiece

import corpus_pipeline
from siftwell.llm import queries
from siftwell.llm.common import Work
from tests.llm.plain import prose, shingles, groups

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_keep_clean_documents(spark, tmp_path):
    item = prose(900, 40)
    clean = {i: f"{prose(i, 80)}.\n{prose(1000 + i, 90)}." for i in range(1, 60)}
    junk = {100 + i: " | ".join(prose(2000 + i, 60).upper().split()) + " !!!" for i in range(40)}
    passage = prose(800, 70)
    special = {300: f"{prose(301, 60)}.\n{passage}", 302: f"{prose(303, 60)}.\n{passage}", 304: clean[5], 306: f"{prose(307, 130)}. {item}"}
    words = clean[7].replace("\n", " ").split()
    special[308] = " ".join([*words[:50], "changed", *words[51:]])
    rows = [(d, t, "xx", "s", len(t)) for d, t in {**clean, **junk, **special}.items()] + [(400, None, None, None, None), (401, "", "xx", "s", 0)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, 1, 0) for d in clean] + [(d, 0, 0) for d in junk], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    work, docs, kept = Work(spark, "test"), spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        docs = work.stage(out, "stage")
        kept.append({r["doc_id"]: r["text"] if "text" in docs.columns else r for r in docs.collect()})
        if len(kept) < 5:
            assert docs.dtypes == spark.read.parquet(f"{tmp_path}/documents.parquet").dtypes
    assert set(kept[0]) == set(clean) | set(special)
    assert kept[1][302] == f"{prose(303, 60)}." and 304 not in kept[1] and all(kept[1][d] == t for d, t in clean.items())
    label = groups({d: shingles(t) for d, t in kept[1].items()})
    assert set(kept[2]) == {d for d in kept[1] if label[d] == d} and 308 not in kept[2] and 7 in kept[2]
    assert set(kept[3]) == set(kept[2]) - {306}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert {d: r["ids"] for d, r in kept[4].items()} == {d: library.encode(t) for d, t in kept[3].items()} and all(r["round_trip"] for r in kept[4].values())
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(kept[4])


def test_columns_that_operators_use_and_empty_tables(spark, tmp_path):
    more = ", items string, n_lines string, hits int, `a.b` int, n_hit string, __score string, component_id string"
    own = ("mine", "seven", 3, 4, "h", "s", "c")
    rows = [(i, f"{prose(i, 60)}.\n{prose(70 + i, 60)}", "xx", "s", 1, *own) for i in range(20)]
    rows += [(50, rows[3][1], "xx", "s", 1, *own)] * 2 + [(60, None, None, None, None, *[None] * 7), (61, "", "xx", "s", 0, *own)]
    item = spark.createDataFrame([(1, prose(5, 40))], "item_id long, text string")
    item.write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    given = spark.createDataFrame(rows, COLUMNS + more)
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, given, str(tmp_path))
        assert out.dtypes == given.dtypes, name
        assert {tuple(r)[5:] for r in out.collect()} <= {own, (None,) * 7}, name
        assert stage(spark, given.limit(0), str(tmp_path)).count() == 0
    kept = corpus_pipeline.drop_benchmark(spark, given, str(tmp_path)).collect()
    assert {r["doc_id"] for r in kept} == {r[0] for r in rows} - {5}
    near = corpus_pipeline.keep_one_of_each(spark, given, str(tmp_path)).collect()
    assert {r["doc_id"] for r in near} == {r[0] for r in rows} - {50}
    runs = corpus_pipeline.drop_repeated_runs(spark, given, str(tmp_path)).collect()
    assert {r["doc_id"] for r in runs} == {r[0] for r in rows} - {50}
    assert corpus_pipeline.encode(spark, given.limit(0), str(tmp_path)).count() == 0


def test_near_copies_are_those_of_five_words(spark):
    texts = {}
    for i, (words, changed) in enumerate([(50, [25]), (97, [20, 60]), (40, [20]), (90, [20, 60]), (120, [])]):
        base = prose(4000 + i, words).split()
        texts[10 * i] = " ".join(base)
        texts[10 * i + 1] = " ".join(f"other{j}" if j in changed else w for j, w in enumerate(base))
    sets = {d: shingles(t, 5) for d, t in texts.items()}
    label, narrow = groups(sets, 80), groups({d: shingles(t) for d, t in texts.items()})
    assert [d for d in texts if label[d] != narrow[d]] == [1, 11] and label[21] == 21 and label[31] == 31 and label[41] == 40
    docs = spark.createDataFrame([(d, t, "xx", "s", len(t)) for d, t in texts.items()], COLUMNS)
    kept = corpus_pipeline.keep_one_of_each(spark, docs, "")
    assert {r["doc_id"] for r in kept.collect()} == {d for d in texts if label[d] == d}


def test_every_operator_has_a_query():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 14))
