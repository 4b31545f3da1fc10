"""Publication by several writers, and the folders that replacements leave behind."""

import os
import threading

import pytest

from siftwell.plans.store import Store, StoreMoved


def one(spark, k, v):
    return spark.createDataFrame([(k, v)], "k string, v bigint")


def test_two_writers_of_one_moment(spark, tmp_path):
    """Both have seen the same log and both go on to append to it: one is refused and leaves nothing."""
    a = Store(spark, str(tmp_path / "s"))
    a.create("t", "k string, v bigint")
    b = Store(spark, a.root)
    mine, yours = a.append("t", one(spark, "a", 1)), b.append("t", one(spark, "b", 2))
    assert b.moment() == a.moment() == 1
    a.publish(mine)
    with pytest.raises(StoreMoved):
        b._append_log([(2, e.table, e.part, e.full, e.path, None, None, None) for e in yours])
    with pytest.raises(StoreMoved):
        b.publish(yours)
    assert [r["k"] for r in Store(spark, a.root).read("t").collect()] == ["a"]
    b.refresh()
    b.publish(yours)
    assert sorted(r["k"] for r in Store(spark, a.root).read("t").collect()) == ["a", "b"]
    names = sorted(n for n in os.listdir(tmp_path / "s" / "_log") if n.endswith(".parquet") and not n.startswith("."))
    assert names == [f"{i:020d}.parquet" for i in (1, 2, 3)]
    assert not [n for n in os.listdir(tmp_path / "s" / "_drafts") if not n.startswith(".")]


def test_writers_that_try_again_lose_nothing(spark, tmp_path):
    root = str(tmp_path / "s")
    Store(spark, root).create("t", "k string, v bigint")

    def write(v):
        store = Store(spark, root)
        written = store.append("t", one(spark, "w", v))
        while True:
            try:
                return store.publish(written)
            except StoreMoved:
                store.refresh()

    writers = [threading.Thread(target=write, args=(v,)) for v in range(4)]
    for w in writers:
        w.start()
    for w in writers:
        w.join(120)
    assert sorted(r["v"] for r in Store(spark, root).read("t").collect()) == [0, 1, 2, 3]


def test_sweep(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.create("t", "k string, v bigint", part_col="k")
    store.publish(store.append("t", one(spark, "a/1", 1).union(one(spark, "b", 2))))
    store.publish(store.replace("t", one(spark, "b", 3), ["k"], 1)[0])
    unpublished = store.append("t", one(spark, "c", 4))
    live = {e.path for e in store._live("t")}
    assert store.sweep(3600) == []
    gone = store.sweep(-60)  # everything counts as old
    assert len(gone) == 2 and not live & set(gone) and not any(os.path.exists(p) for p in gone)
    assert unpublished[0].path.rsplit("/", 1)[0] in gone
    assert sorted(tuple(r) for r in Store(spark, store.root).read("t").collect()) == [("a/1", 1), ("b", 3)]


def test_folders_without_an_incoming_key_stay(spark, tmp_path):
    """A table without parts: only the folders that hold a key are written anew, whatever the key's type, NULL included."""
    schema = "k string, d date, v bigint"
    store = Store(spark, str(tmp_path / "a store+%41"))
    store.create("t", schema)

    def rows(*given):
        return spark.createDataFrame(list(given), "k string, d string, v bigint").selectExpr("k", "cast(d as date) d", "v")

    for given in ([("a", "2020-01-01", 1), ("b", "2020-01-02", 2)], [("c", "2020-01-01", 3), (None, None, 4)], [("a", "2021-01-01", 5)]):
        store.publish(store.append("t", rows(*given)))
    first, second, third = [e.path for e in store._live("t")]

    entries, replaced = store.replace("t", rows(("a", "2020-01-01", 10), ("z", "2020-01-01", 11)), ["k", "d"], 2)
    assert replaced == 1
    pending = [e.path for e in store._live("t", entries)]
    assert pending[:2] == [second, third] and len(pending) == 3 and [e.path for e in store._live("t")] == [first, second, third]
    store.publish(entries)
    assert sorted(r["v"] for r in Store(spark, store.root).read("t").collect()) == [2, 3, 4, 5, 10, 11]

    entries, replaced = store.replace("t", rows((None, None, 40)), ["k", "d"], 1)
    assert replaced == 1
    store.publish(entries)
    assert second not in {e.path for e in store._live("t")} and third in {e.path for e in store._live("t")}
    before = [e.path for e in store._live("t")]
    entries, replaced = store.replace("t", rows(("new", "2030-01-01", 50)), ["k", "d"], 1)
    assert replaced == 0 and [e.full for e in entries] == [False]
    store.publish(entries)
    assert [e.path for e in store._live("t")][:-1] == before
    assert sorted(r["v"] for r in store.read("t").collect()) == [2, 3, 5, 10, 11, 40, 50]

    # keyed changes go by folders, too; a key that no folder holds deletes nothing and writes nothing
    assert store.merge("t", rows(("no", "2020-01-01", 0)), ["k"], "borrar") == []
    store.publish(store.merge("t", rows(("a", "2021-01-01", 0)).select("k"), ["k"], "borrar"))
    store.publish(store.merge("t", rows(("b", "2020-01-02", 20), ("y", "2020-01-02", 21)).select("k", "v"), ["k"], "fusionar"))
    assert sorted((r["k"] or "", r["v"]) for r in Store(spark, store.root).read("t").collect()) == [
        ("", 40), ("b", 20), ("c", 3), ("new", 50), ("y", 21), ("z", 11)]
    gone = store.sweep(-60)
    assert first in gone and second in gone and third in gone
    assert store.read("t").count() == 6


def test_folders_of_parts_that_the_keys_do_not_tell(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.create("t", "p string, k bigint, v bigint", part_col="p")
    store.publish(store.append("t", spark.createDataFrame([("x/1", 1, 1), ("y=%2F", 2, 2), (None, 3, 3)], "p string, k bigint, v bigint")))
    before = {e.part: e.path for e in store._live("t")}
    entries, replaced = store.replace("t", spark.createDataFrame([("x/1", 2, 20)], "p string, k bigint, v bigint"), ["k"], 1)
    store.publish(entries)
    assert replaced == 1
    after = [(e.part, e.path) for e in store._live("t")]
    assert ("x/1", before["x/1"]) in after and before["y=%2F"] not in dict(after).values() and len(after) == 3
    assert sorted((r["k"], r["v"]) for r in store.read("t").collect()) == [(1, 1), (2, 20), (3, 3)]
