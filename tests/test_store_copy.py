"""Snapshots of a store at one moment."""

import pytest
from pyspark.sql import functions as F

from siftwell.plans.store import Store
from siftwell.sinks import store_copy
from siftwell.sinks.snapshot import MANIFEST, verified

ROWS = "k string, a bigint, b bigint, tags array<bigint>"


@pytest.fixture
def store(spark, tmp_path):
    made = Store(spark, str(tmp_path / "store"))
    made.create("parted", ROWS, part_col="k")
    made.create("hashed", ROWS, bucket_keys=["a"], buckets=3)
    made.create("plain", ROWS)
    made.create("empty", ROWS)
    rows = spark.createDataFrame(
        [("x/y z", 1, None, [1, None]), ("x/y z", 1, None, [1, None]), (None, 2, 3, None), ("", None, None, []), ("q", 4, 5, [2])], ROWS)
    made.publish([e for t in ("parted", "hashed", "plain") for e in made.append(t, rows)])
    return made


def content(store, table):
    return sorted(map(str, store.read(table).collect()))


def test_restored_store_opens(spark, store, tmp_path):
    store_copy.take(store, str(tmp_path / "s"))
    done = store_copy.restore(spark, str(tmp_path / "s"), str(tmp_path / "r"))
    assert verified(done) and {(r["table"], r["expected"]) for r in done.collect()} == {("parted", 5), ("hashed", 5), ("plain", 5), ("empty", 0)}
    opened = Store(spark, str(tmp_path / "r"))
    for table in ("hashed", "plain", "empty"):
        assert content(opened, table) == content(store, table)
        assert opened.schema(table) == store.schema(table) and opened.declared(table)["part_col"] == store.declared(table)["part_col"]
    assert opened.read("parted").exceptAll(store.read("parted")).isEmpty() and opened.read("parted").count() == 5
    # it goes on as a store: one part replaced, the others untouched
    incoming = spark.createDataFrame([("q", 9, 9, None)], ROWS)
    opened.publish(opened.replace("parted", incoming, ["k"], 1)[0])
    assert opened.read("parted").count() == 5 and opened.read("parted").where("a = 9").count() == 1
    with pytest.raises(ValueError, match="with rows"):
        store_copy.restore(spark, str(tmp_path / "s"), str(tmp_path / "r"))


def test_unchanged_folders_are_named(spark, store, tmp_path):
    first, second, third = (str(tmp_path / n) for n in ("s1", "s2", "s3"))
    store_copy.take(store, first)
    store.publish(store.replace("parted", spark.createDataFrame([("q", 8, 8, None)], ROWS), ["k"], 1)[0])
    made = store_copy.take(store, second, base=first)
    own = [r["part"] for r in made.where(F.startswith("path", F.lit(second))).collect()]
    assert own == ["q"]
    assert store_copy.named(spark, second).count() == made.where("path IS NOT NULL").count() - 1
    store_copy.take(store, third, base=second)  # nothing has changed: names go back to the first copies
    assert store_copy.manifest(spark, third).where(F.startswith("path", F.lit(third))).isEmpty()
    store_copy.restore(spark, third, str(tmp_path / "r"))
    assert content(Store(spark, str(tmp_path / "r")), "parted") == content(store, "parted")


def test_one_moment(spark, store, tmp_path):
    """A load over two tables is in a snapshot as a whole or not at all, also where the store object is older."""
    other = Store(spark, store.root)
    more = spark.createDataFrame([("n", 7, 7, None)], ROWS)
    written = other.append("parted", more) + other.append("plain", more)
    before = store_copy.take(store, str(tmp_path / "s1"))
    other.publish(written)
    after = store_copy.take(store, str(tmp_path / "s2"))
    rows = lambda made: {r["table"]: r["n"] for r in made.groupBy("table").agg(F.sum("rows").alias("n")).collect()}
    assert rows(before) == {"parted": 5, "hashed": 5, "plain": 5, "empty": 0}
    assert rows(after) == {"parted": 6, "hashed": 5, "plain": 6, "empty": 0}
    assert after.first()["seq"] == before.first()["seq"] + 2


def test_changed_values_of_equal_counts_are_found(spark, store, tmp_path):
    folder = str(tmp_path / "s")
    made = store_copy.take(store, folder)
    assert verified(store_copy.verify(spark, folder))
    path = made.where("table = 'plain' AND path IS NOT NULL").first()["path"]
    given = spark.read.schema(ROWS).parquet(path).collect()
    for change in ({"a": "coalesce(a, 0) + 1"}, {"a": "b", "b": "a"}, {"tags": "reverse(tags)"}):
        rows = spark.createDataFrame(given, ROWS).withColumns({c: F.expr(e) for c, e in change.items()})
        rows.write.mode("overwrite").parquet(path)
        found = {r["table"]: r["status"] for r in store_copy.verify(spark, folder).collect()}
        assert found == {"parted": "ok", "hashed": "ok", "plain": "differs", "empty": "ok"}
    with pytest.raises(ValueError, match="plain"):
        store_copy.restore(spark, folder, str(tmp_path / "r"))
    assert all(Store(spark, str(tmp_path / "r")).read(t).isEmpty() for t in ("parted", "plain"))


def test_a_broken_snapshot_has_no_manifest(spark, store, tmp_path):
    with pytest.raises(Exception):
        store_copy.verify(spark, str(tmp_path / "none"))
    nothing = Store(spark, str(tmp_path / "bare"))
    assert store_copy.take(nothing, str(tmp_path / "s")).isEmpty() and (tmp_path / "s" / MANIFEST).exists()
    assert store_copy.restore(spark, str(tmp_path / "s"), str(tmp_path / "r")).isEmpty()
