"""Deliveries: many files judged each by itself by one plan; keyed changes; rules that share a scan."""

import pytest

from siftwell.operators import merge, rules
from siftwell.operators.variables import InvalidVariable
from siftwell.plans import load, together
from siftwell.plans.store import Store
from tests.test_load import FLOOD, Gauges


@pytest.fixture
def gauges(spark, tmp_path):
    own = Gauges(spark, tmp_path)
    own.store.create_all({"diary": "run bigint, line string", "hall": "station string, mm double"})
    return own


STOP = {**FLOOD, "tipo": "stop"}
MANY = {"nombre": "many", "tipo": "alarma", "mensaje": "more than one line", "sql": "SELECT count(*) AS n FROM _entrante HAVING count(*) > 1"}


def fill(gauges):
    gauges.put("a.txt", "N1|2024.01.01|1|", "N2|2024.01.01|2|")
    gauges.put("b.txt", "N1|2024.01.01|1000|", "N3|2024.01.01|5|")
    gauges.put("d d.txt", "N2|2024.01.01|20|", "N5|soon|1|")


CHANGES = {
    "campos_singularidad": ["station"], "validaciones": [STOP, MANY],
    "variables": [{"momento": "antes", "sql": "SELECT count(*) AS n, max(mm) AS most FROM _entrante"}],
    "acciones": [
        {"momento": "antes", "tabla": "diary", "sql": "SELECT :ejecucion_id AS run, concat(':fichero is ', :fichero) AS line"},
        {"momento": "al_fallar", "tabla": "diary", "sql": "SELECT :ejecucion_id AS run, concat('failed with ', :v_most) AS line"},
        {"momento": "tras_promover", "tabla": "diary", "sql": "SELECT :ejecucion_id AS run, concat_ws('/', :v_n, :promovidas, :carga) AS line"}]}


@pytest.mark.parametrize("unit", ["auto", "file"])
def test_files_judged_by_themselves(gauges, unit, monkeypatch):
    fill(gauges)
    monkeypatch.setattr(load, "NAMED_FILES", 2 if unit == "auto" else 10_000)  # the folder is read, and no list of names
    assert not load.in_turn({**gauges.definition, **CHANGES})
    done = gauges.run(changes=CHANGES, unit=unit)
    assert len(done) == (1 if unit == "auto" else 3)
    assert [(r["fichero"], r["estado"], r["filas_leidas"], r["filas_ok"]) for r in gauges.runs()] == [
        ("a.txt", "OK", 2, 2), ("b.txt", "ERROR", 2, 2), ("d d.txt", "OK", 2, 1)]
    assert gauges.rows("station", "mm", "ejecucion_id") == [("N1", 1.0, 1), ("N2", 20.0, 3)]
    assert gauges.rows("run", "line", table="diary") == sorted([
        *[(i + 1, f":fichero is {n}") for i, n in enumerate(("a.txt", "b.txt", "d d.txt"))], (2, "failed with 1000.0"),
        (1, "2/2/rain"), (3, "1/1/rain")], key=str)
    log = {(r["ejecucion_id"], r["nombre"]): (r["afectadas"], r["detalle"]) for r in gauges.store.read(load.FIRED).collect()}
    assert log == {(2, "flood"): (1, '[{"station":"N1","mm":1000.0}]'), (1, "many"): (1, '[{"n":2}]'), (2, "many"): (1, '[{"n":2}]')}
    assert gauges.store.read(load.REJECTS).count() == 1 and gauges.store.read(load.LINKS).count() == 3
    left = [r["name"] for r in load.new_files(gauges.spark, gauges.store, gauges.definition).collect()]
    assert left == ["b.txt"]  # the stopped one comes again, and only that


@pytest.mark.parametrize("unit", ["auto", "file"])
def test_staging_by_file(gauges, unit):
    gauges.put("a.txt", "N1|2024.01.01|1|", "N1|2024.01.02|2|")
    gauges.put("b.txt", "N1|2024.01.01|7|", "N2|2024.01.01|1|")
    gauges.run(unit=unit, changes={"tabla_hall": "hall", "transformacion_sql": "SELECT station, sum(mm) AS mm, first(:ejecucion_id) AS ejecucion_id FROM hall GROUP BY station"})
    assert gauges.rows("station", "mm", "ejecucion_id") == [("N1", 3.0, 1), ("N1", 7.0, 2), ("N2", 1.0, 2)]
    assert gauges.rows(table="hall") == [("N1", 7.0), ("N2", 1.0)]


def test_what_looks_at_other_files_goes_in_turn(gauges):
    base = {**gauges.definition, "validaciones": [STOP]}
    assert not load.in_turn(base)
    for sql in ("SELECT station FROM reading", "SELECT station FROM _entrante WHERE mm > (SELECT avg(mm) FROM _entrante)", "SELECT :borradas AS n FROM _entrante"):
        assert load.in_turn({**base, "validaciones": [{**STOP, "sql": sql}]})
    assert not load.in_turn({**base, "validaciones": [{**STOP, "sql": "SELECT * FROM (SELECT mm FROM _entrante) WHERE mm > 3 AND 'x' <> ':borradas'"}]})
    assert together.names_bound("SELECT :a, ':b', `:c`, x::int -- :d\n, :e /* :f */") == {"a", "e"}


def test_a_variable_of_many_rows_is_an_error(gauges):
    fill(gauges)
    for sql in ("SELECT mm AS x FROM _entrante", "SELECT mm AS x FROM _entrante WHERE mm < 0"):
        with pytest.raises(InvalidVariable, match="run 1"):
            gauges.run(changes={"variables": [{"momento": "antes", "sql": sql}]})
    assert gauges.runs() == []


def test_files_of_a_large_folder_are_left_out_by_a_join(gauges, monkeypatch):
    monkeypatch.setattr(load, "NAMED_FILES", 0)
    gauges.put("a.txt", "N1|2024.01.01|1|")
    gauges.run()
    gauges.put("b ü.txt", "N2|2024.01.01|2|")
    gauges.put("same.txt", "N1|2024.01.01|1|")
    done, = gauges.run()
    assert [f["file"] for f in done.files] == ["b ü.txt"] and gauges.rows() == [("N1", 1.0), ("N2", 2.0)]


TARGET = [("a", 1, "x"), ("b", 2, "x"), ("b", 3, "y"), (None, 4, "y")]


def test_keyed_changes(spark):
    target = spark.createDataFrame(TARGET, "k string, n int, note string")
    source = spark.createDataFrame([("b", 9, 1), (None, 8, 1), ("new", 7, 1)], "k string, n bigint, other int")
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    updated = [("a", 1, "x"), ("b", 9, "x"), ("b", 9, "y"), (None, 8, "y")]
    for mode, expected in ((merge.UPDATE, updated), (merge.MERGE, [*updated, ("new", 7, None)]), (merge.DELETE, [("a", 1, "x")])):
        once = merge.merge_rows(target, source, ["k"], mode)
        assert rows(once) == sorted(expected, key=str) == rows(merge.merge_rows(once, source, ["k"], mode)) and once.columns == target.columns
    assert rows(merge.merge_rows(target, source.limit(0), ["k"])) == rows(target) and merge.merge_rows(target.limit(0), source, ["k"]).count() == 3
    with pytest.raises(merge.SeveralSources, match="k = 'b'"):
        merge.check_sources(target, source.unionByName(source.limit(1)), ["k"])
    for keys, mode in ((["absent"], merge.MERGE), ([], merge.MERGE), (["k"], "append")):
        with pytest.raises(ValueError):
            merge.merge_rows(target, source, keys, mode)


def test_keyed_changes_write_touched_parts_only(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.create("t", "k string, n int, note string", bucket_keys=["k"], buckets=16)
    store.publish(store.append("t", spark.createDataFrame([(f"k{i}", i, "x") for i in range(80)], "k string, n int, note string")))
    before = {e.part: e.path for e in store._live("t")}
    source = spark.createDataFrame([("k5", 50)], "k string, n int")
    store.publish(store.merge("t", source, ["k"], merge.UPDATE))
    after = {e.part: e.path for e in store._live("t")}
    assert sum(before[p] != after[p] for p in before) == 1
    assert {(r["k"], r["n"], r["note"]) for r in store.read("t").collect()} == {(f"k{i}", 50 if i == 5 else i, "x") for i in range(80)}
    store.publish(store.merge("t", source, ["k"], merge.DELETE))
    assert store.read("t").count() == 79


def test_actions_change_rows_by_key(gauges):
    gauges.store.create("last", "station string, mm double, seen int")
    tell = {"momento": "tras_promover", "tabla": "last", "modo": "fusionar", "claves": ["station"], "sql": "SELECT station, mm FROM _entrante"}
    for i, rows in enumerate((["N1|2024.01.01|1|", "N2|2024.01.01|2|"], ["N2|2024.01.02|5|"], ["N2|2024.01.03|6|", "N2|2024.01.03|7|"])):
        gauges.put(f"{i}.txt", *rows)
    with pytest.raises(merge.SeveralSources):
        gauges.run(changes={"acciones": [tell]})
    assert gauges.rows(table="last") == [("N1", 1.0), ("N2", 5.0)]  # what the files before it left
    assert [r["estado"] for r in gauges.runs()] == ["OK", "OK"]


def test_rules_share_a_scan(spark):
    spark.range(100).selectExpr("id", "id % 10 AS digit", "concat('n', id) AS name").createOrReplaceTempView("numbers")
    given = [rules.Rule("big", rules.STOP, "", "SELECT id, name FROM numbers WHERE id >= :p_least ORDER BY digit DESC, id", 3),
             rules.Rule("odd", rules.ALARM, "", "select * from numbers where digit in (1, 3)", 2), rules.Rule("none", rules.ALARM, "", "SELECT id FROM numbers WHERE id < 0"),
             rules.Rule("hidden", rules.ALARM, "", "SELECT id FROM numbers WHERE id = 1", 0), rules.Rule("sum", rules.ALARM, "", "SELECT sum(id) AS s FROM numbers")]
    assert [bool(rules.by_row(r.sql)) for r in given] == [True, True, True, True, False]
    found = {r["name"]: (r["affected"], r["fired"], r["detail"]) for r in rules.evaluate(spark, given, {"p_least": 90}).collect()}
    assert found["big"] == (10, True, '[{"id":99,"name":"n99"},{"id":98,"name":"n98"},{"id":97,"name":"n97"}]')
    assert found["odd"] == (20, True, '[{"id":1,"digit":1,"name":"n1"},{"id":3,"digit":3,"name":"n3"}]')
    assert found["none"] == (0, False, None) and found["hidden"][:2] == (1, True) and found["sum"] == (1, True, '[{"s":4950}]')
    own = [(r, rules.by_row(r.sql)) for r in given[:4]]
    fired = rules.fired_rows(spark, "numbers", own, {"p_least": 90})
    assert fired._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1


def test_a_batch_is_published_once(gauges):
    gauges.put("a.txt", "N1|2024.01.01|1|")
    gauges.put("b.txt", "N2|2024.01.01|2|")
    assert [r.promoted for r in gauges.run(origin="stream 0", force=True)] == [2]
    assert gauges.run(origin="stream 0", force=True) == [] and len(gauges.rows()) == 2
    assert [r.promoted for r in gauges.run(origin="stream 1", force=True, unit="file")] == [1, 1]
    assert gauges.run(origin="stream 1", force=True, unit="file") == [] and len(gauges.rows()) == 4
