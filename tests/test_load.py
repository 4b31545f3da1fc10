"""Whole loads over small files: rain gauges, their readings and the stations they stand at."""

import pytest

from siftwell.operators.contracts import Contract
from siftwell.plans import load
from siftwell.plans.store import Store
from siftwell.session import staging
from siftwell.streaming.folder import watch_folder

READING = "station string, day date, mm double, wet boolean, note string, extra_fields string, ejecucion_id bigint"


def field(target, source, *operations):
    return {"destino": target, "origen": source, "operaciones": list(operations)}


MAPPING = [
    field("station", "gauge", {"tipo": "trim"}),
    field("day", "read on", {"tipo": "date_format", "formatos": ["%Y.%m.%d"]}),
    field("mm", "rain", {"tipo": "cast", "tipo_destino": "double"}),
    field("wet", "wet?", {"tipo": "cast", "tipo_destino": "boolean"}),
]


class Gauges:
    """A store with one table, a folder of files and the definition that loads them."""

    def __init__(self, spark, folder, **more):
        self.spark, self.inbox = spark, folder / "inbox"
        self.inbox.mkdir()
        self.store = load.prepare(Store(spark, str(folder / "store")))
        self.store.create("reading", READING)
        self.definition = {"nombre": "rain", "carpeta": str(self.inbox), "patron": "*.txt", "delimitador": "|", "fila_cabecera": 1,
                           "tabla_destino": "reading", "mapping": MAPPING, **more}

    def put(self, name, *rows, header="gauge|read on|rain|wet?"):
        (self.inbox / name).write_text("\n".join([header, *rows]) + "\n", encoding="utf-8")

    def run(self, given=None, **options):
        changes = options.pop("changes", {})
        return load.run_load(self.spark, self.store, {**self.definition, **changes}, given, **options)

    def rows(self, *columns, table="reading"):
        return sorted((tuple(r) for r in self.store.read(table).select(*(columns or ("station", "mm"))).collect()), key=str)

    def runs(self):
        return load.current_runs(self.store).orderBy("id").collect()


@pytest.fixture
def gauges(spark, tmp_path):
    return Gauges(spark, tmp_path)


def test_typed_rows_spare_columns_and_run_stamp(gauges):
    gauges.put("north.txt", " N1 |2024.02.29|3.25|yes|J. K.", "N2|2024.03.01||no|", header="gauge|read on|rain|wet?|reader")
    done, = gauges.run()
    assert (done.status, done.promoted, done.replaced, done.undeclared) == ("OK", 2, 0, ["reader"])
    assert gauges.rows("station", "day", "mm", "extra_fields", "ejecucion_id")[0][2:] == (3.25, '{"reader":"J. K."}', 1)
    assert [str(r[0]) for r in gauges.rows("day")] == ["2024-02-29", "2024-03-01"]


def test_rejected_line_is_kept_with_its_reason(gauges):
    gauges.put("a.txt", "N1|2024.02.30|1|", "N2|2024.02.28|1|", "N3|2024.02.28|much|")
    done, = gauges.run()
    assert [(f["rows_read"], f["rows_ok"], f["rows_rejected"]) for f in done.files] == [(3, 1, 2)]
    kept = {r["num_fila"]: r for r in gauges.store.read(load.REJECTS).collect()}
    assert {n: r["campo_implicado"] for n, r in kept.items()} == {2: "day", 4: "mm"} and '"rain":"much"' in kept[4]["contenido_raw"]


def test_a_quote_that_is_not_closed_is_one_reject(gauges):
    """The lines after it are rows again, and a date on its own line is no evidence."""
    gauges.put("a.txt", 'N1|2024.02.28|1|', '"N2|not a date|1|', "N3|2024.02.28|3|", *[f"N4|2024.02.{i}|4|" for i in range(10, 15)])
    done, = gauges.run(changes={"lineas_registro": 3})
    assert [(f["rows_read"], f["rows_ok"], f["rows_rejected"]) for f in done.files] == [(8, 7, 1)]
    kept, = gauges.store.read(load.REJECTS).collect()
    assert (kept["num_fila"], kept["motivo"], kept["campo_implicado"]) == (3, "quote not closed", None)


def test_content_loaded_once_whatever_its_name(gauges):
    gauges.put("a.txt", "N1|2024.01.01|1|")
    gauges.put("b.txt", "N1|2024.01.01|1|")
    for unit in ("auto", "file"):
        assert len(gauges.run(unit=unit)) == (1 if unit == "auto" else 0)
    assert gauges.rows() == [("N1", 1.0)] and [r["fichero"] for r in gauges.runs()] == ["a.txt"]
    gauges.put("c.txt", "N1|2024.01.01|1|")
    assert gauges.run() == []
    assert [r.promoted for r in gauges.run(force=True)] == [3] and len(gauges.runs()) == 4
    assert gauges.store.read(load.DOCUMENTS).count() == 1 and gauges.store.read(load.LINKS).filter("fecha IS NOT NULL").count() == 4
    assert all(r["fecha"] and r["usuario"] for r in gauges.runs())


def test_declared_column_absent_from_all_or_some_files(gauges):
    gauges.put("a.txt", "N1|2024.01.01|1|yes")
    gauges.put("b.txt", "2024.01.02|N2", header="read on|gauge")
    gauges.run()
    assert gauges.rows("station", "mm", "wet") == [("N1", 1.0, True), ("N2", None, None)]
    other = gauges.definition["mapping"] + [field("note", "remark", {"tipo": "trim"})]
    gauges.run(changes={"mapping": other, "nombre": "again"})
    assert {r[0] for r in gauges.rows("note")} == {None}


def test_line_breaks_inside_quotes(gauges):
    gauges.put("a.txt", '"N\n1"|2024.01.01|1|', '"N|2"|2024.01.02|2|')
    gauges.run()
    assert gauges.rows() == [("N\n1", 1.0), ("N|2", 2.0)]


def test_file_without_its_header_line_stops_before_any_record(gauges):
    gauges.put("a.txt", "x", "N1|2024.01.01|1|")
    (gauges.inbox / "b.txt").write_text("x\n")
    with pytest.raises(ValueError, match="b.txt"):
        gauges.run(changes={"fila_cabecera": 2})
    assert gauges.runs() == []


def test_dry_run_leaves_no_trace(gauges):
    gauges.put("a.txt", "N1|2024.01.01|1|", "N2|soon|1|")
    shown = load.dry_run(gauges.spark, gauges.definition)
    assert (shown["counts"].first()["rows_ok"], shown["valid"].count(), shown["rejected"].count()) == (1, 1, 1)
    assert gauges.rows() == [] and gauges.runs() == []


def test_dry_run_names_every_file_and_shows_its_first_rows(gauges):
    gauges.put("a.txt", *[f"A{i}|2024.01.0{i}|1|" for i in range(1, 8)], "A9|soon|1|")
    gauges.put("b.txt", "B1|2024.01.01|x|")
    shown = load.dry_run(gauges.spark, gauges.definition)
    name = lambda row: row["_file"].rsplit("/", 1)[-1]
    assert shown["counts"].columns == ["_file", "rows_read", "rows_ok", "rows_rejected"]
    assert [(name(r), *r[1:]) for r in shown["counts"].collect()] == [("a.txt", 8, 7, 1), ("b.txt", 1, 0, 1)]
    assert sorted((name(r), r["_row_num"], r["station"]) for r in shown["valid"].collect()) == [("a.txt", i + 1, f"A{i}") for i in range(1, 6)]
    assert sorted((name(r), r["_row_num"], r["field"]) for r in shown["rejected"].collect()) == [("a.txt", 9, "day"), ("b.txt", 2, "mm")]
    assert "_run" not in shown["valid"].columns and "ejecucion_id" not in shown["valid"].columns


def test_mapped_rows_know_their_file_by_number_only(gauges):
    """No path is written, hashed or compared row by row, and files that agree on their dates need no lookup."""
    gauges.put("a.txt", "N1|2024.01.01|1|")
    gauges.put("b.txt", "N2|2024.01.02|2|", "N3|2024.01.03|3|")
    with staging(gauges.spark):
        files, scan, mapped = load._begin(gauges.spark, gauges.store, gauges.definition, {}, load.new_files(gauges.spark, gauges.store, gauges.definition))
        assert "_file" not in mapped.columns
        assert sorted((r["_run"], r["ejecucion_id"], r["station"]) for r in mapped.collect()) == [(1, 1, "N1"), (2, 2, "N2"), (2, 2, "N3")]
        plan = scan.rows._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join") == 1 and "_split" in plan and "lambda" not in plan


def test_an_undecided_date_names_its_file(gauges):
    pair = [field("station", "gauge"), field("day", "read on", {"tipo": "date_format", "formatos": ["%d/%m/%Y", "%m/%d/%Y"]})]
    gauges.put("a.txt", "N1|13/01/2024|1|")
    gauges.put("b.txt", "N2|01/02/2024|1|")
    with pytest.raises(load.UnresolvedDates, match="b.txt, day: no evidence"):
        load.dry_run(gauges.spark, {**gauges.definition, "mapping": pair})
    gauges.put("b.txt", "N2|01/13/2024|1|")
    days = load.dry_run(gauges.spark, {**gauges.definition, "mapping": pair})["valid"].collect()
    assert [str(r["day"]) for r in days] == ["2024-01-13", "2024-01-13"]


def test_replacement_by_key(gauges):
    keys = {"campos_singularidad": ["station", "day"]}
    gauges.put("a.txt", "N1|2024.01.01|1|", "N1|2024.01.02|2|", "N4||5|")
    gauges.run(changes=keys)
    gauges.put("a.txt", "N1|2024.01.02|20|", "N4||50|", "N9|2024.01.01|9|")
    done, = gauges.run(changes=keys)
    assert (done.promoted, done.replaced) == (3, 2)
    assert set(gauges.rows()) == {("N1", 1.0), ("N1", 20.0), ("N9", 9.0), ("N4", 50.0)}


def test_only_touched_parts_are_written_again(gauges):
    gauges.store.create("by_station", READING, part_col="station")
    changes = {"tabla_destino": "by_station", "campos_singularidad": ["station", "day"]}
    gauges.put("a.txt", "N1|2024.01.01|1|", "N2|2024.01.01|2|")
    gauges.run(changes=changes)
    before = {e.part: e.path for e in gauges.store._live("by_station")}
    gauges.put("b.txt", "N2|2024.01.01|3|")
    gauges.run(changes=changes)
    after = {e.part: e.path for e in gauges.store._live("by_station")}
    assert before["N1"] == after["N1"] and before["N2"] != after["N2"] and gauges.rows(table="by_station") == [("N1", 1.0), ("N2", 3.0)]


def test_buckets_of_the_key_where_no_column_parts_the_table(gauges):
    gauges.store.create("bucketed", READING, bucket_keys=["station", "day"], buckets=16)
    changes = {"tabla_destino": "bucketed", "campos_singularidad": ["station", "day"]}
    gauges.put("a.txt", *[f"N{i}|2024.01.01|{i}|" for i in range(60)], "N5||5|")
    gauges.run(changes=changes)
    before = {e.part: e.path for e in gauges.store._live("bucketed")}
    gauges.put("b.txt", "N5||50|")
    done, = gauges.run(changes=changes)
    after = {e.part: e.path for e in gauges.store._live("bucketed")}
    assert (done.promoted, done.replaced) == (1, 1) and sum(before[p] != after[p] for p in before) == 1 and len(before) > 8
    assert len(gauges.rows(table="bucketed")) == 61 and ("N5", 50.0) in gauges.rows(table="bucketed")


@pytest.mark.parametrize("unit", ["folder", "file"])
def test_key_in_several_files_is_that_of_the_last(gauges, unit):
    gauges.put("1.txt", "N1|2024.01.01|1|", "N2|2024.01.01|2|")
    gauges.put("2 more.txt", "N1|2024.01.01|7|", "N1|2024.01.01|8|")
    gauges.run(changes={"campos_singularidad": ["station", "day"]}, unit=unit)
    assert gauges.rows() == [("N1", 7.0), ("N1", 8.0), ("N2", 2.0)]


def test_staging_table_and_transformation(gauges):
    gauges.store.create("hall", "station string, day date, mm double")
    gauges.put("a.txt", "N1|2024.01.01|1|", "N1|2024.01.02|2|", "N2|2024.01.01|4|")
    gauges.run(changes={"tabla_hall": "hall", "transformacion_sql": "SELECT station, max(day) AS day, sum(mm) AS mm FROM hall GROUP BY station"})
    assert gauges.rows() == [("N1", 3.0), ("N2", 4.0)] and gauges.store.read("hall").count() == 3


FLOOD = {"nombre": "flood", "mensaje": "more rain than there can be", "sql": "SELECT station, mm FROM _entrante WHERE mm > 900"}


def test_stop_keeps_the_target_and_runs_its_action(gauges):
    gauges.store.create("diary", "line string")
    gauges.put("a.txt", "N1|2024.01.01|1000|")
    changes = {"validaciones": [{**FLOOD, "tipo": "stop"}], "acciones": [
        {"momento": "al_fallar", "tabla": "diary", "sql": "SELECT 'failed' AS line"}, {"momento": "tras_validar", "tabla": "diary", "sql": "SELECT 'went on' AS line"}]}
    done, = gauges.run(changes=changes)
    assert done.status == "ERROR" and gauges.rows() == [] and gauges.rows("line", table="diary") == [("failed",)]
    assert [r["estado"] for r in gauges.runs()] == ["ERROR"] and len(gauges.run(changes=changes)) == 1


def test_alarm_is_logged_and_the_load_goes_on(gauges):
    gauges.put("a.txt", "N1|2024.01.01|1000|", "N2|2024.01.01|1|")
    done, = gauges.run(changes={"validaciones": [{**FLOOD, "tipo": "alarma"}]})
    log = gauges.store.read(load.FIRED).first()
    assert done.promoted == 2 and (log["nombre"], log["afectadas"], log["detalle"]) == ("flood", 1, '[{"station":"N1","mm":1000.0}]')


def test_what_cannot_run_publishes_nothing(gauges):
    gauges.put("a.txt", "N1|2024.01.01|1|")
    for broken in ({"validaciones": [{**FLOOD, "tipo": "stop", "sql": "SELECT 1 FROM absent"}]}, {"acciones": [{"momento": "tras_promover", "tabla": "reading", "sql": "SELECT x FROM absent"}]},
                   {"variables": [{"momento": "tras_promover", "sql": "SELECT station FROM reading WHERE false"}]}):
        with pytest.raises(Exception):
            gauges.run(changes=broken)
    assert gauges.rows() == [] and gauges.runs() == []


def test_every_file_has_its_own_output(gauges, tmp_path):
    for i in (1, 2, 3):
        gauges.put(f"{i}.txt", *[f"N{i}|2024.01.0{d + 1}|{d}|" for d in range(i)])
    output = {"nombre": "own", "fichero": "{carga}-{ejecucion_id}.parquet", "sql": "SELECT station, :fichero AS source FROM reading WHERE ejecucion_id = :ejecucion_id"}
    done, = gauges.run(changes={"salidas": [output]}, export_folder=str(tmp_path / "out"))
    assert [(o["filas"], o["fichero"].rsplit("/", 1)[1]) for o in done.outputs] == [(1, "rain-1.parquet"), (2, "rain-2.parquet"), (3, "rain-3.parquet")]
    assert {tuple(r) for r in gauges.spark.read.parquet(done.outputs[2]["fichero"]).collect()} == {("N3", "3.txt")}


def test_variables_are_captured_at_their_moment(gauges):
    gauges.store.create("diary", "line string")
    gauges.put("a.txt", "N1|2024.01.01|4|", "N2|2024.01.01|6|")
    gauges.run(changes={
        "variables": [{"momento": "antes", "sql": "SELECT count(*) AS old FROM reading"}, {"momento": "tras_promover", "sql": "SELECT avg(mm) AS mean FROM reading"}],
        "acciones": [{"momento": "tras_promover", "tabla": "diary", "sql": "SELECT concat_ws('/', :v_old, :v_mean, :promovidas, :ejecucion_id) AS line"}]})
    assert gauges.rows("line", table="diary") == [("0/5.0/2/1",)]


def test_parameters_from_a_list_and_free_ones(gauges):
    spark, store = gauges.spark, gauges.store
    store.create("network", "code int, title string")
    store.publish(store.append("network", spark.createDataFrame([(4, "Coast"), (5, "Hills"), (6, "hills")], "code int, title string")))
    store.create("owned", "net int, station string, mm double, note string")
    definition = {"tabla_destino": "owned", "campos_singularidad": ["net", "station"], "mapping": [
        *MAPPING[:1], MAPPING[2], {"destino": "net", "operaciones": [{"tipo": "parametro", "nombre": "network"}]},
        {"destino": "note", "operaciones": [{"tipo": "parametro", "nombre": "remark"}]}],
        "parametros": [{"nombre": "network", "obligatorio": True, "valores_de": {"tabla": "network", "campo_valor": "code", "etiqueta": "title"}}, {"nombre": "remark"}]}
    assert load.warnings({**gauges.definition, **definition}) == []
    assert len(load.warnings({**gauges.definition, **definition, "campos_singularidad": ["station"]})) == 1
    gauges.put("a.txt", "N1|2024.01.01|1|")
    for given, said in ((None, "mandatory"), ({"network": "Hills"}, "ambiguous"), ({"network": "Moor"}, "missing"), ({"network": "Coast", "colour": "x"}, "not declared")):
        with pytest.raises(ValueError, match=said):
            gauges.run(given, changes=definition)
    gauges.run({"network": "COAST", "remark": "by hand"}, changes=definition)
    assert gauges.rows("net", "station", "note", table="owned") == [(4, "N1", "by hand")]


def test_doubtful_dates_stop_before_any_record(gauges):
    either = [MAPPING[0], field("day", "read on", {"tipo": "date_format", "formatos": ["%d-%m-%Y", "%m-%d-%Y"]})]
    gauges.put("a.txt", "N1|03-04-2024||")
    with pytest.raises(load.UnresolvedDates):
        gauges.run(changes={"mapping": either})
    assert gauges.runs() == []
    gauges.put("a.txt", "N1|03-04-2024||", "N2|25-04-2024||")
    gauges.run(changes={"mapping": either})
    assert {str(r[0]) for r in gauges.rows("day")} == {"2024-04-03", "2024-04-25"}


def test_cells_above_the_header(gauges):
    cell = lambda target, where: {"destino": target, "operaciones": [{"tipo": "celda", "referencia": where}]}
    mapping = [cell("note", "C2"), cell("station", "A1"), MAPPING[2]]
    (gauges.inbox / "a.txt").write_text("Hut|x\nby|whom|Ada\n\ngauge|rain\n-|1.5\n-|2.5\n")
    gauges.run(changes={"mapping": mapping, "fila_cabecera": 4})
    assert gauges.rows("station", "note", "mm") == [("Hut", "Ada", 1.5), ("Hut", "Ada", 2.5)]


def test_contract_of_the_target(gauges):
    gauges.put("a.txt", "N1|2024.01.01|-1|", "N2|2024.01.01|1|")
    with pytest.raises(load.ContractBroken, match="check:fallen"):
        gauges.run(contract=Contract(checks={"fallen": "mm >= 0"}))
    assert gauges.runs() == []
    assert gauges.run(contract=Contract(not_null=["station"]))[0].promoted == 2


def test_stream_takes_every_content_once(gauges, tmp_path):
    seen = []

    def watch():
        watch_folder(gauges.spark, gauges.store, gauges.definition, str(tmp_path / "state"), on_result=lambda batch, results: seen.extend(results)).awaitTermination(180)

    gauges.put("a.txt", "N1|2024.01.01|1|")
    gauges.put("same.txt", "N1|2024.01.01|1|")
    watch()
    gauges.put("copy.txt", "N1|2024.01.01|1|")
    gauges.put("b.txt", "N2|2024.01.01|2|")
    watch()
    assert gauges.rows() == [("N1", 1.0), ("N2", 2.0)] and [r.promoted for r in seen] == [1, 1]


def test_staged_folders_belong_to_their_thread(spark):
    from threading import Barrier, Thread

    from siftwell.session import stage, staging

    step, sums = Barrier(2, timeout=120), {}

    def work(name, first):
        with staging(spark):
            rows = stage(spark.range(100), name)
            step.wait()
            if not first:
                step.wait()
            sums[name] = rows.groupBy().sum("id").first()[0]
        if first:  # its scope is closed before the other reads
            step.wait()

    threads = [Thread(target=work, args=(n, n == "one")) for n in ("one", "two")]
    for t in threads:
        t.start()
    for t in threads:
        t.join(180)
    assert sums == {"one": 4950, "two": 4950}


def test_parts_with_awkward_names(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.create("t", "k string, n int", part_col="k")
    frame = lambda *rows: spark.createDataFrame(list(rows), "k string, n int")
    store.publish(store.append("t", frame(("x=y/%z", 1), (None, 2), ("plain", 3))))
    entries, replaced = store.replace("t", frame((None, 20), ("x=y/%z", 10)), ["k"], 2)
    assert replaced == 2 and {r["n"] for r in store.read("t").collect()} == {1, 2, 3}
    store.publish(entries)
    seen = Store(spark, str(tmp_path / "s"))
    assert {(r["k"], r["n"]) for r in seen.read("t").collect()} == {("x=y/%z", 10), (None, 20), ("plain", 3)}
    seen.publish(seen.overwrite("t", frame(("only", 4))))
    assert [tuple(r) for r in Store(spark, str(tmp_path / "s")).read("t").collect()] == [("only", 4)]


def test_a_writer_that_was_overtaken_is_refused(spark, tmp_path):
    from siftwell.plans.store import StoreMoved

    first = Store(spark, str(tmp_path / "s"))
    first.create("t", "n int")
    second = Store(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame([(1,)], "n int")
    late = second.overwrite("t", rows)
    first.publish(first.append("t", rows))
    with pytest.raises(StoreMoved):
        second.publish(late)
    second.refresh()
    second.publish(second.append("t", rows))
    assert Store(spark, str(tmp_path / "s")).read("t").count() == 2
