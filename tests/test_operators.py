"""Operators on small frames, and the properties that matter at scale."""

import datetime as dt
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from siftwell.functions import dates
from siftwell.operators import changes, date_evidence, documents, draft, listing, lookup, mapping, overlap, profile, replace, retention, rules, runs, usage, variables
from siftwell.session import key_join, shared_folder, stage, staging
from siftwell.sinks import outputs, snapshot
from siftwell.sources import files, text_files


@contextmanager
def settings_of(spark, wanted):
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


DAY_MONTH = [{"target": "d", "source": "d", "formats": ["%d/%m/%Y", "%m/%d/%Y"], "epoch": "1900"}]


def settle(spark, values, formats=None):
    rows = spark.createDataFrame([("f", v) for v in values], "_file string, d string")
    fields = [{**DAY_MONTH[0], "formats": formats or DAY_MONTH[0]["formats"]}]
    return date_evidence.settle_dates(rows, fields).select("_dates.d.*").first()


@pytest.mark.parametrize("values,formats,mode,fmt", [
    (["13/01/2026", "02/03/2026"], None, "format", "%d/%m/%Y"),
    (["01/13/2026", None, " "], None, "format", "%m/%d/%Y"),
    (["13/01/2026", "01/13/2026"], None, None, None),
    (["01/02/2026"], None, None, None),
    (["", None], None, None, None),
    (["46101", " 46102.5 "], None, "serial", "1900"),
    (["46101", "x"], ["%Y"], "format", "%Y"),
    (["2026-01-02", "2026-13-01"], ["%Y-%m-%d", "%Y-%d-%m"], "format", "%Y-%d-%m"),
    (["2026-01-02"], ["%d/%m/%Y", "%Y-%m-%d", "%m"], "format", "%Y-%m-%d"),
    (["2026-01-02", "x"], ["%d/%m/%Y", "%Y-%m-%d", "%m"], None, None),
])
def test_date_evidence(spark, values, formats, mode, fmt):
    found = settle(spark, values, formats)
    assert (found["mode"], found["format"]) == (mode, fmt) and (found["error"] is None) == (mode is not None)


def test_first_failing_field_wins(spark):
    rows = spark.createDataFrame([(1, "x", "y"), (2, "1", "y"), (3, "1", "2")], "_row_num int, a string, b string")
    whole = [{"tipo": "cast", "tipo_destino": "integer"}]
    mapped = mapping.map_rows(rows, [{"origen": "b", "destino": "bb", "operaciones": whole}, {"origen": "a", "destino": "aa", "operaciones": whole}])
    rejected = {r["_row_num"]: r["field"] for r in mapping.rejected_rows(mapped).collect()}
    assert rejected == {1: "bb", 2: "bb"}
    assert [tuple(r) for r in mapping.valid_rows(mapped).collect()] == [(3, 2, 1)]
    with pytest.raises(ValueError):
        mapping.map_rows(rows, [{"destino": "z", "operaciones": [{"tipo": "eval"}]}])


def test_registered_operation(spark):
    class Upper(mapping.Operation):
        def text(self, value, op, ctx):
            return F.upper(value)

    mapping.register_operation("upper", Upper())
    rows = spark.createDataFrame([("a",)], "a string")
    assert mapping.valid_rows(mapping.map_rows(rows, [{"origen": "a", "destino": "b", "operaciones": [{"tipo": "upper"}]}])).first()["b"] == "A"
    del mapping.OPERATIONS["upper"]


@pytest.mark.parametrize("threshold", ["10485760", "-1"])
def test_replacement_null_keys_and_repeats(spark, threshold):
    """Same rows whether the keys are broadcast or shuffled."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        hot = [(1, None, f"old{i}") for i in range(500)]
        target = spark.createDataFrame(hot + [(2, None, "keep"), (1, "a", "gone"), (None, None, "gone"), (3, "c", "keep2")], "k int, n string, v string").repartition(7)
        incoming = spark.createDataFrame([(1, None, "new"), (1, None, "new"), (1, "a", "new2"), (None, None, "new3"), (9, "z", "new4")], "k int, n string, v string")
        found = sorted(r["v"] for r in replace.replace_block(target, incoming, ["k", "n"]).collect())
        assert found == ["keep", "keep2", "new", "new", "new2", "new3", "new4"]
        counts = replace.replace_counts(target, incoming, ["k", "n"]).first()
        assert tuple(counts) == (5, 502)
        joined = key_join(target, incoming.select(F.col("k").alias("kk"), "v").withColumnRenamed("v", "w").dropDuplicates(["kk"]), [(F.col("k"), F.col("kk"))])
        assert joined.count() == target.count() and joined.filter("k = 1 AND w IS NULL").count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_results_do_not_depend_on_partitions(spark):
    rows = spark.createDataFrame([(i, f" {i % 7} ", None if i % 5 else "0,5") for i in range(300)], "at int, a string, b string")
    one, many = [
        sorted(map(str, profile.profile_columns(rows.repartition(n), ["a", "b"], F.col("at")).collect())) for n in (1, 8)]
    assert one == many


def test_profile_types(spark):
    values = {"ceros": ["03", "04"], "es": ["1,5", "2"], "vacia": [" ", None], "fecha": ["1/2/26", "2026-01-02"], "real": ["1e3", "-.5"], "texto": ["a", "1"],
              "dia": ["20260320", "20260321"], "cod": ["86169897", "1"]}
    rows = spark.createDataFrame([(i, *[v[i] for v in values.values()]) for i in range(2)], "at int, " + ", ".join(f"{c} string" for c in values))
    found = {r["column"]: r for r in profile.profile_columns(rows, list(values), F.col("at")).collect()}
    assert {c: r["apparent_type"] for c, r in found.items()} == {
        "ceros": profile.INTEGER, "es": profile.DOUBLE_ES, "vacia": profile.UNKNOWN, "fecha": profile.DATE, "real": profile.DOUBLE, "texto": profile.VARCHAR,
        "dia": profile.INTEGER, "cod": profile.INTEGER}
    drafted = {r["origin"]: r for r in draft.draft_columns(profile.profile_columns(rows, list(values), F.col("at"))).collect()}
    assert drafted["ceros"]["warnings"] == ["leading_zeros"] and drafted["dia"]["warnings"] == ["compact_date"] and drafted["cod"]["warnings"] == ["identifier"]
    assert drafted["vacia"]["warnings"] == ["all_blank"] and drafted["vacia"]["notes"] == [] and len(drafted["es"]["notes"]) == 1
    sql = draft.create_table_sql(profile.profile_columns(rows, list(values), F.col("at")), "borrador")
    spark.sql("DROP TABLE IF EXISTS borrador")
    spark.sql(sql)
    assert spark.table("borrador").columns[:3] == ["id", "ceros", "es"]
    spark.sql("DROP TABLE borrador")


def test_drafted_names_are_unique(spark):
    rows = spark.createDataFrame([(1, "x", "y", "z", "w")], "at int, `a b` string, `A-B` string, `a_b_2` string, c string")
    names = [r["name"] for r in draft.draft_columns(profile.profile_columns(rows, rows.columns[1:], F.col("at"))).orderBy("position").collect()]
    assert len(set(names)) == 4 and names[0] == "a_b" and names[3] == "c"


def test_overlap_of_nothing(spark):
    empty = spark.createDataFrame([(" ",), (None,)], "v string")
    table = spark.createDataFrame([("x",)], "c string")
    row = overlap.overlap(empty, "v", {"t": (table, ["c"])}).first()
    assert (row["matches"], row["total_proposed"], row["ratio"]) == (0, 0, 0.0)
    assert overlap.foreign_key_candidates(empty, "v", {"t": (table, ["c"])}, 0.0).count() == 0


def test_label_status(spark):
    dimension = spark.createDataFrame([("1", "Uno"), ("2", "Dos"), ("3", "dos")], "id string, nombre string")
    rows = spark.createDataFrame([(" uno ",), ("DOS",), ("3",), ("nada",), (" ",), (None,)], "t string")
    found = [(r["t"], r["resolved_id"], r["status"]) for r in lookup.resolve_labels(rows, "t", dimension, "id", "nombre").collect()]
    assert sorted(found, key=str) == sorted([(" uno ", "1", "ok"), ("DOS", None, "ambiguous"), ("3", "3", "ok"), ("nada", None, "missing"), (" ", None, "ok"), (None, None, "ok")], key=str)
    only_ids = sorted(r["status"] for r in lookup.resolve_labels(rows, "t", dimension, "id", None).collect())
    assert only_ids == ["missing"] * 3 + ["ok"] * 3


def test_filters():
    assert listing.parse_filter("due >= 2025-01-31 ") == ("due", ">=", "2025-01-31")
    assert listing.parse_filter("title<>") == ("title", "<>", "")
    assert listing.parse_filter("note=a<b") == ("note", "=", "a<b")
    for bad in ("title", "= x", ""):
        with pytest.raises(ValueError):
            listing.parse_filter(bad)


def test_listing_order_and_system_fields(spark):
    entity = {"entidad": "e", "tabla": "e", "campos": {"id": {"tipo": "uuid"}, "fecha": {"tipo": "date"}, "ejecucion_id": {"tipo": "integer"}}}
    rows = spark.createDataFrame([("a", dt.date(2026, 1, 1), 1), ("b", dt.date(2026, 2, 1), 1)], "id string, fecha date, ejecucion_id int")
    found = listing.listing(entity, {}, {"e": rows}, [("fecha", ">=", "2026-01-01")])
    assert found.columns == ["id", "fecha"] and [r["id"] for r in found.collect()] == ["b", "a"]
    with pytest.raises(ValueError):
        listing.listing(entity, {}, {"e": rows}, [("ejecucion_id", "=", "1")])


def test_edits_touch_only_what_they_name(spark):
    entity = {"entidad": "e", "tabla": "e", "campos": {"id": {"tipo": "uuid"}, "texto": {"tipo": "varchar"}, "horas": {"tipo": "double"}}}
    table = spark.createDataFrame([("1", "a", 1.0, 7, dt.datetime(2026, 1, 1)), ("2", "b", None, 8, dt.datetime(2026, 1, 1))],
                                  "id string, texto string, horas double, ejecucion_id int, updated_at timestamp_ntz")
    asked = spark.createDataFrame([("1", 1, {"horas": "2,5"}), ("1", 2, {"horas": " "}), ("2", 1, {"horas": "muchas"}), ("3", 1, {"texto": "x"}), ("2", 2, {"id": "9"})],
                                  "id string, seq int, fields map<string,string>")
    edited, refused = changes.edit_rows(table, asked, entity, F.lit("2026-09-01").cast("timestamp_ntz"))
    assert sorted(tuple(r) for r in edited.collect()) == [
        ("1", "a", None, 7, dt.datetime(2026, 9, 1)), ("2", "b", None, 8, dt.datetime(2026, 1, 1))]
    assert {r["id"]: r["error"] for r in refused.collect()} == {"2": "unknown field: id", "3": "no such row"}


def test_variables_need_one_row(spark):
    assert variables.capture(spark, "SELECT 1 AS a, 'x' AS b") == {"a": 1, "b": "x"}
    for sql in ("SELECT 1 AS a WHERE false", "SELECT explode(array(1, 2)) AS a"):
        with pytest.raises(variables.InvalidVariable):
            variables.capture(spark, sql)
    bound = variables.bound(spark, "SELECT ':p_x' AS text, :p_x AS value -- :nothing", variables.context({"x": "it's"})).first()
    assert tuple(bound) == (":p_x", "it's")


def test_guard_reverts_on_stop(spark):
    rows = spark.createDataFrame([(1,), (-1,)], "n int")
    stop = rules.Rule("negativo", rules.STOP, "no", "SELECT n FROM tabla WHERE n < 0")
    with pytest.raises(rules.StopError):
        rules.guard_write(rows, "tabla", [stop])
    assert rules.guard_write(rows.filter("n > 0"), "tabla", [stop])[0].count() == 1
    with pytest.raises(rules.InvalidRule):
        rules.results(spark, [rules.Rule("rota", rules.ALARM, "", "SELECT x FROM tabla")])


def test_gfs(spark):
    def kept(names, *n):
        rows = spark.createDataFrame([("s", x, dt.datetime.strptime(x, "%Y%m%d-%H%M%S")) for x in names], "entity string, name string, taken_at timestamp_ntz")
        return {r["name"] for r in retention.kept_snapshots(rows, *n).collect()}

    assert kept(["20260801-090000", "20260801-180000", "20260802-090000"], 7, 0, 0) == {"20260801-180000", "20260802-090000"}
    year = [f"2026{m:02d}{d:02d}-120000" for m in range(1, 9) for d in range(1, 29)]
    found = kept(year, 7, 8, 12)
    assert len(found) <= 27 and {x for x in found if x.startswith("202601")} == {"20260128-120000"}
    assert kept(["20261231-100000", "20270101-100000"], 0, 1, 0) == {"20270101-100000"}, "both are in 2026-W53"
    assert kept(year, 0, 0, 0) == set()


def test_history_policies(spark):
    use = [("ventas", "carga", "old", "crear", dt.datetime(2026, 1, 1)), ("ventas", "carga", "new", "crear", dt.datetime(2026, 2, 1))]
    schema = "load string, kind string, hash string, tag string, used_at timestamp_ntz"
    docs = spark.createDataFrame([("old", "o", 5, "disponible", None), ("new", "n", 9, "disponible", None)],
                                 "hash string, name string, bytes bigint, status string, purged_at timestamp_ntz")
    now = F.lit("2026-03-01").cast("timestamp_ntz")
    one = {"ventas": {"tipo": "ficheros", "cantidad": 1}}

    def doomed(rows, policies):
        return [r["hash"] for r in retention.purgeable(docs, spark.createDataFrame(rows, schema), policies, now).collect()]

    assert doomed(use, one) == ["old"]
    assert doomed(use, {}) == []
    assert doomed(use + [("ticket.crear", "cli", "old", "crear", dt.datetime(2026, 1, 1))], one) == [], "another process keeps it"
    exempt = {"ventas": {**one["ventas"], "tags_exentos": ["legal"]}}
    assert doomed([use[0][:3] + ("legal", use[0][4]), use[1]], exempt) == []
    assert doomed(use, {"ventas": {"tipo": "anios", "cantidad": 1}}) == []
    late = F.lit("2028-02-29").cast("timestamp_ntz")
    assert spark.range(1).select(retention.years_before(late, 1).alias("x")).first()["x"] == dt.datetime(2027, 2, 28)


def test_run_places(spark):
    log = spark.createDataFrame([(i, 1 if i < 200 and i > 1 else None) for i in range(1, 300)], "run_id int, principal int")
    places = {r["run_id"]: (r["principal"], r["place"]) for r in runs.numbered_histories(log).collect()}
    assert all(places[i] == (1, i) for i in range(1, 200)) and places[250] == (250, 1)


def test_usage_log(spark, tmp_path):
    path = str(tmp_path / "log")
    spark.range(3).createOrReplaceTempView("tres")
    usage.logged_query(spark, "SELECT * FROM tres WHERE id >= :n", {"n": 1}, path, "q1", ["tres"])
    with pytest.raises(Exception):
        usage.logged_query(spark, "SELECT * FROM nada", None, path, "q2")
    log = spark.read.schema(usage.LOG_SCHEMA).parquet(path)
    assert {(r["query_id"], r["rows"], r["status"]) for r in log.collect()} == {("q1", 2, "OK"), ("q2", None, "ERROR")}
    assert usage.usage_by_object(log).collect()[0]["uses"] == 1


def test_export_and_outputs(spark, tmp_path):
    spark.createDataFrame([(1, 'a "b"\nc'), (2, "d,e")], "n int, t string").createOrReplaceTempView("vista")
    done = outputs.export_view(spark, "vista", str(tmp_path), str(tmp_path / "log"))
    assert done["filas"] == 2 and spark.read.parquet(done["parquet"]).count() == 2
    back = spark.read.csv(done["csv"], header=True, multiLine=True, escape='"')
    assert sorted(r["t"] for r in back.collect()) == ['a "b"\nc', "d,e"]
    assert spark.read.parquet(str(tmp_path / "log")).first()["object"] == "vista"
    with pytest.raises(ValueError, match="vista"):
        outputs.export_view(spark, "otra", str(tmp_path))
    assert outputs.resolve_name("%Y%m%d_{carga}.csv", {"carga": "x"}, dt.datetime(2026, 8, 5)) == "20260805_x.csv"
    with pytest.raises(ValueError):
        outputs.format_of("a.xlsx")


def test_snapshot(spark, tmp_path):
    tables = {"a": spark.range(10).toDF("x"), "b": spark.range(0).toDF("x")}
    snapshot.take_snapshot(tables, str(tmp_path / "s"))
    done = snapshot.restore_snapshot(spark, str(tmp_path / "s"), str(tmp_path / "r"))
    assert snapshot.verified(done) and {tuple(r) for r in done.collect()} == {("a", 10, 10, "ok"), ("b", 0, 0, "ok")}
    with pytest.raises(Exception):
        snapshot.restore_snapshot(spark, str(tmp_path / "s"), str(tmp_path / "r"))
    bad = snapshot.compare(spark.createDataFrame([("a", 10), ("c", 1)], "table string, rows bigint"), snapshot.row_counts({"a": spark.range(9)}))
    assert {r["table"]: r["status"] for r in bad.collect()} == {"a": "differs", "c": "absent"} and not snapshot.verified(bad)
    assert not snapshot.verified(bad.limit(0))


def test_mirror(spark, tmp_path):
    docs = lambda *h: spark.createDataFrame([(x, 5) for x in h], "hash string, bytes bigint")
    assert snapshot.mirror(docs("a", "b"), str(tmp_path / "m")) == {"copied": 2, "present": 0, "bytes": 10}
    assert snapshot.mirror(docs("a", "b", "c"), str(tmp_path / "m")) == {"copied": 1, "present": 2, "bytes": 5}
    assert spark.read.parquet(str(tmp_path / "m")).count() == 3


def test_documents_of_a_life(spark):
    rows = spark.createDataFrame([("r1", 1), ("r2", 5)], "row_id string, run_id int")
    log = spark.createDataFrame([(1, None, "crear"), (2, 1, "editar"), (5, None, "crear")], "run_id int, principal int, operation string")
    links = spark.createDataFrame([(1, "h1", "crear"), (2, "h2", "pago"), (5, "h1", "crear")], "run_id int, hash string, tag string")
    docs = spark.createDataFrame([("h1", "a"), ("h2", "b")], "hash string, name string")
    found = {(r["row_id"], r["hash"], r["link_run"]) for r in documents.of_rows(rows, log, links, docs).collect()}
    assert found == {("r1", "h1", 1), ("r1", "h2", 2), ("r2", "h1", 5)}


def test_line_numbers_over_many_splits(spark, tmp_path):
    sizes = {"a.csv": 3000, "b.csv": 1, "c d.csv": 777}
    for name, n in sizes.items():
        (tmp_path / name).write_text("basura\nn;t\n" + "".join(f"{i};texto {i}\n" for i in range(3, n + 3)), encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        scan = text_files.scan_csv(spark, str(tmp_path), ";", header_line=2, pattern="*.csv")
        assert scan.lines.select("_file", "_block").distinct().count() > 10
        rows = scan.rows.select("_row_num", F.col("n").cast("bigint").alias("n")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == sum(sizes.values()) and all(r["_row_num"] == r["n"] for r in rows)


def test_csv_shapes(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿a;b;a\n1;\"x;\"\"y\"\"\";2\n3\n\n4;;5;6\n".encode("utf-8"))
    rows = text_files.scan_csv(spark, str(tmp_path / "a.csv"), ";").rows
    assert rows.columns == ["_file", "_row_num", "a", "b"]
    assert [tuple(r)[1:] for r in rows.orderBy("_row_num").collect()] == [(2, "2", 'x;"y"'), (3, None, None), (4, None, None), (5, "5", "")]


def test_columns_found_by_name_in_each_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("y,z,x\n2,3,1\n")
    rows = text_files.scan_csv(spark, str(tmp_path), ",").rows
    assert sorted((r["x"], r["y"], r["z"] or "") for r in rows.collect()) == [("1", "2", ""), ("1", "2", "3")]


def test_encodings(spark, tmp_path):
    for encoding in ("latin-1", "cp1252", "utf-8"):
        (tmp_path / "a.csv").write_bytes("año;precio\nniño;5\n".encode(encoding) + ("€;6\n".encode(encoding) if encoding != "latin-1" else b""))
        rows = text_files.scan_csv(spark, str(tmp_path / "a.csv"), ";", encoding=encoding).rows
        assert "año" in rows.columns and "niño" in [r["año"] for r in rows.collect()]
        assert encoding == "latin-1" or "€" in [r["año"] for r in rows.collect()]


QUOTED = [
    'k;t\n1;"two\nlines"\n2;x\n', 'k;t\n1;"a ""quoted"" ;\n\n end";z\n"2";"y"tail\n3;a"b\n', 'k;t\n"1\n2\n3";"4\n5"\n6;7\n',
    'k;t\n1;"never closed\n2;x\n3;y"', 'k;t\n\n1;\n;2\n"";""\n', 'k;t\n1;"""x"""\n2;"\n";3\n', 'k;t\n1;x"\n2;"y\n"\n3;z', 'k;t\n"1";"\n\n"";\n";"\n"\n4;5\n']


@pytest.mark.parametrize("text", QUOTED)
@pytest.mark.parametrize("split", [7, 10_000])
def test_quoted_records_like_a_plain_reader(spark, tmp_path, text, split):
    import csv
    import io

    (tmp_path / "a.csv").write_text(text)
    expected = [(c + [None, None])[:2] for c in csv.reader(io.StringIO(text, newline=""), delimiter=";")][1:]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        rows = text_files.scan_csv(spark, str(tmp_path / "a.csv"), ";").rows.orderBy("_row_num").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [[r["k"], r["t"]] for r in rows] == expected


def test_quotes_of_any_number(spark, tmp_path):
    cell = 'say ""so"" ' * 20_000
    (tmp_path / "a.csv").write_text("k;t\n" + ";".join(['"x"'] * 5000) + f'\n1;"{cell}\n"\n')
    rows = text_files.scan_csv(spark, str(tmp_path / "a.csv"), ";").rows.orderBy("_row_num").collect()
    assert rows[0]["t"] == "x" and rows[1]["t"] == cell.replace('""', '"') + "\n"


def bounded_records(body: list[str], bound: int) -> list[tuple[int, str, bool]]:
    """(first line, record, unclosed) read one line after the other, cell by cell."""

    def inside_after(line: str, inside: bool) -> bool:
        begins, at = not inside, 0
        while at < len(line):
            if inside and line[at] == '"':
                if line[at + 1:at + 2] == '"':
                    at += 1
                else:
                    inside = False
            elif not inside:
                inside = begins and line[at] == '"'
                begins = line[at] == ";"
            at += 1
        return inside

    out, at = [], 0
    while at < len(body):
        inside, end = False, at
        for end in range(at, min(at + bound, len(body))):
            inside = inside_after(body[end], inside)
            if not inside:
                break
        end = at if inside else end
        out.append((at + 2, "\n".join(body[at:end + 1]), inside))
        at = end + 1
    return out


@pytest.mark.parametrize("bound, split", [(1, 60), (3, 45), (4, 10_000)])
def test_records_of_bounded_length(spark, tmp_path, split, bound):
    """A quote not closed within the bound is a row of its own, and the next line begins a new one, as often as it happens."""
    import random

    draw, expected = random.Random(7), {}
    for i in range(4):
        body = ["".join(draw.choice('"";ab') for _ in range(draw.randrange(1, 6))) for _ in range(25)]
        (tmp_path / f"{i}.csv").write_text("k;t\n" + "\n".join(body) + "\n")
        expected[f"{i}.csv"] = [(line, unclosed) for line, _, unclosed in bounded_records(body, bound)]
    assert sum(u for rows in expected.values() for _, u in rows) >= 3
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        rows = text_files.scan_csv(spark, str(tmp_path), ";", pattern="*.csv", record_lines=bound).rows.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    got = {}
    for r in sorted(rows, key=lambda r: r["_row_num"]):
        got.setdefault(r["_file"].rsplit("/", 1)[-1], []).append((r["_row_num"], r["_unclosed"]))
    assert got == expected


def test_one_stray_quote_is_one_reject(spark, tmp_path):
    from siftwell.operators import mapping

    lines = [f'{i};"open' if i == 500 else f'{i};"two\nlines"' if i % 100 == 7 else f"{i};x" for i in range(3000)]
    (tmp_path / "a.csv").write_text("k;t\n" + "\n".join(lines) + "\n")
    rows = text_files.scan_csv(spark, str(tmp_path / "a.csv"), ";", record_lines=5).rows
    mapped = mapping.map_rows(rows, [{"origen": "k", "destino": "k", "operaciones": [{"tipo": "cast", "tipo_destino": "integer"}]}, {"origen": "t", "destino": "t", "operaciones": []}])
    bad = mapping.rejected_rows(mapped).collect()
    assert [(r["field"], r["reason"], r["raw"]) for r in bad] == [(None, "quote not closed", '{"k":"500","t":"open"}')]
    good = mapping.valid_rows(mapped).collect()
    assert len(good) == 2999 and "_unclosed" not in mapped.columns
    assert {r["k"] for r in good} == set(range(3000)) - {500} and sum(r["t"] == "two\nlines" for r in good) == 30


def test_a_short_file_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("note\nk;t\n1;2\n")
    (tmp_path / "b.csv").write_text("only\n")
    with pytest.raises(ValueError, match="b.csv has fewer than 2 lines"):
        text_files.scan_csv(spark, str(tmp_path), ";", header_line=2)


def test_content_identity(spark, tmp_path):
    texts = {"a": "x;1\n", "b": "x;1\n", "crlf": "x;1\r\n", "open": "x;1", "bom": "\ufeffx;1\n", "line": "\n", "two": "x;1\ny;2\n", "turned": "y;2\nx;1\n"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    found = {}
    for split in (2, 10_000):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        found[split] = {r["file"].rsplit("/", 1)[-1]: r["hash"] for r in files.hash_files(spark, str(tmp_path)).collect()}
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found[2] == found[10_000]
    assert found[2]["a"] == found[2]["b"] and len(set(found[2].values())) == len(texts) - 1


def test_identity_counts_the_order_of_lines_in_many_splits(spark, tmp_path):
    lines = [f"{i * 7919 % 10007};{i % 3}" for i in range(3000)]
    far, near = lines.copy(), lines.copy()
    far[5], far[2900] = far[2900], far[5]
    near[1000], near[1001] = near[1001], near[1000]
    texts = {"a": lines, "same": lines, "far": far, "near": near, "blank": [""] * 700, "blanks": [""] * 701}
    for name, own in texts.items():
        (tmp_path / name).write_text("\n".join(own))
    found = []
    for split in (700, 4000, 1 << 27):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        found.append({r["file"].rsplit("/", 1)[-1]: r["hash"] for r in files.hash_files(spark, str(tmp_path)).collect()})
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found[0] == found[1] == found[2] and found[0]["a"] == found[0]["same"] and len(set(found[0].values())) == len(texts) - 1


def test_staged_folder_is_shared(spark):
    df = stage(spark.range(5).toDF("n"))
    assert spark.conf.get("spark.checkpoint.dir") in df.inputFiles()[0] and df.count() == 5


def test_sampled_rows(spark):
    rows = spark.range(10).toDF("n")
    first, more = profile.sample_rows(rows, 4, F.col("n"))
    assert more and [r["n"] for r in first.collect()] == [0, 1, 2, 3]
    assert profile.sample_rows(rows, 10, F.col("n"))[1] is False


def test_rows_older_than_the_log_stay_apart(spark):
    """Rows without a run are not all sent to one task, and keep a NULL principal beside a run without a number."""
    rows = spark.range(0, 900, 1, 9).select("id", F.when(F.col("id") % 3 == 0, F.col("id")).alias("ejecucion_id"))
    log = spark.createDataFrame([(0, None), (3, 0), (3, 0), (None, 7)], "run_id bigint, principal bigint")
    with settings_of(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}):
        found = runs.principal_of_rows(rows, log)
        got = found.withColumn("task", F.spark_partition_id()).collect()
    assert found.columns == ["id", "ejecucion_id", "principal"]
    assert sorted((r["id"], r["principal"]) for r in got if r["principal"] is not None) == [(0, 0), (3, 0), (3, 0)]
    assert sorted(r["id"] for r in got) == sorted([*range(900), 3])
    tasks = [r["task"] for r in got if r["ejecucion_id"] is None]
    assert max(map(tasks.count, set(tasks))) < 200


def test_settled_dates_move_no_rows(spark):
    """Rows of two files stay where they are when the dates of their files are attached."""
    rows = spark.range(0, 400, 1, 4).select(
        F.concat(F.lit("f"), F.col("id") % 2).alias("_file"), F.col("id").alias("_row_num"), F.lit("25/01/2020").alias("d"))
    fields = [{"target": "d", "source": "d", "formats": ["%d/%m/%Y", "%m/%d/%Y"], "epoch": "1900"}]
    with settings_of(spark, {"spark.sql.adaptive.enabled": "false"}):
        attached = date_evidence.attach_dates(rows, date_evidence.settle_dates(rows, fields))
        per_task = attached.groupBy(F.spark_partition_id().alias("t")).agg(F.countDistinct("_file").alias("files"), F.count("*").alias("n")).collect()
        formats = {r[0] for r in attached.select("_dates.d.format").collect()}
    assert formats == {"%d/%m/%Y"}
    assert sorted((r["files"], r["n"]) for r in per_task) == [(2, 100)] * 4


def test_settled_dates_move_no_rows(spark):
    """Rows of two files stay where they are when the dates of their files are attached."""
    rows = spark.range(0, 400, 1, 4).select(
        F.concat(F.lit("f"), F.col("id") % 2).alias("_file"), F.col("id").alias("_row_num"), F.lit("25/01/2020").alias("d"))
    fields = [{"target": "d", "source": "d", "formats": ["%d/%m/%Y", "%m/%d/%Y"], "epoch": "1900"}]
    with settings_of(spark, {"spark.sql.adaptive.enabled": "false"}):
        attached = date_evidence.attach_dates(rows, date_evidence.settle_dates(rows, fields))
        per_task = attached.groupBy(F.spark_partition_id().alias("t")).agg(F.countDistinct("_file").alias("files"), F.count("*").alias("n")).collect()
        formats = {r[0] for r in attached.select("_dates.d.format").collect()}
    assert formats == {"%d/%m/%Y"}
    assert sorted((r["files"], r["n"]) for r in per_task) == [(2, 100)] * 4


def test_lines_of_splits_that_share_a_hash_keep_their_numbers(spark):
    lines = spark.createDataFrame(
        [(f, b, (i << 33) + n, 7, f"{f}{b}{n}") for i, (f, b) in enumerate([("x", 0), ("x", 90), ("y", 0)]) for n in range(3)],
        "_file string, _block bigint, _at bigint, _split bigint, value string")
    places = text_files.split_places(lines)
    got = {r["value"]: (r["_file"], r["_line"]) for r in text_files.number_lines(lines, places).collect()}
    assert got == {f"{f}{b}{n}": (f, n + 1 + (3 if b else 0)) for f, b in [("x", 0), ("x", 90), ("y", 0)] for n in range(3)}
    assert sorted(tuple(r) for r in text_files.line_of_files(lines, places, 2).collect()) == [("x", "x01"), ("y", "y01")]
    assert text_files.line_of_files(lines, places, 4).count() == 0


@pytest.mark.parametrize("cell", ["plain", '"two\nlines"', '"a;b"'])
def test_rows_carry_what_is_told_of_their_file(spark, tmp_path, cell):
    for name in "abc":
        (tmp_path / f"{name}.csv").write_text(f"k;t\n{name}1;{cell}\n\n{name}2;x\n")
    listed = files.list_files(spark, str(tmp_path), "*.csv")
    told = listed.select("uri", F.ascii(F.substring("uri", -5, 1)).alias("_run")).filter(F.col("_run") < ord("c"))
    with settings_of(spark, {"spark.sql.files.maxPartitionBytes": "1000000"}):
        rows = text_files.scan_csv(spark, str(tmp_path), ";", pattern="*.csv", only=told.select("uri"), told=told).rows.collect()
    text, last = cell.strip('"'), 4 + cell.count("\n")
    assert sorted((r["_run"], r["_row_num"], r["k"], r["t"]) for r in rows) == sorted(
        row for run, name in ((97, "a"), (98, "b")) for row in [(run, 2, f"{name}1", text), (run, last - 1, None, None), (run, last, f"{name}2", "x")])


def test_parts_above_12_are_those_of_the_patterns(spark):
    parts = ["1", "01", "9", "12", "13", "013", "0013", "31", "99", "100", "0100", "1300", "1 ", "+1", "1T", "", "é1"]
    texts = [f"{a}{x}{b}{y}{c}" for a in parts for b in parts for x, y in ["//", "-.", "/ "] for c in ["2020", "20", "5", "x"]]
    frame = spark.createDataFrame([(t,) for t in texts], "s string")
    first, second = dates.parts_above_12(F.col("s"))
    odd = frame.filter((first != F.col("s").rlike(dates.FIRST_ABOVE_12_RE)) | (second != F.col("s").rlike(dates.SECOND_ABOVE_12_RE)))
    assert odd.collect() == [] and frame.filter(first & second).count() > 100


def test_files_that_agree_need_no_lookup_of_dates(spark):
    rows = spark.createDataFrame([(1, "25/01/2020"), (2, "26/01/2020"), (2, "01/02/2020")], "_run bigint, d string")
    fields = [{"target": "d", "source": "d", "formats": ["%d/%m/%Y", "%m/%d/%Y"], "epoch": "1900"}]

    def attached(rows):
        found = date_evidence.attach_dates(rows, date_evidence.settle_dates(rows, fields, "_run"), "_run", every_file=True)
        return "Join" in found._jdf.queryExecution().optimizedPlan().toString(), sorted((r["_run"], r["d"], r["_dates"]["d"]["format"]) for r in found.collect())

    joined, got = attached(rows)
    assert not joined and [f for _, _, f in got] == ["%d/%m/%Y"] * 3
    joined, got = attached(rows.filter("_run = 1").union(spark.createDataFrame([(2, "01/26/2020")], rows.schema)))
    assert joined and got == [(1, "25/01/2020", "%d/%m/%Y"), (2, "01/26/2020", "%m/%d/%Y")]


def test_raw_text_of_rejects(spark):
    import json

    values = ['a"b', "back\\slash", "tab\t\n", "é", None, ""]
    frame = spark.createDataFrame([tuple(values)], ", ".join(f"`c {i}` string" for i in range(len(values))))
    text = frame.select(mapping.as_json(frame.columns)).first()[0]
    assert text == json.dumps(dict(zip(frame.columns, values)), ensure_ascii=False, separators=(",", ":"))
