"""Recorded batches of changes: a lending shelf with its loans and members."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from siftwell.operators import documents, runs
from siftwell.operators.contracts import Contract
from siftwell.operators.rules import ALARM, STOP, Rule, StopError
from siftwell.plans import load, records
from siftwell.plans.store import Store

MEMBER = {"entidad": "member", "tabla": "member", "etiqueta": "surname", "campos": {"id": {"tipo": "uuid"}, "surname": {"tipo": "varchar"}}}
LOAN = {"entidad": "loan", "tabla": "loan", "campos": {
    "id": {"tipo": "uuid", "sistema": True}, "member_id": {"tipo": "uuid"}, "title": {"tipo": "varchar", "sinonimos": ["Book", "work"]},
    "state": {"tipo": "varchar", "validacion": {"lista_valores": ["out", "back", "lost"]}}, "due": {"tipo": "date"}, "fee": {"tipo": "double"},
    "created_at": {"tipo": "timestamp"}, "updated_at": {"tipo": "timestamp"}, "ejecucion_id": {"tipo": "integer"}},
    "relaciones": [{"campo": "member_id", "entidad_destino": "member"}]}
CATALOGUE = {"member": MEMBER, "loan": LOAN}
FREE = Rule("fee_sign", STOP, "a fee below zero", "SELECT id FROM loan WHERE fee < 0")
CHANGE = "id string, seq int, fields map<string,string>"


def at(day):
    return F.lit(day).cast("timestamp_ntz")


@pytest.fixture
def shelf(spark, tmp_path):
    store = load.prepare(Store(spark, str(tmp_path / "shelf")))
    store.create("member", "id string, surname string")
    store.create("loan", "id string, member_id string, title string, state string, due date, fee double, created_at timestamp_ntz, updated_at timestamp_ntz, ejecucion_id bigint")
    people = [("m1", "Okafor"), ("m2", "Lind"), ("m3", "LIND"), ("m4", "Silva")]
    store.publish(store.append("member", spark.createDataFrame(people, "id string, surname string")))
    return store


def lend(spark, store, *rows, columns="_request string, member string, Book string, state string, due string, fee string", **options):
    return {r["_request"]: r["_error"] for r in records.create(spark, store, LOAN, CATALOGUE, spark.createDataFrame(list(rows), columns), **options).collect()}


def loans(store):
    return {r["title"]: r for r in store.read("loan").collect()}


def history(store):
    return [(r["carga"], r["estado"], r["ejecucion_id_principal"]) for r in load.current_runs(store).orderBy("id").collect()]


def test_creation_resolves_checks_and_stamps(spark, shelf):
    refused = lend(spark, shelf, ("a", "OKAFOR", "Emma", "out", "2025-01-31", "2,5"), ("b", "m3", "Ulysses", "", "", ""), ("c", "lind", "Solaris", "out", "", ""),
                   ("d", "Nobody", "Kim", "out", "", ""), ("e", "", "Dune", "sold", "", ""), ("f", " ", "Orlando", "back", "31/01/2025", ""),
                   now=at("2025-01-01"), defaults={"fee": F.lit(7.0)})
    assert refused == {"c": "member_id: ambiguous member: lind", "d": "member_id: missing member: Nobody", "e": "state: not an allowed value: sold",
                       "f": "due: not a valid date: '31/01/2025'"}
    found = loans(shelf)
    assert {t: (r["member_id"], r["state"], r["fee"], r["ejecucion_id"]) for t, r in found.items()} == {"Emma": ("m1", "out", 2.5, 1), "Ulysses": ("m3", None, None, 1)}
    assert {r["created_at"] for r in found.values()} == {r["updated_at"] for r in found.values()} == {dt.datetime(2025, 1, 1)}


def test_defaults_fill_fields_nobody_asked_for(spark, shelf):
    lend(spark, shelf, ("a", "Emma"), columns="_request string, work string", defaults={"state": F.lit("out")})
    assert loans(shelf)["Emma"]["state"] == "out"


def test_edits_use_labels_synonyms_and_aliases(spark, shelf):
    lend(spark, shelf, ("a", "m1", "Emma", "out", "", "1"), ("b", "m1", "Kim", "out", "", "2"), ("c", "m1", "Dune", "out", "", "3"), ("d", "m1", "Ada", "out", "", "4"),
         now=at("2025-01-01"))
    ids = {t: r["id"] for t, r in loans(shelf).items()}
    asked = [(ids["Emma"], 1, {"member": "silva", "WORK": "Emma II"}), (ids["Emma"], 2, {"member_id": "m2"}), (ids["Kim"], 1, {"member_id": "Lind"}),
             (ids["Dune"], 1, {"member": "Nobody", "fee": "9"}), (ids["Ada"], 1, {"colour": "red"}), ("none", 1, {"fee": "1"})]
    refused = records.edit(spark, shelf, LOAN, spark.createDataFrame(asked, CHANGE), at("2025-02-01"), catalogue=CATALOGUE).collect()
    assert {r["id"]: r["error"] for r in refused} == {
        ids["Kim"]: "member_id: ambiguous member", ids["Dune"]: "member_id: missing member", ids["Ada"]: "unknown field: colour", "none": "no such row"}
    found = loans(shelf)
    assert (found["Emma II"]["member_id"], found["Emma II"]["fee"], found["Emma II"]["updated_at"]) == ("m2", 1.0, dt.datetime(2025, 2, 1))
    assert (found["Dune"]["fee"], found["Dune"]["updated_at"], found["Kim"]["member_id"]) == (3.0, dt.datetime(2025, 1, 1), "m1")
    records.edit(spark, shelf, LOAN, spark.createDataFrame([(ids["Kim"], 1, {"member": " ", "Book": ""})], CHANGE), at("2025-02-01"), catalogue=CATALOGUE)
    assert loans(shelf)[None]["member_id"] is None


def test_invariants_and_contract_guard_both_kinds_of_write(spark, shelf):
    lend(spark, shelf, ("a", "m1", "Emma", "out", "", "1"))
    one = loans(shelf)["Emma"]["id"]
    below = spark.createDataFrame([(one, 1, {"fee": "-4"})], CHANGE)
    with pytest.raises(StopError):
        records.edit(spark, shelf, LOAN, below, at("2025-02-01"), [FREE])
    with pytest.raises(load.ContractBroken):
        records.edit(spark, shelf, LOAN, below, at("2025-02-01"), contract=Contract(checks={"fee": "fee >= 0"}))
    with pytest.raises(StopError):
        lend(spark, shelf, ("b", "m1", "Kim", "", "", "-1"), invariants=[FREE])
    with pytest.raises(load.ContractBroken):
        lend(spark, shelf, ("b", "m1", "Kim", "", "", "1"), contract=Contract(not_null=["state"]))
    assert [r["fee"] for r in loans(shelf).values()] == [1.0]
    heard = []
    records.edit(spark, shelf, LOAN, below, at("2025-02-01"), [Rule("fee_sign", ALARM, "look", FREE.sql)], fired=heard)
    assert [r["fee"] for r in loans(shelf).values()] == [-4.0] and [(r["name"], r["affected"]) for r in heard] == [("fee_sign", 1)]
    assert [s for _, s, _ in history(shelf)] == ["OK", "ERROR", "ERROR", "ERROR", "ERROR", "OK"]
    with pytest.raises(ValueError):
        lend(spark, shelf, ("c", "7"), columns="_request string, ejecucion_id string")


def test_documents_deletions_and_the_chain_of_a_row(spark, shelf):
    lend(spark, shelf, ("a", "m1", "Emma", "", "", ""), ("b", "m1", "Kim", "", "", ""))
    ids = {t: r["id"] for t, r in loans(shelf).items()}
    asked = [(ids["Emma"], "hash-1", "receipt", "r.pdf", 12), ("none", "hash-2", None, "x.pdf", 3)]
    refused = records.attach(spark, shelf, LOAN, spark.createDataFrame(asked, "row_id string, hash string, tag string, name string, bytes bigint"))
    assert [(r["row_id"], r["status"]) for r in refused.collect()] == [("none", "missing_row")] and shelf.read(load.DOCUMENTS).count() == 1
    assert [r["id"] for r in records.delete(spark, shelf, LOAN, spark.createDataFrame([(ids["Kim"],), ("none",)], "id string")).collect()] == ["none"]
    assert set(loans(shelf)) == {"Emma"} and history(shelf) == [("loan.crear", "OK", 1), ("loan.adjuntar", "OK", 1), ("loan.borrar", "OK", 1)]
    log = load.current_runs(shelf).select(F.col("id").alias("run_id"), F.col("ejecucion_id_principal").alias("principal"), F.col("carga").alias("operation"))
    assert runs.history(log, 1).count() == 3
    rows = shelf.read("loan").select(F.col("id").alias("row_id"), F.col("ejecucion_id").alias("run_id"))
    life = documents.of_rows(rows, log, shelf.read(load.LINKS), shelf.read(load.DOCUMENTS)).collect()
    assert [(r["row_id"], r["hash"], r["tag"], r["operation"]) for r in life] == [(ids["Emma"], "hash-1", "receipt", "loan.adjuntar")]


def test_writes_touch_only_the_parts_of_their_rows(spark, tmp_path):
    entity = {"entidad": "tag", "tabla": "tag", "campos": {"id": {"tipo": "uuid", "sistema": True}, "word": {"tipo": "varchar"}, "shelf": {"tipo": "varchar", "sistema": True}}}
    store = load.prepare(Store(spark, str(tmp_path / "s")))
    schema = "id string, word string, shelf string, ejecucion_id bigint"
    store.create("tag", schema, part_col="shelf")
    store.publish(store.append("tag", spark.createDataFrame([("1", "old", "A", None), ("2", "old", "B", None), ("3", "old", "C", 8)], schema)))
    before = {e.part: e.path for e in store._live("tag")}
    records.edit(spark, store, entity, spark.createDataFrame([("1", 1, {"word": "new"})], CHANGE), at("2025-01-01"))
    records.delete(spark, store, entity, spark.createDataFrame([("3",)], "id string"))
    after = {e.part: e.path for e in store._live("tag")}
    assert after["B"] == before["B"] and after["A"] != before["A"] and "C" not in after
    assert {(r["id"], r["word"]) for r in store.read("tag").collect()} == {("1", "new"), ("2", "old")} and [p for _, _, p in history(store)] == [1, 8]


def test_a_killed_writer_leaves_its_run_open(spark, shelf, monkeypatch):
    lend(spark, shelf, ("a", "OKAFOR", "Emma", "out", "2025-01-31", "2"))
    assert records.open_runs(shelf).count() == 0

    def killed(*_, **__):
        raise KeyboardInterrupt

    monkeypatch.setattr(shelf, "rewrite", killed)
    asked = spark.createDataFrame([(loans(shelf)["Emma"]["id"], 1, {"state": "back"})], CHANGE)
    with pytest.raises(KeyboardInterrupt):
        records.edit(spark, shelf, LOAN, asked, at("2025-02-01"), catalogue=CATALOGUE)
    monkeypatch.undo()
    assert loans(shelf)["Emma"]["state"] == "out" and history(shelf)[-1] == ("loan.editar", runs.RUNNING, 1)
    seen = Store(spark, shelf.root)
    assert [(r["operation"], r["principal"]) for r in records.open_runs(seen).collect()] == [("loan.editar", 1)]
    assert records.open_runs(seen, before=at("2000-01-01")).count() == 0
    records.give_up(seen, records.open_runs(seen))
    assert records.open_runs(seen).count() == 0
    shelf.refresh()
    assert history(shelf) == [("loan.crear", "OK", 1), ("loan.editar", "ERROR", 1)]


def test_edits_of_tables_without_parts_write_the_folders_of_their_rows(spark, tmp_path):
    """The id tells the folders; an edit that moves a row to another part leaves the folders of the others, too."""
    entity = {"entidad": "tag", "tabla": "tag", "campos": {"id": {"tipo": "uuid", "sistema": True}, "word": {"tipo": "varchar"}, "shelf": {"tipo": "varchar"}}}
    schema = "id string, word string, shelf string, ejecucion_id bigint"
    store = load.prepare(Store(spark, str(tmp_path / "s")))
    store.create("tag", schema)
    for row in (("1", "old", "A", None), ("2", "old", "B", None), ("3", "old", "C", 8)):
        store.publish(store.append("tag", spark.createDataFrame([row], schema)))
    first, second, third = [e.path for e in store._live("tag")]
    records.edit(spark, store, entity, spark.createDataFrame([("1", 1, {"word": "new"})], CHANGE), at("2025-01-01"))
    records.delete(spark, store, entity, spark.createDataFrame([("3",), ("none",)], "id string"))
    live = {e.path for e in store._live("tag")}
    assert second in live and not live & {first, third}
    assert {(r["id"], r["word"]) for r in store.read("tag").collect()} == {("1", "new"), ("2", "old")}

    parted = load.prepare(Store(spark, str(tmp_path / "parted")))
    parted.create("tag", schema, part_col="shelf")
    parted.publish(parted.append("tag", spark.createDataFrame([("1", "w", "A", None), ("2", "w", "B", None), ("3", "w", "C", None)], schema)))
    before = {e.part: e.path for e in parted._live("tag")}
    records.edit(spark, parted, entity, spark.createDataFrame([("1", 1, {"shelf": "B"})], CHANGE), at("2025-01-01"))
    after = [e.path for e in parted._live("tag")]
    assert before["B"] in after and before["C"] in after and before["A"] not in after and len(after) == 3
    assert {(r["id"], r["shelf"]) for r in parted.read("tag").collect()} == {("1", "B"), ("2", "B"), ("3", "C")}
