import gzip
import hashlib

from siftwell.llm import warc
from siftwell.llm.common import Work

SCHEMA = "page_id long, url string, html string, digest string, first string"


def test_revisits_and_read_back(spark):
    long, other = "x" * 99 + "é", "y" * 100
    rows = [(3, "http://a\r\nb", long, "", ""), (1, None, long, "", ""), (2, "u", long, "", ""), (4, "u", "short", "", ""), (5, "u", "short", "", ""),
            (6, "u", None, "", ""), (7, "u", "", "", ""), (8, "u", "WARC/1.1\r\n\r\nContent-Length: 9\r\n\r\n" * 9, "", ""), (9, "u", "z" * 700_000, "", ""),
            (None, "u", other, "", ""), (10, "u", other, "", ""), (11, "u", long[:-1] + "\n", "", ""), (2, "u", long, "", "")]
    out = warc.archive(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r["page_id"]), r["payload_bytes"]) for r in out) == sorted((str(r[0]), len((r[2] or "").encode())) for r in rows)
    by_id = {r["page_id"]: r for r in out}
    for page, _, html, _, _ in rows:
        assert by_id[page]["payload_digest"] == hashlib.sha256((html or "").encode()).hexdigest()
    revisits = {str(r["page_id"]): r["refers_to"] for r in out if r["record_type"] == "revisit"}
    assert revisits == {"2": 1, "3": 1, "None": 10}
    assert warc.archive(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ids_of_any_characters(spark):
    ids = ["null", None, "a\r\nWARC-Type: x", "<urn:page:1>", "%41 é漢", "", "page-without-id", ": "]
    rows = [(i, "u", "z" * 200 if n % 2 else f"own {n}") for n, i in enumerate(ids)]
    out = warc.archive(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()
    assert sorted(str(r["page_id"]) for r in out) == sorted(map(str, ids)) and len(out) == len(ids)
    first = min(i for n, i in enumerate(ids) if n % 2 and i is not None)
    assert {(r["page_id"], r["refers_to"]) for r in out if r["record_type"] == "revisit"} == {(i, first) for n, i in enumerate(ids) if n % 2 and i != first}


def test_normaliser_writes_members_and_index(spark):
    work = Work(spark, "test-warc")
    records = spark.createDataFrame([(str(i), "u", "body" * i, "response", None, "d") for i in range(40)], "id string, uri string, html string, type string, refers_to string, digest string")
    whole = warc.write_monolithic(work, records.coalesce(1))
    made = warc.normalise(work, whole)
    assert [r["records"] for r in made.collect()] == [40]
    index = warc.index_of(spark, made).orderBy("offset").collect()
    store, path = warc.opened(index[0]["file"])
    with store.open_input_file(path) as file:
        raw = file.read()
    assert index[0]["offset"] == 0 and sum(r["length"] for r in index) == len(raw)
    for number, row in enumerate(index):
        member = gzip.decompress(raw[row["offset"]:row["offset"] + row["length"]])
        assert member.endswith(b"\r\n\r\n" + b"body" * number + b"\r\n\r\n") and row["id"] == f"<urn:page:{number}>"
    store, path = warc.opened(whole.first()["file"])
    with store.open_input_file(path) as file:
        assert gzip.decompress(file.read()) == gzip.decompress(raw)
    # an archive that has members already comes out the same
    assert [r["records"] for r in warc.normalise(work, made).collect()] == [40]


def test_a_cut_archive_is_an_error():
    import io
    import zlib

    import pytest

    packer = zlib.compressobj(wbits=31)
    stream = packer.compress(warc.record("response", "1", "u", "d", b"x" * 5000, None)) + packer.flush()
    for cut in (stream[:40], stream[:-9]):
        with pytest.raises(ValueError):
            for _, body in warc.framed(warc.inflated(io.BytesIO(cut)), "cut"):
                list(body)
