"""WARC archives: write, normalise a monolithic gzip into one member per record, index, read back.

Archives live in the cluster's shared folder. Every task writes files under names of its own and returns
them; the returned names are written as a table first, so a repeated task or a lost executor leaves at most
a file that nobody names.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import Work, map_rows, whole_text

CHUNK = 1 << 18
PLAIN = " !\"#$&'()*+,/:;=?@[\\]^`{|}~"  # signs of an id that stand for themselves in a header
GZIP = 31  # zlib window bits of a gzip stream
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WRITTEN = "file string, records long"
INDEX = "file string, offset long, length long, type string, id string, digest string"
READ = "id string, type string, refers_to string, payload_bytes long, payload_digest string"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else fs.FileSystem.from_uri(path.replace("file:", "file://", 1))


def header_value(text: str) -> str:
    return text.replace("\r", "%0D").replace("\n", "%0A")


NO_PAGE = "<urn:page-without-id>"


def page_name(key: str | None) -> str:
    """The name of a page: its id with what would end or change a header line written as %XX; a null id has a name of its own."""
    return NO_PAGE if key is None else f"<urn:page:{quote(key, safe=PLAIN)}>"


def page_of(name: str | None) -> str | None:
    return None if name is None or name == NO_PAGE else unquote(name[len("<urn:page:"):-1])


def record(kind: str, name: str | None, uri: str | None, digest: str, payload: bytes, refers_to: str | None) -> bytes:
    """One WARC record. A revisit holds no payload but its digest and length."""
    lines = [("WARC-Type", kind), ("WARC-Record-ID", page_name(name)), ("WARC-Date", "1970-01-01T00:00:00Z"),
             ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(len(payload)))]
    if uri is not None:
        lines.append(("WARC-Target-URI", header_value(uri)))
    block = b""
    if kind == "revisit":
        lines += [("WARC-Refers-To", page_name(refers_to)), ("WARC-Profile", PROFILE)]
    else:
        lines.append(("Content-Type", "application/http; msgtype=response"))
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    lines.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)


def write_monolithic(work: Work, records: DataFrame, level: int = 1) -> DataFrame:
    """(file, records): one gzip stream per task over rows (id, uri, html, type, refers_to, digest), written once."""
    folder = work.new_folder("monolithic")

    def write(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(folder)
        name, count = f"{uuid.uuid4().hex}.warc.gz", 0
        packer, out = zlib.compressobj(level, wbits=GZIP), None
        for batch in rows:
            for row in batch.to_pylist():
                out = out or store.open_output_stream(f"{base}/{name}", compression=None)
                out.write(packer.compress(record(
                    row["type"], row["id"], row["uri"], row["digest"], row["html"].encode(), row["refers_to"])))
                count += 1
        if out:
            out.write(packer.flush())
            out.close()
            yield pa.RecordBatch.from_pylist([{"file": f"{folder}/{name}", "records": count}])

    return work.stage(map_rows(records, write, WRITTEN), "monolithic-files")


def inflated(stream) -> Iterator[bytes]:
    """The inflated bytes of a gzip file, of one member or many, in pieces of bounded size."""
    unpack, fresh = zlib.decompressobj(wbits=GZIP), True
    while data := stream.read(CHUNK):
        while data:
            piece, fresh = unpack.decompress(data, CHUNK), False
            if piece:
                yield piece
            if unpack.eof:
                data = unpack.unused_data
                unpack, fresh = zlib.decompressobj(wbits=GZIP), True
            else:
                data = unpack.unconsumed_tail
    while not fresh and not unpack.eof:
        piece = unpack.decompress(unpack.unconsumed_tail, CHUNK)
        if not piece:
            raise ValueError("the gzip stream ends early")
        yield piece


def framed(pieces: Iterator[bytes], name: str) -> Iterator[tuple[bytes, Iterator[bytes]]]:
    """(header bytes, body pieces) of each record; a body is read before the next record is asked for."""
    held = b""

    def more() -> bool:
        nonlocal held
        piece = next(pieces, None)
        if piece is None:
            return False
        held += piece
        return True

    def body(left: int) -> Iterator[bytes]:
        nonlocal held
        while left:
            if not held and not more():
                raise ValueError(f"{name} ends within a record")
            piece, held = held[:left], held[left:]
            left -= len(piece)
            yield piece

    while held or more():
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                raise ValueError(f"{name} ends within a record's header")
        head, held = held[: end + 4], held[end + 4:]
        yield head, body(int(fields(head)["Content-Length"]) + 4)


def normalise(work: Work, files: DataFrame, level: int = 6) -> DataFrame:
    """(file, records) of archives with one gzip member per record, each with a sidecar `<file>.idx`.

    Every given file is inflated once, as a stream; neither a file nor a record is held whole. An index
    line is JSON: file, offset, length of the member, type, record id and payload digest. A file without
    records gives an empty archive; one that ends within a record is an error.
    """
    folder = work.new_folder("members")

    def rewrite(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = []
        for path in (p for batch in rows for p in batch.column(0).to_pylist()):
            store, source = opened(path)
            target, base = opened(folder)
            name, offset, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
            with (store.open_input_stream(source, compression=None) as stream, target.open_output_stream(f"{base}/{name}", compression=None) as out,
                  target.open_output_stream(f"{base}/{name}.idx", compression=None) as index):
                for head, body in framed(inflated(stream), path):
                    packer = zlib.compressobj(level, wbits=GZIP)
                    size = out.write(packer.compress(head))
                    for piece in body:
                        size += out.write(packer.compress(piece))
                    size += out.write(packer.flush())
                    said = fields(head)
                    index.write((json.dumps({
                        "file": f"{folder}/{name}", "offset": offset, "length": size, "type": said["WARC-Type"],
                        "id": said["WARC-Record-ID"], "digest": said["WARC-Payload-Digest"]}) + "\n").encode())
                    offset, count = offset + size, count + 1
            done.append({"file": f"{folder}/{name}", "records": count})
        if done:
            yield pa.RecordBatch.from_pylist(done)

    n = max(files.count(), 1)
    made = work.stage(map_rows(files.select("file").repartition(n), rewrite, WRITTEN), "member-files")
    made._archive_path = folder
    return made


def index_of(spark, archives: DataFrame) -> DataFrame:
    """The sidecar lines of the named archives (and of no other file in their folder)."""
    lines = spark.read.schema(INDEX).option("pathGlobFilter", "*.idx").json(archives._archive_path)
    return lines.join(archives.select("file"), "file", "left_semi")


def read_members(index: DataFrame) -> DataFrame:
    """Each indexed record, read by its offset alone: id, type, refers_to, and size and digest of its full payload.

    Of a response both are taken from the payload read; a revisit names them for the payload it refers to.
    """

    def read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        for batch in rows:
            out = []
            for row in batch.select(["file", "offset", "length"]).to_pylist():
                if row["file"] != name:
                    if source:
                        source.close()
                    store, path = opened(name := row["file"])
                    source = store.open_input_file(path)
                whole = zlib.decompress(source.read_at(row["length"], row["offset"]), wbits=GZIP)
                head, _, rest = whole.partition(b"\r\n\r\n")
                said = fields(head)
                block = rest[: int(said["Content-Length"])]
                if said["WARC-Type"] == "revisit":
                    size, digest = int(said["X-Payload-Length"]), said["WARC-Payload-Digest"].removeprefix("sha256:")
                else:
                    payload = block.partition(b"\r\n\r\n")[2]
                    size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                refers = said.get("WARC-Refers-To")
                out.append({"id": page_of(said["WARC-Record-ID"]), "type": said["WARC-Type"], "payload_bytes": size, "payload_digest": digest,
                            "refers_to": page_of(refers)})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([
                ("id", pa.string()), ("type", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]))
        if source:
            source.close()

    return map_rows(index.repartition("file").sortWithinPartitions("file", "offset"), read, READ)


def archive(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html", least: int = 100) -> DataFrame:
    """Write all pages as WARC records, normalise the archives, and return what is read back per record.

    Columns: page_id, record_type, refers_to (both ids of the type of `page`), payload_bytes, payload_digest. Of
    pages with equal payloads of at least `least` bytes those with the smallest id are responses and the
    others revisit it; a null id is never the smallest, and shorter payloads are responses always. Null html
    is an empty payload, a null url leaves the header out, repeated rows are records of their own, an empty
    table gives none, and other columns are not read. Ids of any characters come back as they were given. Payloads
    are written and hashed whole, whatever their length; one payload at a time is in a task's memory.
    """
    work = Work(pages.sparkSession, "warc")
    kind = pages.schema[page].dataType
    rows = pages.select(F.col(page).alias("page"), F.col(url).cast("string").alias("uri"), whole_text(html).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    ids = rows.where(F.octet_length("html") >= least).select("page", "digest")
    # only payloads that occur twice, and one row each: the join below has one hot side that Spark can split
    first = work.stage(ids.groupBy("digest").agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first IS NOT NULL"), "first")
    repeats = ids.join(first, "digest").where(~F.col("page").eqNullSafe(F.col("first"))).select(
        F.col("page").alias("rpage"), F.col("digest").alias("rdigest"), "first")
    repeats = work.stage(repeats.distinct(), "repeats")
    typed = rows.join(repeats, F.col("page").eqNullSafe(F.col("rpage")) & (F.col("digest") == F.col("rdigest")), "left")
    files = write_monolithic(work, typed.select(
        F.col("page").cast("string").alias("id"), "uri", "html", "digest", F.when(F.col("first").isNull(), "response").otherwise("revisit").alias("type"),
        F.col("first").cast("string").alias("refers_to")))
    read = read_members(index_of(pages.sparkSession, normalise(work, files)))
    return read.select(
        F.col("id").cast(kind).alias(page), F.col("type").alias("record_type"),
        F.col("refers_to").cast(kind).alias("refers_to"), "payload_bytes", "payload_digest")
