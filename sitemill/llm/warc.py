"""WARC archives as a chunked record table.

A record is one or more rows ``archive, record, chunk, chunks, data,
digest``: its bytes in order of ``chunk``, ``CHUNK`` bytes of payload each, with
the header before the first and the closing lines behind the last. ``digest`` is
the payload's SHA-1 up to and with that row, so a damaged row is told where it
lies. All rows of an archive in order of (record, chunk) are a WARC 1.1 file;
``write_files`` makes such files. Parquet keeps the rows, so a half-written
task leaves nothing on any store, and no task ever holds a whole payload beyond
the row that it is read from: Spark cuts it, and Python sees chunks.

Of records with equal payloads of at least ``least`` bytes the one with the
smallest id is a response, the others are revisits of it without a payload;
smaller ones are all responses. Payloads count as equal by SHA-1 and length.
Which one is first is found from a row a record by a map-side minimum, and a
digest that very many records share is split on the way back.

A null payload is empty, like an empty one. Null ids come last; of rows that
share id and payload exactly one is the response. A null or empty address is
``urn:page:<id>``; control characters, spaces and other characters outside
ASCII are percent-encoded in it. Only the columns named are read, so others may
have any name. An empty table gives an empty archive table.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, enter, materialize, shuffle_partitions

#: Payload bytes of a row at most.
CHUNK = 1 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
RECORD_DDL = "archive int, record bigint, chunk int, chunks int, data binary, digest string"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def digest_chunks(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", chunk: int = CHUNK) -> DataFrame:
    """``record, page_id, url, chunk, chunks, size, data, digest``: payloads in
    rows of at most ``chunk`` bytes; ``digest`` runs along each record."""
    raw = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    numbered = pages.select(F.monotonically_increasing_id().alias("record"), F.col(id_col).cast("string").alias("page_id"), F.col(url_col).cast("string").alias("url"), raw.alias("raw"), F.octet_length(raw).cast("bigint").alias("size"))
    last = F.expr(f"CAST((greatest(size, 1) - 1) DIV {chunk} AS INT)")
    cut = numbered.withColumn("last", last).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("last"))))
    rows = cut.select("record", "page_id", "url", "chunk", (F.col("last") + 1).alias("chunks"), "size", F.expr(f"substring(raw, chunk * {chunk} + 1, {chunk})").alias("data"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("warc")
        running = hashlib.sha1()
        for batch in batches:
            so_far = []
            for number, data in zip(batch.column(3).to_pylist(), batch.column(6), strict=True):
                if number == 0:
                    running = hashlib.sha1()
                running.update(data.as_buffer())
                so_far.append(base32(running.digest()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(so_far, pa.string())], [*batch.schema.names, "digest"])

    return rows.mapInArrow(run, "record bigint, page_id string, url string, chunk int, chunks int, size bigint, data binary, digest string")


def record_types(chunks: DataFrame, least: int = 0, id_type: str = "bigint") -> DataFrame:
    """``record, record_type, payload_digest, first_record, first_id`` of every
    record; the last two are null for responses."""
    whole = chunks.where("chunk = chunks - 1").select("record", "page_id", "size", "digest")
    rank = F.struct(F.col("page_id").isNull().alias("lacks"), F.col("page_id").cast(id_type).alias("id"), "record", "page_id")
    firsts = whole.where(F.col("size") >= least).groupBy("digest", "size").agg(F.min(rank).alias("first"))
    # joined on another expression than the aggregation's key: only between two plain exchanges is a hot digest split
    firsts = firsts.select(F.reverse("digest").alias("key"), F.col("size").alias("of_size"), "first")
    both = whole.withColumn("key", F.reverse("digest")).join(firsts, ["key"], "left")
    revisits = (F.col("size") == F.col("of_size")) & (F.col("first.record") != F.col("record"))
    kind = F.when(F.coalesce(revisits, F.lit(False)), "revisit").otherwise("response")
    return both.select("record", kind.alias("record_type"), F.col("digest").alias("payload_digest"), *[F.when(revisits, F.col(f"first.{c}")).alias(f"first_{n}") for c, n in (("record", "record"), ("page_id", "id"))])


def _name(record: int) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.md5(f'record {record}'.encode()).hexdigest())}>"


def header(record: int, page_id: str | None, url: str | None, size: int, kind: str, digest: str, first: tuple[int, str | None] | None) -> bytes:
    """All of a record before its payload: WARC fields, and the HTTP header
    that the block begins with (and, in a revisit, ends with)."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    fields = {
        "WARC-Type": kind, "WARC-Record-ID": _name(record), "WARC-Date": DATE,
        "WARC-Target-URI": quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else f"urn:page:{quote(page_id or '')}",
        "WARC-Payload-Digest": f"sha1:{digest}",
    }
    if first is not None:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": _name(first[0])}
        if first[1] is not None:
            fields["X-Refers-To-Page-ID"] = quote(first[1])
    if page_id is not None:
        fields["X-Page-ID"] = quote(page_id)
    fields |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block) + (size if kind == "response" else 0))}
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n" + block).encode()


def write_records(pages: DataFrame, archives: int | None = None, least: int = 0, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", chunk: int = CHUNK) -> DataFrame:
    """The archive table of ``pages``, written into the shared folder. Records
    are dealt to ``archives`` (a shuffle partition each) by their number."""
    own = Scratch()
    chunks = own.write(digest_chunks(pages, id_col, url_col, text_col, chunk), "payloads", "zstd")
    types = record_types(chunks, least, pages.schema[id_col].dataType.simpleString())
    # a revisit needs its header alone
    both = chunks.join(types, "record").where("record_type = 'response' OR chunk = 0")
    archive = F.pmod(F.xxhash64("record"), F.lit(archives or shuffle_partitions(pages.sparkSession))).cast("int")
    rows = both.select(archive.alias("archive"), "record", "chunk", F.when(F.col("record_type") == "response", F.col("chunks")).otherwise(1).alias("chunks"), F.when(F.col("record_type") == "response", F.col("data")).otherwise(F.lit(b"")).alias("data"), "digest", "page_id", "url", "size", "record_type", "payload_digest", "first_record", "first_id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            enter("warc")
            held = batch.column(4)
            data, digests = [], []
            for i, (_, record, at, of, digest, page_id, url, size, kind, payload_digest, first, first_id) in enumerate(zip(*[c.to_pylist() for j, c in enumerate(batch.columns) if j != 4], strict=True)):
                before = b"" if at else header(record, page_id, url, size, kind, payload_digest, None if first is None else (first, first_id))
                data.append(b"".join((before, held[i].as_buffer(), END if at == of - 1 else b"")))
                digests.append(digest if kind == "response" else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(data, pa.binary()), pa.array(digests, pa.string())], ["archive", "record", "chunk", "chunks", "data", "digest"])

    out = materialize(rows.mapInArrow(run, RECORD_DDL), "warc", "zstd")
    own.remove()
    return out


def _fields(raw: bytes, what: str) -> dict[str, str]:
    first, *rest = raw.decode().split("\r\n")
    if not first.startswith(what):
        raise ValueError(f"no {what} record: {first[:40]!r}")
    return {k.lower(): v for k, v in (x.split(": ", 1) for x in rest if x)}


class Reader:
    """Reads records from their chunks, fed one after the other; holds no more
    of a payload than the chunk at hand."""

    def __init__(self):
        self.record, self.next, self.of = None, 0, 0

    def feed(self, record: int, chunk: int, chunks: int, data: memoryview, digest: str | None) -> tuple | None:
        """The record's page, size, digest, type and reference once it is whole."""
        if chunk == 0 and self.next == self.of:
            self.record, self.next, self.of = record, 0, chunks
            # both headers lie in the first chunk, whatever an address's length
            raw = bytes(data)
            at = raw.find(END) + len(END)
            self.warc = _fields(raw[: at - len(END)], "WARC/1.1")
            start, at = at, raw.find(END, at) + len(END)
            self.http = _fields(raw[start : at - len(END)], "HTTP/1.1")
            self.left = int(self.warc["content-length"]) - (at - start)
            self.sha, self.size, data = hashlib.sha1(), 0, data[at:]
        elif (record, chunk, chunks) != (self.record, self.next, self.of):
            raise ValueError(f"record {self.record}: chunk {self.next} of {self.of} is missing")
        self.next += 1
        own = data[: self.left]
        self.sha.update(own)
        self.size, self.left = self.size + len(own), self.left - len(own)
        told, revisit = base32(self.sha.digest()), self.warc["warc-type"] == "revisit"
        ending = bytes(data[len(own) :])
        if (digest is not None and digest != told) or ending != (END if self.next == self.of else b""):
            raise ValueError(f"record {record} is damaged in chunk {chunk}")
        if self.next < self.of:
            return None
        stated = self.warc["warc-payload-digest"].removeprefix("sha1:")
        if self.left or (not revisit and (stated != told or int(self.http["content-length"]) != self.size)):
            raise ValueError(f"record {record} is damaged")
        page, first = (None if (x := self.warc.get(n)) is None else unquote(x) for n in ("x-page-id", "x-refers-to-page-id"))
        return page, int(self.http["content-length"]), stated, self.warc["warc-type"], first, self.warc["warc-record-id"], self.warc.get("warc-refers-to"), self.warc["warc-target-uri"]

    def close(self) -> None:
        if self.next < self.of:
            raise ValueError(f"record {self.record}: chunk {self.next} of {self.of} is missing")


READ = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "refers_to_record", "target_uri"]


def read_records(records: DataFrame, id_type: str = "bigint") -> DataFrame:
    """Reads an archive table: a row a record with the columns of ``READ``. All
    payloads are verified against their digests, chunk by chunk; a damaged or
    missing chunk fails the task and names it.

    A record of one chunk is whole in its row and is read where it lies; the
    chunks of others are brought together by their record, in order, and go by
    one at a time.
    """
    records = records.select("archive", "record", "chunk", "chunks", "data", "digest")
    parts = records.where("chunks > 1").repartition("archive", "record").sortWithinPartitions("archive", "record", "chunk")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            enter("warc")
            found = []
            for _, record, chunk, chunks, data, digest in zip(*[c if c.type == pa.binary() else c.to_pylist() for c in batch.columns], strict=True):
                row = reader.feed(record, chunk, chunks, memoryview(data.as_buffer()), digest)
                if row is not None:
                    found.append(row)
            columns = list(zip(*found, strict=True)) or [()] * len(READ)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n == "payload_bytes" else pa.string()) for n, c in zip(READ, columns, strict=True)], READ)
        reader.close()

    read = records.where("chunks = 1").union(parts).mapInArrow(run, ", ".join(f"{n} {'bigint' if n == 'payload_bytes' else 'string'}" for n in READ))
    return read.select(*[F.col(c).cast(id_type).alias(c) if c in ("page_id", "refers_to") else F.col(c) for c in READ])


def write_files(records: DataFrame, folder: str) -> DataFrame:
    """Writes every archive as a ``.warc`` file into ``folder``, which all
    workers must be able to open, and returns ``path, bytes``. A file gets its
    name only when it is whole, so a task that is run again does no harm."""
    ordered = records.select("archive", "record", "chunk", "data").repartition("archive").sortWithinPartitions("archive", "record", "chunk")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        current, file, done = None, None, []

        def finish() -> None:
            if file is not None:
                size = file.tell()
                file.close()
                path = f"{folder}/part-{current:05d}.warc"
                os.replace(file.name, path)
                done.append((path, size))

        for batch in batches:
            for archive, data in zip(batch.column(0).to_pylist(), batch.column(3), strict=True):
                if archive != current:
                    finish()
                    current, file = archive, open(f"{folder}/.{uuid.uuid4().hex}", "wb")  # noqa: SIM115
                file.write(data.as_buffer())
        finish()
        paths, sizes = zip(*done, strict=True) if done else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], ["path", "bytes"])

    return ordered.mapInArrow(run, "path string, bytes bigint")


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hex FROM p),
b AS (SELECT page_id, payload_bytes, list_aggregate(list_transform(range(8), lambda i: list_aggregate(list_transform(range(4), lambda k:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(hex, 5 * CAST(i AS INTEGER) + 1, 5) AS BIGINT) >> CAST(15 - 5 * k AS INTEGER)) & 31) + 1, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest FROM d),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM b)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM f
"""
