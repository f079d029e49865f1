"""Archives against brute force and a plain reader of their files."""

import base64
import hashlib
import os
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from sitemill.llm import queries, warc

SCHEMA = "page_id long, url string, html string, record string, digest string, data string, size string, chunk string"


def pages():
    long = "".join(f"<p>Stück {i} 中</p>" for i in range(9000))
    texts = ["<html>a</html>", "", None, "b" * 64, "b" * 65, "\r\n\r\n", "WARC/1.1\r\n\r\nx", long, long + "!", "\x00\x01é", "same", "same", "same", long]
    rows = [(i, f"http://x.example/{i}?ü a\r\n", t) for i, t in enumerate(texts)]
    rows += [(100 + i, "http://hot.example/", "hot") for i in range(40)]
    rows += [rows[10], rows[10], rows[0], (None, None, "same"), (None, "", "only here"), (None, None, "only here"), (7, "", "same"), (500, "u" * 20_000, "long address")]
    return [(*r, "r", "d", "x", "s", "c") for r in rows]


def b32(raw):
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def check(rows, found, least=0):
    """One response for each payload, of the least id; everything else refers to it."""
    assert len(found) == len(rows)
    groups = defaultdict(list)
    for page_id, _, html, *_ in rows:
        groups[(html or "").encode()].append(page_id)
    got = defaultdict(list)
    for r in found:
        got[(r["payload_digest"], r["payload_bytes"])].append(r)
    assert set(got) == {(b32(k), len(k)) for k in groups}
    for payload, ids in groups.items():
        own = got[(b32(payload), len(payload))]
        assert sorted(map(str, ids)) == sorted(str(r["page_id"]) for r in own)
        if len(payload) < least:
            assert all(r["record_type"] == "response" and r["refers_to"] is None and r["refers_to_record"] is None for r in own)
            continue
        known = [i for i in ids if i is not None]
        (first,) = [r for r in own if r["record_type"] == "response"]
        assert first["page_id"] == (min(known) if known else None) and first["refers_to"] is None
        assert all(r["refers_to"] == first["page_id"] and r["refers_to_record"] == first["record_id"] for r in own if r is not first)


@pytest.mark.parametrize(("least", "chunk"), [(0, warc.CHUNK), (0, 1000), (65, 64)])
def test_round_trip_of_odd_pages(spark, least, chunk):
    rows = pages()
    table = warc.write_records(spark.createDataFrame(rows, SCHEMA).repartition(3), 4, least, chunk=chunk)
    stored = table.select("chunk", "chunks", F.length("data").alias("n")).collect()
    assert max(r["n"] for r in stored if r["chunk"]) <= chunk + len(warc.END) if chunk < 10_000 else len(stored) == len(rows)
    check(rows, warc.read_records(table).collect(), least)


def test_files_are_plain_archives(spark, tmp_path):
    rows = pages()
    table = warc.write_records(spark.createDataFrame(rows, SCHEMA).repartition(2), 3, chunk=5000)
    listed = warc.write_files(table, str(tmp_path)).collect()
    assert sorted(os.listdir(tmp_path)) == sorted(os.path.basename(r["path"]) for r in listed)
    bodies, names, referred = [], set(), set()
    for r in listed:
        data = open(r["path"], "rb").read()
        assert len(data) == r["bytes"]
        while data:
            head, _, data = data.partition(b"\r\n\r\n")
            version, *lines = head.decode().split("\r\n")
            fields = dict(x.split(": ", 1) for x in lines)
            n = int(fields["Content-Length"])
            block, ending, data = data[:n], data[n : n + 4], data[n + 4 :]
            assert version == "WARC/1.1" and ending == b"\r\n\r\n"
            names.add(fields["WARC-Record-ID"])
            if fields["WARC-Type"] == "response":
                payload = block.partition(b"\r\n\r\n")[2]
                assert fields["WARC-Payload-Digest"] == f"sha1:{b32(payload)}"
                bodies.append(payload)
            else:
                referred.add(fields["WARC-Refers-To"])
    assert len(names) == len(rows) and referred <= names
    assert sorted(bodies) == sorted({(h or "").encode() for _, _, h, *_ in rows})


def test_damage_is_told(spark):
    table = warc.write_records(spark.createDataFrame(pages(), SCHEMA), 2, chunk=50_000)
    flipped = F.when(F.col("chunk") == 1, F.expr("encode(concat('z', decode(substring(data, 2), 'ISO-8859-1')), 'ISO-8859-1')")).otherwise(F.col("data"))
    with pytest.raises(Exception, match="is damaged in chunk 1"):
        warc.read_records(table.withColumn("data", flipped)).collect()
    for lost in ("chunk = 1", "chunk = 0 AND chunks > 1", "chunks > 1 AND chunk = chunks - 1"):
        with pytest.raises(Exception, match="is missing"):
            warc.read_records(table.where(f"NOT ({lost})")).collect()


def test_empty_tables(spark, tmp_path):
    table = warc.write_records(spark.createDataFrame([], SCHEMA))
    assert table.count() == 0 and warc.read_records(table).count() == 0
    assert warc.write_files(table, str(tmp_path)).count() == 0


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    path = f"{folder}/pages.parquet"
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    found = queries.op13_warc(spark, folder)
    want = con.sql(warc.SQL)
    order = [want.columns.index(c) for c in found.columns]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=repr)
