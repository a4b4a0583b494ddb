import base64
import gzip
import hashlib
import pathlib
import random
import tempfile
import tracemalloc
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strokeline.llm import warc


def rows_of(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    records = warc.convert_arcs(warc.pack_arcs(pages, "page_id", "url", "html"))
    path = tempfile.mkdtemp(prefix="spark-warc-") + "/w"
    warc.write_warc(warc.with_revisits(records, F.col("record_key").cast("bigint")), path, records_per_file=3)
    return warc.read_warc(spark, path).collect()


def test_round_trip_and_revisits(spark):
    body = "aa\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"
    rows = [(1, "http://a/x y", body), (2, None, body), (3, "u", None), (4, "u", ""), (5, "u", "é" * 50_000), (6, "u\n", "\n\n"), (None, "u", body), (7, "u", "z\n"), (7, "u", "z\n"), (8, "http://b", "once")]
    made = rows_of(spark, rows)
    assert len(made) == len(rows)
    top = {}
    for i, _, html in rows:
        top[html or ""] = max(top.get(html or "", -1), -1 if i is None else i)
    for r in made:
        i = None if r.record_key is None else int(r.record_key)
        html = next(h or "" for j, _, h in rows if j == i)
        data = html.encode()
        assert r.payload_bytes == len(data) and r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        if i == top[html]:
            assert r.record_type == "response" and bytes(r.payload) == data and r.refers_to_key is None
        else:
            assert r.record_type == "revisit" and r.payload is None and int(r.refers_to_key) == top[html]
    assert {r.warc_date for r in made} == {"2000-01-01T00:00:00Z"}


def test_no_pages(spark):
    assert rows_of(spark, []) == []


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    bodies = [b"", b"one\n\ntwo", b"\xff\xfe"]
    data = warc.arc_file([(n, f"http://h/{n}", b) for n, b in enumerate(bodies)], version, "19970102030405")
    rejected = []
    found = list(warc.arc_records(data, rejected))
    assert not rejected
    assert [h["URL"] for h, _ in found] == [f"http://h/{n}" for n in range(3)] and all(h["Archive-date"] == "19970102030405" for h, _ in found)
    assert [block[warc._http(block)[0] :] for _, block in found] == bodies
    assert len(list(warc.arc_records(data[:-3], rejected))) == 2 and [r[1] for r in rejected] == ["broken off"]


def test_foreign_arc_headers():
    about = b"1 0 InternetArchive\nURL IP-address Archive-date Content-type Archive-length\n"
    data = b"filedesc://f.arc 0.0.0.0 19960923142103 text/plain %d\n" % len(about) + about + b"\nhttp://x/ 1.2.3.4 19961104142103 text/html; charset=x 5\nhello\n"
    (head, block), = warc.arc_records(data, [])
    assert block == b"hello" and head["Content-type"] == "text/html; charset=x"


def test_what_cannot_be_read_is_rejected(spark):
    about = b"1 0 InternetArchive\nURL IP-address Archive-date Content-type Archive-length\n"
    first = b"filedesc://f.arc 0.0.0.0 19960923142103 text/plain %d\n" % len(about) + about
    files = [
        first + b"\nhttp://x/ text/html 5\nhello\nhttp://y/ 1.2.3.4 19961104 text/html 5\nworld\n",
        b"no archive at all\n", b"", first.replace(b"1 0 I", b"9 0 I"), first + b"\nhttp://z/ 1.2.3.4 19961104142103 text/html many\nhello\n",
    ]
    df = spark.createDataFrame([(bytearray(f),) for f in files], "content binary")
    made = warc.convert_arcs(df).collect()
    assert [(r.target_uri, bytes(r.block), r.warc_date) for r in made] == [("http://y/", b"world", "1996-11-04T00:00:00Z")]
    assert sorted(r.reason for r in warc.rejected_arc_records(df).collect()) == ["no header line", "no header line", "too few fields", "unknown version"]


def test_foreign_warc(spark):
    record = lambda kind, block, *more: b"\r\n".join([b"WARC/1.0", b"WARC-Type: " + kind, b"WARC-Record-ID: <urn:x>", *more, b"Content-Length: %d" % len(block), b"", b""]) + block + b"\r\n\r\n"
    data = record(b"warcinfo", b"software: x\r\n") + record(b"request", b"GET / HTTP/1.1\r\nHost: h\r\n\r\n", b"WARC-Target-URI: http://h/") + record(b"response", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody", b"WARC-Target-URI: http://h/", b"WARC-Date: 2020-01-01T00:00:00Z") + record(b"revisit", b"", b"WARC-Refers-To: <urn:y>")
    path = tempfile.mkdtemp(prefix="spark-warc-") + "/f.warc"
    with open(path, "wb") as file:
        file.write(data)
    made = {r.record_type: r for r in warc.read_warc(spark, path).collect()}
    assert set(made) == {"warcinfo", "request", "response", "revisit"} and bytes(made["response"].payload) == b"body" and bytes(made["warcinfo"].payload) == b"software: x\r\n"
    assert made["response"].payload_digest == base64.b32encode(hashlib.sha1(b"body").digest()).decode() and made["response"].payload_bytes == 4
    assert made["revisit"].payload is None and made["revisit"].payload_bytes is None and made["revisit"].refers_to_id == "urn:y" and made["warcinfo"].target_uri is None


def members_of(data):
    """The content of each gzip member."""
    found = []
    while data:
        one = zlib.decompressobj(31)
        found.append(one.decompress(data))
        data = one.unused_data
    return found


def test_a_record_is_a_member_and_files_are_bounded_by_bytes(spark):
    rows = [(n, f"http://h/{n}", f"{n} " * 5_000) for n in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    records = warc.with_revisits(warc.convert_arcs(warc.pack_arcs(pages, "page_id", "url", "html")), F.col("record_key").cast("bigint"))
    path = tempfile.mkdtemp(prefix="spark-warc-") + "/w"
    warc.write_warc(records.coalesce(1), path, file_bytes=100_000, software="a test")
    files = [f.read_bytes() for f in sorted(pathlib.Path(path).glob("part-*"))]
    assert len(files) >= 4 and all(len(gzip.decompress(f)) < 100_000 + 20_000 for f in files)
    for file in files:
        first, *records, last = members_of(file)
        assert b"WARC-Type: warcinfo" in first and b"software: a test" in first and last == b""
        assert records and all(m.startswith(b"WARC/1.1\r\n") and m.endswith(b"\r\n\r\n") and m.count(b"WARC/1.1") == 1 for m in records)
    made = warc.read_warc(spark, path).collect()
    assert sorted((int(r.record_key), bytes(r.payload).decode()) for r in made if r.record_type == "response") == sorted((n, t) for n, _, t in rows)
    assert sum(r.record_type == "warcinfo" for r in made) == len(files)


def test_a_block_must_match_its_digest():
    head = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x>\r\n"
    good = gzip.decompress(warc.warc_member(head, b"hello"))
    assert [r[1][5] for r in warc._read([pa.py_buffer(good)], True)] == [b"hello"]
    for bad in (good.replace(b"hello", b"hallo"), good.replace(b"Length: 5", b"Length: 4"), good[:-6], good[:40], b"x" + good):
        with pytest.raises(ValueError):
            list(warc._read([pa.py_buffer(bad)], True))


def test_a_long_page_among_many_is_read_in_a_stream():
    noise = random.Random(1).randbytes(50 << 20)
    rows = ((f"urn:{n}", "2000-01-01T00:00:00Z", b"WARC/1.1\r\nWARC-Type: resource\r\n", noise if n == 1_000 else noise[n : n + 20_000]) for n in range(2_000))
    content, = warc.packed(rows, 1_000_000, 1 << 40, None)
    tracemalloc.start()
    total = count = most = 0
    for batch in warc._batches(warc._read([pa.py_buffer(content)], True), warc.READ):
        total, count, most = total + batch.nbytes, count + batch.num_rows, max(most, batch.nbytes)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert count == 2_000 and total > (50 << 20) + 1_999 * 20_000 and most < 55 << 20
    assert peak < 200 << 20
