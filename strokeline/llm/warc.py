r"""Conversion of legacy ARC archives to WARC, and WARC writing and reading.

An ARC file is a sequence of records: a header line of fields that its version names, so many bytes as the line
declares, and a line break; the first record, `filedesc:`, states the version and the field names. The converter makes a
WARC record of each: an identifier derived from the record's fields, a timestamp from the 14-digit date, a type, and
SHA-1 digests in base32. Records whose payloads are equal become revisits of one response.

A record is a gzip member of its own. Files are bounded by bytes: tasks pack members until a file is full, and Spark's
text writer writes each pack, one value, to a file; its line separator is an empty member. Files are read as a stream,
record by record, by the declared lengths, and rows leave in batches of bounded bytes.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import written
from .text_arrow import slices

#: The field lists that the version block of an ARC file states.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
RECORD_END = b"\r\n\r\n"
#: A gzip member that holds nothing.
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff") + b"\x03\x00" + bytes(8)
#: Bytes of blocks or payloads after which a batch of records is passed on; a longer one is passed on with those before it.
BATCH_BYTES = 2 << 20


def digest_of(data: bytes) -> str:
    """SHA-1 in upper-case base32."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _url(url: str | None, key: object) -> str:
    if not url:
        return f"urn:record:{'' if key is None else key}"
    return "".join(ch if ord(ch) > 32 and ord(ch) != 127 else f"%{ord(ch):02X}" for ch in url)


def arc_file(rows: Iterable[tuple[object, str | None, bytes]], version: int, date: str, name: str = "records.arc") -> bytes:
    """An ARC file of HTTP responses (key, url, body); the key travels in the response's X-Record-Key."""
    about = f"{version} 0 archive\n{ARC_FIELDS[version]}\n".encode()
    first = {1: f"filedesc://{name} 0.0.0.0 {date} text/plain {len(about)}\n", 2: f"filedesc://{name} 0.0.0.0 {date} text/plain 200 - - 0 {name} {len(about)}\n"}[version]
    out = [first.encode() + about + b"\n"]
    size = len(out[0])
    for key, url, body in rows:
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n"
        head += f"X-Record-Key: {key}\r\n\r\n" if key is not None else "\r\n"
        block = head.encode() + body
        if version == 1:
            line = f"{_url(url, key)} 0.0.0.0 {date} text/html {len(block)}\n"
        else:
            line = f"{_url(url, key)} 0.0.0.0 {date} text/html 200 {hashlib.md5(block).hexdigest()} - {size} {name} {len(block)}\n"
        out.append(line.encode() + block + b"\n")
        size += len(out[-1])
    return b"".join(out)


def arc_records(content: bytes, rejected: list[tuple[int, str, str]]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record after the version block; (byte, reason, header line) of what can't be read goes to `rejected`.

    A record whose header line has too few fields is passed over by its length. Where a length is missing or goes beyond
    the file's end, and where the version block is missing or unknown, the rest of the file is lost.
    """
    at, fields = 0, None
    while at < len(content):
        begin, end = at, content.find(b"\n", at)
        if end < 0:
            rejected.append((begin, "broken off", content[begin : begin + 200].decode("utf-8", "replace")))
            return
        line = content[at:end].decode("utf-8", "replace").rstrip("\r")
        at = end + 1
        if not line:
            continue
        parts = line.split(" ")
        if not parts[-1].isdigit():
            rejected.append((begin, "no header line", line[:200]))
            return
        block = content[at : at + int(parts[-1])]
        if len(block) < int(parts[-1]):
            rejected.append((begin, "broken off", line[:200]))
            return
        at += len(block)
        if fields is None:
            if not parts[0].startswith("filedesc:"):
                rejected.append((begin, "no version block", line[:200]))
                return
            stated = block.decode("utf-8", "replace").split("\n")
            version = stated[0].split(" ")[0]
            if not version.isdigit() or int(version) not in ARC_FIELDS:
                rejected.append((begin, "unknown version", line[:200]))
                return
            fields = (stated[1] if len(stated) > 1 and stated[1] else ARC_FIELDS[int(version)]).split(" ")
            continue
        if len(parts) < len(fields):
            rejected.append((begin, "too few fields", line[:200]))
            continue
        if len(parts) > len(fields):  # a content type may hold spaces
            extra = len(parts) - len(fields)
            k = fields.index("Content-type") if "Content-type" in fields else 0
            parts[k : k + extra + 1] = [" ".join(parts[k : k + extra + 1])]
        yield dict(zip(fields, parts)), block


def _http(block: bytes) -> tuple[int, dict[str, str]]:
    """(start of the body, header fields) of an HTTP message; of anything else the whole block is the body."""
    if not block.startswith(b"HTTP/"):
        return 0, {}
    end = block.find(b"\r\n\r\n")
    if end < 0:
        return len(block), {}
    fields = (line.partition(":") for line in block[:end].decode("latin-1").split("\r\n")[1:])
    return end + 4, {name.strip().lower(): value.strip() for name, _, value in fields}


def _batches(rows: Iterable[tuple[int, tuple]], columns: str) -> Iterator[pa.RecordBatch]:
    """Record batches of (bytes, row), cut after BATCH_BYTES or 1,000 rows; `columns` is the rows' schema as Spark reads it."""
    kinds = {"string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64()}
    names, types = zip(*(c.split(" ") for c in columns.split(", ")))
    made = lambda: pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, k in zip(zip(*held), types)], list(names))
    held, size = [], 0
    for n, row in rows:
        held.append(row)
        size += n
        if size >= BATCH_BYTES or len(held) >= 1_000:
            yield made()
            held, size = [], 0
    if held:
        yield made()


def pack_arcs(df: DataFrame, key: str, url: str, text: str, date: str = "20000101000000") -> DataFrame:
    """content (binary): ARC files of both versions, in turn, that hold the rows' texts in UTF-8, a null text as an empty one."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t", 2 << 20):
            rows = list(zip(part.column("k").to_pylist(), part.column("u").to_pylist(), [(t or "").encode() for t in part.column("t").to_pylist()]))
            made = [arc_file(rows[v - 1 :: 2], v, date) for v in (1, 2) if rows[v - 1 :: 2]]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["content"])

    return df.select(df[key].cast("string").alias("k"), df[url].alias("u"), df[text].alias("t")).mapInArrow(run, "content binary")


CONVERTED = "record_id string, record_key string, target_uri string, warc_date string, content_type string, http boolean, block binary, payload_start int, payload_bytes long, payload_digest string"


def convert_arcs(files: DataFrame, content: str = "content") -> DataFrame:
    """The records of ARC files (a binary column), with what a WARC record of each needs (CONVERTED).

    record_key is the value of X-Record-Key, where the block is an HTTP response that has it, and null elsewhere. Equal
    records of equal fields get the same identifier. A date that isn't 14 digits is filled up from the right. What can't
    be read is left out here; `rejected_arc_records` lists it.
    """

    def converted(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, tuple]]:
        for data in (d for batch in batches for d in batch.column("content")):
            for head, block in arc_records(data.as_py() or b"", []):
                body, http = _http(block)
                payload = digest_of(memoryview(block)[body:])
                d = (head["Archive-date"] + "00000101000000"[len(head["Archive-date"]) :])[:14]
                date = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
                key = http.get("x-record-key")
                name = uuid.uuid5(uuid.NAMESPACE_URL, "\0".join((head["URL"], date, payload, key or "")))
                yield len(block), (f"urn:uuid:{name}", key, head["URL"], date, head["Content-type"], body > 0, block, body, len(block) - body, payload)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(converted(batches), CONVERTED)

    return files.select(F.col(content).alias("content")).mapInArrow(run, CONVERTED)


def rejected_arc_records(files: DataFrame, content: str = "content") -> DataFrame:
    """file_sha1, byte, reason and line (200 characters) of everything in ARC files that `convert_arcs` leaves out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                found: list[tuple[int, str, str]] = []
                for _ in arc_records(data.as_py() or b"", found):
                    pass
                name = hashlib.sha1(data.as_py() or b"").hexdigest()
                columns = [pa.array([name] * len(found), pa.string()), pa.array([f[0] for f in found], pa.int64()), *[pa.array([f[k] for f in found], pa.string()) for k in (1, 2)]]
                yield pa.RecordBatch.from_arrays(columns, ["file_sha1", "byte", "reason", "line"])

    return files.select(F.col(content).alias("content")).mapInArrow(run, "file_sha1 string, byte bigint, reason string, line string")


def with_revisits(records: DataFrame, order: Column, min_bytes: int = 0) -> DataFrame:
    """record_type, refers_to_id, refers_to_key, refers_to_uri and refers_to_date for converted records.

    Of records with equal payloads of `min_bytes` at least, the one with the largest `order` is the response and the
    others revisit it; records that tie for it are all responses, and a null `order` is below all others. Only narrow
    rows are grouped by payload; the blocks are joined to the outcome by their own identifiers.
    """
    narrow = records.select("record_id", "record_key", "target_uri", "warc_date", "payload_digest", "payload_bytes", order.alias("o")).where(F.col("payload_bytes") >= min_bytes)
    narrow = written(narrow, "payload-digests")
    best = narrow.groupBy("payload_digest", "payload_bytes").agg(
        F.count("*").alias("n"), F.max("o").alias("top"), F.max_by(F.struct("record_id", "record_key", "target_uri", "warc_date"), F.struct("o", "record_id")).alias("of")
    )
    best = best.where("n > 1")
    lower = narrow.join(best, ["payload_digest", "payload_bytes"]).where(~F.col("o").eqNullSafe(F.col("top")))
    lower = lower.select("record_id", F.col("of.record_id").alias("refers_to_id"), F.col("of.record_key").alias("refers_to_key"), F.col("of.target_uri").alias("refers_to_uri"), F.col("of.warc_date").alias("refers_to_date")).distinct()
    return records.join(lower, "record_id", "left").withColumn("record_type", F.when(F.col("refers_to_id").isNull(), "response").otherwise("revisit"))


def warc_member(head: bytes, block: bytes) -> bytes:
    """A WARC record as a gzip member: the header fields `head`, those that tell of the block, and the block."""
    about = f"WARC-Block-Digest: sha1:{digest_of(block)}\r\nContent-Length: {len(block)}\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return b"".join((packer.compress(head + about.encode()), packer.compress(block), packer.compress(RECORD_END), packer.flush()))


def packed(records: Iterable[tuple[str, str, bytes, bytes]], records_per_file: int, file_bytes: int, software: str | None) -> Iterator[bytes]:
    """Contents of WARC files with the records (identifier, date, header fields, block), in order; with `software`, each opens with a warcinfo record."""
    held, size, n = [], 0, 0
    for name, date, head, block in records:
        if not n and software is not None:
            own = uuid.uuid5(uuid.NAMESPACE_URL, f"warcinfo\0{name}")
            info = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{own}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\n"
            held.append(warc_member(info.encode(), f"software: {software}\r\nformat: WARC File Format 1.1\r\n".encode()))
        held.append(warc_member(head, block))
        size, n = size + len(head) + len(block), n + 1
        if size >= file_bytes or n >= records_per_file:
            yield b"".join(held)
            held, size, n = [], 0, 0
    if n:
        yield b"".join(held)


def write_warc(records: DataFrame, path: str, records_per_file: int = 1_000_000, file_bytes: int = 64 << 20, software: str | None = None) -> None:
    """Writes converted records with what `with_revisits` adds as WARC 1.1 files, each record a gzip member.

    A file is closed after `records_per_file` records or `file_bytes` bytes before compression; only a record that is
    longer by itself makes a longer one. A revisit holds the head of its response only, and states the digest and length of
    the payload that it doesn't repeat. With `software`, each file opens with a warcinfo record. Without records there are none.
    """
    field = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit("\r\n"))
    revisit = F.col("record_type") == "revisit"
    block = F.when(revisit, F.expr("substring(block, 1, payload_start)")).otherwise(F.col("block"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        field("WARC-Type", F.col("record_type")),
        field("WARC-Record-ID", F.concat(F.lit("<"), F.col("record_id"), F.lit(">"))),
        field("WARC-Date", F.col("warc_date")),
        field("WARC-Target-URI", F.col("target_uri")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        field("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.coalesce(field("X-Record-Key", F.col("record_key")), F.lit("")),
        F.when(revisit, F.concat(field("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), field("WARC-Refers-To", F.concat(F.lit("<"), F.col("refers_to_id"), F.lit(">"))), field("WARC-Refers-To-Target-URI", F.col("refers_to_uri")), field("WARC-Refers-To-Date", F.col("refers_to_date")))).otherwise(F.lit("")),
        F.when(revisit, F.coalesce(field("X-Refers-To-Key", F.col("refers_to_key")), F.lit(""))).otherwise(F.lit("")),
        field("Content-Type", F.when(F.col("http"), F.lit("application/http; msgtype=response")).otherwise(F.col("content_type"))),
    )

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, str, bytes, bytes]]:
        for batch in batches:
            for row in zip(*batch.columns):
                name, date, head, block = (x.as_py() for x in row)
                yield name, date, head.encode(), block

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for content in packed(rows(batches), records_per_file, file_bytes, software):
            yield pa.RecordBatch.from_arrays([pa.array([content], pa.binary())], ["value"])

    made = records.select("record_id", "warc_date", head.alias("head"), block.alias("block")).mapInArrow(run, "value binary")
    # a binary that is no UTF-8 keeps its bytes in this cast, and the text writer writes them as they are
    made = made.select(F.col("value").cast("string").alias("value"))
    made.write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("maxRecordsPerFile", 1).text(path)


def warc_stream(content: pa.Buffer) -> BinaryIO:
    """A WARC file's content as a stream, unpacked member by member if it is compressed."""
    file = pa.BufferReader(content)
    return gzip.GzipFile(fileobj=file) if content.size > 1 and content[:2].to_pybytes() == b"\x1f\x8b" else io.BufferedReader(file)


def warc_records(file: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record of a WARC stream, which is read one record at a time."""
    while line := file.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record where {line[:60]!r} stands")
        lines = iter(file.readline, b"\r\n")
        head = {}
        for line in lines:
            if not line:
                raise ValueError("a record is broken off in its header")
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        size = int(head["content-length"])
        block = file.read(size)
        if len(block) < size or file.read(4) != RECORD_END:
            raise ValueError(f"{head.get('warc-record-id')} doesn't have its declared length")
        yield head, block


READ = "record_id string, record_type string, record_key string, target_uri string, warc_date string, payload binary, payload_bytes long, payload_digest string, refers_to_id string, refers_to_key string"


def _read(contents: Iterable[pa.Buffer], payloads: bool) -> Iterator[tuple[int, tuple]]:
    """(bytes, row of READ) of each record of WARC files."""
    for head, block in (record for content in contents for record in warc_records(warc_stream(content))):
        kind, stated, size = head.get("warc-type"), head.get("warc-payload-digest", ""), head.get("x-payload-length")
        digest, payload, whole = stated.removeprefix("sha1:") or None, None, head.get("warc-block-digest", "")
        size = None if size is None else int(size)
        if whole.startswith("sha1:") and len(whole) == 37 and digest_of(block) != whole[5:].upper():
            raise ValueError(f"the block of {head.get('warc-record-id')} differs from its digest")
        if kind != "revisit":
            payload = memoryview(block)[_http(block)[0] :]
            own = digest_of(payload)
            if (size is not None and len(payload) != size) or (stated.startswith("sha1:") and len(digest) == 32 and own != digest.upper()):
                raise ValueError(f"the payload of {head.get('warc-record-id')} differs from its digest")
            size, digest = len(payload), own if digest is None else digest
        ids = [None if x is None else x.strip("<>") for x in (head.get("warc-record-id"), head.get("warc-refers-to"))]
        kept = bytes(payload) if payloads and payload is not None else None
        yield len(kept or b""), (ids[0], kind, head.get("x-record-key"), head.get("warc-target-uri"), head.get("warc-date"), kept, size, digest, ids[1], head.get("x-refers-to-key"))


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of WARC files of any origin, compressed or not (READ); payload is null for revisits, and everywhere without `payloads`.

    The payload of an HTTP message is its body, of any other record its block. What a record states of its block and
    payload, SHA-1 digests in base32 and a length, is held against them; a mismatch is an error. What it doesn't state is
    computed; of a revisit it stays null, as do a missing URI and date. A task holds a file as it is stored, which Spark
    bounds to 2 GB, and one record of it unpacked.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contents = (data.as_buffer() for batch in batches for data in batch.column("content"))
        yield from _batches(_read(contents, payloads), READ)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, READ)
