"""Legacy web archives: ARC files of versions 1 and 2 read, turned into WARC records and written.

An ARC file opens with a version block, whose definition line names the fields of all further
header lines; each record is such a line and as many bytes as it declares. A WARC record of
equal meaning gets a name-based UUID, the date in ISO form, a type by its scheme and status
line, and SHA-1 digests in base32. Records whose payload another record has become revisits.

Spark's text sink writes the files, a row each: tasks pack records into rows of at most
``FILE_BYTES`` (a longer record is a file of its own), so a file has its opening record and any
reader holds one file. Names are made from the partition and a counter, so a task that runs
again writes the same records.

- a null payload is an empty one, a null or empty URL is ``urn:none``, blanks in URLs are percent-encoded;
- of rows that repeat the largest page_id of a payload all are responses, and so are equal
  payloads that have no page_id at all; a row without a page_id revisits one that has it;
- a header line that cannot be read is a record of its own (type metadata, problem ``header``), a
  record with fewer bytes than declared keeps them (problem ``length``), a checksum that does not
  fit is told (problem ``checksum``), a date that is none becomes that of the file (problem ``date``);
- an empty table makes archives without records; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgewise.session import release, shared_dir, stage

FILE_BYTES, BATCH_BYTES = 16 << 20, 8 << 20
#: Fixed values of the formats: header fields of both ARC versions, the profile of revisits.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
IDENTICAL = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
ORIGIN = "edgewise"
DATE = re.compile(r"\d{4}(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])(([01]\d|2[0-3])([0-5]\d([0-5]\d)?)?)?")

CAPTURE = "version int, url string, ip string, date string, content_type string, status string, checksum string, block binary"
ARC = "file string, offset long, archive string, version int, url string, ip string, date string, content_type string, status string, problem string, block binary"
RECORD = "file string, offset long, problem string, type string, record_id string, date string, uri string, ip string, content_type string, payload_bytes long, payload_digest string, block_digest string, http string, block binary"
WARC = "file string, offset long, type string, record_id string, date string, uri string, refers_to string, payload_digest string, stored_digest string, http string, payload_bytes long, headers string, block binary"
_KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _pack(schema: str):
    names, kinds = zip(*(x.split() for x in schema.split(", ")))
    return lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], _KINDS[t]) for k, t in enumerate(kinds)], names)


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Headers, with the empty line behind them, and payload of an HTTP message; all is payload if it is none."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    ends = [(at + len(x)) for x in (b"\r\n\r\n", b"\n\n") if (at := block.find(x)) >= 0]
    return (block[: min(ends)], block[min(ends) :]) if ends else (block, b"")


def http_field(http: Column, name: str) -> Column:
    """The value of one HTTP header, null without it."""
    found = F.regexp_extract(http, rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1)
    return F.when(found != "", found)


# ARC


def captures(pages: DataFrame, version: Column | int = 1, date: str = "20000101000000") -> DataFrame:
    """HTTP captures of ``pages`` (page_id, url, html); the page id travels as a header."""
    html = F.coalesce("html", F.lit("")).cast("binary")
    url = F.when(F.coalesce("url", F.lit("")) == "", "urn:none").otherwise(F.col("url"))
    for c in " \t\n\x0b\x0c\r":
        url = F.replace(url, F.lit(c), F.lit(f"%{ord(c):02X}"))
    id = F.coalesce(F.concat(F.lit("X-Page-Id: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n"), id, F.lit("\r\n"))
    block = F.concat(head.cast("binary"), html)
    version = F.lit(version) if isinstance(version, int) else version
    rows = pages.select(version.cast("int").alias("version"), url.alias("url"), F.lit("0.0.0.0").alias("ip"), F.lit(date).alias("date"), F.lit("text/html").alias("content_type"), F.lit("200").alias("status"), block.alias("block"))
    return rows.withColumn("checksum", F.md5("block")).select(*(x.split()[0] for x in CAPTURE.split(", ")))


def _arc_line(version, url, ip, date, content_type, status, checksum, name, offset, n) -> bytes:
    of = {"URL": url, "IP-address": ip, "Archive-date": date, "Content-type": content_type, "Result-code": status, "Checksum": checksum or "-", "Location": "-", "Offset": offset, "Filename": name, "Archive-length": n}
    return (" ".join(str(of[f]) for f in ARC_FIELDS[version].split()) + "\n").encode()


def _files(batches, opened, record, file_bytes: int):
    """One row a file: ``opened`` gives a kind's name and opening bytes, ``record`` a row's kind and a function of
    name and offset that gives its bytes. Records of different kinds go to different files."""
    part, n, held = TaskContext.get().partitionId(), 0, {}
    out = lambda parts: pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], ["value"])
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns):
            kind, made = record(row)
            name, size, parts = held.get(kind, (None, 0, None))
            if parts is None or size + len(row[-1]) > file_bytes:
                if parts is not None:
                    yield out(parts)
                name, start = opened(kind, f"{part:06d}-{n:05d}")
                n, size, parts = n + 1, len(start), [start]
            data = made(name, size)
            parts.append(data)
            held[kind] = name, size + len(data), parts
    for _, _, parts in held.values():
        yield out(parts)


def _write(files: DataFrame, path: str, line_end: str) -> str:
    """Text files of one row each; the sink ends the last record of a file with ``line_end``."""
    made = files.select(F.col("value").cast("string").alias("value"))
    options = {"lineSep": line_end, "compression": "gzip", "zlib.compress.level": "BEST_SPEED", "maxRecordsPerFile": 1}
    made.write.options(**options).text(path)
    return path


def write_arc(rows: DataFrame, path: str, prefix: str = "capture", file_bytes: int = FILE_BYTES) -> str:
    """Write captures as compressed ARC files of their versions."""

    def opened(version, at):
        name = f"{prefix}-v{version}-{at}.arc"
        about = f"{version} 0 {ORIGIN}\n{ARC_FIELDS[version]}\n".encode()
        return name, _arc_line(version, f"filedesc://{name}", "0.0.0.0", "20000101000000", "text/plain", "200", "-", name, 0, len(about)) + about

    def record(row):
        version, url, ip, date, content_type, status, checksum, block = row
        return version, lambda name, at: b"\n" + _arc_line(version, url, ip, date, content_type, status, checksum, name, at, len(block)) + block

    return _write(rows.mapInArrow(lambda batches: _files(batches, opened, record, file_bytes), "value binary"), path, "\n")


def _stream(content: bytes):
    return gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)


def _arc_header(line: bytes, names: list):
    """The fields of a header line by name, or None. A URL with blanks takes what the other fields leave."""
    parts = line.decode("utf-8", "replace").rsplit(" ", len(names) - 1)
    if len(parts) != len(names) or not parts[-1].isdigit():
        return None
    return dict(zip(names, parts))


def arc_records(stream, file: str):
    """Rows of ``ARC`` of one file, read by header lines and declared lengths."""
    offset, archive, version, names, opened = 0, None, 1, ARC_FIELDS[1].split(), None
    while line := stream.readline():
        at, offset = offset, offset + len(line)
        line = line.rstrip(b"\r\n")
        if not line:
            continue
        about = line.startswith(b"filedesc://")
        # the opening line has the fields of a version that only its block tells
        tried = [ARC_FIELDS[v].split() for v in (2, 1)] if about else [names]
        h = next((x for n in tried if (x := _arc_header(line, n))), None)
        if h is None:
            yield file, at, archive, version, None, None, opened, "application/octet-stream", None, "header", line
            continue
        n = int(h["Archive-length"])
        block = stream.read(n)
        offset += len(block)
        problem = "length" if len(block) < n else None
        if about:
            lines = block.decode("utf-8", "replace").splitlines()
            archive, opened = h["URL"].removeprefix("filedesc://"), h["Archive-date"]
            version = 2 if lines and lines[0].startswith("2") else 1
            given = lines[1].split() if len(lines) > 1 else []
            names = given if {"URL", "Archive-date", "Archive-length"} <= set(given) and given[0] == "URL" and given[-1] == "Archive-length" else ARC_FIELDS[version].split()
        checksum, date = h.get("Checksum", "-"), h["Archive-date"]
        if problem is None and re.fullmatch("[0-9a-f]{32}", checksum) and hashlib.md5(block).hexdigest() != checksum:
            problem = "checksum"
        if not DATE.fullmatch(date):
            date, problem = opened, problem or "date"
        yield file, at, archive, version, h["URL"], h.get("IP-address"), date, h.get("Content-type"), h.get("Result-code"), problem, block


def _rows(files: DataFrame, schema: str, records) -> DataFrame:
    """What ``records(stream, file)`` gives for each file of (path, content), in batches of some megabytes."""
    pack = _pack(schema)

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                rows, size = [], 0
                for row in records(_stream(content.as_py()), path.as_py()):
                    rows.append(row)
                    size += 300 + len(row[-1] or b"")
                    if size > BATCH_BYTES:
                        yield pack(rows)
                        rows, size = [], 0
                if rows:
                    yield pack(rows)

    return files.select("path", "content").mapInArrow(run, schema)


def _binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all ARC files under ``path``, plain or compressed, version blocks included."""
    return _rows(_binary(spark, path), ARC, arc_records)


# WARC


def iso_date(date: str | None) -> str:
    d = (date or "19700101").ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(row, with_block: bool = True):
    """The row of ``RECORD`` for one of ``ARC``."""
    file, offset, archive, version, url, ip, date, content_type, status, problem, block = row
    http, payload = split_http(block) if url and re.match("https?:", url) or block.startswith(b"HTTP/") else (b"", block)
    if problem == "header":
        kind = "metadata"
    elif url.startswith("filedesc://"):
        kind = "warcinfo"
    else:
        kind = "response" if http else "resource"
    whole = digest(block)
    id = uuid.uuid5(uuid.NAMESPACE_URL, f"{url} {date} {whole} {archive} {offset}")
    content_type = "application/http; msgtype=response" if http else content_type
    return file, offset, problem, kind, f"urn:uuid:{id}", iso_date(date), url, ip, content_type, len(payload), digest(payload), whole, http.decode("latin-1"), block if with_block else None


def convert(spark: SparkSession, path: str, with_block: bool = True) -> DataFrame:
    """The WARC records (columns of ``RECORD``) of all ARC files under ``path``; without their blocks for a first pass."""
    return _rows(_binary(spark, path), RECORD, lambda stream, file: (warc_record(x, with_block) for x in arc_records(stream, file)))


def revisits(records: DataFrame, page: Column, least_bytes: int = 0) -> DataFrame:
    """(file, offset, refers_to): the responses whose payload of ``least_bytes`` or more a response of a larger ``page`` has, with the
    id of the one of the largest. Equal is what has one length and one SHA-1."""
    facts = records.where((F.col("type") == "response") & (F.col("payload_bytes") >= least_bytes)).select("file", "offset", "record_id", "payload_bytes", "payload_digest", page.alias("page"))
    best = facts.groupBy("payload_bytes", "payload_digest").agg(F.max(F.struct("page", "record_id")).alias("best"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = F.col("best.page").isNotNull() & (F.col("page").isNull() | (F.col("page") < F.col("best.page")))
    return facts.join(best, ["payload_bytes", "payload_digest"]).where(later).select("file", "offset", F.col("best.record_id").alias("refers_to"))


def _warc_bytes(fields: list, block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.0\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n"


def write_warc(records: DataFrame, path: str, prefix: str = "converted", file_bytes: int = FILE_BYTES) -> str:
    """Write records (columns of ``RECORD`` and refers_to) as compressed WARC files; one with refers_to is a revisit and keeps the HTTP headers alone."""
    columns = ["type", "record_id", "date", "uri", "ip", "content_type", "payload_digest", "block_digest", "problem", "refers_to", "block"]

    def opened(_, at):
        name = f"{prefix}-{at}.warc"
        block = f"software: {ORIGIN}\r\nformat: WARC File Format 1.0\r\n".encode()
        id = uuid.uuid5(uuid.NAMESPACE_URL, name)
        return name, _warc_bytes([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{id}>"), ("WARC-Date", "2000-01-01T00:00:00Z"), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], block)

    def record(row):
        kind, id, date, uri, ip, content_type, payload, whole, problem, refers_to, block = row
        if refers_to is not None:
            kind, block = "revisit", split_http(block)[0]
            whole = digest(block)
        fields = [
            ("WARC-Type", kind), ("WARC-Record-ID", f"<{id}>"), ("WARC-Date", date), ("WARC-Target-URI", None if kind == "warcinfo" else uri), ("WARC-Filename", uri.removeprefix("filedesc://") if kind == "warcinfo" else None),
            ("WARC-IP-Address", ip), ("WARC-Payload-Digest", f"sha1:{payload}"), ("WARC-Block-Digest", f"sha1:{whole}"), ("WARC-Refers-To", None if refers_to is None else f"<{refers_to}>"),
            ("WARC-Profile", None if refers_to is None else IDENTICAL), ("WARC-Truncated", "length" if problem == "length" else None), ("Content-Type", content_type),
        ]
        data = _warc_bytes(fields, block)
        return 0, lambda name, at: b"\r\n" + data

    return _write(records.select(*columns).mapInArrow(lambda batches: _files(batches, opened, record, file_bytes), "value binary"), path, "\r\n")


def warc_records(stream, file: str, with_block: bool = True):
    """Rows of ``WARC`` of one file, read by declared lengths; what is no record is skipped up to the next one."""
    offset = 0
    while line := stream.readline():
        at, offset = offset, offset + len(line)
        if not line.startswith(b"WARC/"):
            continue
        fields, lines = {}, []
        while line := stream.readline():
            offset += len(line)
            if not line.strip():
                break
            lines.append(line.decode("utf-8", "replace").rstrip("\r\n"))
            name, _, value = lines[-1].partition(":")
            fields[name.strip().lower()] = value.strip()
        n = int(fields["content-length"]) if fields.get("content-length", "").isdigit() else 0
        block = stream.read(n)
        offset += len(block)
        http, payload = split_http(block)
        bare = lambda x: None if fields.get(x) is None else fields[x].strip("<>")
        stored = fields.get("warc-payload-digest")
        yield (
            file, at, fields.get("warc-type"), bare("warc-record-id"), fields.get("warc-date"), fields.get("warc-target-uri"), bare("warc-refers-to"), digest(payload), None if stored is None else stored.removeprefix("sha1:"),
            http.decode("latin-1"), len(payload), "\n".join(lines), block if with_block else None,
        )


def read_warc(spark: SparkSession, path: str, with_block: bool = True) -> DataFrame:
    """The records of all WARC files under ``path``, plain or compressed; payload_digest is that of the bytes read."""
    return _rows(_binary(spark, path), WARC, lambda stream, file: warc_records(stream, file, with_block))


def converted(spark: SparkSession, arc: str, warc: str, least_bytes: int = 0) -> str:
    """Convert the ARC files under ``arc`` into WARC files under ``warc``, records of equal payloads as revisits of the one with
    the largest X-Page-Id. The first pass reads digests alone; the second moves blocks only if the revisits are too many to broadcast."""
    facts = stage(convert(spark, arc, with_block=False).drop("block"), "arc-facts")
    page = http_field(F.col("http"), "X-Page-Id").cast("long")
    again = stage(revisits(facts, page, least_bytes), "arc-revisits")
    write_warc(convert(spark, arc).join(again, ["file", "offset"], "left"), warc)
    release(facts, again)
    return warc


def archived(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Pages (page_id, url, html) written as ARC files, of version 1 for even page ids and 2 for others, converted and read back:
    (page_id, url, payload_bytes, payload_digest, record_type, refers_to)."""
    spark = pages.sparkSession
    base = f"{shared_dir(spark)}/edgewise/archives-{uuid.uuid4().hex}"
    version = F.when(F.col("page_id") % 2 == 0, 1).otherwise(2)
    arc = write_arc(captures(pages.select("page_id", "url", "html"), version), f"{base}/arc")
    warc = converted(spark, arc, f"{base}/warc", least_bytes)
    length = F.when(F.col("type") == "revisit", http_field(F.col("http"), "Content-Length").cast("long")).otherwise(F.col("payload_bytes"))
    sha = F.when(F.col("type") == "revisit", F.col("stored_digest")).otherwise(F.col("payload_digest"))
    back = read_warc(spark, warc, with_block=False).where(F.col("type").isin("response", "revisit")).select(
        http_field(F.col("http"), "X-Page-Id").cast("long").alias("page_id"), F.col("uri").alias("url"), length.alias("payload_bytes"), sha.alias("payload_digest"), F.col("type").alias("record_type"), "record_id", F.col("refers_to").alias("target"),
    )
    back = stage(back, "warc-facts")
    named = back.where("record_type = 'response'").select(F.col("record_id").alias("target"), F.col("page_id").alias("refers_to"))
    named = back.where("target is not null").select("target").distinct().join(named, "target")
    return back.join(named, "target", "left").select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: What the archives must say, from the table alone; base32 from the hex digits of SHA-1.
ORACLE = """
WITH hashed AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), bits AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(40), lambda i: lpad(bin(CAST('0x' || substr(hex, CAST(i + 1 AS BIGINT), 1) AS BIGINT)), 4, '0')), '') AS b FROM hashed
), named AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + list_reduce(range(5), lambda n, i: 2 * n + CAST(substr(b, CAST(5 * k + i + 1 AS BIGINT), 1) AS BIGINT), CAST(0 AS BIGINT)) AS BIGINT), 1)), '') AS payload_digest FROM bits
), last AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_bytes, payload_digest) AS m FROM named
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN m IS NULL OR page_id = m THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM m THEN m END AS refers_to FROM last
"""
