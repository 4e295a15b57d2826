"""Legacy archives: ARC records parsed and rewritten as WARC.

An ARC file starts with a version block, whose last header line names the fields of all record lines. Version 1 lines
hold `URL IP-address Archive-date Content-type Archive-length`; version 2 lines add a result code, a checksum, a
location, an offset and a file name before the length. A record's network document has the declared length and is
followed by a line feed; a URL may hold spaces, so fields are counted from the right.

Each record becomes a WARC record: the date in ISO form, a UUID derived from URL, date and digest as identifier (the
same at any retry, and computed by Spark's own functions where a revisit refers to it), `response` with the block's own
HTTP head, its lines ended by CRLF, or a synthesised one, SHA-1 digests in base32. Records whose payload another
response holds become `revisit` with the HTTP head alone and the payload's length and digest.

Archives are files of WARC records written by Spark's text writer (gzip by file), so any store that Spark writes will
do, and committed by Spark; each begins with a `warcinfo` record. A record ends with CRLF CRLF; the second is the
writer's line end.

Null payloads count as empty, null URLs as `urn:null`; rows without a key keep null; equal keys with equal payloads
are all responses if theirs is the smallest key. A length that runs past the file's end gives a record with `error`, which
is written with WARC-Truncated; a line that is no record line gives a row with `error` and is not written, and reading
goes on at the next line that is one. Null and empty archives have no records, an empty table gives none; long payloads
are one record each; other columns are not carried along, whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm._arrays import binary_column, slices
from loomtext.llm._held import release
from loomtext.runtime import ship

# Fixed values of the formats: field names of the two versions, WARC's profile for repeated payloads.
FIELDS_V1 = "URL IP-address Archive-date Content-type Archive-length"
FIELDS_V2 = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = b"\r\n"

NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:loomtext:arc")
#: Bytes of html handled at a time; salts over which a repeated payload's records are dealt; records in an archive at most.
PIECE_BYTES, SALTS, FILE_RECORDS = 4 << 20, 32, 20_000
#: Bytes of an archive before compression, about; none holds more than eight times as many.
FILE_BYTES = 128 << 20

RECORD = "uri string, ip string, date string, content_type string, version int, record_id string, http_head binary, payload binary, digest string, error string"
_RECORD = [("uri", pa.string()), ("ip", pa.string()), ("date", pa.string()), ("content_type", pa.string()), ("version", pa.int32()), ("record_id", pa.string()), ("http_head", pa.binary()), ("payload", pa.binary()), ("digest", pa.string()), ("error", pa.string())]


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def arc_file(records: list[tuple[str, str, str, str, bytes]], version: int, name: str = "pages.arc") -> bytes:
    """An ARC file of (url, ip, 14-digit date, content type, network document)."""
    fields = FIELDS_V1 if version == 1 else FIELDS_V2
    about = f"{version} {'0' if version == 1 else '1'} loomtext\n{fields}\n".encode()
    if version == 1:
        out = [f"filedesc://{name} 0.0.0.0 19960101000000 text/plain {len(about)}\n".encode()]
    else:
        out = [f"filedesc://{name} 0.0.0.0 19960101000000 text/plain 200 - - 0 {name} {len(about)}\n".encode()]
    out += [about, b"\n"]
    for url, ip, date, kind, body in records:
        middle = "" if version == 1 else f" 200 - - {sum(map(len, out))} {name}"
        out += [f"{url} {ip} {date} {kind}{middle} {len(body)}\n".encode(), body, b"\n"]
    return b"".join(out)


def read_arc(data: bytes):
    """(version, fields, network document, error) of each record after the version block."""
    version, at, names = 1, 0, FIELDS_V1.split()
    first, lost = True, False
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0 or not data[at:end].strip():
            if end < 0:
                return
            at = end + 1
            continue
        line = data[at:end].decode("utf-8", "replace").rstrip("\r")
        if first and line.startswith("filedesc://"):
            # The version block's own fields tell its length in either version: the last one is the length.
            size = line.rpartition(" ")[2]
            body = data[end + 1 : end + 1 + int(size)] if size.isdigit() else b""
            head = body.decode("utf-8", "replace").split("\n")
            told = re.match("[0-9]+(?= |$)", head[0])
            version = int(told.group()) if told else 1
            names = head[1].split() if len(head) > 1 and head[1].startswith("URL") else (FIELDS_V1 if version == 1 else FIELDS_V2).split()
            at, first = end + 1 + len(body), False
            continue
        first = False
        values = line.rsplit(" ", len(names) - 1)
        fields = dict(zip(names, values, strict=False))
        if len(values) != len(names) or not re.fullmatch("[0-9]{1,18}", values[-1], re.ASCII) or not re.fullmatch("[0-9]*|-", fields.get("Archive-date", ""), re.ASCII):
            if not lost:  # one row for all lines up to the next record line
                yield version, {}, b"", f"no record line: {line[:80]}"
            at, lost = end + 1, True
            continue
        lost = False
        size = int(values[-1])
        body = data[end + 1 : end + 1 + size]
        yield version, fields, body, None if len(body) == size else "declared length runs past the end"
        at = end + 1 + size


_STATUS = re.compile(rb"HTTP/[0-9.]+ [0-9]{3}")


def convert(version: int, fields: dict, body: bytes, error: str | None) -> dict:
    """What a WARC record of this ARC record holds."""
    kind, date = fields.get("Content-type", "-"), fields.get("Archive-date", "")
    if _STATUS.match(body):
        cut = min((i + n for mark, n in ((b"\r\n\r\n", 4), (b"\n\n", 2)) if (i := body.find(mark)) >= 0), default=len(body))
        head, payload = re.sub(rb"\r*\n", CRLF, body[:cut].rstrip(b"\r\n") + b"\n\n"), body[cut:]
    else:
        head, payload = f"HTTP/1.1 {fields.get('Result-code', '200')} OK\r\nContent-Type: {kind}\r\n\r\n".encode(), body
    digest = digest_of(payload)
    stamp = date.ljust(14, "0") if date.isdigit() else "19700101000000"
    when = f"{stamp[:4]}-{stamp[4:6]}-{stamp[6:8]}T{stamp[8:10]}:{stamp[10:12]}:{stamp[12:14]}Z"
    uri = fields.get("URL", "urn:null")
    found = uuid.uuid5(NAMESPACE, f"{uri} {when} {fields.get('Filename', '')} {hashlib.sha1(payload).hexdigest()}")
    return {"uri": uri, "ip": fields.get("IP-address", "0.0.0.0"), "date": when, "content_type": kind, "version": version, "record_id": f"<urn:uuid:{found}>", "http_head": head, "payload": payload, "digest": digest, "error": error}


def record_id(uri: Column, date: Column, filename: Column, sha1: Column) -> Column:
    """The identifier that convert gives, from the hex SHA-1 of the payload: a UUID of version 5."""
    name = F.concat_ws(" ", uri, date, filename, sha1)
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE.hex)), name.cast("binary")))
    part = lambda at, n: F.substring(h, at, n)
    variant = F.translate(part(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12), F.lit(">"))


def warc_record(row: dict, kind: str = "response", refers_to: str | None = None, extra: dict | None = None) -> bytes:
    """Bytes of a WARC record but for the last CRLF."""
    block = row["http_head"] + (row["payload"] if kind == "response" else b"")
    head = {"WARC-Type": kind, "WARC-Record-ID": row["record_id"], "WARC-Date": row["date"], "WARC-Target-URI": row["uri"], "WARC-IP-Address": row["ip"], "Content-Type": "application/http;msgtype=response", "WARC-Payload-Digest": f"sha1:{row['digest']}", "WARC-Block-Digest": f"sha1:{digest_of(block)}"}
    if row.get("error"):
        head["WARC-Truncated"] = "length"
    if kind == "revisit":
        head |= {"WARC-Profile": SAME_PAYLOAD, "WARC-Refers-To": refers_to or ""}
    head |= (extra or {}) | {"Content-Length": str(len(block))}
    lines = "".join(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}\r\n" for k, v in head.items())
    return b"WARC/1.1\r\n" + lines.encode() + CRLF + block + CRLF


def read_warc(stream):
    """(header fields, block) of each record of a binary stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:40]!r}")
        head = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        size = int(head["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a record's block is cut short")
        yield head, block


def info_record(name: str, date: str = "2000-01-01T00:00:00Z") -> bytes:
    """The record that begins an archive, but for its last CRLF."""
    block = b"software: loomtext\r\nformat: WARC File Format 1.1\r\n"
    found = uuid.uuid5(NAMESPACE, f"warcinfo {name}")
    lines = f"WARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{found}>\r\nWARC-Date: {date}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n"
    return b"WARC/1.1\r\n" + lines.encode() + CRLF + block + CRLF


def _pages_to_arc(date: str, batches):
    release()
    for batch in batches:
        for piece in slices(batch, "html", PIECE_BYTES):
            arcs = []
            for key, url, html in zip(*(piece.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (html or "").encode()
                url = re.sub(r"[\r\n]+", " ", url or "urn:null")
                arcs.append(arc_file([(url, "0.0.0.0", date, "text/html", body)], 1 + (key or 0) % 2, f"page-{key}.arc"))
            yield pa.RecordBatch.from_arrays([piece.column("page_id"), binary_column(arcs)], names=["page_id", "arc"])


def pages_to_arc(pages: DataFrame, date: str = "20000101000000") -> DataFrame:
    """Rows (page_id, arc): a legacy archive of each page, version 1 or 2 by the id's parity."""
    ship(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html")
    return rows.mapInArrow(partial(_pages_to_arc, date), "page_id bigint, arc binary")


def page_keys(pages: DataFrame, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Rows (page_id, sha, size, record_id) of what pages_to_arc and arc_to_warc make of pages, without their payloads."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    key = F.col("page_id").cast("bigint")
    uri = F.regexp_replace(F.coalesce("url", F.lit("urn:null")), r"[\r\n]+", " ")
    uri = F.when(uri == "", "urn:null").otherwise(uri)
    filename = F.when(F.pmod(F.coalesce(key, F.lit(0)), F.lit(2)) == 1, F.concat(F.lit("page-"), key.cast("string"), F.lit(".arc"))).otherwise("")
    rows = pages.select(key.alias("page_id"), uri.alias("uri"), filename.alias("filename"), F.sha1(html).alias("sha"), F.length(html).alias("size"))
    return rows.select("page_id", "sha", "size", record_id(F.col("uri"), F.lit(date), F.col("filename"), F.col("sha")).alias("record_id"))


def _convert(key: str, batches):
    release()
    for batch in batches:
        rows, keys = [], []
        size = 0
        schema = pa.schema([(key, batch.schema.field(0).type), *_RECORD])
        make = lambda rows, keys, schema=schema: pa.RecordBatch.from_arrays([pa.array(keys, schema[0].type), *(pa.array([r[n] for r in rows], t) for n, t in _RECORD)], schema=schema)
        for k, arc in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for version, fields, body, error in read_arc(arc.as_py() or b""):
                rows.append(convert(version, fields, body, error))
                keys.append(k)
                size += len(body)
            if size > PIECE_BYTES:
                yield make(rows, keys)
                rows, keys, size = [], [], 0
        if rows:
            yield make(rows, keys)


def arc_to_warc(df: DataFrame, key: str = "page_id", arc: str = "arc") -> DataFrame:
    """Rows (key, columns of RECORD): one per ARC record, with all that its WARC record holds."""
    ship(df.sparkSession)
    return df.select(key, arc).mapInArrow(partial(_convert, key), f"`{key}` {df.schema[key].dataType.simpleString()}, {RECORD}")


def with_revisits(records: DataFrame, keys: DataFrame, key: str = "page_id", least_bytes: int = 0) -> DataFrame:
    """Add `first` and `first_id`: the smallest key that has an equal payload, of at least `least_bytes`, and its record's
    identifier; null if no other has it.

    `keys` has (key, sha, size, record_id) of the same rows, so that payloads are not moved to find the repeated ones. Only
    digests that occur twice are joined, each copied over SALTS salts, and a repeated payload's records are dealt over these.
    """
    again = keys.where(F.col("size") >= least_bytes).groupBy("sha").agg(F.min(key).alias("first"), F.min_by("record_id", key).alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = again.select("sha", "first", "first_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salt = F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")
    return records.withColumn("salt", salt).withColumn("sha", F.sha1("payload")).join(again, ["sha", "salt"], "left").drop("sha", "salt")


def _to_lines(key: str, file_records: int, batches):
    release()
    part, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        for piece in slices(batch, "payload", PIECE_BYTES):
            lines = []
            for row in piece.to_pylist():
                if n % file_records == 0:  # where the writer begins a file
                    lines.append(info_record(f"part-{part:05d}-{n // file_records:05d}.warc.gz"))
                    n += 1
                mine, first = row[key], row["first"]
                kind = "response" if first is None or first == mine else "revisit"
                extra = {"X-Page-Id": "" if mine is None else str(mine), "X-Payload-Length": str(len(row["payload"]))}
                if kind == "revisit":
                    extra["X-Refers-To-Page-Id"] = str(first)
                lines.append(warc_record(row, kind, row["first_id"], extra))
                n += 1
            yield pa.RecordBatch.from_arrays([binary_column(lines)], names=["line"])


def records_of(keys: DataFrame) -> int:
    """Records in an archive, by the mean and the largest `size`, so that no archive grows past what is read at once."""
    sizes = keys.agg(F.avg("size").alias("mean"), F.max("size").alias("most")).first()
    return max(2, min(FILE_RECORDS, int(FILE_BYTES / max(1, sizes["mean"] or 0, (sizes["most"] or 0) / 8))))


def write_warc(records: DataFrame, path: str, key: str = "page_id", file_records: int = FILE_RECORDS) -> None:
    """Write rows of RECORD with `first` and `first_id` as gzip archives of `file_records` records at most (with that which
    begins each) under `path`. Rows of lines that were no records are left out."""
    ship(records.sparkSession)
    rows = records.where("error IS NULL OR error NOT LIKE 'no record line%'")
    lines = rows.select(key, "first", "first_id", "uri", "ip", "date", "record_id", "http_head", "payload", "digest", "error").mapInArrow(partial(_to_lines, key, file_records), "line binary")
    lines.select(F.col("line").cast("string")).write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", file_records).text(path)


READ = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, refers_to_id string, record_id string, uri string, date string"
_READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("refers_to_id", pa.string()), ("record_id", pa.string()), ("uri", pa.string()), ("date", pa.string())])


def _read(batches):
    release()
    for batch in batches:
        for content in batch.column(0):
            rows = []
            for head, block in read_warc(gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer()))):
                number = lambda name, head=head: int(head[name]) if head.get(name) else None
                kind = head["warc-type"]
                if kind == "warcinfo":
                    continue
                if kind == "response":
                    payload = block[block.find(b"\r\n\r\n") + 4 :]
                    size, digest = len(payload), digest_of(payload)
                    if f"sha1:{digest}" != head["warc-payload-digest"]:
                        raise ValueError(f"payload digest of {head['warc-record-id']} doesn't hold")
                else:
                    size, digest = number("x-payload-length"), head["warc-payload-digest"].removeprefix("sha1:")
                rows.append((number("x-page-id"), size, digest, kind, number("x-refers-to-page-id"), head.get("warc-refers-to"), head["warc-record-id"], head["warc-target-uri"], head["warc-date"]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _READ, strict=True)], schema=_READ)


def read_warcs(spark, path: str) -> DataFrame:
    """One row per record of the archives under `path`; payloads' digests are computed again and compared."""
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(_read, READ)


