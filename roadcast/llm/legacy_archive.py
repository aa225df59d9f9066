"""Legacy archive (ARC) to WARC conversion.

``legacy_archives`` lays pages out as ARC files (version 1 or 2), ``arc_records``
parses ARC content by its version-specific header lines and declared lengths
and synthesises what WARC needs: record identifiers, W3C timestamps, record
types and digests. ``write_warc`` decides which records are revisits and writes
WARC 1.1 files; ``read_warc`` parses them back by their declared lengths.

The decision on revisits needs only (page, digest, length), so the corpus-wide
aggregate moves no payload. Payloads move once, by record, to give files of
bounded size, and files are written by Spark's text writer: a record ends with
two CRLFs, which is that writer's line separator, so its commit protocol also
protects the archives when executors are lost.

Cases: null html is an empty payload; a null url becomes urn:page:<id>; white
space in a url is percent-encoded; payloads may hold any text, header-like and
record-like lines included, as only declared lengths delimit; truncated ARC
content gives the whole records before the cut; empty input gives no records;
repeated rows of one page give a record each; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadcast.llm.shared import cut, scratch

# Fixed values of the two formats.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
ARC_ORIGIN = "roadcast"
WARC_VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"

CAPTURED = "20010203040506"
MIN_REVISIT_BYTES = 1000
FILE_BYTES = 32 << 20
ARC_BYTES = 4 << 20
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122, URLs


# ---- ARC ----

def arc_header(version: int, name: str) -> bytes:
    """The version block that opens an ARC file."""
    body = f"{version} 0 {ARC_ORIGIN}\n{ARC_FIELDS[version]}\n".encode()
    head = ["filedesc://" + name, "0.0.0.0", CAPTURED, "text/plain"]
    if version == 2:
        head += ["200", "-", "-", "0", name]
    return f"{' '.join(head)} {len(body)}\n".encode() + body + b"\n"


def arc_document(version: int, url: str, http: bytes, offset: int, name: str) -> bytes:
    head = [url, "0.0.0.0", CAPTURED, "text/html"]
    if version == 2:
        head += ["200", hashlib.md5(http).hexdigest(), "-", str(offset), name]
    return f"{' '.join(head)} {len(http)}\n".encode() + http + b"\n"


def page_to_http(page_id: int | None, html: str | None) -> bytes:
    body = (html or "").encode("utf-8")
    key = "" if page_id is None else str(page_id)
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {key}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body


def clean_url(page_id: int | None, url: str | None) -> str:
    return "".join(f"%{ord(c):02X}" if c.isspace() else c for c in url) if url else f"urn:page:{page_id}"


def pages_to_arc(rows: Iterator[tuple], version: int, name: str) -> bytes:
    """An ARC file of (page_id, url, html) rows."""
    parts, at = [arc_header(version, name)], 0
    at = len(parts[0])
    for page_id, url, html in rows:
        parts.append(arc_document(version, clean_url(page_id, url), page_to_http(page_id, html), at, name))
        at += len(parts[-1])
    return b"".join(parts)


def parse_arc(content: bytes) -> Iterator[dict]:
    """Documents of an ARC file: the version block names the fields, each header line declares a length."""
    at, fields = 0, ARC_FIELDS[1].split()
    while at < len(content):
        end = content.find(b"\n", at)
        if end < 0:
            return
        line = content[at:end].decode("utf-8", "surrogateescape").rstrip("\r")
        if not line:
            at = end + 1
            continue
        if line.startswith("filedesc://"):
            size = int(line.rsplit(" ", 1)[1])
            block = content[end + 1:end + 1 + size].decode("utf-8", "replace").splitlines()
            if len(block) > 1:
                fields = block[1].split()
            elif block and block[0].split()[:1] == ["2"]:
                fields = ARC_FIELDS[2].split()
            at = end + 1 + size
            continue
        values = line.rsplit(" ", len(fields) - 1)
        if len(values) != len(fields) or not values[-1].isdigit():
            raise ValueError(f"ARC header line at byte {at} has {len(values)} fields, not the declared {len(fields)}")
        size = int(values[-1])
        if end + 1 + size > len(content):
            return
        yield dict(zip(fields, values)) | {"block": content[end + 1:end + 1 + size]}
        at = end + 1 + size


# ---- what WARC needs ----

def warc_fields(doc: dict) -> dict:
    """Identifier, timestamp, type, digests and payload of an ARC document."""
    block, stamp = doc["block"], doc["Archive-date"].ljust(14, "0")
    date = f"{stamp[:4]}-{stamp[4:6]}-{stamp[6:8]}T{stamp[8:10]}:{stamp[10:12]}:{stamp[12:14]}Z"
    is_http = block.startswith(b"HTTP/")
    head, _, payload = block.partition(END.encode()) if is_http else (b"", b"", block)
    key = next((int(x[10:]) for x in head.split(b"\r\n") if x[:10].lower() == b"x-page-id:" and x[10:].strip()), None)
    return {"page_id": key, "uri": doc["URL"], "date": date, "is_http": is_http, "mime": doc["Content-type"], "block": block,
            "head_bytes": len(block) - len(payload), "payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest()}


RECORD = "page_id long, uri string, date string, is_http boolean, mime string, head_bytes int, payload_bytes long, payload_digest string, block binary"


def arc_records(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) through ARC files of bounded size, parsed; versions 1 and 2 take turns."""
    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        version, schema = 1, None
        for b in batches:
            rows, size = [], 0
            for row in zip(*(c.to_pylist() for c in b.columns)):
                rows.append(row)
                size += len(row[2] or "")
                if size >= ARC_BYTES:
                    yield _batch(pages_to_arc(rows, version, f"pages-v{version}.arc"))
                    rows, size, version = [], 0, 3 - version
            if rows:
                yield _batch(pages_to_arc(rows, version, f"pages-v{version}.arc"))
                version = 3 - version
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(convert, RECORD)


_ARROW = {"page_id": pa.int64(), "uri": pa.string(), "date": pa.string(), "is_http": pa.bool_(), "mime": pa.string(),
          "head_bytes": pa.int32(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "block": pa.binary()}


def _batch(archive: bytes) -> pa.RecordBatch:
    found = [warc_fields(d) for d in parse_arc(archive)]
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in _ARROW.items()], list(_ARROW))


# ---- WARC ----

def record_id(page_id: int | None, uri: str, date: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id} {date} {uri if page_id is None else ""}')}>"


def warc_record(r: dict, refers_to: int | None) -> bytes:
    """One record without its two closing CRLFs."""
    revisit = refers_to is not None
    block = r["block"][:r["head_bytes"]] if revisit else r["block"]
    kind = "revisit" if revisit else "response" if r["is_http"] else "resource"
    digest = base64.b32encode(bytes.fromhex(r["payload_digest"])).decode()
    head = [WARC_VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(r['page_id'], r['uri'], r['date'])}",
            f"WARC-Date: {r['date']}", f"WARC-Target-URI: {r['uri']}", f"WARC-Payload-Digest: sha1:{digest}",
            f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}"]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, r['uri'], r['date'])}",
                 f"WARC-Truncated: length", f"X-Refers-To-Page: {refers_to}", f"X-Payload-Length: {r['payload_bytes']}"]
    mime = "application/http; msgtype=response" if r["is_http"] else r["mime"]
    head += [f"Content-Type: {mime}", f"Content-Length: {len(block)}"]
    return ("\r\n".join(head) + END).encode("utf-8", "surrogateescape") + block


def revisits(records: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(page_id, refers_to): pages whose payload a page with a larger id also has."""
    narrow = cut(records.select("page_id", "payload_digest", "payload_bytes").where(
        (F.col("payload_bytes") >= min_bytes) & F.col("page_id").isNotNull()), "warc-digests")
    keepers = narrow.groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least"))
    keepers = cut(keepers.where("least < refers_to").drop("least"), "warc-keepers")
    found = narrow.join(keepers, ["payload_digest", "payload_bytes"]).where("page_id < refers_to").select("page_id", "refers_to")
    return cut(found.distinct(), "warc-revisits")


def write_warc(records: DataFrame, path: str) -> None:
    """WARC files of about FILE_BYTES before compression below ``path``; one record per row of ``records``."""
    links = revisits(records)
    total = records.agg(F.sum(F.col("payload_bytes") + 600)).first()[0] or 0
    files = max(records.sparkSession.sparkContext.defaultParallelism, -(-total // FILE_BYTES))
    dealt = records.repartition(int(files), "page_id")
    full = dealt.join(links.withColumnRenamed("page_id", "of"), F.col("page_id") == F.col("of"), "left")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.schema.names
            out = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                r = dict(zip(names, row))
                out.append(warc_record(r, r["refers_to"]))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    lines = full.select(*_ARROW, "refers_to").mapInArrow(build, "value binary")
    lines.select(F.col("value").cast("string").alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


def parse_warc(content: bytes) -> Iterator[tuple[dict, bytes]]:
    """(headers, block) of each record, by declared lengths; repeated separators between records are skipped."""
    at, sep = 0, END.encode()
    while at < len(content):
        end = content.find(sep, at)
        if end < 0:
            return
        lines = content[at:end].decode("utf-8", "surrogateescape").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size, start = int(head["content-length"]), end + 4
        yield head, content[start:start + size]
        at = start + size + 4


def read_warc(spark, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, uri, date) of every record below ``path``."""
    import zlib

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                out = {k: [] for k in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "uri", "date")}
                for head, block in parse_warc(zlib.decompress(content.as_py(), wbits=47)):
                    http, _, payload = block.partition(END.encode()) if head["content-type"].startswith("application/http") else (b"", b"", block)
                    digest = base64.b32decode(head["warc-payload-digest"].partition(":")[2]).hex()
                    key = next((int(x[10:]) for x in http.split(b"\r\n") if x[:10].lower() == b"x-page-id:" and x[10:].strip()), None)
                    revisit = head["warc-type"] == "revisit"
                    if not revisit and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"record {head['warc-record-id']} doesn't have its digest")
                    row = (key, int(head["x-payload-length"]) if revisit else len(payload), digest, head["warc-type"],
                           int(head["x-refers-to-page"]) if revisit else None, head["warc-target-uri"], head["warc-date"])
                    for k, v in zip(out, row):
                        out[k].append(v)
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([
                    ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
                    ("refers_to", pa.int64()), ("uri", pa.string()), ("date", pa.string())]))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(parse, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, uri string, date string")


def round_trip(pages: DataFrame) -> DataFrame:
    """``pages`` written as WARC by way of ARC, and read back."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write_warc(arc_records(pages), path)
    return read_warc(spark, path)
