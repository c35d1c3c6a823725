"""Legacy web archives: ARC files of versions 1 and 2 to WARC 1.1, with revisits for repeated payloads."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from legajo.llm.common import checked, map_arrow
from legajo.session import new_path

# Fixed values of the two formats: fields of a header line by version, and what WARC 1.1 names.
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Between two records; also what the text writer puts after each value.
RECORD_END = "\r\n\r\n"
#: Size at which a new ARC file is begun.
ARC_BYTES = 8 << 20
#: Bytes of records that leave a task at once.
STEP = 4 << 20


class ArcRecord(NamedTuple):
    fields: dict[str, str]
    block: bytes


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def arc_line(version: int, url: str, ip: str, date: str, kind: str, length: int, name: str = "-", offset: int = 0, code: str = "200") -> bytes:
    values = {1: (url, ip, date, kind, length), 2: (url, ip, date, kind, code, "-", "-", offset, name, length)}[version]
    return " ".join(map(str, values)).encode() + b"\n"


def arc_head(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 legajo\n{' '.join(FIELDS[version])}\n".encode()
    return arc_line(version, f"filedesc://{name}", "0.0.0.0", date, "text/plain", len(body), name) + body + b"\n"


def read_arc(stream: BinaryIO) -> Iterator[ArcRecord]:
    """Records of an ARC file, its version block first. Header lines are read from the right by the fields that the
    version block declares, so a URL may hold blanks; blocks by their declared length, whatever they hold. A file
    that ends within a record, or whose header line does not fit, raises ``ValueError``."""
    names: tuple[str, ...] = ()
    while line := stream.readline():
        if not line.strip():
            continue
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        version_block = not names
        if version_block:
            parts = text.rsplit(" ", 4)
            size = int(parts[-1])
        else:
            parts = text.rsplit(" ", len(names) - 1)
            if len(parts) != len(names) or not parts[-1].isdigit():
                raise ValueError(f"not an ARC header line: {text[:200]}")
            size = int(parts[-1])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError(f"ARC file ends within a record of {size} bytes: {text[:200]}")
        if version_block:
            lines = block.decode("utf-8", "replace").split("\n")
            version = int(lines[0].split(" ", 1)[0])
            names = tuple(lines[1].split()) if len(lines) > 1 and lines[1].strip() else FIELDS[version]
            parts = text.rsplit(" ", len(FIELDS[version]) - 1)
            yield ArcRecord(dict(zip(FIELDS[version], parts, strict=True)), block)
        else:
            yield ArcRecord(dict(zip(names, parts, strict=True)), block)


def warc_date(arc: str) -> str:
    """``YYYYMMDDhhmmss``, or the beginning of it, in ISO 8601; without a year the epoch."""
    d = "".join(c for c in arc if c in "0123456789")[:14]
    if len(d) < 4:
        return "1970-01-01T00:00:00Z"
    d += "00000101000000"[len(d) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """Header with the blank line, and body."""
    for mark in (b"\r\n\r\n", b"\n\n"):
        if (at := block.find(mark)) >= 0:
            return block[: at + len(mark)], block[at + len(mark) :]
    return block, b""


def http_value(head: bytes, name: str) -> str | None:
    for line in head.decode("latin-1").splitlines()[1:]:
        key, _, value = line.partition(":")
        if key.strip().lower() == name.lower():
            return value.strip()
    return None


class Converted(NamedTuple):
    record_id: str
    kind: str
    date: str
    uri: str
    ip: str
    content_type: str
    payload_digest: str
    payload_bytes: int
    key: int | None
    http: bytes
    payload: bytes


def converted(record: ArcRecord, key_field: str) -> Converted:
    """The WARC identity of an ARC record. Its id is a name-based UUID of URL, date, key and payload digest, so a
    second conversion gives the same. ``key``: a whole number in the HTTP header field ``key_field``."""
    f = record.fields
    url, head, payload, key = f["URL"], b"", record.block, None
    if url.startswith("filedesc:"):
        kind, content = "warcinfo", "text/plain"
    elif record.block.startswith(b"HTTP/"):
        kind, content = "response", "application/http;msgtype=response"
        head, payload = http_parts(record.block)
        value = http_value(head, key_field)
        key = int(value) if value and value.lstrip("-").isdigit() else None
    else:
        kind, content = "resource", "text/dns" if url.startswith("dns:") else f["Content-type"]
    mark, date = digest(payload), warc_date(f["Archive-date"])
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{url} {date} {key} {mark}")
    return Converted(f"<urn:uuid:{name}>", kind, date, url, f["IP-address"], content, mark, len(payload), key, head, payload)


RECORDS = (
    "record_id string, kind string, date string, uri string, ip string, content_type string, payload_digest string, "
    "payload_bytes long, key long"
)
BLOCK = ", http binary, payload binary"
TYPES = {"payload_bytes": pa.int64(), "key": pa.int64(), "http": pa.binary(), "payload": pa.binary()}


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, TYPES.get(n, pa.string())) for n, c in zip(names, columns, strict=True)], names)


def opened(content: bytes) -> BinaryIO:
    raw = io.BytesIO(content)
    return gzip.GzipFile(fileobj=raw) if content[:2] == b"\x1f\x8b" else raw


def convert(arcs: DataFrame, key_field: str = "X-Page-Id", with_blocks: bool = True) -> DataFrame:
    """WARC records of ARC files: ``RECORDS``, and with ``with_blocks`` the HTTP header and payload of each.

    ``arcs`` has ``content``, as the source ``binaryFile`` reads files (plain or gzip); null content has no records.
    """
    checked(arcs, "content")
    names = [c.split()[0] for c in (RECORDS + BLOCK * with_blocks).split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows, size = [], 0
                for r in read_arc(opened(content.as_py() or b"")):
                    c = converted(r, key_field)
                    rows.append(c if with_blocks else c[:9])
                    size += len(r.block)
                    if size >= STEP:
                        yield _batch(rows, names)
                        rows, size = [], 0
                yield _batch(rows, names)

    return map_arrow(arcs.select("content"), RECORDS + BLOCK * with_blocks, work)


def pages_as_arcs(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "20200101000000") -> DataFrame:
    """``path, content``: ARC files, of version 1 and 2 by turns, of the pages; each the capture of an HTTP response.

    Null html is an empty payload, a null URL ``urn:page:<id>``; the page's id goes into the HTTP header.
    """
    checked(pages, id_col, url_col, html_col)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for b in batches:
            data = io.BytesIO()
            for i in range(b.num_rows):
                key, url, html = (b.column(c)[i].as_py() for c in range(3))
                version, name = 1 + number % 2, f"pages-{number}.arc"
                if not data.tell():
                    data.write(arc_head(version, name, date))
                body = (html or "").encode("utf-8", "surrogatepass")
                mark = f"X-Page-Id: {key}\r\n" if key is not None else ""
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{mark}Content-Length: {len(body)}\r\n\r\n".encode()
                target = "%20".join((url or f"urn:page:{key}").split())
                data.write(arc_line(version, target, "0.0.0.0", date, "text/html", len(head) + len(body), name, data.tell()))
                data.writelines((head, body, b"\n"))
                if data.tell() >= ARC_BYTES or i == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([data.getvalue()], pa.binary())], ["path", "content"])
                    data, number = io.BytesIO(), number + 1

    return map_arrow(rows, "path string, content binary", work)


def with_revisits(records: DataFrame, narrow: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``records`` with ``first_id`` and ``first_key``: of responses with equal payloads (digest and length) of at
    least ``min_bytes``, the one with the largest key, which the others revisit; null for all that stands alone.

    ``narrow``: the same records without blocks. Groups of one stay out of the join; a payload that a third of the
    records share is one row after the grouping, and its records a key that Spark splits.
    """
    like = narrow.where((F.col("kind") == "response") & (F.col("payload_bytes") >= min_bytes))
    first = F.max(F.struct("key", "record_id"))
    groups = like.groupBy("payload_digest", "payload_bytes").agg(first.alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = groups.select(
        F.lit("response").alias("kind"), "payload_digest", "payload_bytes", F.col("first.key").alias("first_key"), F.col("first.record_id").alias("first_id")
    )
    return records.join(groups, ["kind", "payload_digest", "payload_bytes"], "left")


def record_bytes(r: dict) -> bytes:
    """A WARC record without the blank lines that end it."""
    revisit = r["first_id"] is not None and r["first_id"] != r["record_id"]
    block = r["http"] if revisit else r["http"] + r["payload"]
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else r['kind']}", f"WARC-Record-ID: {r['record_id']}", f"WARC-Date: {r['date']}",
        f"WARC-Target-URI: {r['uri']}" if r["kind"] != "warcinfo" else f"WARC-Filename: {r['uri'].removeprefix('filedesc://')}",
    ]
    if r["kind"] != "warcinfo":
        head += [f"WARC-IP-Address: {r['ip']}", f"WARC-Payload-Digest: sha1:{r['payload_digest']}"]
    if revisit:
        head += [f"WARC-Profile: {SAME_PAYLOAD}", f"WARC-Refers-To: {r['first_id']}", f"X-Payload-Length: {r['payload_bytes']}"]
    head += [f"WARC-Block-Digest: sha1:{digest(block)}", f"Content-Type: {r['content_type']}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block


def write_warc(records: DataFrame, path: str, max_records: int = 20_000) -> None:
    """Write the output of ``with_revisits`` as gzipped WARC files of at most ``max_records`` records in ``path``.

    Spark's text writer puts the two line ends that close a record after each value; bytes pass through unchanged.
    """
    names = [*(c.split()[0] for c in (RECORDS + BLOCK).split(", ")), "first_id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, size = [], 0
            for i in range(b.num_rows):
                out.append(record_bytes({n: b.column(k)[i].as_py() for k, n in enumerate(names)}))
                size += len(out[-1])
                if size >= STEP or i == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                    out, size = [], 0

    lines = map_arrow(records.select(*names), "value binary", work).select(F.col("value").cast("string").alias("value"))
    lines.write.option("lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", max_records).text(path)


def warc_records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record, by declared lengths."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:80]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError(f"WARC file ends within a record of {size} bytes")
        yield fields, block


READ = "record_id string, record_type string, date string, uri string, refers_to_id string, key long, payload_bytes long, payload_digest string"


def read_warc(spark: SparkSession, path: str, key_field: str = "X-Page-Id", with_payload: bool = False) -> DataFrame:
    """Records of the WARC files in ``path``: ``READ`` and, with ``with_payload``, ``payload``.

    Size and digest are those of the full payload: taken from it where it is there, and for a revisit from the
    header of the record (of the HTTP response, where it names no length). A payload whose digest is not the declared one raises.
    """
    names = [c.split()[0] for c in READ.split(", ")] + ["payload"] * with_payload

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows, size = [], 0
                for f, block in warc_records(opened(content.as_py())):
                    kind, http = f["warc-type"], f.get("content-type", "").startswith("application/http")
                    head, payload = http_parts(block) if http else (b"", block)
                    declared = f.get("warc-payload-digest", "").removeprefix("sha1:")
                    key = http_value(head, key_field) if http else None
                    if kind == "revisit":
                        length, mark = int(f.get("x-payload-length") or http_value(head, "Content-Length") or 0), declared
                    else:
                        length, mark = len(payload), digest(payload)
                        if declared and mark != declared:
                            raise ValueError(f"payload of {f['warc-record-id']} has digest {mark}, not {declared}")
                    row = (f["warc-record-id"], kind, f["warc-date"], f.get("warc-target-uri"), f.get("warc-refers-to"), int(key) if key else None, length, mark)
                    rows.append((*row, payload) if with_payload else row)
                    size += len(block)
                    if size >= STEP:
                        yield _batch(rows, names)
                        rows, size = [], 0
                yield _batch(rows, names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return map_arrow(files, READ + ", payload binary" * with_payload, work)


def archived(arcs: DataFrame, min_bytes: int = 0, name: str = "warc") -> str:
    """Convert ``arcs`` and write them, with revisits, to a new folder of the shared one; its path."""
    path = new_path(arcs.sparkSession, name)
    write_warc(with_revisits(convert(arcs), convert(arcs, with_blocks=False), min_bytes), path)
    return path


def captures(records: DataFrame) -> DataFrame:
    """``key, payload_bytes, payload_digest, record_type, refers_to`` of responses and revisits read back; what a
    revisit refers to is found by record id."""
    own = records.where(F.col("record_type").isin("response", "revisit"))
    first = own.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to_id")).agg(F.max("key").alias("refers_to"))
    return own.join(first, "refers_to_id", "left").select("key", "payload_bytes", "payload_digest", "record_type", "refers_to")
