import base64
import gzip
import hashlib
import io

import pytest

from legajo.llm import warc

SCHEMA = "page_id long, url string, html string"
TRICKY = "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nhttp://x/ 1.2.3.4 20200101000000 text/html 5\nHello"


def brute(rows, least=0):
    best = {}
    for i, _, h in rows:
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        first = len(data) < least or best[h or ""] == (-1 if i is None else i)
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first else "revisit", None if first else best[h or ""]))
    return sorted(out, key=str)


ROWS = [
    (1, "http://a.example/x", "<p>same</p>"), (5, "http://b.example/ y\nz", "<p>same</p>"), (3, None, "<p>same</p>"), (2, "http://c/", None), (4, "http://d/", ""),
    (7, "http://e/", TRICKY), (6, "http://e/2", TRICKY), (8, "ü", "é漢 " * 90_000), (9, "http://f/", "\x00\r\n"), (None, "http://g/", "no id"), (None, "http://h/", "<p>same</p>"),
]


@pytest.mark.parametrize("least", [0, 12])
def test_round_trip(spark, least):
    pages = spark.createDataFrame([(*r, "x") for r in ROWS], SCHEMA + ", record_id string")
    path = warc.archived(warc.pages_as_arcs(pages), least)
    got = sorted((tuple(r) for r in warc.captures(warc.read_warc(spark, path)).collect()), key=str)
    assert got == brute(ROWS, least)


def test_payloads_and_identity(spark):
    arcs = warc.pages_as_arcs(spark.createDataFrame(ROWS, SCHEMA))
    out = warc.read_warc(spark, warc.archived(arcs), with_payload=True).collect()
    html = {i: (h or "").encode() for i, _, h in ROWS}
    for r in out:
        if r.record_type == "response" and r.key is not None:
            assert r.payload == html[r.key] and r.record_id.startswith("<urn:uuid:") and r.date == "2020-01-01T00:00:00Z"
    assert len({r.record_id for r in out if r.record_type != "warcinfo"}) == len(ROWS)
    again = {r.record_id for r in warc.convert(arcs).collect() if r.kind == "response"}
    assert again == {r.record_id for r in out if r.record_type != "warcinfo"}


def arc(version, records):
    data = warc.arc_head(version, "old.arc", "19970304050607")
    for url, date, kind, block in records:
        data += warc.arc_line(version, url, "10.0.0.1", date, kind, len(block), "old.arc", len(data)) + block + b"\n"
    return data


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("packed", [False, True])
def test_legacy_files(spark, tmp_path, version, packed):
    http = b"HTTP/1.0 200 OK\nServer: old\n\n\xff\xfe body \n\n more"
    data = arc(version, [("http://x/with blank", "19970304", "text/html", http), ("dns:x.example", "1997", "text/dns", b"20 IN A 1.2.3.4"), ("ftp://x/f", "", "text/plain", b"")])
    (tmp_path / "old.arc").write_bytes(gzip.compress(data) if packed else data)
    files = spark.read.format("binaryFile").load(str(tmp_path / "old.arc"))
    out = {r.uri: r for r in warc.convert(files).collect()}
    page, dns, ftp, info = out["http://x/with blank"], out["dns:x.example"], out["ftp://x/f"], out["filedesc://old.arc"]
    assert (page.kind, page.date, bytes(page.http) + bytes(page.payload)) == ("response", "1997-03-04T00:00:00Z", http)
    assert page.payload_digest == base64.b32encode(hashlib.sha1(b"\xff\xfe body \n\n more").digest()).decode()
    assert (dns.kind, dns.content_type, dns.date) == ("resource", "text/dns", "1997-01-01T00:00:00Z")
    assert (ftp.kind, ftp.payload_bytes, ftp.date, info.kind) == ("resource", 0, "1970-01-01T00:00:00Z", "warcinfo")
    back = {r.uri: r for r in warc.read_warc(spark, warc.archived(files), with_payload=True).collect()}
    assert bytes(back["http://x/with blank"].payload) == b"\xff\xfe body \n\n more"
    assert bytes(back["dns:x.example"].payload) == b"20 IN A 1.2.3.4"


@pytest.mark.parametrize("data", [arc(1, [("http://x/", "1999", "text/html", b"12345")])[:-4], warc.arc_head(1, "a", "1999") + b"not a header\n", warc.arc_head(2, "a", "1999") + b"http://x/ 1.1.1.1 1999 text/html 0\n"])
def test_broken_files(data):
    with pytest.raises(ValueError):
        list(warc.read_arc(io.BytesIO(data)))


def test_dates():
    assert warc.warc_date("20010203040506") == "2001-02-03T04:05:06Z"
    assert warc.warc_date("200102030405") == "2001-02-03T04:05:00Z"
    assert warc.warc_date("junk") == "1970-01-01T00:00:00Z"


def test_empty(spark):
    path = warc.archived(warc.pages_as_arcs(spark.createDataFrame([], SCHEMA)))
    assert warc.captures(warc.read_warc(spark, path)).collect() == []
