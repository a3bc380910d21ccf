import base64
import gzip
import hashlib

import pytest

from silkloom.llm import warc

PAGES = "page_id long, url string, html string, extra string"


def captured(spark, rows, path):
    warc.write(spark.createDataFrame(rows, PAGES), path)
    return {r.record_id: r for r in warc.assemble(warc.read(spark, path)).collect()}, warc.read(spark, path)


def test_round_trip(spark, tmp_path):
    big = "x" * 1500
    odd = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n\r\n\r\n\rtail\r\n"
    rows = [(1, "http://a/b?c#d", odd, "e"), (2, None, None, None), (3, "http://x\r\nEvil: 1", big, None), (9, "u", big, None), (5, "", big, None), (6, "http://s", "small", None), (7, "http://s", "small", None), (None, "http://n", "né", None), (9, "u", big, None), (4, "http://l", "ä\r\n" * 300_000, None)]
    got, records = captured(spark, rows, str(tmp_path / "w"))
    all_rows = warc.assemble(records).collect()
    assert len(all_rows) == len(rows)
    seen = {}
    for r in all_rows:
        fields = {f.name: f.value for f in r.metadata.fields}
        page = int(fields["page-id"]) if "page-id" in fields else None
        seen.setdefault(page, []).append(r)
        assert r.n_requests >= 1 and r.request.record_type == "request"
    for page, _, html, _ in rows:
        payload = (html or "").encode()
        for r in seen[page]:
            assert r.response.payload_bytes == len(payload) and r.response.payload_digest == hashlib.sha1(payload).hexdigest()
            if page in (3, 5):
                assert r.response.record_type == "revisit" and r.response.refers_to.startswith("<urn:page:9:") and bytes(r.response.payload) == b""
            else:
                assert r.response.record_type == "response" and bytes(r.response.payload) == payload
    assert warc.orphans(records).count() == 0


def test_empty(spark, tmp_path):
    warc.write(spark.createDataFrame([], PAGES), str(tmp_path / "w"))
    assert warc.read(spark, str(tmp_path / "w")).count() == 0


def foreign(*records):
    out = b""
    for headers, block in records:
        head = "".join(f"{k}: {v}\r\n" for k, v in headers)
        out += gzip.compress(f"WARC/1.0\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n")
    return out


def test_foreign_archive(spark, tmp_path):
    body = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n\xff\xfe binary"
    digest = "sha1:" + base64.b32encode(hashlib.sha1(b"\xff\xfe binary").digest()).decode()
    http = ("Content-Type", "application/http; msgtype=response")
    (tmp_path / "f.warc.gz").write_bytes(foreign(
        ([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<i>"), ("Content-Type", "application/warc-fields")], b"software: t\r\n"),
        ([("WARC-Type", "response"), ("WARC-Record-ID", "<r>"), ("WARC-Concurrent-To", "<q>"), ("WARC-Payload-Digest", digest), http], body),
        ([("WARC-Type", "request"), ("WARC-Record-ID", "<q>"), http], b"GET / HTTP/1.1\r\n\r\n"),
        ([("WARC-Type", "metadata"), ("WARC-Record-ID", "<m>"), ("WARC-Concurrent-To", "<r>")], b"text"),
        ([("WARC-Type", "metadata"), ("WARC-Record-ID", "<o>")], b"alone"),
    ))
    records = warc.read(spark, str(tmp_path / "f.warc.gz"))
    row = warc.assemble(records).first()
    assert bytes(row.response.payload) == b"\xff\xfe binary" and row.request.record_id == "<q>" and row.metadata.record_id == "<m>"
    assert [r.record_id for r in warc.orphans(records).collect()] == ["<o>"]
    (tmp_path / "bad.warc.gz").write_bytes(gzip.compress(b"WARC/1.0\r\nContent-Length: 99\r\n\r\nshort"))
    with pytest.raises(Exception, match="ends within"):
        warc.read(spark, str(tmp_path / "bad.warc.gz")).collect()
