"""WARC archives: writing captures, reading records, and assembling transactions.

Archives are written by Spark's text writer, one gzip file a task, so they can lie in any store that Spark reaches.
Records end in CRLF CRLF, which is also the reader's line separator: pieces between separators reach a Python task in
file order, and records are framed by their Content-Length alone, so payloads may hold anything. A task holds one
record at a time.

A capture is a response (or revisit) with the request and metadata records that name it, or that it names, as
concurrent. Only ids and header fields take part in the joins; payloads stay with their response.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, stored, table

CRLF, SEPARATOR = "\r\n", "\r\n\r\n"
PRIMARY = ("response", "revisit")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Equal payloads from this size on are stored once.
REVISIT_BYTES = 1000
DATE = "2026-01-01T00:00:00Z"

RECORD_SCHEMA = (
    "file string, record_id string, record_type string, concurrent_to array<string>, refers_to string, target_uri string, "
    "date string, payload_bytes long, payload_digest string, fields map<string,string>, payload binary"
)


def duplicates(pages: DataFrame, at_least: int = REVISIT_BYTES) -> DataFrame:
    """pages (page_id, url, html) with payload, digest (hex SHA-1) and ``keeper``: the page that holds an equal payload, if it is another.

    Of equal payloads of ``at_least`` bytes the largest page_id keeps it. Only (digest, page_id) is aggregated; the
    side that carries payloads is the streamed side of a hash join on the digest, whose other side has one row per
    repeated payload, so a payload that a third of the pages share is split among tasks.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    of = rows.filter(F.octet_length("payload") >= at_least).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
    of = of.filter(F.col("n") > 1).select(F.col("digest").alias("_d"), "keeper")
    big = F.octet_length("payload") >= at_least
    out = rows.join(of.hint("shuffle_hash"), F.col("digest") == F.col("_d"), "left").drop("_d")
    return out.withColumn("keeper", F.when(big & ~F.col("keeper").eqNullSafe(F.col("page_id")), F.col("keeper")))


def _record(fields: list[tuple[str, Column | str]], block: Column) -> Column:
    """A record's text without its last separator. Null fields are left out; line ends in values are percent-encoded."""
    named = []
    for name, value in fields:
        value = F.lit(value) if isinstance(value, str) else F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
        named.append(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)))
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))
    return F.concat(F.lit(f"WARC/1.1{CRLF}"), F.concat_ws("", *named), length, F.lit(SEPARATOR), block)


def captures_text(rows: DataFrame, date: str = DATE) -> DataFrame:
    """One row ``value`` for each row of duplicates(): its request, response or revisit, and metadata records.

    A record's id names page and payload (urn:page:<page_id>:<digest>), so rows that repeat both are alike.
    """
    ident = lambda page: F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), F.col("digest"))
    own = F.concat(ident(F.col("page_id")), F.lit(">"))
    other = lambda kind: F.concat(ident(F.col("page_id")), F.lit(f":{kind}>"))
    uri, revisit = F.when(F.col("url") != "", F.col("url")), F.col("keeper").isNotNull()
    common = [("WARC-Target-URI", uri), ("WARC-Date", date)]
    host = F.coalesce(F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#\r\n]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]*([^#\r\n]*)", 1), F.lit(""))
    ask = F.concat(F.lit("GET "), F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)), F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(SEPARATOR))
    request = _record([("WARC-Type", "request"), ("WARC-Record-ID", other("request")), ("WARC-Concurrent-To", own), *common, ("Content-Type", "application/http; msgtype=request")], ask)
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length("payload").cast("string"), F.lit(SEPARATOR))
    response = _record(
        [
            ("WARC-Type", F.when(revisit, "revisit").otherwise("response")), ("WARC-Record-ID", own), *common,
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), ("WARC-Profile", F.when(revisit, PROFILE)),
            ("WARC-Refers-To", F.when(revisit, F.concat(ident(F.col("keeper")), F.lit(">")))), ("Content-Type", "application/http; msgtype=response"),
        ],
        F.concat(head, F.when(revisit, F.lit("")).otherwise(F.col("payload"))),
    )
    about = F.concat_ws("", F.lit(f"via: page table{CRLF}"), F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit(CRLF)))
    metadata = _record([("WARC-Type", "metadata"), ("WARC-Record-ID", other("metadata")), ("WARC-Concurrent-To", own), *common, ("Content-Type", "application/warc-fields")], about)
    return rows.select(F.concat_ws(SEPARATOR, request, response, metadata).alias("value"))


def write(pages: DataFrame, path: str) -> None:
    """Writes pages (page_id, url, html) as gzip archives into the folder path.

    Null html is an empty payload; a null url leaves the target out, a null page_id the page-id field. Every row is
    written, repeated rows too. Other columns are ignored; an empty table gives archives without records. A payload of any length is one record,
    as long as it fits a row of Spark's.
    """
    captures_text(duplicates(pages)).write.option("compression", "gzip").option("lineSep", SEPARATOR).text(path)


class Framer:
    """Cuts a stream of bytes into records (headers, block)."""

    def __init__(self):
        self.buffer, self.headers, self.start, self.need = bytearray(), None, 0, 0

    def feed(self, data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
        self.buffer += data
        while True:
            if self.headers is None:
                if self.buffer[:1] in (b"\r", b"\n"):  # blank lines between records
                    self.buffer = self.buffer.lstrip(b"\r\n")
                end = self.buffer.find(b"\r\n\r\n")
                if end < 0:
                    return
                first, *lines = bytes(self.buffer[:end]).decode("utf-8", "replace").split(CRLF)
                if not first.startswith("WARC/"):
                    raise ValueError(f"not a record: {first[:60]!r}")
                self.headers = [(k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines)]
                self.start = end + 4
                self.need = self.start + int(dict(self.headers).get("content-length", 0))
            if len(self.buffer) < self.need + 4:
                return
            yield self.headers, bytes(self.buffer[self.start : self.need])
            del self.buffer[: self.need + 4]
            self.headers = None

    def end(self) -> None:
        if self.buffer.strip():
            raise ValueError("the archive ends within a record")


def _hex(digest: str | None) -> str | None:
    """The hexadecimal form of a labelled SHA-1 digest, which may be in base 32."""
    value = (digest or "").partition(":")[2]
    return base64.b32decode(value.upper()).hex() if len(value) == 32 else value.lower() or None


def _row(file: str, headers: list[tuple[str, str]], block: bytes, payloads: bool) -> dict:
    h = dict(headers)
    kind, content = h.get("warc-type"), h.get("content-type", "")
    head, http = b"", "application/http" in content
    if http:
        head, _, block = block.partition(b"\r\n\r\n")
    fields = {}
    for line in (head if http else block if "warc-fields" in content else b"").decode("utf-8", "replace").split(CRLF):
        k, sep, v = line.partition(":")
        if sep:
            fields[k.strip().lower()] = v.strip()
    size, digest = len(block), hashlib.sha1(block).hexdigest()
    if kind == "revisit":  # the payload is elsewhere: its size and digest are those of the headers
        size, digest = int(fields["content-length"]) if fields.get("content-length", "").isdigit() else None, _hex(h.get("warc-payload-digest"))
    elif kind == "response" and h.get("warc-payload-digest") and _hex(h["warc-payload-digest"]) != digest:
        raise ValueError(f"{file}: the payload of {h.get('warc-record-id')} does not have its digest")
    return {
        "file": file, "record_id": h.get("warc-record-id"), "record_type": kind, "concurrent_to": [v for k, v in headers if k == "warc-concurrent-to"],
        "refers_to": h.get("warc-refers-to"), "target_uri": h.get("warc-target-uri"), "date": h.get("warc-date"),
        "payload_bytes": size, "payload_digest": digest, "fields": list(fields.items()), "payload": block if payloads else None,
    }


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of gzip archives (one row each, RECORD_SCHEMA); without payloads, only their sizes and digests.

    Of HTTP records, ``payload`` is the body and ``fields`` the HTTP header; of warc-fields records, ``fields`` is the
    block. A response whose payload does not have the digest it states, or a broken archive, raises an error. Gzip
    files are not split, so a task sees each of its archives from the start.
    """
    schema = pa.schema([
        ("file", pa.string()), ("record_id", pa.string()), ("record_type", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()),
        ("target_uri", pa.string()), ("date", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()),
    ])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, framer, out, held = None, Framer(), [], 0
        for batch in batches:
            for file, piece in zip(batch.column(0).to_pylist(), batch.column(1)):
                if file != at:
                    framer.end()
                    at, framer = file, Framer()
                for headers, block in framer.feed(piece.as_py() + b"\r\n\r\n"):
                    out.append(_row(file, headers, block, payloads))
                    held += len(block) if payloads else 500
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, held = [], 0
        framer.end()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    pieces = spark.read.option("lineSep", SEPARATOR).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece"))
    return pieces.mapInArrow(records, RECORD_SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: record_id, ``response`` (struct, a response or revisit), ``request`` and ``metadata`` (structs or null), n_requests, n_metadata.

    A request or metadata record belongs to the capture that it names as concurrent; to the one that names it; or to
    that of the request that it names. Of several, the one with the smallest record id is shown and all are counted,
    so no group is gathered. Records without a capture are left to ``orphans``. Rows that repeat a response each give
    a capture.
    """
    captures = records.filter(F.col("record_type").isin(*PRIMARY))
    side = _linked(records).groupBy("capture_id").agg(
        *[F.min(F.when(F.col("record_type") == kind, F.col("it"))).alias(kind) for kind in ("request", "metadata")],
        F.count(F.when(F.col("record_type") == "request", 1)).alias("n_requests"), F.count(F.when(F.col("record_type") == "metadata", 1)).alias("n_metadata"),
    )
    joined = captures.join(side, captures.record_id == side.capture_id, "left")
    return joined.select(
        "record_id", F.struct(*[captures[c] for c in captures.columns]).alias("response"), "request", "metadata",
        F.coalesce("n_requests", F.lit(0)).alias("n_requests"), F.coalesce("n_metadata", F.lit(0)).alias("n_metadata"),
    )


def _linked(records: DataFrame) -> DataFrame:
    """Request and metadata records (``it``, struct that can be compared) with the id of the record that they belong to."""
    rest = records.filter(F.col("record_type").isin("request", "metadata"))
    entries = F.transform(F.array_sort(F.map_keys("fields")), lambda k: F.struct(k.alias("name"), F.element_at(F.col("fields"), k).alias("value")))
    it = F.struct("record_id", "record_type", "target_uri", "date", "payload_bytes", "payload_digest", "fields")
    rest = rest.withColumn("fields", entries).select("record_id", "record_type", it.alias("it"), F.explode_outer("concurrent_to").alias("names"))
    named_by = records.filter(F.col("record_type").isin(*PRIMARY)).select(F.explode("concurrent_to").alias("_named"), F.col("record_id").alias("_by")).distinct()
    of_request = rest.filter((F.col("record_type") == "request") & F.col("names").isNotNull()).select(F.col("record_id").alias("_request"), F.col("names").alias("_of")).distinct()
    out = rest.join(named_by, rest.record_id == named_by._named, "left").join(of_request, rest.names == of_request._request, "left")
    return out.select(F.coalesce("_by", "_of", "names").alias("capture_id"), "record_type", "it").filter("capture_id is not null")


def orphans(records: DataFrame) -> DataFrame:
    """Request and metadata records that no capture claims."""
    captures = records.filter(F.col("record_type").isin(*PRIMARY)).select(F.col("record_id").alias("_c"))
    linked = _linked(records)
    claimed = linked.join(captures, linked.capture_id == captures._c, "left_semi").select(F.col("it.record_id").alias("_r"))
    rest = records.filter(F.col("record_type").isin("request", "metadata"))
    return rest.join(claimed, rest.record_id == claimed._r, "left_anti")


def op1_warc_transactions(spark, sf_dir):
    path = scratch(spark, "warc")
    write(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    captures = assemble(stored(read(spark, path, payloads=False), "records"))  # archives are parsed once
    field = F.element_at(F.filter("metadata.fields", lambda f: f["name"] == "page-id"), 1)["value"]
    return captures.select(
        F.when(F.size(F.filter("metadata.fields", lambda f: f["name"] == "page-id")) > 0, field.cast("long")).alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"), F.col("response.record_type").alias("record_type"),
        F.regexp_extract("response.refers_to", r"^<urn:page:(-?\d+):", 1).cast("long").alias("refers_to"), F.col("response.target_uri").alias("url"),
    )


QUERIES = {"op1_warc_transactions": op1_warc_transactions}

ORACLE_SQL = {
    "op1_warc_transactions": """
WITH p AS (SELECT page_id, url, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS keeper FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN keeper <> page_id THEN keeper END AS refers_to, url
FROM k
"""
}
