"""Derivatives of web archive responses: linked metadata records and plain-text conversion records.

From each response record (target URI, date, HTTP head and body) two records are derived. The metadata record carries
the response's HTTP status and headers (pairs, in order, repeats kept), the headers of its own record, title, links
and digests as JSON; the conversion record carries the page's plain text. Chunked, gzip and deflate bodies are decoded
first; a body in another encoding gives no text, and the metadata name that encoding. Both name the response they come from in WARC-Refers-To and keep its target URI and date; each has its own
record id and its block digest (SHA-1 in base 32, as archives write them), and the payload digest, address and payload
type of the response's record where it gives them; else the payload digest is of the body without its chunks.

Records can be read from and written to archive files: ``read_warc`` parses plain or gzip files that any Spark reader
reaches, ``responses_from`` makes its rows the input of ``build``, ``write_warc`` lays the records of each partition out as bytes (a record a gzip member).

Defined results: a null body is an empty one; a null URL gives an empty target URI; a null date stays out of the
header; rows that repeat an id give the same records again; other columns are ignored; an empty table gives an empty
result. Bodies are taken whole.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.pages import lines
from plumbline.session import ship

# The version line and line ending of the format, and the namespace of derived record ids.
VERSION = "WARC/1.0"
CRLF = b"\r\n"
IDS = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the namespace of URLs in RFC 4122
DERIVED = ("metadata", "conversion")

_TITLE = re.compile(r"<title\b[^>]*>(.*?)(?:</title\b|\Z)", re.I | re.S)
_LINK = re.compile(r"<(a|link|img|script|iframe)\b[^>]*?\b(?:href|src)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_META = re.compile(r"<meta\b[^>]*?\bname\s*=\s*[\"']?([\w:.-]+)[^>]*?\bcontent\s*=\s*[\"']([^\"']*)", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, uri: str, date: str | None, body_digest: str) -> str:
    """An id fixed by what the record holds, so that a task run again gives the same record."""
    return f"<urn:uuid:{uuid.uuid5(IDS, ' '.join((kind, uri, date or '', body_digest)))}>"


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and body of an HTTP response block."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        head, gap, body = block.partition(b"\n\n")
    rows = head.decode("utf-8", "replace").splitlines()
    if not rows or not rows[0].startswith("HTTP/"):
        return "", [], block
    pairs = [(a.strip(), b.strip()) for a, c, b in (r.partition(":") for r in rows[1:]) if c]
    return rows[0], pairs, body


def unchunk(body: bytes) -> bytes:
    """The body without chunk marks, as far as it goes; as it is, if it does not begin with a chunk."""
    out, at = [], 0
    while (end := body.find(b"\n", at)) >= 0:
        try:
            size = int(body[at:end].split(b";")[0].strip() or b"-1", 16)
        except ValueError:
            size = -1
        if size < 0:
            return b"".join(out) if out else body
        if not size:
            return b"".join(out)
        out.append(body[end + 1 : end + 1 + size])
        at = end + 1 + size
        at += 2 if body[at : at + 2] == b"\r\n" else body[at : at + 1] == b"\n"
    return b"".join(out) if out else body


def inflate(body: bytes, how: str) -> bytes:
    """A gzip or deflate body unpacked, as far as it goes; as it is, if archives stored it unpacked."""
    for window in (31,) if how.endswith("gzip") else (15, -15):
        out, rest = [], body
        try:
            while rest:
                z = zlib.decompressobj(window)
                out.append(z.decompress(rest))
                out.append(z.flush())
                rest = z.unused_data if window == 31 and z.unused_data[:2] == b"\x1f\x8b" else b""
        except zlib.error:
            pass
        if any(out):
            return b"".join(out)
    return body


def decoded(headers: list[tuple[str, str]], body: bytes) -> tuple[bytes, bytes | None, str]:
    """The body without its chunks, its content (None if it cannot be decoded), and the encoding that is left."""

    def steps(name: str) -> list[str]:
        return [x.strip().lower() for k, v in headers if k.lower() == name for x in v.split(",") if x.strip()]

    def undo(data: bytes, how: str) -> bytes | None:
        if how == "chunked":
            return unchunk(data)
        if how in ("gzip", "x-gzip", "deflate"):
            return inflate(data, how)
        return data if how in ("identity", "none") else None

    left = ""
    for name in ("transfer-encoding", "content-encoding"):
        content = body
        for how in reversed(steps(name)):
            if (data := undo(content, how)) is None:
                left = how
                break
            content = data
        if name == "transfer-encoding":
            body = content
        if left:
            return body, None, left
    return body, content, ""


def plain_text(page: str) -> str:
    """All text of a page, a line a block, without scripts and styles."""
    return "\n".join(t for _, t in lines(page))


def metadata(uri: str, status: str, headers: list[tuple[str, str]], page: str, payload: str, source: list[tuple[str, str]], left: str) -> dict:
    title = _TITLE.search(page)
    links = []
    for m in _LINK.finditer(page):
        to = html.unescape(m[2] or m[3] or m[4] or "").strip()
        try:
            to = urljoin(uri, to)
        except ValueError:
            pass
        links.append({"path": m[1].lower(), "url": to})
    return {
        "status": status,
        "headers": [list(h) for h in headers],
        "source-headers": [list(h) for h in source],
        "encoding-left": left,
        "payload-digest": payload,
        "title": " ".join(html.unescape(title[1]).split()) if title else "",
        "metas": {k.lower(): html.unescape(v) for k, v in _META.findall(page)},
        "links": links,
    }


#: Headers of the response's record that both derived records carry.
CARRIED = ("WARC-Payload-Digest", "WARC-IP-Address", "WARC-Identified-Payload-Type")


def derive(
    uri: str | None, date: str | None, block: bytes | None, response_id: str | None = None, source_headers: list[tuple[str, str]] | None = None
) -> list[dict]:
    """The two derived records of one response block; ``source_headers`` are those of its record."""
    uri, block = uri or "", block or b""
    status, headers, body = split_http(block)
    body, content, left = decoded(headers, body)
    given = {k.lower(): v for k, v in source_headers or ()}
    carried = {k: given[k.lower()] for k in CARRIED if k.lower() in given}
    payload = carried.get("WARC-Payload-Digest") or digest(body)
    source = response_id or record_id("response", uri, date, digest(block))
    charset = next((m[1] for k, v in headers if k.lower() == "content-type" and (m := re.search(r"charset=\"?([\w-]+)", v))), "utf-8")
    try:
        page = (content or b"").decode(charset, "replace")
    except LookupError:
        page = (content or b"").decode("utf-8", "replace")
    out = []
    for kind in DERIVED:
        if kind == "metadata":
            data = json.dumps(metadata(uri, status, headers, page, payload, source_headers or [], left), ensure_ascii=False, sort_keys=True).encode()
            mime = "application/json"
        else:
            data, mime = plain_text(page).encode(), "text/plain"
        mark = digest(data)
        head = {
            "WARC-Type": kind, "WARC-Record-ID": record_id(kind, uri, date, source + mark), "WARC-Target-URI": uri, "WARC-Date": date,
            "WARC-Refers-To": source, "WARC-Block-Digest": mark, **carried, "WARC-Payload-Digest": payload, "Content-Type": mime, "Content-Length": str(len(data)),
        }
        out.append({"kind": kind, "headers": {k: v for k, v in head.items() if v is not None}, "block": data, "refers_to": source})
    return out


def to_bytes(headers: dict[str, str], block: bytes) -> bytes:
    """A record as it stands in a file."""
    head = [VERSION, *(f"{k}: {v}" for k, v in headers.items())]
    return CRLF.join([*(h.encode() for h in head), b"", block, b"", b""])


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (of repeated ones the last) and block of every record of a file, plain or in gzip members."""
    return ((dict(pairs), block) for pairs, block in parse_pairs(data))


def parse_pairs(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """Header pairs and block of every record of a file, plain or in gzip members."""
    if data[:2] == b"\x1f\x8b":
        parts = []
        while data:
            z = zlib.decompressobj(31)
            parts.append(z.decompress(data) + z.flush())
            data = z.unused_data.lstrip(b"\0")
        data = b"".join(parts)
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        rows = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        head = [(k.strip(), v.strip()) for k, _, v in (r.partition(":") for r in rows)]
        size = next((int(v) for k, v in head if k.lower() == "content-length"), 0)
        yield head, data[end + 4 : end + 4 + size]
        at = end + 4 + size


SCHEMA = "page_id long, kind string, record_id string, refers_to string, target_uri string, date string, headers map<string,string>, block binary"


def build(responses: DataFrame) -> DataFrame:
    """Derived records (two a row) of ``responses`` (page_id, target_uri, date, block[, record_id, source_headers])."""
    ship(responses.sparkSession)
    cols = ["page_id", "target_uri", "date", "block"] + [c for c in ("record_id", "source_headers") if c in responses.columns]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                rows = []
                for r in batch.slice(k, 500).to_pylist():
                    source = [(h["name"], h["value"]) for h in r.get("source_headers") or ()]
                    for d in derive(r["target_uri"], r["date"], r["block"], r.get("record_id"), source):
                        h = d["headers"]
                        rows.append((r["page_id"], d["kind"], h["WARC-Record-ID"], d["refers_to"], h["WARC-Target-URI"], r["date"], list(h.items()), d["block"]))
                types = [pa.int64(), *[pa.string()] * 5, pa.map_(pa.string(), pa.string()), pa.binary()]
                names = ["page_id", "kind", "record_id", "refers_to", "target_uri", "date", "headers", "block"]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(types)], names)

    return responses.select(F.col("page_id").cast("long").alias("page_id"), *cols[1:]).mapInArrow(kernel, SCHEMA)


def responses_of(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Pages (page_id, url, html) as response records with an HTTP head."""
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length(F.coalesce("html", F.lit(""))).cast("string"), F.lit("\r\n\r\n"),
    )
    return pages.select(
        "page_id", F.coalesce("url", F.lit("")).alias("target_uri"), F.lit(date).alias("date"),
        F.concat(F.encode(head, "UTF-8"), F.encode(F.coalesce("html", F.lit("")), "UTF-8")).alias("block"),
    )


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(path, headers, pairs, block) of every record of the archive files at ``path``; a file is one task's work."""
    ship(spark)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for head, block in parse_pairs(data):
                    pairs = pa.array([[{"name": k, "value": v} for k, v in head]], pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())])))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([p]), pa.array([list(dict(head).items())], pa.map_(pa.string(), pa.string())), pairs, pa.array([block], pa.binary())],
                        ["path", "headers", "pairs", "block"],
                    )

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(kernel, "path string, headers map<string,string>, pairs array<struct<name:string,value:string>>, block binary")


def responses_from(records: DataFrame) -> DataFrame:
    """The response records among the rows of :func:`read_warc` as input of :func:`build`; page_id is a hash of the record's id."""

    def first(name: str):
        return F.filter("pairs", lambda h: F.lower(h["name"]) == name.lower())[0]["value"]

    rows = records.select("block", F.col("pairs").alias("source_headers"), *(first(n).alias(a) for n, a in (
        ("WARC-Type", "type"), ("WARC-Target-URI", "uri"), ("WARC-Date", "date"), ("WARC-Record-ID", "record_id"))))
    uri = F.regexp_replace("uri", "^<(.*)>$", "$1").alias("target_uri")
    return rows.where("type = 'response'").select(F.xxhash64("record_id").alias("page_id"), uri, "date", "block", "record_id", "source_headers")


def write_warc(records: DataFrame) -> DataFrame:
    """(record_id, bytes): each record of (headers, block) as a gzip member; members end to end make a file."""
    ship(records.sparkSession)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, data = [], []
            for head, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                head = dict(head)
                ids.append(head.get("WARC-Record-ID"))
                data.append(gzip.compress(to_bytes(head, block or b""), mtime=0))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(data, pa.binary())], ["record_id", "bytes"])

    return records.select("headers", "block").mapInArrow(kernel, "record_id string, bytes binary")
