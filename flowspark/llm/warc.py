"""WARC derivatives (operator 2): from responses, linked metadata and plain-text conversion records.

Every response gives two records: ``metadata`` (application/warc-fields: the source's HTTP status line and headers, the
page's title, language and outgoing links) and ``conversion`` (text/plain: what a reader sees). Both carry
WARC-Refers-To with the response's identifier, its WARC-Target-URI and WARC-Date, the digest of the response's
payload, and a digest of their own block. Identifiers are name-based, from the type and the source's identifier and
payload digest, so a rerun gives the same records.

All is done row by row, in map tasks: nothing is shuffled, and a row's memory is bounded by its own page.

Defined results: a null payload is an empty one; a null target URI or date leaves its header out; repeated responses
give repeated records with equal identifiers; broken markup is read up to its end; an empty table gives an empty
result; of the input only the named columns are read. A source record's own headers, where the column source_headers has
them (read() gives it, with its declared digests), go into the metadata record as warc-source-* fields, as declared; files of
gzip members are inflated, and other files without a record raise.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import without

VERSION = "WARC/1.1"
DATE = "2024-01-01T00:00:00Z"

_SKIP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:[^<>\"']|\"[^\"<>]*\"|'[^'<>]*'|[\"'])*)>?|<[!?][^<>]*>?", re.S)
_TITLE = re.compile(r"<title\b[^<>]*>([^<]*)", re.I)
_LANG = re.compile(r"<html\b[^<>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I)
_HREF = re.compile(r"<a\b[^<>]*?\bhref\s*=\s*(?:\"([^\"<>]*)\"|'([^'<>]*)'|([^\s\"'<>]+))", re.I)
_CHARSET = re.compile(rb"charset\s*=\s*[\"']?([A-Za-z0-9_-]+)", re.I)
_INLINE = frozenset("a abbr b bdi bdo cite code data dfn em font i kbd mark q s samp small span strong sub sup time tt u var wbr".split())


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def identifier(*names: str | None) -> str:
    raw = hashlib.sha1("\0".join(n or "" for n in names).encode()).digest()[:16]
    return f"<urn:uuid:{uuid.UUID(bytes=raw, version=5)}>"


def _spaced(m: re.Match) -> str:
    return "" if m[2] and m[2].lower() in _INLINE else "\n"


def plain_text(page: str) -> str:
    """What a reader sees, a line for each block; inner spaces are single and empty lines go."""
    text = _TAG.sub(_spaced, _SKIP.sub(" ", page))
    lines = (" ".join(line.split()) for line in html.unescape(text).split("\n"))
    return "\n".join(line for line in lines if line)


def decoded(payload: bytes, content_type: str | None) -> str:
    found = _CHARSET.search((content_type or "").encode()) or _CHARSET.search(payload[:1024])
    try:
        return payload.decode(found[1].decode() if found else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record as it is written to a file."""
    head = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return f"{VERSION}\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def inflated(data: bytes) -> bytes:
    """A file's bytes, with its gzip members inflated; a cut last member is read as far as it goes."""
    if data[:2] != b"\x1f\x8b":
        if data.strip() and b"WARC/" not in data:
            raise ValueError("neither a WARC file nor one of gzip members")
        return data
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        out.append(member.decompress(data))
        data = member.unused_data
    return b"".join(out)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of a file: headers by lower-case name, and blocks. A cut last record is left out."""
    at = 0
    while True:
        at = data.find(b"WARC/", at)
        end = data.find(b"\r\n\r\n", at)
        if at < 0 or end < 0:
            return
        headers = {}
        for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers.get("content-length", "0"))
        if end + 4 + size > len(data):
            return
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and payload of a response's block."""
    head, _, payload = block.partition(b"\r\n\r\n")
    status, *lines = head.decode("utf-8", "replace").split("\r\n")
    return status, [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines)], payload


def _clean(value: str) -> str:
    return " ".join(value.split())


def derive_one(source_id: str, uri: str | None, date: str | None, block: bytes, source: list[tuple[str, str]] = ()) -> list[dict]:
    status, http, payload = split_http(block)
    source_digest = digest(payload)
    kind = next((v for k, v in http if k.lower() == "content-type"), None)
    page = decoded(payload, kind)
    fields = [("source-status", status), *((f"source-header-{k.lower()}", v) for k, v in http), *((f"warc-source-{k.lower().removeprefix('warc-')}", v) for k, v in source)]
    markup = _SKIP.sub(" ", page)
    if title := _TITLE.search(markup):
        fields.append(("title", _clean(html.unescape(title[1]))))
    if lang := _LANG.search(markup):
        fields.append(("language", lang[1]))
    fields += [("outlink", _clean(html.unescape(a or b or c))) for a, b, c in _HREF.findall(markup)]
    out = []
    for warc_type, mime, body in (("metadata", "application/warc-fields", "".join(f"{k}: {_clean(v)}\r\n" for k, v in fields).encode()), ("conversion", "text/plain", plain_text(page).encode())):
        own = identifier(warc_type, source_id, source_digest)
        headers = [("WARC-Type", warc_type), ("WARC-Record-ID", own), ("WARC-Refers-To", source_id)]
        headers += [("WARC-Target-URI", uri)] if uri is not None else []
        headers += [("WARC-Date", date)] if date is not None else []
        headers += [("WARC-Source-Payload-Digest", source_digest), ("WARC-Block-Digest", digest(body)), ("Content-Type", mime)]
        out.append({"warc_type": warc_type, "record_id": own, "refers_to": source_id, "target_uri": uri, "warc_date": date, "content_type": mime, "payload_digest": source_digest, "block_digest": digest(body), "content_length": len(body), "block": body, "record": record(headers, body)})
    return out


RESPONSE = "record_id string, target_uri string, warc_date string, block binary"
_DERIVED = pa.schema([(n, pa.int64() if n == "content_length" else pa.binary() if n in ("block", "record") else pa.string()) for n in ("warc_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type", "payload_digest", "block_digest", "content_length", "block", "record")])


def derive(responses: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Two records for each response (columns RESPONSE), with the input's columns named in keep."""
    own = {f.name for f in _DERIVED} | {"record_id"}
    keep = tuple(k for k in keep if k.lower() not in own)
    names = ["record_id", "target_uri", "warc_date", "block", *(["source_headers"] if "source_headers" in responses.columns else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [derive_one(i or identifier("response", u), u, d, b or b"", [(x["name"], x["value"]) for x in h[0] or ()] if h else ()) for i, u, d, b, *h in zip(*(part.column(c).to_pylist() for c in names), strict=True)]
                made = pa.RecordBatch.from_pylist([x for two in rows for x in two], schema=_DERIVED)
                twice = pa.array([k for k in range(part.num_rows) for _ in range(2)], pa.int32())
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(twice) for k in keep), *made.columns], names=[*keep, *_DERIVED.names])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in responses.schema.fields if f.name in keep)
    fields = ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'binary' if f.type == pa.binary() else 'string'}" for f in _DERIVED)
    return responses.select(*(k for k in keep if k not in names), *names).mapInArrow(run, f"{kept}, {fields}" if kept else fields)


def responses_of(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", date: Column | None = None) -> DataFrame:
    """Fetched pages as response records, with the key kept; a null page has an empty payload."""
    body = F.coalesce(F.encode(F.col(page), "UTF-8"), F.lit(b""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.length(body).cast("string"), F.lit("\r\n\r\n"))
    name = F.sha1(F.concat_ws("|", F.lit("response"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.coalesce(F.col(url), F.lit(""))))
    parts = [F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    own = F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))
    return pages.select(F.col(key), own.alias("record_id"), F.col(url).alias("target_uri"), (F.lit(DATE) if date is None else date).alias("warc_date"), F.concat(F.encode(head, "UTF-8"), body).alias("block"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The response records of WARC files, plain or of gzip members, with all their WARC headers; a file is read by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pa.struct([("name", pa.string()), ("value", pa.string())])
        schema = pa.schema([("record_id", pa.string()), ("target_uri", pa.string()), ("warc_date", pa.string()), ("block", pa.binary()), ("source_headers", pa.list_(pair))])
        for batch in batches:
            for data in batch.column("content"):
                for h, block in parse(inflated(data.as_py() or b"")):
                    if h.get("warc-type") == "response":
                        row = {"record_id": h.get("warc-record-id"), "target_uri": h.get("warc-target-uri"), "warc_date": h.get("warc-date"), "block": block, "source_headers": [{"name": k, "value": v} for k, v in h.items()]}
                        yield pa.RecordBatch.from_pylist([row], schema=schema)

    return without(spark.read.format("binaryFile").load(path), ("path", "length")).select("content").mapInArrow(run, f"{RESPONSE}, source_headers array<struct<name: string, value: string>>")
