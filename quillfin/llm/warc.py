"""WARC derivatives: metadata and plain-text conversion records of responses.

``responses`` writes each page as a WARC/1.1 response record; ``derive`` reads
response records back and builds two records for each: ``metadata`` (JSON: the
source's WARC and HTTP headers, in order and repeated ones included, title, links, digests) and ``conversion``
(plain text). Both name their source in WARC-Refers-To and its
target, date and payload digest, and carry digests of their own blocks.

Null pages count as empty; null URLs give no target; record ids follow from content, so
repeated pages give equal records; very long pages are read whole, in linear time; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import html as entities
import json
import re
import uuid
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DATE = "2025-01-01T00:00:00Z"
CRLF = b"\r\n"
#: Tags that begin a line; whose content is no visible text; whose content holds no tags; that link.
BLOCKS = frozenset("p div br hr li ul ol tr table h1 h2 h3 h4 h5 h6 section article header footer nav main pre blockquote dd dt dl title body html form".split())
HIDDEN = frozenset("script style head template noscript".split())
RAW = frozenset("script style title".split())
LINKS = frozenset("a link img script iframe source area".split())
TAG = re.compile(r"<([/!?]?)([A-Za-z][A-Za-z0-9]*)")
HREF = re.compile(r"\b(?:href|src)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(10).join(parts))}>"


def build(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC/1.1 record."""
    lines = [*headers, ("WARC-Block-Digest", digest(block)), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in lines) + CRLF + block + CRLF + CRLF


def fields(lines: list[str]) -> list[tuple[str, str]]:
    """(name, value) of header lines, in order, repeated ones included; lines that begin with white space go on with the one before."""
    out: list[tuple[str, str]] = []
    for x in lines:
        if x[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {x.strip()}")
        elif x:
            name, _, value = x.partition(":")
            out.append((name.strip(), value.strip()))
    return out


def value(headers: list[tuple[str, str]], name: str) -> str | None:
    """The first value of a header, whose name may be in either case."""
    return next((v for k, v in headers if k.lower() == name.lower()), None)


def parse(record: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """Headers, in order, and block of a record; ValueError if it isn't one or its block digest is wrong."""
    head, mark, rest = record.partition(CRLF + CRLF)
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not mark or not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = fields(lines)
    length = value(headers, "Content-Length") or ""
    if not length.isdecimal():
        raise ValueError("no content length")
    block = rest[: int(length)]
    if len(block) != int(length) or (value(headers, "WARC-Block-Digest") or digest(block)) != digest(block):
        raise ValueError("block is damaged")
    return headers, block


def response(page_id: int | None, url: str | None, page: str | None, date: str = DATE) -> bytes:
    body = (page or "").encode()
    target = re.sub(r"[\r\n]+", " ", url) if url is not None else None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {len(body)}\r\n".encode() + CRLF + body
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", str(page_id), str(url), digest(body))), ("WARC-Date", date)]
    if target is not None:
        headers.append(("WARC-Target-URI", target))
    headers += [("WARC-Payload-Digest", digest(body)), ("Content-Type", "application/http; msgtype=response")]
    return build(headers, block)


def scan(page: str) -> tuple[str, str | None, list[tuple[str, str]]]:
    """(visible text, a line for each block; title; links as (tag, reference as written)), in one pass.

    Comments, CDATA, and elements without visible text count as such only where they end. What isn't found
    once isn't looked for again, so the time is linear in the page's length.
    """
    out: list[str] = []
    found: list[tuple[str, str]] = []
    title = hidden = None
    gone: set[str] = set()

    def end_of(mark: str, at: int) -> int:
        """Where the next ``mark`` ends, or -1."""
        if mark in gone:
            return -1
        at = page.find(mark, at)
        if at < 0:
            gone.add(mark)
            return -1
        return at + len(mark)

    closers: dict[str, re.Pattern] = {}

    def closer(name: str, at: int) -> re.Match | None:
        if name in gone:
            return None
        m = closers.setdefault(name, re.compile(rf"</{name}\s*>", re.I)).search(page, at)
        if m is None:
            gone.add(name)
        return m

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if hidden is None:
            out.append(page[at : lt if lt >= 0 else n])
        if lt < 0:
            break
        for begin, mark in (("<!--", "-->"), ("<![CDATA[", "]]>")):
            if page.startswith(begin, lt) and (end := end_of(mark, lt + len(begin))) >= 0:
                at = end
                if hidden is None:
                    out.append(" ")
                break
        else:
            m = TAG.match(page, lt)
            end = end_of(">", m.end()) if m else -1
            if end < 0:
                if hidden is None:
                    out.append("<")
                at = lt + 1
                continue
            at, kind, name = end, m[1], m[2].lower()
            if kind == "/" and name == hidden:
                hidden = None
                out.append(" ")
                continue
            if hidden is None and name in BLOCKS:
                out.append("\n")
            if kind:
                continue
            if name in LINKS and (h := HREF.search(page, m.end(), end)):
                found.append((name, next(g for g in h.groups() if g is not None)))
            close = closer(name, end) if name in RAW or (name in HIDDEN and hidden is None) else None
            if close is None:
                continue
            if name == "title":
                title = page[end : close.start()] if title is None else title
                if hidden is None:
                    out += [page[end : close.start()], "\n"]
                at = close.end()
            elif name in RAW:
                at = close.end()
                if hidden is None:
                    out.append(" ")
            else:
                hidden = name
    lines = (" ".join(x.split()) for x in entities.unescape("".join(out)).split("\n"))
    return "\n".join(x for x in lines if x), title, found


def links(found: list[tuple[str, str]], base: str | None) -> list[dict[str, str]]:
    """Links with their targets, relative ones resolved."""
    out = []
    for tag, reference in found:
        href = entities.unescape(reference).strip()
        try:
            out.append({"tag": tag, "url": urljoin(base, href) if base else href})
        except ValueError:
            out.append({"tag": tag, "url": href})
    return out


def derivatives(record: bytes) -> list[tuple[str, list[tuple[str, str]], bytes, bytes, int]]:
    """(type, headers, block, record, links) of the metadata and the conversion record of a response."""
    source, block = parse(record)
    own = {k: value(source, k) for k in ("WARC-Type", "WARC-Record-ID", "WARC-Date", "WARC-Target-URI", "WARC-Payload-Digest")}
    if own["WARC-Type"] != "response" or own["WARC-Record-ID"] is None or own["WARC-Date"] is None:
        raise ValueError("not a response")
    head, _, body = block.partition(CRLF + CRLF)
    status, *lines = head.decode("latin-1").split("\r\n")
    target, payload = own["WARC-Target-URI"], own["WARC-Payload-Digest"]
    text, title, found = scan(body.decode("utf-8", "replace"))
    resolved = links(found, target)
    envelope = {
        "source-headers": source,
        "http-status": status,
        "http-headers": fields(lines),
        "actual-payload-digest": digest(body),
        "payload-digest-matches": payload == digest(body),
        "title": " ".join(entities.unescape(title).split()) if title is not None else None,
        "links": resolved,
    }
    refers = [("WARC-Refers-To", own["WARC-Record-ID"]), ("WARC-Refers-To-Date", own["WARC-Date"])]
    if target is not None:
        refers += [("WARC-Refers-To-Target-URI", target), ("WARC-Target-URI", target)]
    if payload is not None:
        refers.append(("WARC-Source-Payload-Digest", payload))
    out = []
    for kind, content, data in (("metadata", "application/json", json.dumps(envelope, ensure_ascii=False, sort_keys=True).encode()), ("conversion", "text/plain; charset=utf-8", text.encode())):
        headers = [("WARC-Type", kind), ("WARC-Record-ID", record_id(kind, own["WARC-Record-ID"])), ("WARC-Date", own["WARC-Date"]), *refers, ("Content-Type", content)]
        whole = build(headers, data)
        out.append((kind, [*headers, ("WARC-Block-Digest", digest(data)), ("Content-Length", str(len(data)))], data, whole, len(resolved) if kind == "metadata" else 0))
    return out


def responses(pages: DataFrame, date: str = DATE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, record): each page's response record."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 256):
                p = b.slice(k, 256)
                made = [response(*x, date) for x in zip(*(c.to_pylist() for c in p.columns))]
                yield pa.RecordBatch.from_arrays([p.column(0), pa.array(made, pa.binary())], names=["id", "record"])

    return rows.mapInArrow(run, "id long, record binary")


def derive(records: DataFrame, record_col: str = "record", id_col: str = "id") -> DataFrame:
    """Two rows for each response record: id, record_type, record_id, refers_to, target_uri,
    source_digest, block_digest, n_links, block (text), record. Other records and nulls give none; a damaged record gives one of type ``damaged``
    with the reason as its block."""
    schema = "id long, record_type string, record_id string, refers_to string, target_uri string, source_digest string, block_digest string, n_links long, block string, record binary"
    rows = records.select(F.col(id_col).cast("long").alias("id"), F.col(record_col).alias("record")).where("record is not null")
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64(), *[pa.string()] * 6, pa.int64(), pa.string(), pa.binary()]

    def rows_of(i, record):
        try:
            if value(parse(record)[0], "WARC-Type") != "response":
                return
            made = derivatives(record)
        except ValueError as reason:
            yield i, "damaged", None, None, None, None, None, 0, str(reason), None
            return
        for kind, h, data, whole, n in made:
            yield i, kind, *(value(h, k) for k in ("WARC-Record-ID", "WARC-Refers-To", "WARC-Target-URI", "WARC-Source-Payload-Digest", "WARC-Block-Digest")), n, data.decode(), whole

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 256):
                p = b.slice(k, 256)
                out = [r for i, record in zip(p.column(0).to_pylist(), p.column(1).to_pylist()) for r in rows_of(i, record)]
                columns = list(zip(*out)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return rows.mapInArrow(run, schema)
