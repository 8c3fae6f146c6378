"""WARC derivatives: every response record becomes a linked metadata record and a plain-text conversion record.

Derivatives refer to the response's record id, keep its target, date and HTTP headers, and carry block and payload digests (SHA-1 in base32) of
their own beside those of the source. Ids are name-based, so a rerun writes the same records.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DATE = "1970-01-01T00:00:00Z"
COLUMNS = (
    "page_id", "record_type", "record_id", "refers_to", "target_uri", "date", "content_type", "block_digest", "payload_digest",
    "source_digest", "source_headers", "content_length", "block",
)
RAW = {"script", "style", "noscript", "template"}
BLOCKS = set("p div br li ul ol tr table h1 h2 h3 h4 h5 h6 title section article header footer nav blockquote pre form hr".split())
_NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9]*)|[!?/]")
_CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW} | {"title": re.compile("</title", re.I)}
_HREF = re.compile(r"\bhref\s*=\s*([\"']?)", re.I)
_BARE = re.compile(r"[^\s>]*")
_LANG = re.compile(r"\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I)
_SPACES = re.compile(r"[ \t\r\f\v\xa0]+")


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(31).join(parts))}>"


def scan(page: str) -> tuple[str, dict[str, object]]:
    """(plain text, title, language and links in order of appearance) in one pass over the page; it never goes back, so time is linear.

    Scripts, styles and comments are dropped up to their end or the page's, block tags are line ends, other tags blanks; a known tag reaches
    up to the next >, an unknown one only if no < comes first. Entities are resolved, blank lines removed.
    """
    out: list[str] = []
    title, lang, links = None, None, []
    pos, end = 0, -1
    while (at := page.find("<", pos)) >= 0:
        if page.startswith("<!--", at):
            close = page.find("-->", at + 4)
            out += [page[pos:at], " "]
            pos = close + 3 if close >= 0 else len(page)
            continue
        found = _NAME.match(page, at + 1)
        if not found:
            out.append(page[pos : at + 1])
            pos = at + 1
            continue
        if end < at:
            end = page.find(">", at)
            if end < 0:  # no tag can end any more
                break
        name, closing = (found[1] or "").lower(), page[at + 1] == "/"
        if not (name in BLOCKS or name in RAW or name in ("a", "html")):
            after = page.find("<", at + 1)
            if 0 <= after < end:
                out.append(page[pos:after])
                pos = after
                continue
        out += [page[pos:at], "\n" if name in BLOCKS else " "]
        pos = end + 1
        if closing:
            continue
        if name in RAW:
            close = _CLOSE[name].search(page, pos)
            pos = close.end() if close else len(page)
        elif name == "a" and (link := _HREF.search(page, at, pos)):
            close = page.find(link[1], link.end()) if link[1] else -1
            if close >= 0:
                links.append(html.unescape(page[link.end() : close]))
                if close > end:  # the value holds a >
                    end = page.find(">", close)
                    pos = end + 1 if end >= 0 else len(page)
            else:
                links.append(html.unescape(link[1] + _BARE.match(page, link.end(), pos)[0]))
        elif name == "html" and lang is None and (named := _LANG.search(page, at, pos)):
            lang = named[1].lower()
        elif name == "title" and title is None and (close := _CLOSE["title"].search(page, pos)):
            title = html.unescape(page[pos : close.start()]).strip()
        elif name == "title" and title is None:
            title = ""  # never closed: do not search for its end again
    out.append(page[pos:])
    lines = (_SPACES.sub(" ", line).strip() for line in html.unescape("".join(out)).split("\n"))
    return "\n".join(line for line in lines if line), {"title": title or None, "lang": lang, "links": links}


def plain_text(page: str) -> str:
    return scan(page)[0]


def page_facts(page: str) -> dict[str, object]:
    """Title (None without one), language and outgoing links."""
    return scan(page)[1]


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records of crawled pages (page_id, url, html): the HTTP message is the block, the page its payload.

    A null page has an empty payload, a null url an empty target. Repeated rows give repeated records with one id.
    """
    size = F.octet_length(F.coalesce("html", F.lit(""))).cast("string")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit("\r\n\r\n"))
    return pages.select("page_id", F.coalesce("url", F.lit("")).alias("target_uri"), F.lit(date).alias("date"), head.alias("headers"), F.coalesce("html", F.lit("")).alias("payload"))


def derive(records: DataFrame) -> DataFrame:
    """Three rows per response: the response itself, its metadata and its conversion."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            rows: list[tuple] = []
            ids = batch.column("page_id").to_pylist()
            own = (batch.column(c).to_pylist() for c in ("target_uri", "date", "headers", "payload"))
            for i, (page_id, uri, date, head, page) in enumerate(zip(ids, *own)):
                payload = page.encode()
                block = head.encode() + payload
                source = record_id("response", str(page_id), uri, digest(block))
                fields = [line.split(": ", 1) for line in head.split("\r\n")[1:] if ": " in line]  # in order, repeated names too
                headers = json.dumps(fields, ensure_ascii=False)
                rows.append(("response", source, None, uri, date, "application/http; msgtype=response", digest(block), digest(payload), None, headers, len(block), block.decode()))
                text, facts = scan(page)
                facts |= {"http": fields}
                for kind, form, body in (("metadata", "application/json", json.dumps(facts, sort_keys=True, ensure_ascii=False)), ("conversion", "text/plain; charset=utf-8", text)):
                    made = body.encode()
                    rows.append((kind, record_id(kind, source), source, uri, date, form, digest(made), digest(made), digest(payload), headers, len(made), body))
                at += [i, i, i]
            kinds = [pa.string()] * 10 + [pa.int64(), pa.string()]
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id").take(pa.array(at, pa.int64())), *columns], list(COLUMNS))

    kind = records.schema["page_id"].dataType.simpleString()
    texts = ", ".join(f"{c} string" for c in COLUMNS[1:11])
    return records.mapInArrow(run, f"page_id {kind}, {texts}, content_length long, block string")


def serialize(derivatives: DataFrame) -> DataFrame:
    """Every record in the WARC/1.1 file form (page_id, record_id, record); derivatives name their source's target, date, digest and headers."""
    derived = F.col("refers_to").isNotNull()
    named = (
        ("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"),
        ("WARC-Refers-To-Target-URI", F.when(derived, F.col("target_uri"))), ("WARC-Date", "date"), ("WARC-Refers-To-Date", F.when(derived, F.col("date"))),
        ("WARC-Block-Digest", "block_digest"), ("WARC-Payload-Digest", "payload_digest"), ("WARC-Source-Digest", "source_digest"),
        ("WARC-Source-Headers", F.when(derived, F.col("source_headers"))), ("Content-Type", "content_type"),
    )
    lines = [F.concat(F.lit(f"{name}: "), F.col(c) if isinstance(c, str) else c) for name, c in named]
    head = F.concat_ws("\r\n", F.lit("WARC/1.1"), *lines, F.concat(F.lit("Content-Length: "), F.col("content_length").cast("string")))
    return derivatives.select("page_id", "record_id", F.concat(head, F.lit("\r\n\r\n"), F.col("block"), F.lit("\r\n\r\n")).alias("record"))
