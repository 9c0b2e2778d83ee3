"""Derivatives of archived responses: a metadata record and a plain-text conversion record for each page.

Both records name the response they come from (WARC-Refers-To), its address, date, headers and payload digest, and
carry the digest of their own block. Identifiers are UUIDs made from a digest of page id, address and payload, so
a second run, or a task that is run again, gives the same ones.

`derivatives` returns two rows per input row: page_id, record_type, record_id, refers_to, target_uri,
content_type, content_length, block_digest, payload_digest, header, block. `write_warc` writes them as WARC text.

Defined cases. Null html: an empty payload, whose conversion is empty. Null address: no WARC-Target-URI, and
links stay as they stand. Null page id: written as an empty field. Repeated rows: equal records. Empty table: no
rows. Other columns of the input are ignored. Text without tags is its own conversion.
"""

from __future__ import annotations

import base64
import hashlib
import html as html_lib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pitpanel.llm import arrowtext as at

#: The pages have no capture time; a table that has one names its column.
NO_DATE = "1970-01-01T00:00:00Z"

# What is cut out, what starts a line, what is read for the metadata. No pattern looks for its end from every beginning:
# ends are searched for once, as a page of beginnings without ends would otherwise take quadratic time.
HIDDEN = re.compile(r"<!--|<(script|style|template|noscript)\b", re.I)
HIDDEN_END = {k: re.compile(e, re.I) for k, e in {"": "-->", **{t: rf"</{t}\s*>" for t in ("script", "style", "template", "noscript")}}.items()}
LINE = re.compile(r"</?(?:p|div|br|li|ul|ol|tr|table|h[1-6]|article|section|nav|header|footer|blockquote|pre|title|head|body|html)\b[^>]*>", re.I)
TAG = re.compile(r"<[/!?a-zA-Z][^>]*>")
TITLE, TITLE_END = re.compile(r"<title\b", re.I), re.compile(r"</title\s*>", re.I)
HTML, LANG = re.compile(r"<html\b", re.I), re.compile(r"\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I)
META, CHARSET = re.compile(r"<meta\b", re.I), re.compile(r"\bcharset\s*=\s*[\"']?([\w-]+)", re.I)
ANCHOR, HREF = re.compile(r"<a\b", re.I), re.compile(r"\bhref\s*=\s*", re.I)
BARE = re.compile(r"[^\s>]+")
BLANKS = re.compile(r"[^\S\n]+")
COLUMNS = "record_type string, record_id string, refers_to string, target_uri string, content_type string, content_length long, block_digest string, payload_digest string, header string, block string"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def identifier(*parts: bytes) -> str:
    h = hashlib.sha1()
    for p in parts:
        h.update(len(p).to_bytes(8, "little") + p)
    return f"<urn:uuid:{uuid.UUID(bytes=h.digest()[:16], version=5)}>"


def one_line(s: str) -> str:
    return " ".join(s.split())


def shown(page: str) -> str:
    """The page with a blank for each comment and each element that is not shown; those without an end stay."""
    out, at_, missing, pos = [], 0, set(), 0
    while m := HIDDEN.search(page, pos):
        kind = (m[1] or "").lower()
        end = None if kind in missing else HIDDEN_END[kind].search(page, m.end())
        if end is None:  # nor for a later beginning
            missing.add(kind)
            pos = m.end()
            continue
        out += [page[at_ : m.start()], " "]
        at_ = pos = end.end()
    return "".join(out) + page[at_:]


def plain_text(seen: str) -> str:
    """Text of a shown page: one line per block, blanks collapsed, entities decoded."""
    last = seen.rfind(">") + 1  # behind it no tag ends
    body = TAG.sub("", LINE.sub("\n", seen[:last])) + seen[last:]
    lines = (BLANKS.sub(" ", x).strip() for x in html_lib.unescape(body).split("\n"))
    return "\n".join(x for x in lines if x)


def tags(seen: str, opening: re.Pattern) -> Iterator[tuple[int, int]]:
    """(after the name, end) of each tag; one that begins inside another is part of it."""
    pos = 0
    while m := opening.search(seen, pos):
        pos = seen.find(">", m.end())
        pos = len(seen) if pos < 0 else pos
        yield m.end(), pos


def attribute(seen: str, opening: re.Pattern, pattern: re.Pattern) -> str | None:
    for i, j in tags(seen, opening):
        if m := pattern.search(seen, i, j):
            return m[1]
    return None


def title(seen: str) -> str | None:
    m = TITLE.search(seen)
    begin = seen.find(">", m.end()) + 1 if m else 0
    end = TITLE_END.search(seen, begin) if begin else None
    return seen[begin : end.start()] if end else None


def links(seen: str) -> Iterator[str]:
    """Addresses of all anchors, quoted or bare."""
    quotes = {'"', "'"}  # those that are still to come
    pos = 0
    while m := ANCHOR.search(seen, pos):
        end = seen.find(">", m.end())
        end = pos = len(seen) if end < 0 else end
        i = m.end()
        while h := HREF.search(seen, i, end):
            i = h.end()
            quote = seen[i] if i < len(seen) and seen[i] in quotes else None
            if quote:
                close = seen.find(quote, i + 1)
                if close >= 0:
                    yield seen[i + 1 : close]
                    pos = close + 1
                    break
                quotes.discard(quote)
            if bare := BARE.match(seen, i):
                yield bare[0]
                pos = bare.end()
                break


def fields(seen: str, url: str | None) -> str:
    """Body of the metadata record of a shown page: application/warc-fields, one outlink per line."""
    out = []
    for name, value in (("title", title(seen)), ("language", attribute(seen, HTML, LANG)), ("charset", attribute(seen, META, CHARSET))):
        if value is not None:
            out.append(f"{name}: {one_line(html_lib.unescape(value))}")
    for link in links(seen):
        link = one_line(html_lib.unescape(link))
        if url:
            try:
                link = urljoin(url, link)
            except ValueError:
                pass
        out.append(f"outlink: {link}")
    return "".join(f"{x}\r\n" for x in out)


def records(page_id: str, url: str | None, page: str | None, date: str, source: str) -> list[dict]:
    payload = (page or "").encode()
    response = identifier(b"response", page_id.encode(), (url or "").encode(), payload)
    out, seen = [], shown(page or "")
    for kind, content_type, block in (
        ("metadata", "application/warc-fields", fields(seen, url)),
        ("conversion", "text/plain; charset=UTF-8", plain_text(seen)),
    ):
        data = block.encode()
        record = {
            "record_type": kind, "record_id": identifier(kind.encode(), response.encode()), "refers_to": response, "target_uri": url,
            "content_type": content_type, "content_length": len(data), "block_digest": digest(data), "payload_digest": digest(payload),
        }
        lines = [
            "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record['record_id']}", f"WARC-Date: {date}", f"WARC-Refers-To: {response}",
            f"WARC-Refers-To-Date: {date}", f"WARC-Source-Payload-Digest: {record['payload_digest']}", f"WARC-Block-Digest: {record['block_digest']}",
            f"Content-Type: {content_type}", f"Content-Length: {len(data)}", f"X-Source-Length: {len(payload)}",
        ]
        if url:
            lines += [f"WARC-Target-URI: {one_line(url)}", f"WARC-Refers-To-Target-URI: {one_line(url)}"]
        lines += [f"X-Source-Header: {one_line(h)}" for h in source.splitlines() if h.strip()]
        out.append(record | {"header": "\r\n".join(lines) + "\r\n\r\n", "block": block})
    return out


def derivatives(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date_col: str | None = None, header_col: str | None = None,
) -> DataFrame:
    """Metadata and conversion records of every page. header_col: the response's own header lines, carried along."""
    kind = dict(pages.dtypes)[id_col]
    text = lambda c: F.col(c).cast("string")
    rows = pages.select(
        F.col(id_col).alias("page_id"), text(url_col).alias("url"), text(html_col).alias("html"),
        (F.coalesce(text(date_col), F.lit(NO_DATE)) if date_col else F.lit(NO_DATE)).alias("date"),
        (F.coalesce(text(header_col), F.lit("")) if header_col else F.lit("")).alias("source"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in at.slices(batches, "html"):
            ids = part.column("page_id")
            found = [r for i, u, h, d, s in zip(ids.to_pylist(), *(part.column(c).to_pylist() for c in ("url", "html", "date", "source"))) for r in records("" if i is None else str(i), u, h, d, s)]
            twice = ids.take(pa.array([k // 2 for k in range(2 * part.num_rows)], pa.int64()))
            names = [c.split()[0] for c in COLUMNS.split(", ")]
            columns = [pa.array([r[n] for r in found], pa.int64() if n == "content_length" else pa.string()) for n in names]
            yield pa.RecordBatch.from_arrays([twice, *columns], ["page_id", *names])

    return rows.mapInArrow(run, f"page_id {kind}, {COLUMNS}")


def write_warc(found: DataFrame, path: str, compression: str = "gzip") -> None:
    """Files of WARC records. The writer ends each row with two line ends, which is how a WARC record ends."""
    found.select(F.concat("header", "block").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)
