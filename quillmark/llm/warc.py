"""WARC derivatives: responses become linked metadata and plain-text conversion records.

A record is its header lines and its block, as in WARC 1.1.  For each ``response`` the builder
makes a ``conversion`` record with the page's plain text and a ``metadata`` record with the source's
WARC and HTTP headers and what the page says of itself (title, meta tags, links).  Both name the
source in WARC-Refers-To with its URI and date and carry its payload digest; the metadata record names
the conversion in WARC-Concurrent-To.  Record ids follow from the source's id, so a repeated task
writes the same records.

Records travel as rows with their bytes; concatenated in any order those bytes are a WARC file.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections import deque
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = b"WARC/1.1"
DATE = "2024-01-01T00:00:00Z"  # of responses made from a table that has no date
#: Elements whose text isn't shown, and elements that start a new line.
HIDDEN = {"script", "style", "noscript", "template", "svg", "iframe", "object"}
#: Elements that can stand in a head; any other ends it, as its end tag may be left out.
HEAD = {"html", "head", "title", "meta", "link", "base", "basefont", "bgsound", "noframes", "style", "script", "noscript", "template"}
BREAKS = {"address", "article", "aside", "blockquote", "br", "dd", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul"}
#: Attributes that link, by element.
LINKS = {"a": "href", "link": "href", "area": "href", "img": "src", "script": "src", "iframe": "src", "source": "src", "form": "action"}

Headers = list[tuple[str, str]]


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(parts))}>"


def serialize(headers: Headers, block: bytes) -> bytes:
    """A record: version, headers, length, empty line, block, two line ends."""
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in headers), f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_headers(raw: bytes) -> Headers:
    """Header lines; a line that starts with white space continues the one before."""
    out: Headers = []
    for line in re.split(rb"\r?\n", raw):
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {text.strip()}")
        elif ":" in text:
            name, _, value = text.partition(":")
            out.append((name.strip(), value.strip()))
    return out


def value(headers: Headers, name: str) -> str | None:
    return next((v for k, v in headers if k.lower() == name.lower()), None)


_MARK = b"\r\n\r\nWARC/1."  # ends a record and begins the next
_LONGEST = 1 << 30  # a longer record fits no row


def _sound(piece: bytes) -> tuple[Headers, bytes | None, int] | None:
    """Headers, what is there of the block (None before its begin), and the block's length by its header."""
    end = re.search(rb"\r?\n\r?\n", piece)
    first, _, lines = piece[: end.start() if end else len(piece)].partition(b"\n")
    if not re.fullmatch(rb"\d+\r?", first):
        return None
    headers = parse_headers(lines)
    length = value(headers, "Content-Length")
    if not length or not re.fullmatch(r"[0-9]{1,10}", length) or int(length) > _LONGEST:
        return None
    return headers, piece[end.end() :] if end else None, int(length)


def assemble(pieces: Iterable[bytes]) -> Iterator[tuple[Headers, bytes] | int]:
    """Records of what stands between one ``_MARK`` and the next, or how many bytes no record could be made of.

    A block that holds the mark itself comes in several pieces, which are put together if its length is reached
    exactly.  Else the record is damaged: it alone is passed over, and the next begins at the next mark.
    """
    source, waiting = iter(pieces), deque()

    def take() -> bytes | None:
        return waiting.popleft() if waiting else next(source, None)

    while (piece := take()) is not None:
        found = _sound(piece)
        if found is None:
            yield len(piece)
            continue
        headers, block, length = found
        used, size = [block or b""], len(block or b"")
        while size < length and (more := take()) is not None:
            used += [_MARK if block is not None or len(used) > 1 else _MARK[4:], more]  # the empty line may be the headers' own
            size += len(used[-2]) + len(more)
        if size >= length:
            block = b"".join(used)
            if not block[length:].strip(b"\r\n"):
                yield headers, block[:length]
                continue
        waiting.extendleft(reversed(used[2::2]))
        yield len(piece)


def records(data: bytes) -> Iterator[tuple[Headers, bytes]]:
    """The sound records of some bytes."""
    for found in assemble(_pieces(data)):
        if not isinstance(found, int):
            yield found


def _pieces(data: bytes) -> list[bytes]:
    return re.split(rb"(?:^|\r?\n\r?\n)\s*WARC/1\.", data)[1:]


class _Page(HTMLParser):
    """Text, title, meta tags and links of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.title: list[str] = []
        self.metas: list[dict[str, str]] = []
        self.links: list[dict[str, str]] = []
        self.hidden = 0
        self.in_title = False
        self.in_head = False

    def handle_starttag(self, tag, attrs):
        if tag == "head":
            self.in_head = True
        elif tag not in HEAD and not self.hidden or tag in ("body", "main"):
            self.in_head = False
        attrs = {k: v or "" for k, v in attrs}
        if tag == "title":
            self.in_title = True
        elif tag == "meta":
            name = attrs.get("name") or attrs.get("property") or attrs.get("http-equiv")
            if name:
                self.metas.append({"name": name, "content": attrs.get("content", "")})
        if attrs.get(LINKS.get(tag, ""), ""):
            self.links.append({"path": f"{tag}@/{LINKS[tag]}", "url": attrs[LINKS[tag]]})
        if tag in HIDDEN:
            self.hidden += 1
        elif tag in BREAKS:
            if tag in ("body", "main"):
                self.hidden = 0
            self.parts.append("\n")
        if tag == "body":
            self.hidden = 0

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        elif tag == "head":
            self.in_head = False
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag in BREAKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.hidden and (not self.in_head or data.strip()):
            self.in_head = False
            self.parts.append(data)


def page_text(html: str) -> tuple[str, dict]:
    """Plain text, one line for each block, and the page's own metadata."""
    page = _Page()
    broken = False
    try:
        page.feed(html)
        page.close()
    except (AssertionError, ValueError):  # the parser gave up on a malformed declaration
        broken = True
    lines = (" ".join(x.split()) for x in "".join(page.parts).split("\n"))
    about = {"title": " ".join("".join(page.title).split()), "metas": page.metas, "links": page.links}
    return "\n".join(x for x in lines if x), about | ({"broken": True} if broken else {})


def response(uri: str | None, key: str, payload: bytes, date: str = DATE) -> bytes:
    """A response record of an HTML page."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_id(key, uri or "")), ("WARC-Date", date)]
    if uri is not None:
        headers.append(("WARC-Target-URI", re.sub(r"[\r\n]+", " ", uri)))
    headers += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", sha1(payload)), ("WARC-Block-Digest", sha1(block))]
    return serialize(headers, block)


def _unchunked(data: bytes) -> bytes:
    """The content of chunks; data that isn't chunked, as where a crawler undid it, is returned as it is."""
    out, at = [], 0
    while at < len(data):
        stop = data.find(b"\r\n", at)
        size = data[at : max(stop, at)].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", size):
            break
        n = int(size, 16)
        if not n:
            return b"".join(out)
        piece = data[stop + 2 : stop + 2 + n]
        out.append(piece)
        at = stop + 2 + n
        if at < len(data) and data[at : at + 2] != b"\r\n":
            return data
        at += 2
    return b"".join(out) if out else data  # a cut tail keeps what came before


def _inflated(data: bytes, kind: str) -> bytes:
    """The content of gzip members or a deflate stream, as far as it goes; other data as it is."""
    if kind == "gzip":
        if data[:2] != b"\x1f\x8b":
            return data
        tries = (31,)
    else:
        tries = (15, -15)
    for bits in tries:
        out, rest = [], data
        try:
            while rest:
                part = zlib.decompressobj(bits)
                out.append(part.decompress(rest))
                rest = part.unused_data if bits == 31 and part.unused_data[:2] == b"\x1f\x8b" else b""
            return b"".join(out)
        except zlib.error:
            if bits == 31:
                return b"".join([*out, _as_far(rest)])
    return data


def _as_far(data: bytes) -> bytes:
    """What a damaged gzip member still gives."""
    part, out = zlib.decompressobj(31), []
    try:
        for i in range(0, len(data), 256):
            out.append(part.decompress(data[i : i + 256]))
    except zlib.error:
        pass
    return b"".join(out)


def _codings(http: Headers, name: str) -> list[str]:
    """Codings in the order in which they are undone."""
    found = [x.strip().lower().removeprefix("x-") for k, v in http if k.lower() == name for x in v.split(",")]
    return [x for x in reversed(found) if x and x != "identity"]


def decoded(http: Headers, payload: bytes) -> tuple[bytes, bytes | None]:
    """The payload without transfer codings, and without content codings too: None for one unknown here."""
    body: bytes | None = payload
    for name in ("transfer-encoding", "content-encoding"):
        for coding in _codings(http, name):
            if body is None:
                break
            body = _unchunked(body) if coding == "chunked" else _inflated(body, coding) if coding in ("gzip", "deflate") else None
        if name == "transfer-encoding":
            sent = payload if body is None else body
    return sent, body


def derive(headers: Headers, block: bytes) -> list[tuple[Headers, bytes, dict]]:
    """The conversion (for text payloads) and metadata records of a response, with facts for columns."""
    head, _, payload = block.partition(b"\r\n\r\n")
    status, _, rest = head.partition(b"\r\n")
    http = parse_headers(rest)
    kind = (value(http, "Content-Type") or "").lower()
    charset = re.search(r"charset=[\"']?([\w.:-]+)", kind)
    source, uri, date = (value(headers, k) for k in ("WARC-Record-ID", "WARC-Target-URI", "WARC-Date"))
    digest = sha1(payload)
    given = value(headers, "WARC-Payload-Digest")
    sent, content = decoded(http, payload)
    link = [("WARC-Refers-To", source or "")]
    if uri is not None:
        link += [("WARC-Target-URI", uri), ("WARC-Refers-To-Target-URI", uri)]
    if date is not None:
        link += [("WARC-Date", date), ("WARC-Refers-To-Date", date)]
    link.append(("WARC-Payload-Digest", given or digest))
    out, text, about = [], None, {}
    if content is not None and (not kind or "html" in kind or kind.startswith("text/")):
        try:
            body = content.decode(charset[1] if charset else "utf-8", "replace")
        except LookupError:
            body = content.decode("utf-8", "replace")
        text, about = page_text(body) if not kind or "html" in kind else (body, {})
    ids = {k: record_id(source or "", k) for k in ("conversion", "metadata")}
    facts = {"digest_ok": given in (None, digest) or sent is not payload and given == sha1(sent), "n_links": len(about.get("links", [])), "title": about.get("title")}
    if text is not None:
        raw = text.encode()
        made = [("WARC-Type", "conversion"), ("WARC-Record-ID", ids["conversion"]), *link, ("Content-Type", "text/plain; charset=utf-8"), ("WARC-Block-Digest", sha1(raw))]
        out.append((made, raw, facts))
    told = {
        "Envelope": {"WARC-Header-Metadata": headers, "Block-Length": len(block), "Payload-Length": len(payload), "Payload-Digest": digest, "Digest-Matches": facts["digest_ok"]},
        "HTTP-Response-Metadata": {"Status": status.decode("latin-1"), "Headers": http},
        "HTML-Metadata": about,
    }
    raw = json.dumps(told, ensure_ascii=False).encode()
    made = [("WARC-Type", "metadata"), ("WARC-Record-ID", ids["metadata"]), *link]
    if text is not None:
        made.append(("WARC-Concurrent-To", ids["conversion"]))
    out.append((made + [("Content-Type", "application/json"), ("WARC-Block-Digest", sha1(raw))], raw, facts))
    return out


def responses(pages: DataFrame, key: str = "page_id", date: str = DATE) -> DataFrame:
    """``key, record``: a response record of every row of ``key, url, html``; null html is an empty page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            made = [response(url, str(k), (html or "").encode(), date) for k, url, html in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], [key, "record"])

    ready = pages.select(F.col(key).cast("long").alias(key), F.col("url").cast("string"), F.col("html").cast("string"))
    return ready.mapInArrow(run, f"`{key}` long, record binary")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``source, record, skipped`` of all records of the .warc and .warc.gz files at ``path``.

    Spark's line reader splits at the mark between records, so a file of any size is read in a stream, and one
    that isn't compressed by several tasks.  Bytes of which no record could be made are counted in ``skipped`` of a
    row with a null record; the records after them are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = ((n, v) for batch in batches for n, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        for name, group in groupby(pieces, key=lambda x: x[0]):
            begins = (re.sub(rb"^\s*WARC/1\.", b"", v) for _, v in group)  # of a file's first piece
            for found in assemble(x for x in begins if x.strip()):
                if isinstance(found, int):
                    record, skipped = None, found
                else:
                    record, skipped = serialize([(k, v) for k, v in found[0] if k.lower() != "content-length"], found[1]), 0
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([record], pa.binary()), pa.array([skipped], pa.int64())], ["source", "record", "skipped"])

    lines = spark.read.option("lineSep", _MARK.decode()).text(path)
    return lines.select(F.col("_metadata.file_path"), F.col("value").cast("binary")).mapInArrow(run, "source string, record binary, skipped long")


_DERIVED = "{key} {kind}, warc_type string, record_id string, refers_to string, target_uri string, refers_to_date string, content_type string, content_length long, block_digest string, payload_digest string, digest_ok boolean, title string, n_links int, content string, record binary"


def derivatives(source: DataFrame, key: str = "page_id") -> DataFrame:
    """Derived records, a row each, of the response records in ``key, record``.

    Columns hold the main headers, ``content`` the block as text and ``record`` the whole record.
    Records of other types, null and damaged ones give none.  Chunked, gzip and deflate codings are
    undone before the text is taken.  Responses with a payload that isn't text, or in another
    coding, give metadata only.  Repeated responses give repeated records.
    """
    schema = _DERIVED.format(key=f"`{key}`", kind=source.schema[key].dataType.simpleString())
    names = [x.strip().split(" ")[0].strip("`") for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows: list[tuple] = []
                for k, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    for headers, block in records(raw or b""):
                        if (value(headers, "WARC-Type") or "").lower() != "response":
                            continue
                        for made, data, facts in derive(headers, block):
                            get = lambda n, h=made: value(h, n)
                            rows.append((
                                k, get("WARC-Type"), get("WARC-Record-ID"), get("WARC-Refers-To"), get("WARC-Target-URI"), get("WARC-Refers-To-Date"), get("Content-Type"), len(data),
                                get("WARC-Block-Digest"), get("WARC-Payload-Digest"), facts["digest_ok"], facts["title"], facts["n_links"], data.decode(), serialize(made, data),
                            ))
                types = [part.schema.field(0).type] + [pa.string()] * 6 + [pa.int64()] + [pa.string()] * 2 + [pa.bool_(), pa.string(), pa.int32(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    return source.select(key, "record").mapInArrow(run, schema)
