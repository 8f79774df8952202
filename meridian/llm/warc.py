"""WARC derivatives: linked metadata and plain-text conversion records of responses.

``responses`` makes a response record of each page; ``parse`` reads records of a WARC file's
bytes, plain or gzipped by record; ``derive`` turns a response into two records. Both name the
response in WARC-Refers-To, keep its target URI and date, and name each other: the metadata
record lists its conversion under ``conversion`` and the conversion has the metadata in
WARC-Concurrent-To. The metadata record keeps the response's HTTP status and headers, its block
and payload digests, its title and its links; the conversion is the text of the page, a line
for each block element. Record ids are UUIDs (version 5) of the source's id, so a rerun makes the same.

``write_warc`` writes records to gzipped files, one for each partition, whose names hold a
random part; the manifest it returns names the files of the successful tasks.

Defined results: a null or empty page is a response with an empty payload and gives both
derivatives with empty text; a null URI leaves WARC-Target-URI out; equal rows give equal records; a
null page id is written as an empty word in the record's name; other columns are ignored; an empty table gives no
records; a response whose block has no HTTP head is all payload. A very long or malformed page is read whole, see ``Page``.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import cut, file_system, shared_dir

DATE = "1970-01-01T00:00:00Z"
OPEN = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*+))")
QUOTE = re.compile("[>\"']")
HREF = re.compile(r"(?:^|[\s\"'/])href\s*+=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s>\"']\S*+))", re.I)
#: fixed element names: those whose content is no text, and those that start a line
RAW = frozenset("script style noscript template".split())
BREAK = frozenset("address article aside blockquote br dd div dl dt footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table title tr ul".split())
CLOSE = {name: re.compile(rf"</{name}\s*+>", re.I) for name in (*RAW, "title")}
FIELDS = pa.schema(
    [
        ("page_id", pa.int64()),
        ("record_type", pa.string()),
        ("record_id", pa.string()),
        ("refers_to", pa.string()),
        ("concurrent_to", pa.string()),
        ("target_uri", pa.string()),
        ("warc_date", pa.string()),
        ("content_type", pa.string()),
        ("content_length", pa.int64()),
        ("block_digest", pa.string()),
        ("source_headers", pa.string()),
        ("source_block_digest", pa.string()),
        ("source_payload_digest", pa.string()),
        ("block", pa.string()),
    ]
)
SCHEMA = "page_id long, record_type string, record_id string, refers_to string, concurrent_to string, target_uri string, warc_date string, content_type string, content_length long, block_digest string, source_headers string, source_block_digest string, source_payload_digest string, block string"


def digest(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(raw, usedforsecurity=False).digest()).decode()


def urn(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A record's bytes; headers without a value are left out."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))] if v is not None)
    return b"WARC/1.1\r\n" + head.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def response(page_id: int | None, uri: str | None, page: str | None, date: str = DATE) -> bytes:
    """The response record of a page."""
    payload = (page or "").encode("utf-8", "surrogatepass")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    name = f"response {'' if page_id is None else page_id} {uri or ''} {digest(payload)}"
    uri = None if uri is None else re.sub(r"[\r\n]+", " ", uri)
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", urn(name)), ("WARC-Date", date), ("WARC-Target-URI", uri), ("Content-Type", "application/http; msgtype=response"), ("WARC-Block-Digest", digest(block)), ("WARC-Payload-Digest", digest(payload))]
    return record(headers, block)


def parse(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record. ``raw``: whole records, plain or gzipped."""
    if raw[:2] == b"\x1f\x8b":
        parts = []
        while raw[:2] == b"\x1f\x8b":
            d = zlib.decompressobj(31)
            parts.append(d.decompress(raw) + d.flush())
            raw = d.unused_data
        raw = b"".join(parts)
    at = 0
    while (begin := raw.find(b"WARC/", at)) >= 0:
        end = raw.find(b"\r\n\r\n", begin)
        if end < 0:
            return
        headers, last = {}, None
        for line in raw[begin:end].split(b"\r\n")[1:]:
            text = line.decode("utf-8", "surrogateescape")
            if text[:1] in " \t" and last:  # a folded line
                headers[last] += " " + text.strip()
            elif ":" in text:
                last, value = text.split(":", 1)
                last = last.strip().lower()
                headers[last] = value.strip()
        size = int(headers.get("content-length", "0"))
        yield headers, raw[end + 4 : end + 4 + size]
        at = end + 4 + size


def split_http(block: bytes) -> tuple[list[str], bytes]:
    """The lines of an HTTP head, and the payload."""
    head, found, payload = block.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"HTTP/"):
        return [], block
    return head.decode("utf-8", "replace").split("\r\n"), payload


class Page:
    """What one pass over a page finds: its text, title (None without one) and links.

    A tag ends at the first ``>`` outside of its quoted values, or at the first of all where its quotes do not close.
    Comments, declarations and the content of ``RAW`` elements are no text; one that is not closed, and a tag
    without an end, loses no more than its own mark. What was searched for in vain is not searched for again, so a page
    costs time in proportion to its length, however it is formed.
    """

    def __init__(self, page: str):
        self.page, self.title, self.links = page, None, []
        self.never: set[str] = set()  # what does not occur any more
        self.text = self._read()

    def _find(self, what: str, at: int) -> int:
        if what in self.never:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.never.add(what)
        return found

    def _close(self, name: str, at: int) -> re.Match | None:
        if name in self.never:
            return None
        found = CLOSE[name].search(self.page, at)
        if not found:
            self.never.add(name)
        return found

    def _end(self, at: int) -> int:
        """The end of a tag whose name ends at ``at``; -1 if no ``>`` is left."""
        first, i = self._find(">", at), at
        while first >= 0 and "quotes" not in self.never:
            m = QUOTE.search(self.page, i)
            if not m:
                break
            if m[0] == ">":
                return m.end()
            # a quote opens a value only behind an equals sign
            i = m.end()
            if self.page[max(at, m.start() - 8) : m.start()].rstrip().endswith("="):
                i = self.page.find(m[0], m.end()) + 1
                if not i or self.page.find(">", i) < 0:
                    self.never.add("quotes")
        return first + 1 if first >= 0 else -1

    def _read(self) -> str:
        page, out, at = self.page, [], 0
        title_from = None
        while m := OPEN.search(page, at):
            out.append(page[at : m.start()])
            at = m.end()
            name = (m[2] or "").lower()
            if not name:
                end = self._find("-->" if m[0] == "<!--" else ">", at)
                if end < 0 and m[0] == "<!--":
                    end = self._find(">", at)
                    at = end + 1 if end >= 0 else at
                elif end >= 0:
                    at = end + (3 if m[0] == "<!--" else 1)
                elif m[0] != "<!--":
                    out.append(m[0])
                continue
            end = self._end(at)
            if end < 0:
                out.append(page[m.start() : at])
                continue
            attributes, at = page[at : end - 1], end
            if name in BREAK:
                out.append("\n")
            if not m[1] and name in RAW:
                if close := self._close(name, at):
                    at = close.end()
            elif not m[1] and name == "a":
                if link := HREF.search(attributes):
                    self.links.append(" ".join(html.unescape(next(x for x in (*link.groups(), "") if x is not None)).split()))
            elif name == "title" and self.title is None:
                if not m[1] and title_from is None:
                    title_from = len(out) if self._close(name, at) else None
                elif m[1] and title_from is not None:
                    self.title = " ".join(html.unescape("".join(out[title_from:])).split())
        out.append(page[at:])
        lines = (" ".join(x.split()) for x in html.unescape("".join(out)).split("\n"))
        return "\n".join(x for x in lines if x)


def derive(headers: dict[str, str], block: bytes) -> list[dict]:
    """The metadata and the conversion record of a response, as rows of ``FIELDS`` without page_id."""
    http, payload = split_http(block)
    charset = next((m[1] for x in http if (m := re.match(r"(?i)content-type:.*charset=\"?([\w.-]+)", x))), "utf-8")
    try:
        page = payload.decode(charset, "replace")
    except LookupError:
        page = payload.decode("utf-8", "replace")
    source = headers.get("warc-record-id", "")
    ids = {kind: urn(f"{kind} of {source}") for kind in ("metadata", "conversion")}
    digests = headers.get("warc-block-digest") or digest(block), headers.get("warc-payload-digest") or digest(payload)
    read = Page(page)
    fields = [f"conversion: {ids['conversion']}", f"source-block-digest: {digests[0]}", f"source-payload-digest: {digests[1]}", *(f"http-header: {x}" for x in http)]
    if read.title is not None:
        fields.append(f"title: {read.title}")
    fields += [f"outlink: {x}" for x in read.links]
    meta = "".join(f"{x}\r\n" for x in fields)
    text = read.text
    out = []
    for kind, content, other, body in (("metadata", "application/warc-fields", ids["conversion"], meta), ("conversion", "text/plain; charset=utf-8", ids["metadata"], text)):
        raw = body.encode("utf-8", "replace")
        out.append(
            {
                "record_type": kind,
                "record_id": ids[kind],
                "refers_to": source,
                "concurrent_to": other,
                "target_uri": headers.get("warc-target-uri"),
                "warc_date": headers.get("warc-date"),
                "content_type": content,
                "content_length": len(raw),
                "block_digest": digest(raw),
                "source_headers": "\r\n".join(http),
                "source_block_digest": digests[0],
                "source_payload_digest": digests[1],
                "block": raw.decode(),
            }
        )
    return out


def record_bytes(row: dict) -> bytes:
    """The record of a row of ``FIELDS``."""
    headers = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", row["warc_date"]), ("WARC-Target-URI", row["target_uri"]), ("WARC-Refers-To", row["refers_to"]), ("WARC-Concurrent-To", row["concurrent_to"]), ("Content-Type", row["content_type"]), ("WARC-Block-Digest", row["block_digest"])]
    return record(headers, (row["block"] or "").encode())


def _build(date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in (big.slice(i, 256) for i in range(0, big.num_rows, 256)):
                rows = []
                for page_id, uri, page in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    for headers, block in parse(response(page_id, uri, page, date)):
                        rows += [{"page_id": page_id, **x} for x in derive(headers, block)]
                yield pa.RecordBatch.from_pylist(rows, schema=FIELDS)

    return run


def derivatives(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", html_col: str = "html", date: str = DATE) -> DataFrame:
    """The derived records of the responses of ``pages``, two rows for each."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(uri_col).cast("string").alias("uri"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_build(date), SCHEMA)


def _parse_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for raw in b.column(0).to_pylist():
            rows = [x for headers, block in parse(raw) if headers.get("warc-type") == "response" for x in derive(headers, block)]
            for lo in range(0, len(rows), 512):
                yield pa.RecordBatch.from_pylist([{"page_id": None, **x} for x in rows[lo : lo + 512]], schema=FIELDS)


def derive_files(spark, path: str) -> DataFrame:
    """The derived records of the responses in WARC files that Spark can read."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_parse_files, SCHEMA)


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, n, out = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, None
        for b in batches:
            for row in b.to_pylist():
                if out is None:
                    where, at = file_system(name)
                    where.create_dir(at.rsplit("/", 1)[0], recursive=True)
                    out = where.open_output_stream(at, compression=None)
                out.write(gzip.compress(record_bytes(row), 6, mtime=0))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["file", "n_records"])

    return run


def write_warc(records: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes records to gzipped files in a shared folder; returns their manifest."""
    folder = folder or f"{shared_dir(records.sparkSession)}/warc-{uuid.uuid4().hex}"
    return cut(records.select(*FIELDS.names).mapInArrow(_write(folder), "file string, n_records long"))
