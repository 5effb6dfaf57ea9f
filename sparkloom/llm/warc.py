"""WARC derivatives: from each response record a linked metadata record and a plain-text conversion record.

Both name the response in WARC-Refers-To and keep its target, date, source headers and payload digest. Records are parsed and
made row by row in Arrow batches; nothing is exchanged, so no host or page can become a hot key.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.tables import table

# Fixed values of the WARC 1.1 format and of HTML.
VERSION, STAMP = "WARC/1.1", "2024-01-01T00:00:00Z"
BLOCKS = "address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul title".split()
RAW = ("script", "style", "noscript", "template")
# Only how markup begins: its end is looked for once, so that unclosed markup costs no more than other text.
_MARK = re.compile(r"<(?:!--|[!?]|/?([a-zA-Z][a-zA-Z0-9]*))")
_CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
_HREF = re.compile(r"""\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_LANG = re.compile(r"""\blang\s*=\s*["']?([A-Za-z-]+)""", re.I)
_END_TITLE = re.compile(r"</title\s*>", re.I)
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([A-Za-z0-9_-]+)", re.I)
_ZEROS, _HUGE = re.compile(r"&#0+(?=[0-9])"), re.compile(r"&#[1-9][0-9]{7,};?")
_SPACES, _LINES = re.compile(r"[^\S\n]+"), re.compile(r" ?\n[ \n]*")
RECORDS = "page_id bigint, type string, record_id string, refers_to string, target_uri string, headers map<string,string>, source_headers map<string,string>, payload_digest string, block_digest string, block binary"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    """A name-based urn:uuid, so that reruns give the same identifiers."""
    h = bytearray(hashlib.sha1("\0".join(parts).encode("utf-8", "surrogatepass")).digest()[:16])
    h[6], h[8] = h[6] & 15 | 80, h[8] & 63 | 128
    x = h.hex()
    return f"<urn:uuid:{x[:8]}-{x[8:12]}-{x[12:16]}-{x[16:20]}-{x[20:]}>"


def serialise(headers: dict[str, str], block: bytes) -> bytes:
    """One WARC record. Line breaks in header values become spaces."""
    lines = [VERSION, *(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}" for k, v in headers.items()), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(raw: bytes) -> dict[str, str]:
    """Header fields; folded lines are joined, of repeated names the values are joined by a comma."""
    out: dict[str, str] = {}
    name = ""
    for line in raw.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip()
            out[name] = f"{out[name]}, {value.strip()}" if name in out else value.strip()
    return out


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record; the block is what Content-Length says, or all that is there."""
    head, _, rest = record.partition(b"\r\n\r\n")
    headers = _fields(head.partition(b"\r\n")[2])
    size = headers.get("Content-Length", "")
    return headers, rest[: int(size)] if size.isdigit() else rest.removesuffix(b"\r\n\r\n")


def http_parts(block: bytes) -> tuple[str, dict[str, str], bytes]:
    """Status line, header fields and body without its transfer encoding: chunks are joined up to the last whole one."""
    head, _, payload = block.partition(b"\r\n\r\n")
    status, _, fields = head.partition(b"\r\n")
    named = _fields(fields)
    if "chunked" in _field(named, "Transfer-Encoding").lower():
        payload = _unchunked(payload)
    return status.decode("latin-1"), named, payload


def _field(fields: dict[str, str], name: str) -> str:
    return next((v for k, v in fields.items() if k.lower() == name.lower()), "")


def _unchunked(raw: bytes) -> bytes:
    """The chunks' bytes. A body that does not begin with a chunk is taken as it is."""
    out, at = [], 0
    while True:
        end = raw.find(b"\r\n", at)
        size = raw[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", size):
            return b"".join(out) if out else raw
        n = int(size, 16)
        if not n:
            return b"".join(out)
        out.append(raw[end + 2 : end + 2 + n])
        at = end + 2 + n + 2


def decoded(payload: bytes, encoding: str) -> bytes:
    """The payload without its content encodings (gzip, deflate, zstd). What cannot be decoded stays as it is; of a cut-off stream the readable part is taken."""
    for name in reversed([x.strip().lower() for x in encoding.split(",") if x.strip()]):
        try:
            if name in ("gzip", "x-gzip"):
                payload = zlib.decompressobj(47).decompress(payload)
            elif name == "deflate":
                try:
                    payload = zlib.decompressobj().decompress(payload)
                except zlib.error:
                    payload = zlib.decompressobj(-15).decompress(payload)
            elif name == "zstd":
                import zstandard

                payload = zstandard.ZstdDecompressor().decompressobj().decompress(payload)
            elif name != "identity":
                break
        except Exception:  # noqa: BLE001 - each codec has errors of its own; all mean that these bytes are not of that encoding
            break
    return payload


def unescape(text: str) -> str:
    """Entities resolved; numbers may be of any length."""
    return html.unescape(_HUGE.sub("\ufffd", _ZEROS.sub("&#", text)) if "&#" in text else text)


@dataclass
class Page:
    text: str
    links: list[str]
    title: str
    language: str


def read_page(page: str, base: str = "") -> Page:
    """Text outside markup, distinct absolute targets of anchors in order, first title and language, from one linear pass.

    Scripts, styles and comments go, block elements break lines, entities are resolved. Markup that never closes is text,
    but for a comment, which takes the rest.
    """
    out, found, at, title, language = [], {}, 0, None, ""
    while m := _MARK.search(page, at):
        name, end = m[1], page.find(">", m.end())
        if m[0] == "<!--":
            out.append(page[at : m.start()])
            end = page.find("-->", m.end())
            at = len(page) if end < 0 else end + 3
            continue
        if end < 0:
            # no markup ends behind this point: only a comment still counts
            rest = page.find("<!--", m.start())
            out.append(page[at:] if rest < 0 else page[at:rest])
            at = len(page)
            break
        out.append(page[at : m.start()])
        at = end + 1
        if name is None:
            continue
        name, opens = name.lower(), page[m.start() + 1] != "/"
        if name in _BLOCKS:
            out.append("\n")
        if name in _CLOSE:
            if opens:
                closed = _CLOSE[name].search(page, at)
                at = closed.end() if closed else len(page)
        elif name == "a" and (h := _HREF.search(page, m.end(), end)):
            target = unescape(next(x for x in h.groups() if x is not None)).strip()
            try:
                found[urljoin(base, target)] = None
            except ValueError:
                found[target] = None
        elif name == "html" and not language and (lang := _LANG.search(page, m.end(), end)):
            language = lang[1]
        elif name == "title" and opens and title is None:
            closed = _END_TITLE.search(page, at)
            title = page[at : closed.start() if closed else len(page)]
    out.append(page[at:])
    # a title holds text alone: markup in it is read once more, and a title in that is none
    return Page(_tidy("".join(out)), list(found), (read_page(title).text if "<" in title else _tidy(title)) if title else "", language)


def _tidy(text: str) -> str:
    return _LINES.sub("\n", _SPACES.sub(" ", unescape(text))).strip()


_BLOCKS = frozenset(BLOCKS)


def plain_text(page: str) -> str:
    return read_page(page).text


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id and warc: a response record of each page. Null url or html counts as empty.

    Record identifiers name page, url and payload: rows that repeat an id with other contents have their own, rows that are equal
    are one record.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, url, page in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "html")), strict=True):
                url, payload = url or "", (page or "").encode()
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
                headers = {"WARC-Type": "response", "WARC-Record-ID": record_id("response", str(key), url, digest(payload)), "WARC-Date": STAMP, "WARC-Target-URI": url, "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": digest(payload), "WARC-Block-Digest": digest(block)}
                out.append(serialise(headers, block))
            yield pa.RecordBatch.from_arrays([batch["page_id"], pa.array(out, pa.binary())], names=["page_id", "warc"])

    src = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return src.mapInArrow(work, "page_id bigint, warc binary")


def derive(records: DataFrame) -> DataFrame:
    """Two rows for each response record in `warc`: its metadata and its conversion record, as fields and block.

    Records of other types give none, null or broken ones neither. A wrong or absent payload digest is made anew and the
    source's is kept among source_headers. Transfer and content encodings are undone before a page is read; the payload digest is that of the
    payload before content decoding. Text that isn't in its declared charset is read with replacements. Rows stand alone:
    repeated records give repeated rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, raw in zip(batch["page_id"].to_pylist(), batch["warc"].to_pylist(), strict=True):
                if not raw:
                    continue
                headers, block = parse(raw)
                if headers.get("WARC-Type") != "response":
                    continue
                status, fields, payload = http_parts(block)
                source, uri = headers.get("WARC-Record-ID", ""), headers.get("WARC-Target-URI", "")
                charset = _CHARSET.search(_field(fields, "Content-Type"))
                body = decoded(payload, _field(fields, "Content-Encoding"))
                try:
                    page = body.decode(charset[1] if charset else "utf-8", "replace")
                except LookupError:
                    page = body.decode("utf-8", "replace")
                read = read_page(page, uri)
                text, own = read.text.encode("utf-8", "replace"), digest(payload)
                facts = [("sourceStatus", status), ("title", read.title), ("language", read.language), ("textLength", str(len(text)))]
                facts += [("outlink", x) for x in read.links]
                meta = "".join(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}\r\n" for k, v in facts).encode("utf-8", "replace")
                shared = {"WARC-Date": headers.get("WARC-Date", STAMP), "WARC-Target-URI": uri, "WARC-Refers-To": source, "WARC-Payload-Digest": own}
                for kind, mime, data in (("metadata", "application/warc-fields", meta), ("conversion", "text/plain; charset=utf-8", text)):
                    name = record_id(kind, source, own)
                    made = {"WARC-Type": kind, "WARC-Record-ID": name, **shared, "Content-Type": mime, "WARC-Block-Digest": digest(data)}
                    kept = {k: v for k, v in headers.items()} | {f"http:{k}": v for k, v in fields.items()}
                    rows.append((key, kind, name, source, uri, list(made.items()), list(kept.items()), own, made["WARC-Block-Digest"], data))
            kinds = (pa.int64(), *[pa.string()] * 4, pa.map_(pa.string(), pa.string()), pa.map_(pa.string(), pa.string()), pa.string(), pa.string(), pa.binary())
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            names = ["page_id", "type", "record_id", "refers_to", "target_uri", "headers", "source_headers", "payload_digest", "block_digest", "block"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return records.select("page_id", "warc").mapInArrow(work, RECORDS)


def as_records(derived: DataFrame) -> DataFrame:
    """page_id and warc: the derived rows as serialised records, ready to be appended to files."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [serialise(dict(h), b) for h, b in zip(batch["headers"].to_pylist(), batch["block"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["page_id"], pa.array(out, pa.binary())], names=["page_id", "warc"])

    return derived.select("page_id", "headers", "block").mapInArrow(work, "page_id bigint, warc binary")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = derive(responses(table(spark, sf_dir, "pages")))
    return out.select(
        "page_id", "type", "record_id", "refers_to", "target_uri", F.col("source_headers")["WARC-Payload-Digest"].alias("source_digest"),
        "payload_digest", "block_digest", F.octet_length("block").cast("bigint").alias("n_bytes"), F.sha2("block", 256).alias("block_sha256"),
    )
