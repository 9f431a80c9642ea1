"""WARC derivatives: from response records, linked metadata and plain-text conversion records.

A response is (record_id, target_uri, warc_date, http): the HTTP message with its header. Both derivatives name it in
WARC-Refers-To and carry its target URI, date and payload digest; its HTTP header fields are kept in order, repeated ones too. The conversion
record holds the text of the page; the metadata record the title, language, charset, outlinks and the digest
of the conversion. Record ids are derived from the source's id, so a task that runs again makes the same records.

Header names count whatever their case, and folded lines are joined. Chunked, gzip and deflate payloads are undone for text and metadata, while the payload digest is that of
the bytes as they came; of a payload in another coding, or broken, the conversion is empty and the metadata says why.

Edge cases: null html or http is an empty payload with an empty conversion; null url is an empty target; a null id is its own value;
repeated rows give repeated records; markup that never closes is dropped to its end for script, style and comments, else taken as
text; very long pages, of tags that never close too, take time in proportion to their length; header bytes that are no UTF-8 stay as they are in the
record and are replaced in the columns; an empty table gives an empty result; other columns aren't read.
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
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat
from .store import mapped

SPACE_ID = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public name space for URLs
MAX_BODY = 1 << 30  # bytes that a payload may inflate to
DATE = "1970-01-01T00:00:00Z"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BREAK = re.compile(r"</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|nav|header|footer|title|body|head)\b[^>]*>", re.I)
_TAG = re.compile(r"<[a-zA-Z/!?][^>]*>")
_SPACES, _LINES = re.compile(r"[ \t\r\f\v\xa0]{2,}|[\t\r\f\v\xa0]"), re.compile(r" ?\n[ \n]*")
_TITLE, _TITLE_END, _A, _HTML = (re.compile(x, re.I) for x in ("<title", "</title", r"<a\b", r"<html\b"))
_HREF, _LANG = (re.compile(x, re.I) for x in (r"\bhref\s*=\s*[\"']?([^\"'\s>]+)", r"\blang\s*=\s*[\"']?([\w-]+)"))
_LANG_AT, _CHARSET = re.compile(r"\blang", re.I), re.compile(r"charset\s*=\s*[\"']?([\w-]+)", re.I)
FIELDS = "source_id long, warc_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, payload_digest string, block_digest string, content_length long, source_headers array<struct<name: string, value: string>>, block string, record_digest string, record binary"


def digest(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


def _without(tags: re.Pattern, put: str, page: str) -> str:
    """Replace tags. None ends beyond the last ">", so what never closes isn't looked through again and again."""
    end = page.rfind(">") + 1
    return tags.sub(put, page[:end]) + page[end:]


def title_of(page: str) -> str:
    """Text between the first title tag and its end, or nothing. If the first never closes, no later one does."""
    at = _TITLE.search(page)
    start = page.find(">", at.end()) + 1 if at else 0
    end = _TITLE_END.search(page, start) if start else None
    return html.unescape(_without(_TAG, "", page[start : end.start()])) if end else ""


def _tags(start: re.Pattern, page: str, within):
    """``within(from, to)`` for tags in their order; it returns where to go on, or None if the tag has nothing."""
    at, end = 0, -1
    while tag := start.search(page, at):
        if end < tag.end():  # else no ">" has come since
            end = page.find(">", tag.end())
            end = len(page) if end < 0 else end
        at = within(tag.end(), end) or end  # what follows in the same tag has nothing either


def language_of(page: str) -> str:
    """The last lang attribute of the first html tag that has one."""
    found: list[str] = []

    def within(a: int, z: int):
        for m in reversed([*_LANG_AT.finditer(page, a, z)]):
            if not found and (value := _LANG.match(page, m.start(), z)):
                found.append(value[1])
        return len(page) if found else None

    _tags(_HTML, page, within)
    return found[0] if found else ""


def links_of(page: str) -> list[str]:
    """The href of each link, once, in order."""
    found: dict[str, None] = {}

    def within(a: int, z: int):
        if m := _HREF.search(page, a, z):
            found[m[1]] = None
        return m.end() if m else None

    _tags(_A, page, within)
    return [*found]


def plain_text(page: str) -> str:
    """Visible text: a line for each block element, entities resolved, spaces collapsed."""
    page = _without(_TAG, "", _without(_BREAK, "\n", _HIDDEN.sub(" ", page)))
    return _LINES.sub("\n", _SPACES.sub(" ", html.unescape(page))).strip()


def split_http(message: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """Header fields in their order, folded lines joined, and payload. A message without a header is all payload."""
    if not message.startswith(b"HTTP/"):
        return [], message
    head, _, payload = message.partition(b"\r\n\r\n")
    lines: list[str] = []
    for x in head.decode("utf-8", "surrogateescape").split("\r\n")[1:]:
        if x[:1] in (" ", "\t") and lines:
            lines[-1] += " " + x.strip()
        else:
            lines.append(x)
    return [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines) if k.strip()], payload


def field(headers: list[tuple[str, str]], name: str) -> str:
    """The values of a header field, whatever the case of its name, joined by commas."""
    return ", ".join(v for k, v in headers if k.lower() == name)


def _unchunked(raw: bytes) -> bytes:
    """What the chunks of a transfer hold."""
    out, at = [], 0
    while True:
        end = raw.find(b"\r\n", at)
        size = int(raw[at:end].split(b";")[0].strip() or b"x", 16) if end >= 0 else -1
        if size < 0 or len(raw) < end + 2 + size:
            raise ValueError("chunks end early")
        if not size:
            return b"".join(out)
        out.append(raw[end + 2 : end + 2 + size])
        at = end + 4 + size


def _inflated(raw: bytes, bits: int) -> bytes:
    made = zlib.decompressobj(bits)
    out = made.decompress(raw, MAX_BODY)
    if made.unconsumed_tail:
        raise ValueError("larger than MAX_BODY")
    if not made.eof:
        raise ValueError("ends early")
    return out


def body(headers: list[tuple[str, str]], payload: bytes) -> tuple[bytes, str]:
    """The payload without its transfer and content codings, and why there is no body where one can't be undone. Crawlers often undo them and keep the
    header; a payload that isn't coded as its header says is taken as it is."""
    try:
        if "chunked" in field(headers, "transfer-encoding").lower() and re.match(rb"[0-9a-fA-F]+[ \t]*(;[^\r\n]*)?\r\n", payload):
            payload = _unchunked(payload)
        for coding in reversed([x.strip().lower() for x in field(headers, "content-encoding").split(",") if x.strip()]):
            if coding in ("gzip", "x-gzip"):
                payload = _inflated(payload, 31) if payload[:2] == b"\x1f\x8b" else payload
            elif coding == "deflate":
                payload = _inflated(payload, 15) if payload[:1] == b"\x78" else payload
            elif coding != "identity":
                return b"", f"content encoding {coding}"
    except (ValueError, zlib.error) as e:
        return b"", f"broken coding: {e}"
    return payload, ""


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC/1.0 record."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.0\r\n" + head.encode("utf-8", "surrogateescape") + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of an uncompressed WARC file."""
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        lines = raw[at:end].decode("utf-8", "surrogateescape").split("\r\n")
        fields = {k: v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(fields["Content-Length"])
        yield fields, raw[end + 4 : end + 4 + size]
        at = end + 8 + size


def _clean(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value).strip()


def _shown(value: str) -> str:
    return value.encode("utf-8", "surrogateescape").decode("utf-8", "replace")


def derive_one(source: str, uri: str, date: str, message: bytes) -> list[dict]:
    """The conversion and the metadata record of one response."""
    headers, payload = split_http(message)
    charset = _CHARSET.search(field(headers, "content-type"))
    plain, why = body(headers, payload)
    try:
        page = plain.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        page = plain.decode("utf-8", "replace")
    text = plain_text(page).encode()
    lines = [("title", _clean(title_of(page))), ("language", language_of(page)), ("charset", charset[1] if charset else "utf-8"), ("conversion-digest", digest(text))]
    lines += [("conversion-error", why)] if why else []
    meta = "".join(f"{k}: {v}\r\n" for k, v in lines + [("outlink", x) for x in links_of(page)]).encode()
    out = []
    ids = {t: f"<urn:uuid:{uuid.uuid5(SPACE_ID, f'{source} {t}')}>" for t in ("conversion", "metadata")}
    of = digest(payload)
    for kind, what, block in (("conversion", "text/plain; charset=utf-8", text), ("metadata", "application/warc-fields", meta)):
        own = digest(block)
        fields = [("WARC-Type", kind), ("WARC-Record-ID", ids[kind]), ("WARC-Refers-To", source), ("WARC-Target-URI", _clean(uri)), ("WARC-Date", date), ("Content-Type", what), ("WARC-Block-Digest", own), ("WARC-Payload-Digest", of)]
        fields += [(f"X-Source-{k}", v) for k, v in headers]
        out.append({"warc_type": kind, "record_id": ids[kind], "refers_to": source, "target_uri": uri, "warc_date": date, "content_type": what, "payload_digest": of, "block_digest": own, "content_length": len(block), "source_headers": [{"name": _shown(k), "value": _shown(v)} for k, v in headers], "block": block.decode(), "record": record(fields, block)})
    return out


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages as response records: (source_id, record_id, target_uri, warc_date, http)."""
    url, body = F.coalesce(F.col(url_col), F.lit("")), F.coalesce(F.col(html_col), F.lit(""))
    hexed = F.md5(F.concat_ws("\n", F.coalesce(F.col(id_col).cast("string"), F.lit("")), url))
    parts = [F.substring(hexed, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    head, _, rest = HTTP_HEAD.partition("{}")
    http = F.concat(F.lit(head), F.octet_length(body).cast("string"), F.lit(rest), body)
    return pages.select(F.col(id_col).cast("bigint").alias("source_id"), F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">")).alias("record_id"), url.alias("target_uri"), F.lit(DATE).alias("warc_date"), http.cast("binary").alias("http"))


def _derive(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = schema.names
            out: list[list] = [[] for _ in names]
            held = 0
            cols = [flat.column(b, x).to_pylist() for x in ("source_id", "record_id", "target_uri", "warc_date", "http")]
            for number, source, uri, date, message in zip(*cols, strict=True):
                for x in derive_one(source or "", uri or "", date or DATE, message or b""):
                    raw = x["record"]
                    x |= {"source_id": number, "record_digest": digest(raw)}
                    for name, col in zip(names, out, strict=True):
                        col.append(x[name])
                    held += len(raw)
                if held > 8 * flat.BLOCK_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types, strict=True)], schema=schema)
                    out, held = [[] for _ in names], 0
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types, strict=True)], schema=schema)

    return run


def derive(source: DataFrame, records: bool = True) -> DataFrame:
    """Two rows, conversion and metadata, for each response; ``record`` is the whole record as bytes, left out unless ``records``."""
    text = pa.string()
    schema = pa.schema([("source_id", pa.int64()), *((x, text) for x in ("warc_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type", "payload_digest", "block_digest")), ("content_length", pa.int64()), ("source_headers", pa.list_(pa.struct([("name", text), ("value", text)]))), ("block", text), ("record_digest", text), *([("record", pa.binary())] if records else [])])
    fields = FIELDS if records else FIELDS.removesuffix(", record binary")
    return mapped(source.select("source_id", "record_id", "target_uri", "warc_date", "http"), _derive(schema), fields)
