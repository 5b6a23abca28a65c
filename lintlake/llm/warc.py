"""Metadata and conversion records derived from WARC responses.

Every response gives a metadata record (its source headers and measures) and, if its payload is a page or a text, a
conversion record with the payload as plain text. Both refer to the response by identifier, address and date, and carry
the digests of their own block and of the source payload. Identifiers derive from the response's, so running the job
again makes the same records. Rows are handled one by one; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.common import sliced
from lintlake.llm.html import block_texts, parse

RECORDS = ("source_id string, record_type string, record_id string, refers_to string, target_uri string, warc_date string, "
           "content_type string, content_length long, block_digest string, source_digest string, record binary")
_SPACE = uuid.UUID("8c2f1d2e-7d34-5a8b-9a54-3f0f6d1f7a10")
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)
# Codecs of the language that are no character sets of payloads.
_NO_CHARSETS = frozenset("idna punycode undefined unicode-escape raw-unicode-escape unicode_escape raw_unicode_escape mbcs oem".split())
UNPACKED = 1 << 28


def digest(block: bytes) -> str:
    return f"sha256:{hashlib.sha256(block).hexdigest()}"


def responses_of_pages(pages: DataFrame, warc_date: str) -> DataFrame:
    """Response records (source_id, record_id, target_uri, warc_date, block) of fetched pages; the fetch date is not in the table."""
    body = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.length(body).cast("string"), F.lit("\r\n\r\n"))
    key = F.sha2(F.concat_ws("\n", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.coalesce(F.col("url").cast("string"), F.lit("-")), F.sha2(body, 256)), 256)
    parts = [F.substring(key, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return pages.select(
        F.col("page_id").cast("string").alias("source_id"), F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">")).alias("record_id"),
        F.col("url").cast("string").alias("target_uri"), F.lit(warc_date).alias("warc_date"), F.concat(F.encode(head, "UTF-8"), body).alias("block"))


def split_response(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers in their order (folded lines joined) and payload of an HTTP response block."""
    found = re.search(rb"\r?\n\r?\n", block)
    head, payload = (block[:found.start()], block[found.end():]) if found else (b"", block)
    lines = re.sub(r"\r?\n[ \t]+", " ", head.decode("utf-8", "replace")).splitlines()
    if not lines or not lines[0].upper().startswith("HTTP/"):
        return "", [], block
    pairs = [line.split(":", 1) for line in lines[1:] if ":" in line]
    return lines[0], [(name.strip(), value.strip()) for name, value in pairs], payload


def unchunked(payload: bytes) -> bytes | None:
    """The body of a chunked payload; None if it is not one. A payload that was cut off gives what is there."""
    out, at = [], 0
    while at < len(payload):
        end = payload.find(b"\n", at)
        size = re.fullmatch(rb"\s*([0-9A-Fa-f]{1,15})\s*(?:;[^\n]*)?", payload[at:end if end >= 0 else len(payload)].rstrip(b"\r"))
        if not size:
            return None
        length = int(size[1], 16)
        if not length or end < 0:
            break
        out.append(payload[end + 1:end + 1 + length])
        at = end + 1 + length
        at += 2 if payload[at:at + 2] == b"\r\n" else 1
    return b"".join(out)


def unpacked(payload: bytes, headers: list[tuple[str, str]]) -> bytes | None:
    """The payload without its transfer and content encodings; None if one is unknown, broken, or unpacks to over 256 MB."""
    def coded(name: str) -> list[str]:
        return [c.strip().lower() for n, v in headers if n.lower() == name for c in v.split(",") if c.strip()]

    codings = coded("content-encoding") + coded("transfer-encoding")
    for coding in reversed(codings):
        if coding == "identity":
            continue
        if coding == "chunked":
            payload = unchunked(payload)
        elif coding in ("gzip", "x-gzip", "deflate"):
            for window in ((31,) if "gzip" in coding else (15, -15)):
                reader = zlib.decompressobj(window)
                try:
                    found = reader.decompress(payload, UNPACKED)
                    payload = found if not reader.unconsumed_tail else None
                    break
                except zlib.error:
                    found = None
            else:
                payload = None
        else:
            payload = None
        if payload is None:
            return None
    return payload


def decoded(payload: bytes, content_type: str) -> str:
    """Text of a payload by the charset its header names; by UTF-8 where it names none, or one that is none."""
    charset = _CHARSET.search(content_type)
    name = charset[1].lower() if charset else "utf-8"
    try:
        text = payload.decode("utf-8" if name in _NO_CHARSETS else name, "replace")
    except (LookupError, ValueError):  # unknown, not a text codec, or one that refuses the bytes
        text = payload.decode("utf-8", "replace")
    return text.encode("utf-8", "replace").decode("utf-8")


def plain_text(payload: bytes, content_type: str) -> str | None:
    """Text of a page (all its blocks) or of a text payload; None for other kinds."""
    kind = content_type.split(";")[0].strip().lower()
    text = decoded(payload, content_type)
    if kind in ("text/html", "application/xhtml+xml", ""):
        root = parse(text)
        stack = [root]
        while stack:  # a conversion keeps menus and the like: only markup goes
            node = stack.pop()
            node.noise = False
            stack.extend(p for p in node.parts if type(p) is not str)
        # References to lone surrogates are no text either.
        return "\n".join(block_texts(root)).encode("utf-8", "replace").decode("utf-8")
    return text if kind.startswith("text/") else None


def record_bytes(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A WARC/1.1 record; fields without a value are left out."""
    head = "".join(f"{name}: {value}\r\n" for name, value in fields if value is not None)
    return b"WARC/1.1\r\n" + head.encode("utf-8", "replace") + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def derive(source_id: str | None, record_id: str, uri: str | None, date: str, block: bytes, named: dict[str, str | None]) -> list[tuple]:
    """The derived records of one response. ``named`` has the digests that its own record states; they are carried, not recomputed."""
    status, headers, payload = split_response(block)
    kind = next((v for n, v in headers if n.lower() == "content-type"), "")
    body = unpacked(payload, headers)
    source, text = digest(payload), None if body is None else plain_text(body, kind)
    # A header value can't break the line format: control characters become spaces.
    safe = [(n, re.sub(r"[\x00-\x1f\x7f]", " ", v)) for n, v in headers]
    lines = [("source-status", status), *[(f"source-header-{n.lower()}", v) for n, v in safe], ("source-payload-digest", source),
             ("source-payload-length", str(len(payload))), ("source-block-digest", digest(block))]
    lines += [(f"source-record-{n.replace('_', '-')}", re.sub(r"[\x00-\x1f\x7f]", " ", v)) for n, v in named.items() if v is not None]
    if text is not None:
        lines += [("text-length", str(len(text))), ("text-digest", digest(text.encode()))]
    made = [("metadata", "application/warc-fields", "".join(f"{n}: {v}\r\n" for n, v in lines).encode("utf-8", "replace"))]
    if text is not None:
        made.append(("conversion", "text/plain; charset=utf-8", text.encode("utf-8", "replace")))
    ids = {t: f"<urn:uuid:{uuid.uuid5(_SPACE, f'{record_id} {t}')}>" for t, _, _ in made}
    out = []
    for t, content, body in made:
        other = next((i for k, i in ids.items() if k != t), None)
        fields = [("WARC-Type", t), ("WARC-Record-ID", ids[t]), ("WARC-Refers-To", record_id), ("WARC-Concurrent-To", other if t == "metadata" else None),
                  ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date), ("WARC-Target-URI", uri), ("WARC-Date", date),
                  ("WARC-Block-Digest", digest(body)), ("WARC-Source-Payload-Digest", source), ("Content-Type", content)]
        out.append((source_id, t, ids[t], record_id, uri, date, content, len(body), digest(body), source, record_bytes(fields, body)))
    return out


def derivatives(responses: DataFrame) -> DataFrame:
    """Derived records of responses (source_id, record_id, target_uri, warc_date, block), two for a page, one for an image.

    Columns block_digest and payload_digest, if there, are the digests that the response's record states; they go into the metadata
    beside the computed ones. Chunked, gzip and deflate payloads are unpacked first; a payload that can't be has a metadata record
    only. An unknown charset, or one that is no charset, reads as UTF-8. A null address is left out of the headers; a null block is an empty payload; repeated responses give repeated records
    with the same identifiers. An empty table gives no rows.
    """
    names = [part.split()[0] for part in RECORDS.split(", ")]
    kinds = [pa.int64() if n == "content_length" else pa.binary() if n == "record" else pa.string() for n in names]

    own = ("source_id", "record_id", "target_uri", "warc_date", "block")
    digests = [c for c in ("block_digest", "payload_digest") if c in responses.columns]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 500):
            rows = [r for source, key, uri, date, block, *stated in zip(*[batch.column(n).to_pylist() for n in (*own, *digests)], strict=True)
                    for r in derive(source, key or "", uri, date or "", block or b"", dict(zip(digests, stated, strict=True)))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return responses.select(*own, *[F.col(c).cast("string") for c in digests]).mapInArrow(build, RECORDS)
