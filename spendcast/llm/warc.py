"""Records derived from web archive responses: linked metadata and plain text.

Every response record gives a ``metadata`` record (its HTTP status and headers, title and links) and a ``conversion``
record (its text). Both refer to the response by its identifier and repeat its target, date and payload digest, so
the chain from text to capture stays whole. Identifiers are made from that of the response: a second run, or a
repeated task, names the same records.
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
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendcast.llm.text import map_columns, python_workers

VERSION = "WARC/1.1"
HIDDEN = re.compile(r"<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)", re.I | re.S)
BLOCKS = re.compile(
    r"</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p"
    r"|pre|section|table|td|th|title|tr|ul)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>",
    re.I,
)
TAG = re.compile(r"</?[a-z!?](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>", re.I)
TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.I | re.S)
ANCHOR = re.compile(r"<a\s(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>", re.I)
HREF = re.compile(r"\shref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
DERIVED = "warc_type string, record_id string, refers_to string, target_uri string, date string, "
DERIVED += "content_type string, content_length long, block_digest string, payload_digest string, record binary"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def identifier(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(parts))}>"


def one_line(value: str) -> str:
    """Header values stay on one line, whatever a page holds."""
    return " ".join(value.split())


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {one_line(v)}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return f"{VERSION}\r\n{head}\r\n".encode("utf-8", "replace") + block + b"\r\n\r\n"


def read_record(raw: bytes) -> tuple[dict[str, str], bytes] | None:
    """Header fields, names in lower case, and block of one record, zipped or not; None if it is damaged."""
    try:
        if raw[:2] == b"\x1f\x8b":
            raw = gzip.decompress(raw)
        head, _, rest = raw.partition(b"\r\n\r\n")
        version, *lines = head.decode("utf-8", "replace").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        length = int(fields["content-length"])
    except (OSError, EOFError, KeyError, ValueError, zlib.error):
        return None
    return (fields, rest[:length]) if version.startswith("WARC/") and len(rest) >= length else None


def split_records(data: bytes) -> Iterator[bytes]:
    """The records of a whole file, zipped by member or plain. What follows a damaged record is left out."""
    if data[:2] == b"\x1f\x8b":
        while data:
            part = zlib.decompressobj(31)
            try:
                yield part.decompress(data) + part.flush()
            except zlib.error:
                return
            data = part.unused_data
        return
    at = 0
    while (end := data.find(b"\r\n\r\n", at)) >= 0:
        found = re.search(rb"\r\ncontent-length:\s*(\d+)", data[at:end], re.I)
        if not found:
            return
        stop = end + 4 + int(found[1]) + 4
        yield data[at:stop]
        at = stop


def text_of(page: str) -> str:
    """Text without scripts, styles, comments and tags; a block of the page begins a line; entities are resolved."""
    bare = TAG.sub("", BLOCKS.sub("\n", HIDDEN.sub(" ", page)))
    lines = (" ".join(line.split()) for line in html.unescape(bare).split("\n"))
    return "\n".join(line for line in lines if line)


def response(key: object, url: str | None, page: str | None, date: str) -> bytes:
    """A response record for a captured page; a NULL page is an empty payload, a NULL address an empty target."""
    payload = (page or "").encode("utf-8", "replace")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = head.encode() + payload
    fields = [
        ("WARC-Type", "response"),
        ("WARC-Record-ID", identifier("response", str(key), url or "", digest(payload))),
        ("WARC-Date", date),
        ("WARC-Target-URI", url or ""),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Block-Digest", digest(block)),
        ("WARC-Payload-Digest", digest(payload)),
    ]
    return record(fields, block)


def derive(raw: bytes) -> list[dict]:
    """The metadata and the conversion record of one response; none for other or damaged records."""
    read = read_record(raw)
    if read is None or read[0].get("warc-type") != "response":
        return []
    fields, block = read
    head, _, payload = block.partition(b"\r\n\r\n")
    status, *headers = head.decode("latin-1").split("\r\n")
    charset = re.search(r"charset=[\"']?([\w-]+)", head.decode("latin-1"), re.I)
    try:
        page = payload.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        page = payload.decode("utf-8", "replace")
    source, url, date = (fields.get(x, "") for x in ("warc-record-id", "warc-target-uri", "warc-date"))
    source_digest = fields.get("warc-payload-digest") or digest(payload)
    title = TITLE.search(page)
    shown = HIDDEN.sub(" ", page)
    about = [("http-status", status), *((f"http-header-{k.strip().lower()}", v) for k, _, v in (h.partition(":") for h in headers) if k)]
    if title:
        about.append(("title", html.unescape(title[1])))
    for link in filter(None, (HREF.search(m.group()) for m in ANCHOR.finditer(shown))):
        target = html.unescape(next(x for x in link.groups() if x is not None))
        try:
            about.append(("outlink", urljoin(url, target.strip())))
        except ValueError:  # an address that can't be joined is kept as written
            about.append(("outlink", target))
    metadata = "".join(f"{k}: {one_line(v)}\r\n" for k, v in about).encode("utf-8", "replace")
    out = []
    for kind, content, made in (
        ("metadata", "application/warc-fields", metadata),
        ("conversion", "text/plain; charset=UTF-8", text_of(page).encode("utf-8", "replace")),
    ):
        row = {
            "warc_type": kind,
            "record_id": identifier(kind, source),
            "refers_to": source,
            "target_uri": url,
            "date": date,
            "content_type": content,
            "content_length": len(made),
            "block_digest": digest(made),
            "payload_digest": source_digest,
        }
        row["record"] = record(
            [
                ("WARC-Type", kind),
                ("WARC-Record-ID", row["record_id"]),
                ("WARC-Refers-To", source),
                ("WARC-Target-URI", url),
                ("WARC-Date", date),
                ("WARC-Source-Payload-Digest", source_digest),
                ("Content-Type", content),
                ("WARC-Block-Digest", row["block_digest"]),
            ],
            made,
        )
        out.append(row)
    return out


def responses(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """``key`` and ``record`` of captured pages. The pages carry no date of their own, so all take ``date``."""
    # the key is read as it is for the identifier, and carried as it is
    def make(keys: list, urls: list[str | None], found: list[str | None]) -> tuple:
        return None, [[response(*x, date) for x in zip(keys, urls, found, strict=True)]]

    inputs = [F.col(f"`{key}`"), F.col(f"`{url}`").cast("string"), F.col(f"`{page}`").cast("string")]
    return map_columns(pages, [key], inputs, make, "record binary")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``file`` and ``record`` of all records in the archive files at ``path``, zipped by record or plain."""
    python_workers(spark)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, data in zip(b["path"], b["content"], strict=True):
                for raw in split_records(data):
                    yield pd.DataFrame({"file": [name], "record": [raw]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(split, "file string, record binary")


def derivatives(records: DataFrame, key: str = "page_id", raw: str = "record") -> DataFrame:
    """Two rows per response record: ``key``, the fields of the derived record, and its bytes as ``record``.

    Records of other types, damaged ones and NULL give no row. A response without text gives an empty conversion.
    Repeated records give repeated rows. An empty table gives an empty one. Each record is worked on by itself: there
    is no shuffle.
    """
    columns = [x.split()[0] for x in DERIVED.split(", ")]

    def build(given: list[bytes | None]) -> tuple:
        rows = [(place, r) for place, data in enumerate(given) if data is not None for r in derive(data)]
        return [place for place, _ in rows], [[r[c] for _, r in rows] for c in columns]

    return map_columns(records, [key], [F.col(f"`{raw}`")], build, DERIVED)
