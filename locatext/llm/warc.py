"""WARC records and the derivative builder.

``responses`` turns fetched pages into response records; ``read_warc`` reads them from
WARC files. ``derive`` converts every response into two linked records: ``metadata``
(source headers and figures of the payload) and ``conversion`` (the plain text). Both
refer to the response by WARC-Refers-To and keep its target URI and date; the payload
digest and the source's HTTP headers go with them. Record ids are name-based UUIDs of
what they identify, so a task that runs again makes the same records."""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locatext.llm.arrays import BATCH_BYTES, bound_batches

_SPACE_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space of URLs (RFC 4122)
RECORD = "record_id string, record_type string, refers_to string, target_uri string, warc_date string, content_type string, payload_digest string, block_digest string, source_headers string, block binary"
_RECORD_ARROW = pa.schema([(n.split()[0], pa.binary() if n.endswith("binary") else pa.string()) for n in RECORD.split(", ")])
#: Date of records whose source gives none.
NO_DATE = "1970-01-01T00:00:00Z"

_DROP = re.compile(r"<!--.*?(?:-->|$)|<(script|style|noscript|template|head)\b[^>]*>.*?(?:</\1\s*>|$)", re.S | re.I)
_BREAKS = re.compile(r"<(?:br|/?(?:p|div|li|ul|ol|h[1-6]|tr|table|section|article|nav|header|footer|aside|main|blockquote|pre|form|dl|dt|dd|hr))\b[^>]*>", re.I)
_TAGS = re.compile(r"<[/!?A-Za-z][^>]*(?:>|$)")


def digest(data: bytes) -> str:
    """A labelled digest as WARC headers carry it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE_NAMES, chr(0).join(parts))}>"


def plain_text(page: str) -> str:
    """All visible text, a line per block; nothing is judged or dropped as boilerplate."""
    lines = html.unescape(_TAGS.sub("", _BREAKS.sub("\n", _DROP.sub("\n", page)))).split("\n")
    return "\n".join(t for x in lines if (t := " ".join(x.split())))


def _field(value: str) -> str:
    """A header value cannot hold line ends."""
    return re.sub(r"[\r\n]+", " ", value)


def serialise(r: dict) -> bytes:
    """One record of the WARC/1.1 format."""
    names = [("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Date", "warc_date"), ("WARC-Target-URI", "target_uri"), ("WARC-Refers-To", "refers_to"), ("WARC-Payload-Digest", "payload_digest"), ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type")]
    head = "WARC/1.1\r\n" + "".join(f"{n}: {_field(r[k])}\r\n" for n, k in names if r[k]) + f"Content-Length: {len(r['block'])}\r\n\r\n"
    return head.encode() + r["block"] + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[dict]:
    """Records of a WARC file, plain or gzipped (one member per record or one for all),
    one after the other: only the record at hand is unpacked."""
    raw = io.BytesIO(data)
    file = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if data[:2] == b"\x1f\x8b" else raw
    while line := file.readline():
        if not line.startswith(b"WARC/"):
            continue
        fields = {}
        while (line := file.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields.get("content-length") or 0)
        block = file.read(size)
        yield {"record_id": fields.get("warc-record-id"), "record_type": fields.get("warc-type"), "refers_to": fields.get("warc-refers-to"), "target_uri": fields.get("warc-target-uri"), "warc_date": fields.get("warc-date"), "content_type": fields.get("content-type"), "payload_digest": fields.get("warc-payload-digest"), "block_digest": fields.get("warc-block-digest") or digest(block), "source_headers": None, "block": block}


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files; Spark lists and opens the files, so any store works. A file
    is one row of Spark's binary source (2 GB at most; crawls write files of 1 GB), and
    its records leave in batches of about ``BATCH_BYTES``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                held: list[dict] = []
                size = 0
                for record in parse_records(data.as_py()):
                    held.append(record)
                    size += len(record["block"])
                    if size > BATCH_BYTES:
                        yield from pa.Table.from_pylist(held, _RECORD_ARROW).to_batches()
                        held, size = [], 0
                yield from pa.Table.from_pylist(held, _RECORD_ARROW).to_batches()

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def responses(pages: DataFrame) -> DataFrame:
    """Response records of fetched ``pages`` (url, html; ``page_id`` where there is one
    makes ids of repeated rows differ). Null url and html are empty."""
    key = F.col("page_id") if "page_id" in pages.columns else F.lit(None)
    src = bound_batches(pages).select(F.coalesce(key.cast("string"), F.lit("")).alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                payload = r["html"].encode()
                headers = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}"
                block = headers.encode() + b"\r\n\r\n" + payload
                out.append({"record_id": record_id("response", r["page_id"], r["url"]), "record_type": "response", "refers_to": None, "target_uri": r["url"], "warc_date": NO_DATE, "content_type": "application/http; msgtype=response", "payload_digest": digest(payload), "block_digest": digest(block), "source_headers": headers, "block": block})
            yield from pa.Table.from_pylist(out, _RECORD_ARROW).to_batches()

    return src.mapInArrow(run, RECORD)


def derive_one(r: dict) -> list[dict]:
    """The metadata and the conversion record of one response."""
    block = r["block"] or b""
    head, cut, payload = block.partition(b"\r\n\r\n")
    if not cut:
        head, payload = b"", block
    headers = head.decode("utf-8", "replace")
    source = r["record_id"] or ""
    charset = re.search(r"(?im)^content-type:[^\r\n]*charset=[\"']?([\w.:-]+)", headers)
    try:
        page = payload.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        page = payload.decode("utf-8", "replace")
    text = plain_text(page).encode("utf-8", "replace")
    title = re.search(r"<title[^>]*>(.*?)</title", page, re.S | re.I)
    payload_digest = r["payload_digest"] or digest(payload)
    about = [("fetched-from", r["target_uri"] or ""), ("source-payload-digest", payload_digest), ("source-block-digest", r["block_digest"] or digest(block)), ("payload-bytes", str(len(payload))), ("text-bytes", str(len(text))), ("text-digest", digest(text)), ("title", " ".join(html.unescape(title[1]).split()) if title else ""), ("charset", charset[1].lower() if charset else "utf-8")]
    about += [(f"source-header-{i}", line) for i, line in enumerate(headers.split("\r\n")) if line]
    fields = "".join(f"{k}: {_field(v)}\r\n" for k, v in about).encode()
    common = {"refers_to": source, "target_uri": r["target_uri"], "warc_date": r["warc_date"] or NO_DATE, "source_headers": headers}
    return [
        common | {"record_id": record_id("metadata", source), "record_type": "metadata", "content_type": "application/warc-fields", "payload_digest": payload_digest, "block_digest": digest(fields), "block": fields},
        common | {"record_id": record_id("conversion", source), "record_type": "conversion", "content_type": "text/plain; charset=utf-8", "payload_digest": payload_digest, "block_digest": digest(text), "block": text},
    ]


def derive(records: DataFrame) -> DataFrame:
    """Metadata and conversion records of every ``response`` in ``records``; records of
    other types give none. Nulls count as absent headers or an empty block; repeated
    responses give repeated derivatives; further columns are ignored."""
    src = bound_batches(records).where(F.col("record_type") == "response").select(*[n.split()[0] for n in RECORD.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                out = [d for r in batch.slice(at, 500).to_pylist() for d in derive_one(r)]
                yield from pa.Table.from_pylist(out, _RECORD_ARROW).to_batches()

    return src.mapInArrow(run, RECORD)


def with_bytes(records: DataFrame) -> DataFrame:
    """The records and ``warc``: each serialised, ready to be joined into files."""
    names = [n.split()[0] for n in RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("warc", pa.array([serialise({**r, "block": r["block"] or b""}) for r in batch.to_pylist()], pa.binary()))

    return records.select(*names).mapInArrow(run, RECORD + ", warc binary")
