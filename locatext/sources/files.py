"""Project files of several formats as evidence fragments.

Spark lists and opens the files (``binaryFile``); each is parsed by its extension where
it is read. A file that cannot be parsed is a row with its reason, never an error."""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from email import message_from_bytes, policy
from email.message import EmailMessage
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locatext.sources.text import visible_text

#: Characters read from one text, and bytes that an archive may unpack to.
MAX_CHARS, MAX_UNPACKED, MAX_RATIO = 2_000_000, 200 << 20, 200

FRAGMENT = "file_name string, sha256 string, status string, warnings array<string>, ord int, locator string, raw_text string"
_ARROW = pa.schema([("file_name", pa.string()), ("sha256", pa.string()), ("status", pa.string()), ("warnings", pa.list_(pa.string())), ("ord", pa.int32()), ("locator", pa.string()), ("raw_text", pa.string())])

Fragments = list[tuple[str, str]]


class Unreadable(ValueError):
    pass


def parse_text(data: bytes) -> tuple[Fragments, list[str]]:
    """UTF-8 (with or without a mark) or UTF-16 with a mark; nothing is guessed."""
    try:
        text = data.decode("utf-16" if data[:2] in (b"\xff\xfe", b"\xfe\xff") else "utf-8-sig")
    except UnicodeDecodeError as e:
        raise Unreadable("ENCODING") from e
    warnings = ["TRUNCATED"] if len(text) > MAX_CHARS else []
    return [(f"line {i}", line) for i, line in enumerate(text[:MAX_CHARS].splitlines(), 1) if line.strip()], warnings


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def parse_docx(data: bytes) -> tuple[Fragments, list[str]]:
    """Paragraphs and table rows of the body in order; an archive that unpacks to too
    much, declares entities or lacks a body is unreadable; tracked changes are warned of."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            size = sum(i.file_size for i in z.infolist())
            if size > MAX_UNPACKED or size > MAX_RATIO * max(1, len(data)):
                raise Unreadable("ARCHIVE_TOO_LARGE")
            xml = z.read("word/document.xml")
        if b"<!ENTITY" in xml or b"<!DOCTYPE" in xml:
            raise Unreadable("ENTITIES")
        body = ElementTree.fromstring(xml).find(f"{_W}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        raise Unreadable("NOT_A_DOCUMENT") from e
    if body is None:
        raise Unreadable("NOT_A_DOCUMENT")
    said = lambda node: "".join(t.text or "" if t.tag == f"{_W}t" else "\t" if t.tag == f"{_W}tab" else "" for t in node.iter() if t.tag in (f"{_W}t", f"{_W}tab")).strip()
    out: Fragments = []
    paragraphs = tables = 0
    for child in body:
        if child.tag == f"{_W}p":
            paragraphs += 1
            if text := said(child):
                out.append((f"Paragraph {paragraphs}", text))
        elif child.tag == f"{_W}tbl":
            tables += 1
            for r, row in enumerate(child.iter(f"{_W}tr"), 1):
                cells = [said(c) for c in row.iter(f"{_W}tc")]
                if any(cells):
                    out.append((f"Table {tables} row {r}", " | ".join(cells)))
    changes = any(body.iter(f"{_W}ins")) or any(body.iter(f"{_W}del"))
    return out, ["TRACKED_CHANGES"] if changes else []


def message_key(value: str) -> str:
    return "MSG-" + hashlib.sha256(value.strip().casefold().encode()).hexdigest()[:24]


def body_parts(message: EmailMessage) -> list[tuple[str, str]]:
    """(kind, text) of the body: of alternatives the plain text, of related parts the
    root, other inline text parts one after the other."""
    kind = message.get_content_type()
    if kind == "multipart/alternative":
        found = [body_parts(p) for p in message.iter_parts()]
        plain = next((f for f in found if any(k == "text/plain" for k, _ in f)), None)
        return plain if plain is not None else next((f for f in found if f), [])
    if kind == "multipart/related":
        return next((f for p in message.iter_parts() if (f := body_parts(p))), [])
    if message.is_multipart():
        return [x for p in message.iter_parts() if p.get_content_disposition() != "attachment" for x in body_parts(p)]
    if kind not in ("text/plain", "text/html") or message.get_filename():
        return []
    text = message.get_content()
    return [(kind, visible_text(text) if kind == "text/html" else text)]


_WROTE = re.compile(r"^On .{1,200} wrote:$|^-{2,}\s*(?:Original|Forwarded) Message\s*-{2,}$", re.I)


def split_body(text: str) -> dict[str, str]:
    """Body, quoted history (from a marker line or the first run of quotes on) and
    signature (from the line "-- " on)."""
    parts: dict[str, list[str]] = {"BODY": [], "QUOTED HISTORY": [], "SIGNATURE": []}
    now = "BODY"
    for line in text.splitlines():
        if _WROTE.match(line.strip()) or (line.startswith(">") and now != "QUOTED HISTORY"):
            now = "QUOTED HISTORY"
        elif line == "-- " and now == "BODY":
            now = "SIGNATURE"
        parts[now].append(line)
    return {k: said for k, v in parts.items() if (said := "\n".join(v).strip())}


def attachments(message: EmailMessage) -> Iterator[tuple[int, str, str, bytes]]:
    """(index, name, type, bytes) of the attached parts."""
    parts = (p for p in message.walk() if not p.is_multipart() and (p.get_content_disposition() == "attachment" or p.get_filename()))
    for i, p in enumerate(parts, 1):
        yield i, p.get_filename() or "", p.get_content_type(), p.get_payload(decode=True) or b""


def parse_mail(data: bytes) -> tuple[Fragments, list[str]]:
    """Headers, the parts of the body, attachments by digest, and the keys of the thread."""
    message = message_from_bytes(data, policy=policy.default)
    out: Fragments = []
    for name in ("Subject", "From", "To", "Cc", "Bcc", "Reply-To", "Date"):
        out += [("EMAIL > HEADERS", f"{name}: {v}") for v in message.get_all(name, [])]
    ids = lambda name: re.findall(r"<[^<>\s]+>", " ".join(map(str, message.get_all(name, []))))
    own, parent, references = ids("Message-ID"), ids("In-Reply-To"), ids("References")
    for label, found in (("KEY", own[:1]), ("PARENT", (parent or references)[-1:]), ("REFERENCE", references)):
        out += [(f"EMAIL > THREAD > {label}", message_key(x)) for x in found]
    text = "\n".join(t for _, t in body_parts(message))
    out += [(f"EMAIL > {part}", said) for part, said in split_body(text).items()]
    out += [(f"EMAIL > ATTACHMENT {i}", f"{name} | {kind} | {hashlib.sha256(body).hexdigest()} | {len(body)}") for i, name, kind, body in attachments(message)]
    return out, ["MESSAGE_ID_CONFLICT"] if len(set(map(str.casefold, own))) > 1 else []


def parse_html(data: bytes) -> tuple[Fragments, list[str]]:
    text = visible_text(data.decode("utf-8", "replace"))
    return [(f"line {i}", x) for i, x in enumerate(text.split("\n"), 1) if x], []


PARSERS: dict[str, Callable[[bytes], tuple[Fragments, list[str]]]] = {"txt": parse_text, "docx": parse_docx, "eml": parse_mail, "html": parse_html, "htm": parse_html}


def parse_file(name: str, data: bytes) -> list[dict]:
    """Rows of one file; one row without text where there is none to give."""
    head = {"file_name": name, "sha256": hashlib.sha256(data).hexdigest()}
    parser = PARSERS.get(name.rsplit(".", 1)[-1].lower() if "." in name else "")
    if parser is None:
        return [head | {"status": "UNSUPPORTED", "warnings": ["NO_PARSER"], "ord": 0, "locator": None, "raw_text": None}]
    try:
        found, warnings = parser(data)
    except Unreadable as e:
        return [head | {"status": "FAILED", "warnings": [str(e)], "ord": 0, "locator": None, "raw_text": None}]
    if not found:
        return [head | {"status": "EMPTY", "warnings": warnings, "ord": 0, "locator": None, "raw_text": None}]
    return [head | {"status": "PARSED", "warnings": warnings, "ord": i, "locator": at, "raw_text": text} for i, (at, text) in enumerate(found, 1)]


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Fragments of all files under ``path`` (a folder or pattern); Spark does not list
    files of no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                yield from pa.Table.from_pylist(parse_file(name.rsplit("/", 1)[-1], data.as_py()), _ARROW).to_batches(max_chunksize=2000)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, FRAGMENT)


def import_attachments(mails: DataFrame, wanted: DataFrame) -> DataFrame:
    """Attached files of ``mails`` (file_name, content) that ``wanted`` (file_name, index,
    sha256) names, by place and digest both, as (file_name, index, name, sha256, content)."""
    schema = "file_name string, index int, name string, sha256 string, content binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("file_name").to_pylist(), batch.column("content"), strict=True):
                rows = [(name, i, label, hashlib.sha256(body).hexdigest(), body) for i, label, _, body in attachments(message_from_bytes(data.as_py(), policy=policy.default))]
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["file_name", "index", "name", "sha256", "content"])

    found = mails.select("file_name", F.col("content").cast("binary").alias("content")).mapInArrow(run, schema)
    return found.join(wanted.select("file_name", "index", "sha256").distinct(), ["file_name", "index", "sha256"], "left_semi")
