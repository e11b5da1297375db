"""Text sources: visible text of HTML, e-mail parts, demonstration lines, binary files."""

from __future__ import annotations

from collections.abc import Iterator
from email import message_from_bytes, policy
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


class _Visible(HTMLParser):
    """Visible text: block elements end lines, scripts and styles say nothing."""

    HIDDEN = frozenset("script style noscript".split())
    BLOCKS = frozenset("p div br li tr h1 h2 h3 h4 h5 h6 table section article blockquote ul ol nav header footer".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        if tag in self.HIDDEN:
            self.hidden += 1
        elif tag in self.BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if tag in self.HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag in self.BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def visible_text(page: str | None) -> str:
    reader = _Visible()
    reader.feed(page or "")
    reader.close()
    return "\n".join(x for line in "".join(reader.parts).split("\n") if (x := " ".join(line.split())))


@F.pandas_udf(StringType())
def visible_text_udf(pages: pd.Series) -> pd.Series:
    return pages.map(visible_text)


def demo_atoms(lines: DataFrame) -> DataFrame:
    """Requirement atoms of ``DEMO_*|subject|object|condition|name=value|...`` lines."""
    rows = lines.withColumn("line", F.explode(F.split("raw_text", "\n"))).where(F.col("line").startswith("DEMO_"))
    f = F.split("line", "\\|")
    properties = F.transform(F.filter(f, lambda x: x.contains("=")), lambda x: F.struct(F.split_part(x, F.lit("="), F.lit(1)).alias("name"), F.split_part(x, F.lit("="), F.lit(2)).alias("value")))
    return rows.select("*", F.regexp_replace(f[0], "^DEMO_", "").alias("category"), F.get(f, F.lit(1)).alias("subject"), F.get(f, F.lit(2)).alias("object"), properties.alias("properties")).drop("line")


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files as evidence rows (file_name, text_line, raw_text); a BOM goes."""
    rows = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file_name"), F.regexp_replace("value", "^﻿", "").alias("text"))
    return rows.select("file_name", F.posexplode(F.split("text", "\r\n|\n|\r")).alias("n", "raw_text")).select("file_name", (F.col("n") + 1).alias("text_line"), "raw_text")


_MAIL = "file_name string, sha256 string, part string, ord int, raw_text string"


def read_emails(spark: SparkSession, path: str) -> DataFrame:
    """Parts of .eml files: HEADERS (one row a header), BODY and ATTACHMENT names. Of
    alternatives the plain text is taken, else the visible text of the HTML."""

    def parts(data: bytes) -> Iterator[tuple[str, str]]:
        message = message_from_bytes(data, policy=policy.default)
        for name in ("Subject", "From", "To", "Cc", "Bcc", "Reply-To", "Date", "Message-ID", "In-Reply-To", "References"):
            for value in message.get_all(name, []):
                yield "HEADERS", f"{name}: {value}"
        body = message.get_body(preferencelist=("plain", "html"))
        if body is not None:
            said = body.get_content()
            yield "BODY", visible_text(said) if body.get_content_type() == "text/html" else said
        for a in message.iter_attachments():
            yield "ATTACHMENT", a.get_filename() or ""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for frame in frames:
            rows = [(p.rsplit("/", 1)[-1], hashlib.sha256(c).hexdigest(), kind, i, said) for p, c in zip(frame["path"], frame["content"], strict=True) for i, (kind, said) in enumerate(parts(bytes(c)))]
            yield pd.DataFrame(rows, columns=["file_name", "sha256", "part", "ord", "raw_text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, _MAIL)
