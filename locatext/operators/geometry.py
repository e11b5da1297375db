"""Page geometry: clustering along a page is sequential (its anchor is a running mean),
so pages are the unit of parallelism. Words are dealt and sorted by page and streamed;
a task holds one page at a time, and no per-group frame is built."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_COLUMNS = ["page", "x0", "y0", "x1", "y1", "text"]


def _per_page(words: DataFrame, f: Callable[[str, list[dict]], list[tuple]], schema: str) -> DataFrame:
    dealt = words.select(*_COLUMNS).repartition("page").sortWithinPartitions("page", "y0", "x0", "text")
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [{"string": pa.string(), "int": pa.int32(), "double": pa.float64()}[c.split()[1]] for c in schema.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * len(kinds), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page: list[dict] = []
        out: list[tuple] = []
        for b in batches:
            for w in b.to_pylist():
                if page and w["page"] != page[0]["page"]:
                    out += f(page[0]["page"], page)
                    page = []
                page.append(w)
            if len(out) > 5000:
                yield batch(out)
                out = []
        if page:
            out += f(page[0]["page"], page)
        if out:
            yield batch(out)

    return dealt.mapInArrow(run, schema)


def lines_of(words: list[dict]) -> list[list[dict]]:
    """Words from the top down; a word joins the line before it if its top is within
    max(2, min(5, 0.45 height)) of the mean of that line's tops."""
    out: list[list[dict]] = []
    total = 0.0
    for w in sorted(words, key=lambda w: (w["y0"], w["x0"])):
        tolerance = max(2.0, min(5.0, 0.45 * max(1.0, w["y1"] - w["y0"])))
        if out and abs(w["y0"] - total / len(out[-1])) <= tolerance:
            out[-1].append(w)
            total += w["y0"]
        else:
            out.append([w])
            total = w["y0"]
    return [sorted(line, key=lambda w: w["x0"]) for line in out]


def word_lines(words: DataFrame) -> DataFrame:
    """Lines of text of every page from word boxes (page, x0, y0, x1, y1, text)."""

    def lines(page: str, ws: list[dict]) -> list[tuple]:
        return [(page, i, min(w["x0"] for w in ws), min(w["y0"] for w in ws), max(w["x1"] for w in ws), max(w["y1"] for w in ws), " ".join(w["text"] for w in ws)) for i, ws in enumerate(lines_of(ws), 1)]

    return _per_page(words, lines, "page string, line int, x0 double, y0 double, x1 double, y1 double, text string")


def column_layout(words: DataFrame, gap: float = 24.0, edge: float = 80.0) -> DataFrame:
    """(page, col, line, text): lines cut at wide gaps, cuts gathered to columns by their
    left edge."""

    def columns(page: str, ws: list[dict]) -> list[tuple]:
        segments = []
        for i, line in enumerate(lines_of(ws), 1):
            cut = [line[0]]
            for w in line[1:]:
                if w["x0"] - cut[-1]["x1"] > gap:
                    segments.append((i, cut))
                    cut = []
                cut.append(w)
            segments.append((i, cut))
        edges: list[float] = []
        for x in sorted(s[1][0]["x0"] for s in segments):
            if not edges or x - edges[-1] > edge:
                edges.append(x)
        return sorted((page, max(k for k, e in enumerate(edges, 1) if e <= s[0]["x0"]), i, " ".join(w["text"] for w in s)) for i, s in segments)

    return _per_page(words, columns, "page string, col int, line int, text string")
