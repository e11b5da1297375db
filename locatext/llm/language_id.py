"""Language identification: multinomial naive Bayes over hashed character n-grams.

The model is a log-probability matrix (buckets x languages). It is fitted on
all labelled rows that are not held out, and broadcast; its size is fixed by
``BUCKETS`` and the number of languages, never by the input. Scoring takes the whole
texts of a batch at once, as sparse rows of n-gram buckets, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locatext.llm.arrays import bound_batches, text_slices

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
ALPHA = 0.1
#: Code points scored in one numpy pass.
PASS_CHARS = 1 << 19
UND = "und"


@lru_cache(maxsize=1)
def _fold_table() -> np.ndarray:
    """Code point -> lower-case letter, or 32 for whatever is no letter."""
    table = np.full(0x110000, 32, dtype=np.uint32)
    for cp in [*range(0x0000, 0xD800), *range(0xF900, 0x10000), *range(0x10000, 0x20000)]:
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            table[cp] = ord(low) if len(low) == 1 else cp
    table[0x20000:0x32000] = np.arange(0x20000, 0x32000)
    return table


def _code_points(buf: np.ndarray) -> np.ndarray:
    text = buf.tobytes().decode("utf-8")
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def _grams(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, row after it, bucket) of the n-grams of a batch, slice by slice: all
    rows of a slice are one array of folded code points with an edge before and after
    each row. Letters are lower-cased, a run of other code points is one space; n-grams
    without a letter, and those that reach over an edge, are left out."""
    for lo, _, offs, buf in text_slices(column):
        cp = _fold_table()[_code_points(buf)]
        at = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])[offs]
        f = np.insert(cp, at, np.uint32(32))
        edge = np.zeros(len(f), dtype=bool)
        edge[at + np.arange(len(at))] = True
        keep = (f != 32) | edge
        keep[1:] |= f[:-1] != 32
        f, edge = f[keep], edge[keep]
        keep = np.ones(len(f), dtype=bool)
        keep[:-1] = (f[:-1] != 32) | edge[:-1] | ~edge[1:]
        f, edge = f[keep], edge[keep]
        row = np.cumsum(edge) - 1
        for start in range(0, len(f), PASS_CHARS):
            end = start + PASS_CHARS
            yield lo, *_hashed(f[start : end + max(ORDERS) - 1], edge[start : end + max(ORDERS) - 1], row[start:end])


def _hashed(f: np.ndarray, edge: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of the n-grams of all orders that start where ``row`` is given."""
    rows, found = [], []
    is_letter = f != 32
    for n in ORDERS:
        m = min(len(f) - n + 1, len(row))
        if m <= 0:
            continue
        h = np.full(m, n * 0x9E3779B1 & 0xFFFFFFFF, dtype=np.uint32)
        some = np.zeros(m, dtype=bool)
        for i in range(n):
            h = (h ^ f[i : i + m]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(13)
            some |= is_letter[i : i + m]
        for i in range(1, n - 1):
            some &= ~edge[i : i + m]
        h *= np.uint32(0xC2B2AE35)
        found.append((h >> np.uint32(16) if BUCKETS == 1 << 16 else h % np.uint32(BUCKETS))[some])
        rows.append(row[:m][some])
    return (np.concatenate(rows), np.concatenate(found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.uint32))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place: dict[str, int] = {}
    totals = np.zeros((0, BUCKETS), np.int64)
    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        names = langs.dictionary.to_pylist()
        code = np.array([place.setdefault(x, len(place)) for x in names], dtype=np.int64)[langs.indices.to_numpy()]
        totals = np.vstack([totals, np.zeros((len(place) - len(totals), BUCKETS), np.int64)])
        for lo, row, found in _grams(batch.column("text")):
            totals += np.bincount(code[lo + row] * BUCKETS + found, minlength=totals.size).reshape(totals.shape)
    for lang, k in place.items():
        at = np.flatnonzero(totals[k])
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(totals[k][at])],
            names=["lang", "bucket", "n"],
        )


class LanguageModel:
    """Sorted languages and their log-probability matrix and log priors."""

    def __init__(self, langs: list[str], matrix: np.ndarray, prior: np.ndarray):
        self.langs, self.matrix, self.prior = langs, matrix.astype(np.float64), prior

    def score_texts(self, column: pa.Array) -> tuple[list[str], list[float]]:
        n = len(column)
        total = np.tile(self.prior.astype(np.float64), (n, 1))
        letters = np.zeros(n, dtype=bool)
        for lo, row, found in _grams(column):
            # The slice is a sparse matrix of rows by buckets, given by its entries: their
            # log probabilities are summed over each run of one row.
            if len(row):
                start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                np.add.at(total, lo + row[start], np.add.reduceat(self.matrix.take(found, axis=0), start, axis=0))
                letters[lo + row[start]] = True
        if not self.langs or not n:
            return [UND] * n, [0.0] * n
        best = total.argmax(axis=1)
        sure = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        names = [self.langs[k] if some else UND for k, some in zip(best.tolist(), letters.tolist(), strict=True)]
        return names, np.where(letters, sure, 0.0).tolist()


def fit(docs: DataFrame) -> LanguageModel:
    """Fit on all rows of ``docs`` with ``text`` and ``lang``. Rows are counted where
    they are read, a table of buckets by languages a task; no row is moved.
    No labelled row gives a model that answers ``und`` for every text."""
    labelled = bound_batches(docs).where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", F.col("lang").cast("string").alias("lang"))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    counted = labelled.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counted.toArrow()  # at most BUCKETS x languages rows
    counts = np.zeros((BUCKETS, len(langs)))
    column = np.array([langs.index(x) for x in found.column("lang").to_pylist()], dtype=np.int64)
    counts[found.column("bucket").to_numpy(), column] = found.column("n").to_numpy()
    matrix = np.log((counts + ALPHA) / (counts.sum(axis=0) + ALPHA * BUCKETS)).astype(np.float32)
    total = sum(sizes.values())
    return LanguageModel(langs, matrix, np.log(np.array([sizes[x] / total for x in langs])))


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: the id, ``carry`` columns, ``lang_pred`` and
    ``score`` (posterior probability, 0 to 1). Null texts and texts without a
    letter give ``und`` and 0.0; repeated rows are each answered; ties go to the
    language first in order. Other columns are neither read nor needed."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.langs, model.matrix, model.prior))
    keys = [id_col, *carry]
    src = bound_batches(docs).select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keys)], F.col("text").cast("string").alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = LanguageModel(*shared.value)
        for batch in batches:
            names, scores = local.score_texts(batch.column("text"))
            kept = [batch.column(f"k{i}") for i in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*[f"k{i}" for i in range(len(keys))], "lang_pred", "score"])

    kinds = ", ".join(f"k{i} {src.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keys)))
    out = src.mapInArrow(score, f"{kinds}, lang_pred string, score double")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keys)], "lang_pred", "score")


def certain(docs: DataFrame, model: LanguageModel, least: float) -> DataFrame:
    """The rows of ``docs``, with all their columns under whatever names, whose language
    is predicted with a score of ``least`` or more; ``und`` is no language."""
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.matrix, model.prior))
    places = [f"k{i}" for i in range(len(docs.columns))]
    src = bound_batches(docs).select(*[F.col(f"`{c}`").alias(k) for c, k in zip(docs.columns, places, strict=True)], F.col("text").cast("string").alias("text"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = LanguageModel(*shared.value)
        for batch in batches:
            names, scores = local.score_texts(batch.column("text"))
            stays = pa.array([n != UND and s >= least for n, s in zip(names, scores, strict=True)], pa.bool_())
            yield batch.select(places).filter(stays)

    kept = src.mapInArrow(keep, src.select(*places).schema)
    return kept.select(*[F.col(k).alias(c) for c, k in zip(docs.columns, places, strict=True)])


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 4 == 2


def fit_unheld(docs: DataFrame) -> LanguageModel:
    """Fit on the rows that are not held out (crc32 of the id mod 4 is not 2); a
    null id cannot be placed and is held out."""
    return fit(docs.where(~F.coalesce(held_out(), F.lit(True))))
