"""Vectorised text primitives shared by the operators: Arrow string columns are
viewed as one byte buffer plus offsets, and words, shingles and rolling byte
windows are hashed with whole-array numpy arithmetic."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of one Arrow batch from Spark, where the session leaves Spark's default (64 MB,
#: which a task holds twice outside the heap and its worker twice again).
BATCH_BYTES = 8 << 20
_BATCH_CONF, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"

#: Bytes handled in one numpy pass; a longer text is one pass of its own.
SLICE_BYTES = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: everything but space and 0x09-0x0D.
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False


def bound_batches(df: DataFrame) -> DataFrame:
    """``df``, with Arrow batches bounded to ``BATCH_BYTES`` in its session (a longer text
    is a batch of its own). A bound that the user has set stays."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH_CONF) == _BATCH_DEFAULT:
        conf.set(_BATCH_CONF, f"{BATCH_BYTES}b")
    return df


def _power(kind: str, n: int) -> np.ndarray:
    """Powers 0..n-1 of the base (kind "p") or of its inverse mod 2**64 (kind "i")."""
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        steps = np.full(size, _BASE if kind == "p" else _BASE_INV, dtype=np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if size <= SLICE_BYTES * 4:
            _powers[kind] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Split a string column into runs of rows of at most ``limit`` bytes (or one
    row): (first row, end row, offsets from 0, bytes). Nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, offs[lo : hi + 1] - offs[lo], raw[offs[lo] : offs[hi]]
        lo = hi


def words(buf: np.ndarray, offs: np.ndarray, table: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and for each row the index of its
    first word (one more entry at the end). Words never cross rows."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = table[buf]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offs] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (edge[:n] | ~before))
    ends = np.flatnonzero(inside & (edge[1:] | ~after)) + 1
    return starts, ends, np.searchsorted(starts, offs)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of buf[start:end] for every span, from prefix sums."""
    n = len(buf)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _power("p", n + 1)[:n], out=sums[1:])
    h = (sums[ends] - sums[starts]) * _power("i", n + 1)[starts]
    return mix(h + (ends - starts).astype(np.uint64))


def shingles(word_hash: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles row by row and their row offsets. A row of
    1 to k-1 words has its whole sequence as one shingle; one without words none."""
    counts = np.diff(first)
    made = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    out_offs = np.concatenate([[0], np.cumsum(made)])
    total = int(out_offs[-1])
    if not total:
        return np.zeros(0, np.uint64), out_offs
    row = np.repeat(np.arange(len(counts)), made)
    at = np.arange(total) - out_offs[row] + first[row]
    length = np.minimum(counts, k)[row]
    padded = np.concatenate([word_hash, np.zeros(k, np.uint64)])
    h = np.zeros(total, np.uint64)
    for i in range(k):
        part = mix(padded[at + i] + np.uint64(i * 0x9E3779B97F4A7C15 % (1 << 64)))
        h += np.where(i < length, part, np.uint64(0)) if (length < k).any() else part
        h = mix(h)
    return h + length.astype(np.uint64), out_offs


def window_hashes(buf: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k-byte window of one text (prefix sums, no loop)."""
    n = len(buf)
    if n < k:
        return np.zeros(0, np.uint64)
    at = np.arange(n - k + 1)
    return span_hashes(buf, at, at + k)
