"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are sequences of words (runs of ASCII letters, digits
and non-ASCII characters, A-Z lower-cased; punctuation only separates). Shared runs of
``MIN_MATCH`` words are the seeds: they are joined by hash, and only a document's
neighbourhood of its seeds is tiled. Tiling repeatedly marks the longest matches that
do not overlap marked words, found by running Karp-Rabin over shrinking search
lengths, so passages whose sentences were reordered are still covered. A pair is
reported where the tiles cover at least ``COVERAGE`` of the item's words.

The benchmark is taken in parts of at most ``PART_BYTES`` of text; each part is
broadcast and all documents are read against it. No part depends on the documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locatext.llm import arrays
from locatext.llm.arrays import bound_batches, LOWER, mix, span_hashes, text_slices

MIN_MATCH = 5
COVERAGE = 0.5
#: Bound of what is broadcast at once: benchmark text in bytes.
PART_BYTES = 32 << 20
_SIEVE_BITS = 22

IS_ALNUM = np.zeros(256, dtype=bool)
IS_ALNUM[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def _words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all rows and each row's first word."""
    low = LOWER[buf]
    starts, ends, first = arrays.words(low, offs, IS_ALNUM)
    return span_hashes(low, starts, ends), first


def _runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words."""
    n = len(h) - k + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(k if n > 0 else 0):
        out = mix(out + h[i : i + n] + np.uint64(i + 1))
    return out


def tiles(item: list[int], text: list[int], min_match: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling by running Karp-Rabin: (item start, text start, length) of
    non-overlapping matches of at least ``min_match``, longest first. Ties go to the
    smaller item position, then text position."""
    m, n = len(item), len(text)
    used_i, used_t = bytearray(m), bytearray(n)
    out: list[tuple[int, int, int]] = []
    base, mod = 0x5BD1E995, (1 << 61) - 1

    def windows(seq: list[int], used: bytearray, s: int) -> Iterator[tuple[int, int]]:
        """(start, Karp-Rabin hash) of every unmarked window of s words."""
        top, h, run = pow(base, s, mod), 0, 0
        for j, x in enumerate(seq):
            if used[j]:
                h = run = 0
                continue
            h = (h * base + x) % mod
            run += 1
            if run > s:
                h = (h - seq[j - s] * top) % mod
            if run >= s:
                yield j - s + 1, h

    s = max(min_match, min(m, n))
    while True:
        while True:  # one search length until it marks nothing more
            table: dict[int, list[int]] = {}
            for i, h in windows(item, used_i, s):
                table.setdefault(h, []).append(i)
            found, longest = [], 0
            if table:
                for t, h in windows(text, used_t, s):
                    for i in table.get(h, ()):
                        if i and t and item[i - 1] == text[t - 1] and not used_i[i - 1] and not used_t[t - 1]:
                            continue  # met from its own start
                        k = 0
                        while i + k < m and t + k < n and item[i + k] == text[t + k] and not used_i[i + k] and not used_t[t + k]:
                            k += 1
                        if k >= s:
                            found.append((-k, i, t))
                            longest = max(longest, k)
            marked = False
            for k, i, t in sorted(found):
                k = -k
                if k < longest:
                    break  # what these marks leave of a longer match may beat it: look again
                if not any(used_i[i : i + k]) and not any(used_t[t : t + k]):
                    used_i[i : i + k] = used_t[t : t + k] = b"\x01" * k
                    out.append((i, t, k))
                    marked = True
            if not marked:
                break
        if s <= min_match:
            return out
        s = max(min_match, s // 2)


class Benchmark:
    """One part of the benchmark: word hashes of its items and the seed table."""

    def __init__(self, ids: list, texts: list[str], min_match: int):
        self.ids, self.min_match = ids, min_match
        self.items: list[np.ndarray] = []
        hashes, owners, kinds = [], [], []
        for lo, _, offs, buf in text_slices(pa.array(texts, pa.string())):
            h, first = _words(buf, offs)
            for r in range(len(offs) - 1):
                w = h[first[r] : first[r + 1]]
                self.items.append(w)
                k = min(min_match, len(w))
                if k:
                    seeds = _runs(w, k)
                    hashes.append(seeds)
                    owners.append(np.full(len(seeds), lo + r))
                    kinds.append(np.full(len(seeds), k))
        #: Seed length -> (sorted hashes, owning items, sieve of hash bits).
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        if hashes:
            h, o, k = map(np.concatenate, (hashes, owners, kinds))
            for size in np.unique(k):
                pick = k == size
                order = np.lexsort((o[pick], h[pick]))
                own = h[pick][order]
                sieve = np.zeros(1 << _SIEVE_BITS, dtype=bool)
                sieve[own >> np.uint64(64 - _SIEVE_BITS)] = True
                self.seeds[int(size)] = (own, o[pick][order], sieve)

    def matches(self, h: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(row, item, words of the item, words covered) of pairs that share a seed."""
        pairs: dict[tuple[int, int], set[int]] = {}
        for k, (own, owners, sieve) in self.seeds.items():
            runs = _runs(h, k)
            at = np.flatnonzero(sieve[runs >> np.uint64(64 - _SIEVE_BITS)])
            lo = np.searchsorted(own, runs[at], "left")
            hi = np.searchsorted(own, runs[at], "right")
            some = hi > lo
            at, lo, hi = at[some], lo[some], hi[some]
            row = np.searchsorted(first, at, "right") - 1
            inside = at + k <= first[row + 1]
            for p, a, b, r in zip(at[inside].tolist(), lo[inside].tolist(), hi[inside].tolist(), row[inside].tolist(), strict=True):
                for o in set(owners[a:b].tolist()):
                    pairs.setdefault((r, o), set()).add(p)
        for (r, o), places in sorted(pairs.items()):
            item = self.items[o]
            k = min(self.min_match, len(item))
            text: list[int] = []
            end, row_lo, row_hi, gap = -1, int(first[r]), int(first[r + 1]), 0
            for p in sorted(places):
                a, b = max(row_lo, p - len(item)), min(row_hi, p + k + len(item))
                if a > end and end >= 0:
                    gap -= 1
                    text.append(gap)  # never equal to a word
                a = max(a, end)
                if b > a:
                    text += h[a:b].tolist()
                    end = b
            covered = sum(n for _, _, n in tiles(item.tolist(), text, k))
            yield r, o, len(item), covered


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", min_match: int = MIN_MATCH, coverage: float = COVERAGE, part_bytes: int = PART_BYTES) -> DataFrame:
    """Pairs (id, item_id, item_words, covered_words, coverage) of every document and
    item whose tiles cover at least ``coverage`` of the item. Null or wordless texts and
    items match nothing; items of fewer than ``min_match`` words match whole; repeated
    documents or items are each reported; other columns are not read."""
    spark = docs.sparkSession
    src = bound_batches(docs).select(F.col(id_col).alias("k"), F.col("text").cast("string").alias("text"))
    kind, item_kind = src.schema["k"].dataType.simpleString(), benchmark.schema["item_id"].dataType
    schema = f"k {kind}, item_id {item_kind.simpleString()}, item_words long, covered_words long, coverage double"
    items = benchmark.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // part_bytes))

    def scan(part: DataFrame) -> DataFrame:
        rows = part.collect()  # at most about part_bytes of text
        shared = spark.sparkContext.broadcast(([r["item_id"] for r in rows], [r["text"] for r in rows]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bench = Benchmark(*shared.value, min_match)
            for batch in batches:
                keys = batch.column("k")
                out: list[list] = [[], [], [], [], []]
                for lo, _, offs, buf in text_slices(batch.column("text")):
                    for r, o, words, covered in bench.matches(*_words(buf, offs)):
                        if covered >= coverage * words:
                            for c, v in zip(out, (lo + r, bench.ids[o], words, covered, covered / words), strict=True):
                                c.append(v)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(out[0])), pa.array(out[1]), *(pa.array(c) for c in out[2:])], names=["k", "item_id", "item_words", "covered_words", "coverage"])

        return src.mapInArrow(run, schema)

    found = None
    for i in range(parts):
        part = items if parts == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == i)
        found = scan(part) if found is None else found.unionByName(scan(part))
    return found.withColumnRenamed("k", id_col)
