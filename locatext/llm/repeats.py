"""Removal of repeated byte strings (exact substring deduplication).

Every window of ``length`` bytes has one anchor: the ``GRAM``-byte string in it with
the least hash, leftmost on a tie. Equal windows have the same anchor at the same
place, so whatever repeats meets at a shared anchor. The windows of a text that have
the same anchor occurrence make one *piece*; pieces are about 1/170 as many as bytes.

1. Pieces are counted by anchor; only anchors met twice go on. Equal pieces (by anchor
   and a cryptographic digest) are combined before any text moves: a piece met twice is a
   repeat as a whole. Anchors and pieces that hold more than a thousandth of all rows are
   at most a thousand; their rows are not moved, the few keys are broadcast instead.
2. Different pieces of one anchor go to one task with their text. There the suffixes
   that start at the anchors form a (sparse) enhanced suffix array: sorted, with common
   prefix lengths. A stack scan visits its common-prefix intervals; in each, the
   members are split by how far they agree to the left, and the diversity of their
   left extensions shows the maximal repeats with all their occurrences.
3. An anchor with more than ``MAX_PIECES`` different pieces is split without a bound on
   its rows: its windows are dealt by a longer common core (``STEP`` window starts
   each), and where even that is too many, one by one, by the hash of each window.
4. Texts take back the covered ranges of their pieces.

The same runs over words in place of bytes (``WORDS``: a symbol is a word's hash), for
runs of more than 50 words that another document holds too, however few bytes they are."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locatext.llm.arrays import bound_batches, span_hashes, text_slices, words
from locatext.session import release, written

LENGTH = 400
GRAM = 64
#: Words of a run that counts as shared between documents, and of an anchor in it.
RUN_WORDS, RUN_GRAM = 51, 8
#: Keys with more rows than this and than a thousandth of all are handled by broadcast.
HOT_ROWS = 10_000
MAX_PIECES = 32768
STEP = 32
_POS = np.uint64((1 << 24) - 1)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, from block-wise running minima."""
    n = len(x) - w + 1
    size = -(-len(x) // w) * w
    padded = np.full(size, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(x)] = x
    grid = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def pieces(buf: np.ndarray, offs: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, anchor, first and last window start, anchor hash) of all pieces of the rows;
    positions are within the buffer of symbols."""
    empty = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    n = len(buf)
    if n < length:
        return empty
    row_of = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    valid = np.zeros(n - length + 1, dtype=bool)
    ends = offs[1:][row_of[: len(valid)]]
    valid[:] = np.arange(len(valid)) + length <= ends
    if not valid.any():
        return empty
    at = np.arange(n - gram + 1)
    h = span_hashes(buf, at, at + gram)
    if n > int(_POS):
        raise ValueError("a slice is longer than positions can tell")
    low = _sliding_min((h & ~_POS) | at.astype(np.uint64), length - gram + 1)
    p = np.flatnonzero(valid)
    a = (low[p] & _POS).astype(np.int64)
    new = np.ones(len(p), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)
    lo = np.flatnonzero(new)
    hi = np.concatenate([lo[1:], [len(p)]]) - 1
    first, last, anchor = p[lo], p[hi], a[lo]
    return row_of[first], anchor, first, last, h[anchor]


#: Texts longer than this are cut into overlapping stretches (positions have 24 bits).
STRETCH = 8 << 20


def _stretches(column: pa.Array, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, byte offset in it, offsets, bytes)."""
    for lo, _, offs, buf in text_slices(column):
        if len(buf) <= STRETCH:
            yield lo, 0, offs, buf
            continue
        for at in range(0, len(buf), STRETCH):
            part = buf[at : at + STRETCH + length - 1]
            yield lo, at, np.array([0, len(part)]), part


@dataclass(frozen=True)
class Strings:
    """What is repeated: runs of ``length`` symbols of ``unit`` bytes (1: the bytes of the
    text, 8: hashes of its words), anchored at runs of ``gram``; with ``across``, only
    those that two documents hold."""

    unit: int
    length: int
    gram: int
    across: bool = False

    def read(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, symbols of it before these, row offsets, symbols)."""
        if self.unit == 1:
            yield from _stretches(column, self.length)
            return
        for lo, _, offs, buf in text_slices(column):
            starts, ends, first = words(buf, offs)
            said = span_hashes(buf, starts, ends)
            if len(said) <= STRETCH:
                yield lo, 0, first, said
                continue
            for at in range(0, len(said), STRETCH):
                part = said[at : at + STRETCH + self.length - 1]
                yield lo, at, np.array([0, len(part)]), part

    def symbols(self, text: str) -> bytes:
        data = text.encode()
        if self.unit == 1:
            return data
        buf = np.frombuffer(data, np.uint8)
        starts, ends, _ = words(buf, np.array([0, len(buf)]))
        return span_hashes(buf, starts, ends).tobytes()

    def flip(self, data: bytes) -> bytes:
        """The symbols from last to first."""
        return data[::-1] if self.unit == 1 else np.frombuffer(data, np.uint64)[::-1].tobytes()


BYTES = Strings(1, LENGTH, GRAM)
WORDS = Strings(8, RUN_WORDS, RUN_GRAM, across=True)


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """Common-prefix intervals (value, first, last) of a sorted list with ``lcp[i]`` the
    common prefix of entries i-1 and i, by a stack scan; inner before outer."""
    stack: list[tuple[int, int]] = []
    for i in range(1, len(lcp) + 1):
        value, first = (lcp[i] if i < len(lcp) else -1), i - 1
        while stack and stack[-1][0] > value:
            top, first = stack.pop()
            yield top, first, i - 1
        if value >= 0 and (not stack or stack[-1][0] < value):
            stack.append((value, first))


def maximal_repeats(lefts: list[bytes], rights: list[bytes], length: int, unit: int = 1) -> Iterator[tuple[int, int, list[int]]]:
    """Maximal repeats of at least ``length`` symbols that contain the anchor, for pieces
    given as the (reversed) symbols before the anchor and those from it on: (symbols to
    the left, symbols to the right, all pieces that have it)."""
    n = len(rights)
    order = sorted(range(n), key=rights.__getitem__)
    lcp = [0] + [common(rights[order[i - 1]], rights[order[i]]) // unit for i in range(1, n)]
    by_left = sorted(range(n), key=lefts.__getitem__)
    rank = [0] * n
    for i, x in enumerate(by_left):
        rank[x] = i
    for right, lo, hi in intervals(lcp):
        if right + max(len(lefts[m]) // unit for m in order[lo : hi + 1]) < length:
            continue
        members = sorted(order[lo : hi + 1], key=rank.__getitem__)
        # The same tree once more, over what stands to the left: an inner interval has
        # more to its left in common, an outer one has diverse left extensions.
        left_lcp = [0] + [common(lefts[members[i - 1]], lefts[members[i]]) // unit for i in range(1, len(members))]
        for left, a, b in intervals(left_lcp):
            if left + right < length:
                continue
            group = members[a : b + 1]
            # Maximal to the right: members must not all go on alike (else an inner
            # interval of the outer tree has given them, with more to the right).
            if len({rights[m][right * unit : right * unit + unit] for m in group}) > 1 or any(len(rights[m]) == right * unit for m in group):
                yield left, right, group


def extents(lefts: list[bytes], rights: list[bytes], length: int, unit: int = 1, owners: list[tuple[int, int]] | None = None) -> list[tuple[int, int]]:
    """For each piece the farthest reach to the left and right of the repeats it has
    with other pieces; (0, 0) if it has none. With ``owners`` (least and greatest
    document of each piece) only repeats that two documents hold count."""
    out = [(0, 0)] * len(rights)
    for left, right, group in maximal_repeats(lefts, rights, length, unit):
        if owners and min(owners[m][0] for m in group) == max(owners[m][1] for m in group):
            continue
        for m in group:
            out[m] = (max(out[m][0], left), max(out[m][1], right))
    return out


_CUT = "h long, g long, q int, ph long, rel int, size int, c long, d0 long, d1 long, lft binary, rgt binary"
_CUT_COLUMNS = [x.split()[0] for x in _CUT.split(", ")]


def _groups(batches: Iterator[pa.RecordBatch], kind: Strings) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (h, g, q): reach of every piece within its group."""
    now, rows = None, []

    def flush() -> pa.RecordBatch:
        owners = [(r[5], r[6]) for r in rows] if kind.across else None
        reach = extents([r[7] for r in rows], [r[8] for r in rows], kind.length, kind.unit, owners) if len(rows) > 1 else [(0, 0)]
        out = []
        for r, (left, right) in zip(rows, reach, strict=True):
            if (r[5] != r[6]) if kind.across else r[4] > 1:
                left, right = max(left, len(r[7]) // kind.unit), max(right, len(r[8]) // kind.unit)
            if right:
                out.append((r[0], r[1], r[2], r[3], left, right))
        cols = list(zip(*out, strict=True)) or [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _REACH_TYPES, strict=True)], names=["h", "ph", "rel", "size", "lft", "rgt"])

    for batch in batches:
        for h, g, q, *r in zip(*(batch.column(c).to_pylist() for c in _CUT_COLUMNS), strict=True):
            if (h, g, q) != now:
                if rows:
                    yield flush()
                now, rows = (h, g, q), []
            rows.append((h, *r))
    if rows:
        yield flush()


_REACH = "h long, ph long, rel int, size int, lft int, rgt int"
_REACH_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]


def _met(kind: Strings):
    """Condition on count and owners: a repeat."""
    return F.expr("d0 <> d1" if kind.across else "c > 1")


def _hot_join(rows: DataFrame, keys: DataFrame, hot: DataFrame, on: list[str]) -> DataFrame:
    """``rows.join(keys, on)`` with the keys in ``hot`` (a thousand at most) broadcast."""
    hot = F.broadcast(hot)
    few = F.broadcast(keys.join(hot, on, "left_semi"))
    return rows.join(few, on).unionByName(rows.join(hot, on, "left_anti").join(keys.join(hot, on, "left_anti"), on))


def spans(docs: DataFrame, kind: Strings = BYTES, max_pieces: int = MAX_PIECES, step: int = STEP, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(id, tag, spans): ranges of symbols of repeated strings for every (id, text hash)
    of ``docs`` (id, tag, text) that has some; ranges may overlap."""
    unit, length = kind.unit, kind.length
    step = min(step, length)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, skip, offs, symbols in kind.read(batch.column("text")):
                row, anchor, first, last, h = pieces(symbols, offs, length, kind.gram)
                if len(row):
                    take = pa.array(row + lo)
                    data = memoryview(np.ascontiguousarray(symbols)).cast("B")
                    ph = np.frombuffer(b"".join([hashlib.blake2b(data[a:e], digest_size=8).digest() for a, e in zip((first * unit).tolist(), ((last + length) * unit).tolist(), strict=True)]), np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("id").take(take), batch.column("tag").take(take), pa.array(h.view(np.int64)), pa.array(ph), pa.array((anchor - first).astype(np.int32)), pa.array((last - first + length).astype(np.int32)), pa.array(first - offs[row] + skip)],
                        names=["id", "tag", "h", "ph", "rel", "size", "start"],
                    )

    id_kind = docs.schema["id"].dataType.simpleString()
    found = written(docs.mapInArrow(cut, f"id {id_kind}, tag long, h long, ph long, rel int, size int, start long"), "repeat-cuts")
    bound = max(hot_rows, found.count() // 1000)
    anchors = found.groupBy("h").agg(F.count("*").alias("c"), F.min("ph").alias("x"), F.max("ph").alias("y")).where("c > 1")
    anchors = written(anchors.select("h", "c", (F.col("x") != F.col("y")).alias("mixed")), "repeat-anchors")
    hits = written(_hot_join(found, anchors.select("h", "mixed"), anchors.where(F.col("c") > bound).select("h"), ["h"]), "repeat-hits")
    release(found, anchors)
    piece = ["h", "ph", "rel", "size"]
    doc = F.xxhash64("id", "tag")
    kinds = hits.groupBy(*piece, "mixed").agg(F.count("*").alias("c"), F.min(doc).alias("d0"), F.max(doc).alias("d1"), F.min(F.struct("id", "tag", "start")).alias("at"))
    kinds = written(kinds, "repeat-pieces")
    hot_pieces = written(kinds.where(F.col("c") > bound).select(*piece), "repeat-hot-pieces")
    whole = kinds.where(_met(kind)).select(*piece, F.col("rel").alias("lft"), (F.col("size") - F.col("rel")).alias("rgt"))

    # The text of one occurrence of each piece that others at its anchor differ from.
    wanted = kinds.where("mixed").select("at.*", *piece, "c", "d0", "d1").groupBy("id", "tag").agg(F.collect_list(F.struct("start", *piece, "c", "d0", "d1")).alias("wanted"))
    source = docs.join(wanted, docs["id"].eqNullSafe(wanted["id"]) & (docs["tag"] == wanted["tag"])).select(docs["text"], wanted["wanted"], docs["id"], docs["tag"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, asked in zip(batch.column("text"), batch.column("wanted"), strict=True):
                data, out = kind.symbols(text.as_py()), []
                for w in asked.as_py():
                    s, a, e = (unit * (w["start"] + x) for x in (0, w["rel"], w["size"]))
                    out.append((w["h"], 0, 0, w["ph"], w["rel"], w["size"], w["c"], w["d0"], w["d1"], kind.flip(data[s:a]), data[a:e]))
                yield from _cut_batches(out)

    # Rows that repeat an id and text would fetch the same pieces again.
    texts = written(source.mapInArrow(fetch, _CUT).dropDuplicates(piece), "repeat-texts")
    crowd = texts.groupBy("h").agg(F.count("*").alias("n"))
    hot = written(crowd.where(F.col("n") > max_pieces).select("h"), "repeat-hot")

    def reach(cuts: DataFrame) -> DataFrame:
        dealt = cuts.repartition("h", "g", "q").sortWithinPartitions("h", "g", "q", "ph")
        return dealt.select(*_CUT_COLUMNS).mapInArrow(lambda batches: _groups(batches, kind), _REACH)

    cover = whole.unionByName(reach(texts.join(hot, "h", "left_anti")))
    scratch = [kinds, texts, hot]
    if not hot.isEmpty():
        for x in _split_hot(texts.join(hot, "h", "left_semi"), kind, max_pieces, step, reach, scratch):
            cover = cover.unionByName(x)
    cover = written(cover.groupBy(*piece).agg(F.max("lft").alias("lft"), F.max("rgt").alias("rgt")), "repeat-cover")
    release(*scratch)
    ranges = _hot_join(hits.drop("mixed"), cover, hot_pieces, piece)
    start = F.col("start") + F.col("rel") - F.col("lft")
    return ranges.select("id", "tag", F.struct(start.alias("s"), (start + F.col("lft") + F.col("rgt")).alias("e")).alias("span")).groupBy("id", "tag").agg(F.collect_list("span").alias("spans"))


def _cut_batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    for at in range(0, len(rows), 2000):
        cols = zip(*rows[at : at + 2000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=_CUT_COLUMNS)


def _hash(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _split_hot(texts: DataFrame, kind: Strings, max_pieces: int, step: int, reach, scratch: list[DataFrame]) -> list[DataFrame]:
    """The pieces of hot anchors by the core their windows share; what is still too
    crowded window by window. Every reach is one of the original piece."""
    unit, length = kind.unit, kind.length

    def windows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                data, a = kind.flip(r["lft"]) + r["rgt"], len(r["lft"]) // unit
                part = lambda s, e: data[s * unit : e * unit]  # noqa: E731, B023
                # A window starts r symbols before the anchor, low <= r <= high.
                low, high = max(0, length - len(r["rgt"]) // unit), a
                for q in range(low // width, high // width + 1):
                    r1, r2 = max(low, q * width), min(high, q * width + width - 1)
                    if r1 > r2:
                        continue
                    core = part(a - q * width, a - q * width - width + 1 + length)
                    out.append((r["h"], _hash(core), q, r["ph"], r["rel"], r["size"], r["c"], r["d0"], r["d1"], kind.flip(part(a - r2, a)), part(a, a - r1 + length)))
            yield from _cut_batches(out)

    def combined(cuts: DataFrame) -> DataFrame:
        """Equal cuts of different pieces become one, which then counts for all."""
        own = ["h", "g", "q", "lft", "rgt"]
        return cuts.groupBy(*own).agg(F.sum("c").alias("c"), F.min("d0").alias("d0"), F.max("d1").alias("d1"), F.min("ph").alias("ph"), F.first("rel").alias("rel"), F.first("size").alias("size"))

    cores = written(texts.mapInArrow(lambda b: windows(b, step), _CUT), "repeat-cores")
    distinct = written(combined(cores), "repeat-cores")
    crowd = distinct.groupBy("h", "g", "q").agg(F.count("*").alias("n"), F.sum("c").alias("c"), F.min("d0").alias("d0"), F.max("d1").alias("d1"))
    few = crowd.where((F.col("n") <= max_pieces) & _met(kind)).select("h", "g", "q")
    many = written(crowd.where(F.col("n") > max_pieces).select("h", "g", "q"), "repeat-many")
    scratch += [cores, distinct, many]
    units = lambda c: (F.octet_length(c) / unit).cast("int")

    def named(cuts: DataFrame) -> DataFrame:
        """Stand-in piece names: the cut itself, so that its reach finds all its pieces."""
        return cuts.withColumn("ph", F.xxhash64("g", "lft", "rgt")).withColumn("rel", units("lft")).withColumn("size", units("lft") + units("rgt"))

    def back(of_cuts: DataFrame, cuts: DataFrame) -> DataFrame:
        """From reaches of cuts to reaches of the pieces they were cut from."""
        own = cuts.select("h", F.xxhash64("g", "lft", "rgt").alias("cut"), units("lft").alias("cl"), (units("lft") + units("rgt")).alias("cs"), "ph", "rel", "size")
        named_reach = of_cuts.select("h", F.col("ph").alias("cut"), F.col("rel").alias("cl"), F.col("size").alias("cs"), "lft", "rgt")
        return own.join(named_reach, ["h", "cut", "cl", "cs"]).select("h", "ph", "rel", "size", "lft", "rgt")

    out = [back(reach(named(distinct.join(few, ["h", "g", "q"], "left_semi"))), cores)]
    if not many.isEmpty():
        crowded = cores.join(many, ["h", "g", "q"], "left_semi")
        single = crowded.mapInArrow(lambda b: windows(b, 1), _CUT)
        met = single.groupBy("h", "g", "q").agg(F.sum("c").alias("c"), F.min("d0").alias("d0"), F.max("d1").alias("d1")).where(_met(kind)).select("h", "g", "q")
        again = single.join(met, ["h", "g", "q"])
        out.append(again.select("h", "ph", "rel", "size", units("lft").alias("lft"), units("rgt").alias("rgt")))
    return out


def merged(ranges: list[tuple[int, int]]) -> list[list[int]]:
    """Overlapping and touching ranges as one, in order."""
    out: list[list[int]] = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def remove(docs: DataFrame, id_col: str = "doc_id", keep_text: bool = False, kind: Strings = BYTES, runs: Strings = WORDS, **options) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans, kept_sha256,
    n_shared_words (words in runs of more than 50 words that another document holds too;
    nothing is removed for them), shares_run (whether there are any) and, with
    ``keep_text``, ``spans`` (array of start, end in bytes) and ``kept`` (binary: cuts may
    split a character). Null texts are empty. Rows may repeat an id, also with other
    texts, and ids may be null; equal texts are repeats of each other wherever they
    stand, but rows that repeat both id and text are one document to the shared runs.
    Texts shorter than the length are never cut. Other columns are not read."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    src = bound_batches(docs).select(F.col(id_col).alias("id"), F.xxhash64(text).alias("tag"), text.alias("text"))
    named = lambda found, n: found.select(F.col("id").alias("fid"), F.col("tag").alias("ftag"), F.lit(n).alias("of"), "spans")
    found = named(spans(src, kind, **options), 0).unionByName(named(spans(src, runs, **options), 1))
    found = found.groupBy("fid", "ftag").agg(*(F.flatten(F.collect_list(F.when(F.col("of") == n, F.col("spans")))).alias(c) for n, c in enumerate(("spans", "shared"))))
    joined = src.join(found, F.col("id").eqNullSafe(F.col("fid")) & (F.col("tag") == F.col("ftag")), "left").select("id", "text", "spans", "shared")
    more = ", spans array<struct<s:long,e:long>>, kept binary" if keep_text else ""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])), pa.binary()]
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared_words", "shares_run", "spans", "kept"]
    n = len(names) if keep_text else 6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(n)]
            for text, ranges, shared in zip(batch.column("text"), batch.column("spans"), batch.column("shared"), strict=True):
                data = text.as_py().encode()
                gone = merged([(x["s"], x["e"]) for x in ranges.as_py() or ()])
                at, kept = 0, []
                for s, e in gone:
                    kept.append(data[at:s])
                    at = e
                kept.append(data[at:])
                rest = b"".join(kept)
                said = sum(e - s for s, e in merged([(x["s"], x["e"]) for x in shared.as_py() or ()]))
                row = (len(data), len(data) - len(rest), len(gone), hashlib.sha256(rest).hexdigest(), said, said > 0, [{"s": s, "e": e} for s, e in gone], rest)
                for c, v in zip(cols, row, strict=False):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=False))], names=["id", *names[:n]])

    of_id = src.schema["id"].dataType.simpleString()
    return joined.mapInArrow(run, f"id {of_id}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared_words long, shares_run boolean{more}").withColumnRenamed("id", id_col)
