"""Byte-level BPE encoding and decoding with a public vocabulary.

Each pre-token ("word") keeps one contiguous array of parts and one of the ranks of
adjacent pairs. The smallest rank is found by scanning the array, its boundary is
deleted and the two neighbouring ranks are refreshed. Words longer than
``SHORT_WORD`` bytes, where rescanning would be quadratic, keep the same pairs in a
heap; the merge order (rank, then position) and so the result are the same."""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain, repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locatext.llm.arrays import bound_batches

SHORT_WORD = 48
#: Words kept encoded per worker; the memo is emptied when full (results never depend on it).
MEMO_WORDS = 500_000
#: Characters that these hold: without spaces, a run is as long as a piece.
MEMO_CHARS = 1 << 23
#: Texts are encoded in pieces of about this many characters, cut where a word must end.
PIECE_CHARS = 1 << 18
#: Characters of texts whose new words are merged together.
ROUND_CHARS = 1 << 20
#: A rank and the id it makes are one number: rank << _SHIFT | id.
_SHIFT = 32
_ID = (1 << _SHIFT) - 1
_NONE = 1 << 62


#: The byte-level pre-tokenizer's words. White space is spelt out as the Unicode
#: property (fixed values), of which U+001C-001F are no part.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: A space after something other than white space always begins a new word.
_BREAK = re.compile(r"(?<=\S) ")
_LATIN = "[A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u024f]+"
_MARKS = "[!-&(-/:-@\\[-`{-~]*"
#: Runs whose words are plain without ``WORDS``: letters, marks (no apostrophe), and
#: perhaps a line end with letters and marks after it.
_PLAIN = re.compile(f"({_LATIN})({_MARKS})(?:(\n)({_LATIN})({_MARKS}))?")


def _words_of(run: str) -> list[str]:
    """The words of a space and ``run``, which starts after a break."""
    if m := _PLAIN.fullmatch(run):
        head, marks, line, more, last = m.groups()
        found = [" " + head, marks] if marks else [" " + head]
        if line:
            found += (line, more, last) if last else (line, more)
        return found
    return WORDS.findall(" " + run)


def _cut(text: str) -> list[str]:
    """``text`` cut at its breaks. Where white space never stands before a space, these
    are its spaces."""
    if text[:1] != " " and "  " not in text and "\n " not in text and text.replace("\n", "").isprintable():
        return text.split(" ")
    return _BREAK.split(text)


Entry = tuple[str, bytes, int]


@contextmanager
def _no_cycles() -> Iterator[None]:
    """Millions of small tuples and strings hold no cycles: don't search them for any."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


@lru_cache(maxsize=1)
def _byte_of_char() -> dict[str, int]:
    """Byte-level alphabet: printable Latin-1 stands for itself, the other bytes
    for 256, 257, ... in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Encoder and decoder for one vocabulary file in the tokenizers JSON format."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        table = _byte_of_char()
        vocab = {bytes(table[c] for c in token): i for token, i in data["model"]["vocab"].items() if all(c in table for c in token)}
        self.byte_ids = [vocab[bytes([b])] for b in range(256)]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(data["model"]["merges"]):
            left, right = (bytes(table[c] for c in part) for part in (merge if isinstance(merge, list) else merge.split(" ")))
            self.pairs[vocab[left], vocab[right]] = (rank, vocab[left + right])
        self.packed = {pair: rank << _SHIFT | new for pair, (rank, new) in self.pairs.items()}
        self.token_bytes: dict[int, bytes] = {i: token for token, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.token_bytes |= {i: content.encode() for content, i in self.added.items()}
        self.added_pattern = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        #: The same pairs for whole arrays: keys (left << 32 | right) and packed ranks in
        #: an open hash table; ``_steps`` is the farthest a key lies from its slot.
        size = 1 << max(10, (len(self.packed) * 8).bit_length())
        self._shift = np.uint64(64 - size.bit_length() + 1)
        self._keys = np.full(size + 64, -1, dtype=np.int64)
        self._ranks = np.full(size + 64, _NONE, dtype=np.int64)
        self._steps = 1
        keys = np.array([a << _SHIFT | b for a, b in self.packed], dtype=np.int64)
        for key, slot, rank in zip(keys.tolist(), self._slot(keys).tolist(), self.packed.values(), strict=True):
            at = slot
            while self._keys[at] >= 0:
                at += 1
            self._keys[at], self._ranks[at] = key, rank
            self._steps = max(self._steps, at - slot + 1)
        #: Keyed by the text after a break: decimal ids, decoded bytes, number of ids.
        self.runs: dict[str, Entry] = {}
        self._held = 0
        self._said = {i: str(i) for i in self.token_bytes}

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Packed ranks of pairs; a side of -1 has none."""
        key = left.astype(np.int64) << _SHIFT | right
        key[(left < 0) | (right < 0)] = -2
        at = self._slot(key)
        found = np.where(self._keys[at] == key, self._ranks[at], _NONE)
        for step in range(1, self._steps):
            found = np.where(self._keys[at + step] == key, self._ranks[at + step], found)
        return found

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """``encode_word`` of many words at once: the rank arrays of words of like length
        are the rows of one table, and every pass deletes one boundary in each row."""
        out: list[list[int]] = [[]] * len(words)
        sizes = np.array([len(w) for w in words])
        for low, high in ((0, 8), (8, 12), (12, 20), (20, SHORT_WORD)):
            for pick in np.array_split(some, -(-len(some) // 4096)) if len(some := np.flatnonzero((sizes > low) & (sizes <= high))) else ():
                width = int(sizes[pick].max()) + 1
                raw = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in pick), dtype=np.uint8).reshape(-1, width)
                parts = np.where(np.arange(width) < sizes[pick][:, None], np.array(self.byte_ids)[raw], -1)
                ranks = self._look_up(parts[:, :-1], parts[:, 1:])
                row = pick
                columns = np.arange(width)
                while len(row):
                    i = ranks.argmin(axis=1)
                    lows = ranks[np.arange(len(row)), i]
                    going = lows < _NONE
                    if not going.all():
                        done = parts[~going]
                        left = done >= 0
                        flat, at = done[left].tolist(), 0
                        for k, n in zip(row[~going].tolist(), left.sum(axis=1).tolist(), strict=True):
                            out[k] = flat[at : at + n]
                            at += n
                        parts, ranks, row, i, lows = parts[going], ranks[going], row[going], i[going], lows[going]
                        if not len(row):
                            break
                    r, new = np.arange(len(row)), lows & _ID
                    late = columns > i[:, None]
                    parts[:, :-1] = np.where(late[:, :-1], parts[:, 1:], parts[:, :-1])
                    parts[:, -1] = -1
                    parts[r, i] = new
                    ranks[:, :-1] = np.where(late[:, 1:-1], ranks[:, 1:], ranks[:, :-1])
                    ranks[:, -1] = _NONE
                    before = np.maximum(i - 1, 0)
                    ranks[r, before] = np.where(i > 0, self._look_up(parts[r, before], new), ranks[r, before])
                    ranks[r, i] = self._look_up(new, parts[r, i + 1])
        for k in np.flatnonzero(sizes > SHORT_WORD).tolist():
            out[k] = self._encode_long([self.byte_ids[b] for b in words[k]])
        return out

    def encode_word(self, word: bytes) -> list[int]:
        if len(word) > SHORT_WORD:
            return self._encode_long([self.byte_ids[b] for b in word])
        packed = self.packed.get
        parts = list(map(self.byte_ids.__getitem__, word))
        ranks = list(map(packed, zip(parts, parts[1:], strict=False), repeat(_NONE)))
        while ranks:
            low = min(ranks)
            if low == _NONE:
                break
            i = ranks.index(low)
            parts[i] = new = low & _ID
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = packed((parts[i - 1], new), _NONE)
            if i < len(ranks):
                ranks[i] = packed((new, parts[i + 1]), _NONE)
        return parts

    def _encode_long(self, parts: list[int]) -> list[int]:
        n, pairs = len(parts), self.pairs
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(pairs[p][0], i, *p) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in pairs]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j < 0 or parts[j] != right:
                continue
            parts[i], parts[j] = pairs[left, right][1], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (pair := (parts[a], parts[b])) in pairs:
                    heapq.heappush(heap, (pairs[pair][0], a, *pair))
        return [p for p in parts if p >= 0]

    def _pieces(self, text: str) -> Iterator[str]:
        """Cut before white space that follows something else: no word spans that."""
        at = 0
        while len(text) - at > PIECE_CHARS:
            cut = at + PIECE_CHARS
            while cut < len(text) and not (text[cut].isspace() and not text[cut - 1].isspace() and text[cut] not in "\x1c\x1d\x1e\x1f" and text[cut - 1] not in "\x1c\x1d\x1e\x1f"):
                cut += 1
            yield text[at:cut]
            at = cut
        yield text[at:] if at else text

    def _parts(self, text: str) -> Iterator[str]:
        return self.added_pattern.split(text) if self.added_pattern and any(t in text for t in self.added) else (text,)

    def _entry(self, ids: list[int]) -> Entry:
        return ",".join(map(self._said.__getitem__, ids)), self.decode_bytes(ids), len(ids)

    def learn(self, runs: set[str]) -> None:
        """Encode those of ``runs`` not known yet, all their words together. A full memo
        keeps only the runs asked for."""
        new = [r for r in runs if r not in self.runs]
        size = sum(map(len, new))
        if len(self.runs) + len(new) > MEMO_WORDS or self._held + size > MEMO_CHARS:
            self.runs = {r: self.runs[r] for r in runs if r in self.runs}
            self._held = sum(map(len, self.runs))
        if not new:
            return
        self._held += size
        split = list(map(_words_of, new))
        words = list(dict.fromkeys(chain.from_iterable(split)))
        entry = dict(zip(words, map(self._entry, self.encode_words([w.encode() for w in words])), strict=True))
        for r, ws in zip(new, split, strict=True):
            self.runs[r] = entry[ws[0]] if len(ws) == 1 else _joined([entry[w] for w in ws])

    def encode_iter(self, text: str) -> Iterator[Entry]:
        """Piece by piece, for the whole text: decimal ids, the bytes decoded from them and
        their number. Added tokens stand for themselves."""
        for part in self._parts(text):
            if part in self.added:
                yield self._entry([self.added[part]])
                continue
            for piece in self._pieces(part):
                runs = _cut(piece)
                self.learn(set(runs[1:]))
                yield self._encoded(runs)

    def _encoded(self, runs: list[str]) -> Entry:
        """The entry of a stretch of text cut at its breaks, whose runs are known."""
        head = self._entry(list(chain.from_iterable(map(self.encode_word, map(str.encode, WORDS.findall(runs[0]))))))
        got = list(map(self.runs.__getitem__, runs[1:]))
        return _joined([head, *got] if head[2] else got)

    def encode_many(self, texts: list[str]) -> Iterator[Iterable[Entry]]:
        """``encode_iter`` of every text; those of one piece are encoded together."""
        with _no_cycles():
            split = [_cut(t) if len(t) <= PIECE_CHARS and not any(x in t for x in self.added) else None for t in texts]
            self.learn(set(chain.from_iterable(r[1:] for r in split if r)))
            known = [[self._encoded(r)] if r else None for r in split]
        for text, entries in zip(texts, known, strict=True):
            yield entries or self.encode_iter(text)

    def encode(self, text: str) -> list[int]:
        return [int(i) for said, _, n in self.encode_iter(text) if n for i in said.split(",")]

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


def _joined(entries: list[Entry]) -> Entry:
    if not entries:
        return "", b"", 0
    said, data, counts = zip(*entries, strict=True)
    return ",".join(said), b"".join(data), sum(counts)


def digests(entries: Iterable[Entry]) -> tuple[int, str, str]:
    """Number of ids, digest of the ids, digest of the text decoded from them."""
    n, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()
    for said, data, count in entries:
        if not count:
            continue
        of_ids.update((("," if n else "") + said).encode())
        n += count
        of_text.update(data.decode("utf-8", "replace").encode())
    return n, of_ids.hexdigest(), of_text.hexdigest()


def _rounds(texts: list[str]) -> Iterator[slice]:
    """Consecutive texts that are encoded together: ``ROUND_CHARS``, or one text."""
    at = size = 0
    for i, text in enumerate(texts):
        if i > at and size + len(text) > ROUND_CHARS:
            yield slice(at, i)
            at, size = i, 0
        size += len(text)
    if at < len(texts):
        yield slice(at, len(texts))


@lru_cache(maxsize=2)
def codec_of(spec: str) -> ByteBpe:
    """One codec a worker process, which keeps its memo from task to task."""
    return ByteBpe(spec)


def _codec(spark: SparkSession, vocab_path: str):
    """The vocabulary file is read once on the driver and broadcast (a fixed size)."""
    shared = spark.sparkContext.broadcast(Path(vocab_path).read_text(encoding="utf-8"))

    return lambda: codec_of(shared.value)


def encode_decode(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """One row per row of ``docs``: the id, n_tokens, ids_sha256, decoded_sha256 and,
    with ``keep_ids``, ``ids`` (array<int>) and ``decoded``. A null text is empty (no
    ids); repeated rows are each answered; other columns are not read."""
    get = _codec(docs.sparkSession, vocab_path)
    src = bound_batches(docs).select(F.col(id_col).alias("k"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    more = ", ids array<int>, decoded string" if keep_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = get()
        for batch in batches:
            every = batch.column("text").to_pylist()
            for part in _rounds(every):
                texts = every[part]
                rows = list(map(digests, codec.encode_many(texts)))
                cols = [batch.column("k").slice(part.start, len(texts)), *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string())))]
                names = ["k", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    ids = [codec.encode(t) for t in texts]
                    cols += [pa.array(ids, pa.list_(pa.int32())), pa.array([codec.decode(i) for i in ids], pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = src.schema["k"].dataType.simpleString()
    out = src.mapInArrow(run, f"k {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
    return out.withColumnRenamed("k", id_col)
