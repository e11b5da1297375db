"""Personal data: fixed base patterns plus a semi-Markov conditional random field.

The base kinds (email, ip, card, phone) are what the patterns say. The CRF adds
spans the patterns miss: candidate segments are the matches of a few forms over the
whole text, and what stands after a word that announces a secret. Each run of touching
candidates is a lattice whose edges are single outside tokens and the candidates (of at
most ``MAX_TOKENS`` tokens where they hold spaces and are no IBAN). Each segment of a kind is scored by
features of the *whole* span (shape, checksum, separators, entropy, context words)
plus a transition from the kind before it; dynamic programming chooses boundaries and
kinds together, with base spans clamped to their kind. The weights are trained here
by maximising conditional likelihood on generated sentences (``train``); their number
is fixed, and they are broadcast."""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locatext.llm.arrays import bound_batches

BASE = ("email", "ip", "card", "phone")
#: Kinds that only the CRF can give, after the base kinds in the output's order.
ADDED = ("account", "handle", "national", "secret")
KINDS = (*BASE, *ADDED)
MAX_TOKENS = 12
CONTEXT_CHARS = 24

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LONG_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9]){15}")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each "@" outwards (the local part cannot hold one)."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", last if m else at + 1)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """All base spans by kind, then start."""
    out = [("email", *x) for x in _emails(text)]
    if text.count(".") >= 3:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append(("ip", *m.span()))
    if _LONG_DIGITS.search(text):
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


# Candidates, and the lattice of one neighbourhood.

_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\S")
#: Forms of candidate segments; each gives whole spans, the CRF judges them.
_FORMS = tuple(
    re.compile(p)
    for p in (
        r"[^\s@<>\"(),;:]{1,64}@[^\s@<>\"(),;:]{1,255}",
        r"(?<![\w.])@[A-Za-z0-9_]{2,40}",
        r"\+?\(?[0-9][0-9() ./-]{4,40}[0-9]",
        r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z+/=_-]*[0-9])[A-Za-z0-9+/=_-]{16,512}",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,8}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    )
)
# Words that announce a kind.
_CUES = {
    "secret": "token key secret password passwd pwd apikey bearer credential",
    "phone": "tel telephone phone call mobile fax telefon teléfono téléphone",
    "email": "email mail e-mail correo courriel",
    "card": "card visa mastercard credit karte tarjeta carte",
    "account": "iban account konto cuenta compte passport acct",
    "national": "ssn social security national id dni nif steuer",
    "ip": "ip host server address",
}
_CUE_OF = {w: k for k, ws in _CUES.items() for w in ws.split()}
_IBAN = _FORMS[-1]
_SECRET = _CUES["secret"].split()
#: The word after one that announces a secret, whatever it is made of.
_TOLD = re.compile(rf"(?<![^\W_])(?:{'|'.join(_SECRET)})(?![^\W_])(?=[\"']?\s{{0,3}}(?:[:=]|is\b|was\b)?\s{{0,3}}[\"']?([^\s\"',;:=]{{6,512}}))", re.I)
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
_GROUP = re.compile(r"\S+")


def _features(text: str, start: int, end: int, left: str) -> list[str]:
    """Features of the whole span and of what stands before it (kind comes later)."""
    s = text[start:end]
    digits = sum("0" <= c <= "9" for c in s)
    letters = sum(c.isalpha() for c in s)
    seps = {c for c in s if not c.isalnum()}
    counts = [s.count(c) for c in set(s)]
    entropy = -sum(c / len(s) * math.log2(c / len(s)) for c in counts)
    shape = re.sub(r"9+", lambda m: f"9{min(len(m[0]), 9)}", "".join("9" if "0" <= c <= "9" else "A" if c.isalpha() else c for c in s[:40]))
    out = [
        "bias", f"digits={min(digits, 20)}", f"letters={min(letters, 3) if letters < 4 else 'many'}", f"length={min(len(s) // 4, 12)}",
        f"entropy={int(entropy)}", f"plus={s[0] == '+'}", f"at={s.find('@') == 0}/{'@' in s}", f"dots={min(s.count('.'), 4)}",
        f"space={' ' in seps}", f"dash={'-' in seps}", f"paren={'(' in seps}", f"shape={re.sub('A+', 'A', shape)[:16]}",
        f"luhn={digits >= 13 and not letters and luhn(''.join(c for c in s if '0' <= c <= '9'))}",
        f"cutL={start > 0 and text[start - 1].isalnum()}", f"cutR={end < len(text) and text[end].isalnum()}",
        f"tail={s[-1].isalnum()}",
    ]
    for w in _WORD.findall(left.lower())[-2:]:
        if w in _CUE_OF:
            out.append(f"cue={_CUE_OF[w]}")
    if left.rstrip(" \"'")[-1:] in ("=", ":"):
        out.append("assigned")
    out.append(f"iban={bool(_IBAN.fullmatch(s))}")
    if not digits:
        out.append(f"bare={any(c.isupper() for c in s[1:]) and any(c.islower() for c in s)}/{bool(seps)}/{min(len(s) // 3, 8)}/{any(x == 'cue=secret' for x in out)}")
    return out


def _candidates(text: str) -> list[tuple[int, int]]:
    """Spans that any form gives over the whole text, without and with what ends them, and
    every run of the groups (between white space) inside one: which of them is a segment,
    and where it begins and ends, is for the dynamic program to choose."""
    at, digit, low = "@" in text, re.search("[0-9]", text), text.lower()
    found = {m.span() for i, form in enumerate(_FORMS) if (at if i < 2 else digit) for m in form.finditer(text)}
    if any(w in low for w in _SECRET):
        found.update(m.span(1) for m in _TOLD.finditer(text))
    for s, e in list(found):
        groups = [m.span() for m in _GROUP.finditer(text, s, e)]
        if 1 < len(groups) <= MAX_TOKENS and not _IBAN.fullmatch(text, s, e):
            found.update((a, b) for i, (a, _) in enumerate(groups) for _, b in groups[i:])
    for s, e in list(found):
        if not text[e - 1].isalnum():
            found.add((s, e - 1))
            while e > s and not text[e - 1].isalnum():
                e -= 1
            found.add((s, e))
    return sorted(x for x in found if x[0] < x[1])


class Lattice:
    """Tokens of text[lo:hi] and candidate segments between token boundaries (those of
    the whole text, where they are not given)."""

    def __init__(self, text: str, lo: int, hi: int, clamped: list[tuple[str, int, int]], candidates: list[tuple[int, int]] | None = None):
        piece = text[lo:hi]
        if candidates is None:
            candidates = _candidates(text)
        bounds = {0, len(piece)}
        for m in _TOKEN.finditer(piece):
            bounds.update(m.span())
        for _, s, e in clamped:
            bounds.update((min(max(s - lo, 0), len(piece)), min(max(e - lo, 0), len(piece))))
        cuts = sorted(bounds)
        place = {c: i for i, c in enumerate(cuts)}
        self.n = len(cuts) - 1
        self.cuts = [c + lo for c in cuts]
        #: By end boundary: (start boundary, features, allowed kinds or None for all).
        self.ends: list[list[tuple[int, list[str], tuple[str, ...] | None]]] = [[] for _ in cuts]
        spans = {(s, e): k for k, s, e in clamped if lo <= s and e <= hi}
        seen = set(spans)
        for s, e in candidates:
            if lo <= s and e <= hi and not any(a < e and s < b for a, b in spans):
                seen.add((s, e))
        for s, e in sorted(seen):
            i, j = place.get(s - lo), place.get(e - lo)
            if i is None or j is None or i >= j or (j - i > MAX_TOKENS and (s, e) not in spans):
                opaque = i is not None and j is not None and (" " not in text[s:e] or _IBAN.fullmatch(text[s:e]))
                if not opaque:
                    continue
            self.ends[j].append((i, _features(text, s, e, text[max(0, s - CONTEXT_CHARS) : s]), (spans[s, e],) if (s, e) in spans else None))

    def __bool__(self) -> bool:
        return any(kinds is None for x in self.ends for _, _, kinds in x)


Weights = dict[str, float]
_STATES = ("O", *KINDS)


def _segment_scores(lat: Lattice, w: Weights) -> list[list[tuple[int, list[float], list[str]]]]:
    out = []
    for arcs in lat.ends:
        row = []
        for i, features, kinds in arcs:
            row.append((i, [sum(w.get(f"{f}|{k}", 0.0) for f in features) if kinds is None or k in kinds else -math.inf for k in KINDS], features))
            if kinds is not None:
                row[-1] = (i, [50.0 if k in kinds else -math.inf for k in KINDS], features)
        out.append(row)
    return out


def _after(state: int, w: Weights) -> list[float]:
    """Transition scores from a state; ``O`` to anything is free."""
    return [0.0 if state == 0 or t == 0 else w.get(f"next={_STATES[state]}>{_STATES[t]}", 0.0) for t in range(len(_STATES))]


def decode(lat: Lattice, w: Weights) -> list[tuple[str, int, int]]:
    """The best segmentation; ties keep the earlier arc, outside tokens first."""
    arcs, turn = _segment_scores(lat, w), [_after(s, w) for s in range(len(_STATES))]
    best = [[-math.inf] * len(_STATES) for _ in range(lat.n + 1)]
    back: list[list[tuple[int, int] | None]] = [[None] * len(_STATES) for _ in range(lat.n + 1)]
    best[0][0] = 0.0
    for j in range(1, lat.n + 1):
        s = max(range(len(_STATES)), key=lambda x: best[j - 1][x])
        best[j][0], back[j][0] = best[j - 1][s], (j - 1, s)
        for i, scores, _ in arcs[j]:
            for k, score in enumerate(scores, 1):
                if score == -math.inf:
                    continue
                for s in range(len(_STATES)):
                    total = best[i][s] + turn[s][k] + score
                    if total > best[j][k]:
                        best[j][k], back[j][k] = total, (i, s)
    out, j = [], lat.n
    k = max(range(len(_STATES)), key=lambda x: best[j][x])
    while j:
        i, s = back[j][k]
        if k:
            out.append((_STATES[k], lat.cuts[i], lat.cuts[j]))
        j, k = i, s
    return out[::-1]


def _lse(xs: list[float]) -> float:
    top = max(xs)
    return top if top == -math.inf else top + math.log(sum(math.exp(x - top) for x in xs))


def _gradient(lat: Lattice, gold: set[tuple[str, int, int]], w: Weights) -> tuple[float, Weights]:
    """Log likelihood of the gold segmentation and its gradient (forward-backward)."""
    arcs, turn = _segment_scores(lat, w), [_after(s, w) for s in range(len(_STATES))]
    m, n = len(_STATES), lat.n
    alpha = [[-math.inf] * m for _ in range(n + 1)]
    alpha[0][0] = 0.0
    for j in range(1, n + 1):
        alpha[j][0] = _lse(alpha[j - 1])
        for i, scores, _ in arcs[j]:
            for k, score in enumerate(scores, 1):
                if score > -math.inf:
                    alpha[j][k] = _lse([alpha[j][k], *(alpha[i][s] + turn[s][k] + score for s in range(m))])
    beta = [[-math.inf] * m for _ in range(n + 1)]
    beta[n] = [0.0] * m
    starts: list[list[tuple[int, list[float], list[str]]]] = [[] for _ in range(n + 1)]
    for j, row in enumerate(arcs):
        for i, scores, features in row:
            starts[i].append((j, scores, features))
    grad: Weights = {}
    total = _lse(alpha[n])
    for i in range(n - 1, -1, -1):
        for s in range(m):
            terms = [beta[i + 1][0]]
            for j, scores, features in starts[i]:
                for k, score in enumerate(scores, 1):
                    if score > -math.inf:
                        v = turn[s][k] + score + beta[j][k]
                        terms.append(v)
                        p = math.exp(min(0.0, alpha[i][s] + v - total)) if alpha[i][s] > -math.inf else 0.0
                        if p > 1e-9:
                            for f in features:
                                grad[f"{f}|{KINDS[k - 1]}"] = grad.get(f"{f}|{KINDS[k - 1]}", 0.0) - p
                            if s:
                                t = f"next={_STATES[s]}>{KINDS[k - 1]}"
                                grad[t] = grad.get(t, 0.0) - p
            beta[i][s] = _lse(terms)
    score, previous = 0.0, (0, 0)
    for kind, s, e in sorted(gold, key=lambda x: x[1]):
        i, j = lat.cuts.index(s), lat.cuts.index(e)
        features, scores = next((f, sc) for a, sc, f in arcs[j] if a == i)
        score += scores[KINDS.index(kind)]
        for f in features:
            grad[f"{f}|{kind}"] = grad.get(f"{f}|{kind}", 0.0) + 1.0
        if previous[1] and previous[0] == i:
            t = f"next={_STATES[previous[1]]}>{kind}"
            score += w.get(t, 0.0)
            grad[t] = grad.get(t, 0.0) + 1.0
        previous = (j, KINDS.index(kind) + 1)
    return score - total, grad


def _sentences(seed: int, n: int) -> Iterator[tuple[str, list[tuple[str, int, int]]]]:
    """Generated training sentences with their gold spans (kinds the base patterns
    miss, and look-alikes that are nothing)."""
    rnd = random.Random(seed)
    digits = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    hexes = lambda k: "".join(rnd.choice("0123456789abcdef") for _ in range(k))
    word = lambda: "".join(rnd.choice("abcdefghiklmnoprstuvw") for _ in range(rnd.randint(2, 9)))
    letters = lambda k: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(k))
    mixed = lambda k: "".join(rnd.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ") for _ in range(k))

    def bank() -> str:
        """An IBAN with a bank code, in groups of four."""
        land, rest = rnd.choice([("GB", 14), ("IE", 14), ("NL", 10)])
        whole = land + digits(2) + letters(4).upper() + digits(rest)
        return " ".join(whole[i : i + 4] for i in range(0, len(whole), 4))

    for _ in range(n):
        kind = rnd.choice(["secret", "secret", "account", "handle", "national", "phone", "card", "email", None, None, None])
        cue = rnd.choice([*(_CUES.get(kind or "", "").split() or [word(), rnd.choice(_SECRET)]), word(), word()])
        told = rnd.random() < 0.3 and kind == "secret"
        if told:
            cue = rnd.choice(_SECRET)
        value = {
            "secret": lambda: rnd.choice([hexes(rnd.choice([32, 40, 64])), "sk_" + hexes(24), hexes(40).upper(), "".join(rnd.choice("ABCDEFGHIJKLMNOPabcdefghijk0123456789") for _ in range(rnd.randint(20, 44)))]) if not told else rnd.choice([mixed(rnd.randint(10, 40)), letters(rnd.randint(14, 32)), letters(rnd.randint(4, 7)) + rnd.choice("-_!.") + mixed(rnd.randint(4, 9))]),
            "account": lambda: rnd.choice([f"DE{digits(2)} {digits(4)} {digits(4)} {digits(4)} {digits(4)} {digits(2)}", f"GB{digits(2)}ABCD{digits(8)}{digits(4)}", bank(), digits(16), digits(rnd.randint(10, 15))]),
            "handle": lambda: "@" + word() + rnd.choice(["", "_", digits(2)]) + word(),
            "national": lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
            "phone": lambda: rnd.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"0{digits(2)} {digits(4)} {digits(4)}"]),
            "card": lambda: " ".join(digits(4) for _ in range(4)),
            "email": lambda: word() + "ü." + word() + "@" + word() + "." + rnd.choice(["com", "org", "de"]),
            None: lambda: rnd.choice([digits(rnd.randint(1, 6)), f"{digits(1)}.{digits(2)}.{digits(1)}", f"20{digits(2)}-{digits(2)}-{digits(2)}", f"{digits(4)}/{digits(3)}", word() + digits(2), f"{digits(2)}:{digits(2)}", word() + "-" + word() + digits(1), word(), word()]),
        }[kind]()
        before = " ".join(word() for _ in range(rnd.randint(1, 4))) + " " + cue + rnd.choice([" ", " ", ": ", ' = "'])
        after = ('"' if before.endswith('"') else "") + rnd.choice([" ", ". ", ", ", "$$$ "]) + " ".join(word() for _ in range(rnd.randint(1, 3)))
        yield before + value + after, [(kind, len(before), len(before) + len(value))] if kind else []


@lru_cache(maxsize=4)
def train(seed: int = 7, sentences: int = 900, epochs: int = 6, rate: float = 0.15, decay: float = 1e-3) -> Weights:
    """Weights by stochastic gradient ascent on the conditional likelihood."""
    w: Weights = {}
    made = []
    for text, gold in _sentences(seed, sentences):
        base = base_spans(text)
        lat = Lattice(text, 0, len(text), _disjoint(base))
        kept = {g for g in gold if not any(s < g[2] and g[1] < e for _, s, e in base)}
        if lat and all(s in lat.cuts and e in lat.cuts and any(lat.cuts[a] == s for a, _, _ in lat.ends[lat.cuts.index(e)]) for _, s, e in kept):
            made.append((lat, kept | {b for b in _disjoint(base)}))
    order = random.Random(seed)
    for epoch in range(epochs):
        order.shuffle(made)
        for lat, gold in made:
            _, grad = _gradient(lat, gold, w)
            for f, g in grad.items():
                w[f] = w.get(f, 0.0) * (1 - decay) + rate / (1 + epoch / 2) * g
    return {f: round(x, 4) for f, x in w.items() if abs(x) > 1e-3}


def _disjoint(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Base spans of different kinds may overlap; the lattice is clamped to the
    earliest, then longest, of each overlapping run."""
    out: list[tuple[str, int, int]] = []
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2], KINDS.index(x[0]))):
        if not out or s >= out[-1][2]:
            out.append((k, s, e))
    return out


def _regions(spans: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Neighbourhoods: runs of spans (sorted) that overlap or nearly touch."""
    lo = hi = -1
    for start, end in spans:
        if lo < 0:
            lo, hi = start, end
        elif start - hi <= 2:
            hi = max(hi, end)
        else:
            yield lo, hi
            lo, hi = start, end
    if lo >= 0:
        yield lo, hi


#: A neighbourhood longer than this is decoded in overlapping parts.
REGION_CHARS = 4096


def find_spans(text: str, w: Weights) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), both by kind as listed and start."""
    base = base_spans(text)
    clamp = _disjoint(base)
    extra: set[tuple[str, int, int]] = set()
    at = 0
    candidates = _candidates(text)
    for lo, hi in _regions(sorted({*candidates, *(c[1:] for c in clamp)})):
        for a in range(lo, hi, REGION_CHARS):
            b = min(hi, a + REGION_CHARS + 560)
            while at < len(clamp) and clamp[at][2] <= a:
                at += 1
            own = []
            for c in clamp[at:]:
                if c[1] >= b:
                    break
                own.append(c)
            lat = Lattice(text, a, b, own, candidates[bisect_left(candidates, (a, 0)) : bisect_left(candidates, (b, 0))])
            if lat:
                extra.update(x for x in decode(lat, w) if x not in own)
    added: list[tuple[str, int, int]] = []
    for k, s, e in sorted(extra, key=lambda x: (x[1], -x[2], KINDS.index(x[0]))):
        if (not added or s >= added[-1][2]) and not any(a < e and s < b for _, a, b in base):
            added.append((k, s, e))
    order = lambda x: (KINDS.index(x[0]), x[1])
    return base, sorted({*base, *added}, key=order)


def _said(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find(docs: DataFrame, id_col: str = "doc_id", weights: Weights | None = None) -> DataFrame:
    """One row per row of ``docs``: the id, the number of base spans of each kind,
    base_sha256, ``spans`` (all, as text), n_spans (their number) and ``found`` (array of
    kind, start, end, text). A null text is empty (no spans); repeated rows are each answered; other
    columns are not read. Offsets are code points, ends exclusive."""
    shared = docs.sparkSession.sparkContext.broadcast(weights if weights is not None else train())
    src = bound_batches(docs).select(F.col(id_col).alias("k"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            cols: list[list] = [[] for _ in range(8)]
            for text in batch.column("text").to_pylist():
                base, every = find_spans(text, w)
                row = [*(sum(k == kind for k, _, _ in base) for kind in BASE), hashlib.sha256(_said(base).encode()).hexdigest(), _said(every), len(every), [{"kind": k, "start": s, "end": e, "text": text[s:e]} for k, s, e in every]]
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64(), found_type]
            yield pa.RecordBatch.from_arrays([batch.column("k"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["k", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans", "found"])

    kind = src.schema["k"].dataType.simpleString()
    out = src.mapInArrow(run, f"k {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, found array<struct<kind:string,start:long,end:long,text:string>>")
    return out.withColumnRenamed("k", id_col)
