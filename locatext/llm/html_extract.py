"""Main-text extraction with a site style tree.

All pages of a host are merged into one style tree: a node is the chain of elements
(tag and class) from the root, and keeps in how many distinct pages it stands, with
how many presentations (sequences of child elements) and how many contents. The
importance of a node joins two entropies over the host's pages, of presentation and of
content: navigation, footers and notices repeat, articles differ. Branches of low
importance go, and of the containers that stand side by side on a page those whose
presentation hardly varies beside one that does (a footer is one line everywhere, an
article has as many paragraphs as it needs). Entropy alone cannot tell an advert (different on every page) from an
article, nor say anything on a host of a few pages; what is left after the tree is
therefore judged by what its elements or classes name. Within a marked article the tree
judges the branches over the host's distinct articles, so copies of one article are no
template; and where unmarked branches of a page outweigh its marked ones, both are its
text.

The statistics are gathered per host with map-side partial counts; a hot host is one
key of a combined aggregate, and its pages are never brought together."""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator, Mapping
from functools import lru_cache
from types import MappingProxyType

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locatext.llm.arrays import bound_batches
from locatext.session import written

#: A branch is judged by entropy only on hosts with this many distinct pages that have it.
MIN_PAGES = 8
#: Importance (0 to 1) under which a branch goes.
LOW_IMPORTANCE = 0.2
#: Where the branches of a page part, a container goes whose presentation varies less
#: than this share of the one that varies most, if that has this entropy at least.
LOW_SHARE, MUCH_VARIETY = 0.5, 0.5

#: Branches (of 24 bytes) that are broadcast; a larger tree meets the pages by host.
BROADCAST_BRANCHES = 1 << 18

# Elements of HTML by their role.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe noembed noframes xmp".split())
_RCDATA = frozenset(("title", "textarea"))
_BOILERPLATE = frozenset("head nav header footer aside form button select option input textarea label fieldset dialog menu svg canvas object audio video map".split()) | _RAW
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption option legend".split())
_CLOSES_P = _BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "legend"}
_MAIN = frozenset(("article", "main"))
_CONTAINERS = frozenset("div section nav header footer aside form fieldset dialog center details menu ul ol".split())
_NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|adsense|adbox|banner|promo(?:tion)?s?|sponsor(?:ed|s)?|sidebar|side|nav(?:bar|igation)?|menu|breadcrumbs?|header|masthead|footer|copyright|cookies?|consent|gdpr|notices?|notification|alert|popup|modal|overlay|newsletter|subscribe|signup|login|search|share|sharing|social|related|recommended|comments?|commentlist|disqus|replies|reply|respond|discussion|widget|toolbar|skip|pagination|pager|tags|toc)(?:$|[\s_-])",
    re.I,
)
_CONTENT = re.compile(r"(?:^|[\s_-])(?:article|content|entry|post|story|main|body|text)(?:$|[\s_-])", re.I)
_TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|</\s*([A-Za-z][^\s/>]*)[^>]*(?:>|$)|<([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?(?=\s|/|$)", re.I)


class Block:
    """One run of text between block boundaries, with the open elements around it."""

    __slots__ = ("path", "named", "main", "raw")

    def __init__(self, path: tuple[str, ...], named: bool, main: int, raw: list[str]):
        #: ``main`` is the length of the path to the outermost marked element, 0 without one.
        self.path, self.named, self.main, self.raw = path, named, main, raw

    def text(self) -> str:
        return " ".join(html.unescape("".join(self.raw)).split())


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTR.finditer(raw)} if raw else {}


def _role(tag: str, attributes: dict[str, str]) -> tuple[str, bool, bool]:
    """(name in the style tree, named boilerplate, marked main text) of an element."""
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}".strip()
    role = attributes.get("role", "").lower()
    label = f"{tag}.{'.'.join(sorted(names.lower().split()))}" if names else tag
    named = tag in _BOILERPLATE or role in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "dialog", "alert")
    main = tag in _MAIN or role in ("main", "article")
    if names and not named and tag not in ("html", "body", *_MAIN):
        named = bool(_NAMED.search(names)) and not _CONTENT.search(names)
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        named = True
    return label, named, main


def blocks(page: str) -> list[Block]:
    """Blocks of a page in order, by a forgiving one-pass reading: unclosed and
    misplaced elements are closed where a browser would close them."""
    out: list[Block] = []
    stack: list[tuple[str, str, bool, int]] = []  # tag, label, named here or above, main here or above
    raw: list[str] = []

    def cut() -> None:
        if raw:
            if any(not x.isspace() for x in raw):
                out.append(Block(tuple(s[1] for s in stack), bool(stack and stack[-1][2]), stack[-1][3] if stack else 0, list(raw)))
            raw.clear()

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            raw.append(page[at:])
            break
        if lt > at:
            raw.append(page[at:lt])
        m = _TAG.match(page, lt)
        if not m:
            raw.append("<")
            at = lt + 1
            continue
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag in _BLOCK:
                cut()
            if tag in ("html", "body"):
                continue
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if tag not in _BLOCK and any(s[0] in _BLOCK for s in stack[i + 1 :]):
                        # An inline element that blocks were opened in ends alone.
                        del stack[i]
                    else:
                        del stack[i:]
                    break
                if tag in ("p", "li") and stack[i][0] in ("article", "section", "div", "td", "th", "main", "body", "ul", "ol"):
                    break
        elif m[2]:
            tag = m[2].lower()
            attributes = _attributes(m[3])
            if tag in _BLOCK:
                cut()
                while tag in _CLOSES_P and (i := next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == "p"), -1)) >= 0 and not any(s[0] in ("td", "th", "button", "object") for s in stack[i:]):
                    # The paragraph ends; inline elements left open in it end with it.
                    del stack[i:]
                peers = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}.get(tag, ())
                if peers and (i := next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in peers or stack[k][0] in ("ul", "ol", "dl", "table", "select")), -1)) >= 0 and stack[i][0] in peers:
                    del stack[i:]
            if tag == "body" or tag == "html":
                stack = [s for s in stack if s[0] != "head"]
            if tag == "br":
                raw.append("\n")
            if tag in _VOID or m[3].endswith("/") and tag not in _BLOCK:
                continue
            if tag in _RAW or tag in _RCDATA:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|$)[^>]*(?:>|$)", re.I).search(page, at)
                at = end.end() if end else n
                continue
            label, named, main = _role(tag, attributes)
            up = stack[-1] if stack else ("", "", False, 0)
            stack.append((tag, label, named or up[2], up[3] or (len(stack) + 1 if main else 0)))
        elif page.startswith("<![CDATA[", lt):
            raw.append(html.escape(page[lt + 9 : m.end() - (3 if page.endswith("]]>", lt, m.end()) else 0)]))
    cut()
    return out


def _digest(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\x00".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _prefixes(path: tuple[str, ...]) -> list[tuple[str, ...]]:
    """Style-tree branches above a block, below html and body."""
    skip = next((i + 1 for i in range(len(path) - 1, -1, -1) if path[i].split(".")[0] in ("body", "html")), 0)
    return [path[: i + 1] for i in range(skip, len(path))]


def _branches(page_blocks: list[Block]) -> dict[int, tuple[int, int]]:
    """For each branch of the page: digests of its presentation (children in order) and content."""
    seen: dict[tuple[str, ...], tuple[list[str], list[str]]] = {}
    for b in page_blocks:
        text = "".join(b.raw)
        for p in _prefixes(b.path):
            shape, content = seen.setdefault(p, ([], []))
            shape.append("/".join(b.path[len(p) :]))
            content.append(text)
    return {_digest(*p): (_digest(*shape), _digest(*content)) for p, (shape, content) in seen.items()}


@lru_cache(maxsize=1 << 16)
def _branch(path: tuple[str, ...]) -> int:
    return _digest(*path)


@lru_cache(maxsize=1 << 12)
def _teaser(path: tuple[str, ...]) -> int:
    """A marked element as a branch among its host's pages, not among its articles."""
    return _digest("page", *path)


def _sightings(page: str) -> Iterator[tuple[int, int, int, int]]:
    """(branch, presentation, content, what it is counted in) of all branches: the page,
    or within a marked element the article."""
    found = blocks(page)
    left = [b for b in found if not b.named]
    seen, own = _branches(found), _digest(page)
    article = _digest(*("".join(b.raw) for b in left if b.main))
    inside = {_branch(p): b.main and len(p) >= b.main for b in found for p in _prefixes(b.path)}
    for branch, marked in inside.items():
        yield branch, *seen[branch], article if marked else own
    for path in {b.path[: b.main] for b in left if b.main}:
        if (branch := _branch(path)) in seen:
            yield _teaser(path), *seen[branch], own


def host_of(url: str | None) -> str:
    """Lower-cased host of a URL without user and port; empty if there is none."""
    m = re.match(r"\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", url or "")
    return re.sub(r":\d*$", "", m[1].rpartition("@")[2]).lower() if m else ""


def _observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), *[pa.int64()] * 4]
    for batch in batches:
        rows: set[tuple[str, int, int, int, int]] = set()
        for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
            host = host_of(url)
            rows.update((host, *x) for x in _sightings(page))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["host", "branch", "shape", "content", "page"])


def style_tree(pages: DataFrame) -> DataFrame:
    """The merged trees of all hosts: host, branch, pages, contents, importance and
    presentation (that part of it). Only
    distinct pages of a host count (within a marked element, distinct articles), so
    copies of one article are no template.
    Importance is a weighted mean of the content's and the presentation's entropy,
    each over the log of the number of pages."""
    seen = pages.mapInArrow(_observe, "host string, branch long, shape long, content long, page long").distinct()
    by_content = seen.groupBy("host", "branch", "shape", "content").agg(F.count("*").alias("c"))
    by_shape = by_content.groupBy("host", "branch", "shape").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.log("c")).alias("clogc"), F.count("*").alias("k"))
    nodes = by_shape.groupBy("host", "branch").agg(F.sum("s").alias("n"), F.sum("clogc").alias("clogc"), F.sum(F.col("s") * F.log("s")).alias("slogs"), F.sum("k").alias("contents"))
    entropy = lambda x: F.when(F.col("n") > 1, (F.log("n") - F.col(x) / F.col("n")) / F.log("n")).otherwise(F.lit(1.0))
    return nodes.select("host", "branch", F.col("n").alias("pages"), "contents", ((entropy("clogc") * 3 + entropy("slogs")) / 4).alias("importance"), entropy("slogs").alias("presentation"))


def judged_branches(tree: DataFrame) -> DataFrame:
    """Per host the branches that can be judged with their importance, as one array (as
    long as the host's style tree at most)."""
    return tree.where(F.col("pages") >= MIN_PAGES).groupBy("host").agg(F.collect_list(F.struct("branch", "importance", "presentation")).alias("judged"))


def _parted(found: list[Block]) -> list[tuple[str, ...]]:
    """For each block the branch in which it parts from the page's other blocks."""
    whole = [_prefixes(b.path) for b in found]
    shared = 0
    while all(len(w) > shared for w in whole) and len({w[shared] for w in whole}) == 1:
        shared += 1
    return [w[min(shared, len(w) - 1)] if w else () for w in whole]


def _uniform(found: list[Block], presentation: Mapping[int, float]) -> set[tuple[str, ...]]:
    """The containers whose presentation hardly varies beside one that does."""
    variety = {p: presentation.get(_branch(p), 1.0) for p in set(_parted(found)) if p}
    judged = [v for p, v in variety.items() if _branch(p) in presentation]
    best = max(judged, default=0.0)
    return {p for p, v in variety.items() if best >= MUCH_VARIETY and v < LOW_SHARE * best and p[-1].split(".")[0] in _CONTAINERS}


def main_text(page: str, low: frozenset[int], importance: Mapping[int, float] = MappingProxyType({}), presentation: Mapping[int, float] = MappingProxyType({})) -> str:
    """The article of one page, without the branches in ``low``."""
    found = blocks(page)
    if presentation:
        gone = _uniform(found, presentation)
        # A marked element is no template for being presented alike.
        found = [b for b, p in zip(found, _parted(found), strict=True) if p not in gone or b.main]
    if low:
        found = [b for b in found if not any(_branch(p) in low for p in _prefixes(b.path) if len(p) >= b.main)]
    # What differs from page to page and is yet no article (adverts, comments), and hosts
    # of a few pages, are left to names.
    found = [b for b in found if not b.named]
    marked = [b for b in found if b.main]
    if marked and len(marked) < len(found):
        # Unmarked text counts as far as the tree has seen its branch differ.
        weight = sum(importance.get(_branch(b.path), 0.0) * len(b.text()) for b in found if not b.main)
        if weight > sum(len(b.text()) for b in marked):
            marked = [b for b in found if not b.main or _teaser(b.path[: b.main]) not in low]
    return "\n".join(t for b in marked or found if (t := b.text()))


def extract(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """One row per row of ``pages``: id, url, text, n_chars. Null or empty html gives
    an empty text; a null or hostless url belongs to the empty host; repeated rows are
    each answered; other columns are not read."""
    src = bound_batches(pages).select(F.col(id_col).alias("k"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    host = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_extract(F.coalesce("url", F.lit("")), r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1), r"^.*@", ""), r":[0-9]*$", ""))
    judged = written(judged_branches(style_tree(src.select("url", "html"))), "style-tree")
    # Pages are not dealt by host while the judged branches are few enough to broadcast;
    # beyond, they are, and adaptive execution splits a hot host.
    if (judged.agg(F.sum(F.size("judged"))).first()[0] or 0) <= BROADCAST_BRANCHES:
        judged = F.broadcast(judged)
    joined = src.withColumn("host", host).join(judged, "host", "left").select("k", "url", "html", "judged")
    kind = src.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: tuple[list | None, frozenset[int], dict[int, float], dict[int, float]] = (None, frozenset(), {}, {})
        for batch in batches:
            texts = []
            for page, branches in zip(batch.column("html").to_pylist(), batch.column("judged").to_pylist(), strict=True):
                if branches != memo[0]:
                    importance = {x["branch"]: x["importance"] for x in branches or ()}
                    memo = (branches, frozenset(b for b, x in importance.items() if x < LOW_IMPORTANCE), importance, {x["branch"]: x["presentation"] for x in branches or ()})
                texts.append(main_text(page, *memo[1:]))
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["k", "url", "text", "n_chars"])

    return joined.mapInArrow(run, f"k {kind}, url string, text string, n_chars long").withColumnRenamed("k", id_col)
