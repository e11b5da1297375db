import html
import math
import re
from collections import Counter

import pytest
from locatext.llm import html_extract as H
from locatext.llm import queries as Q

NONE = frozenset()


@pytest.mark.parametrize(
    "page,want",
    [
        ("", ""),
        ("plain &amp; text", "plain & text"),
        ("<body><p>a<p>b<b>c</b> d\n\n e</body>", "a\nbc d e"),
        ("<nav>x</nav><article><h1>T</h1><p><b>A<br><p>B&nbsp;&nbsp;C</p></article><footer>f</footer>", "T\nA\nB C"),
        ("<article>one<script>var t='</p>'</script> two<!-- </article> --><style>p{}</style></article>", "one two"),
        ("<div class='ad'>x</div><div id=content><p>y</p></div><div class=\"site-footer\">z</div>", "y"),
        ("<article><p>a</p><section class=comments><article><p>no</p></article></section></article>", "a"),
        ("<main><ul><li>1<li>2</ul><table><tr><td>3<td>4</table></main>", "1\n2\n3\n4"),
        ("<p>a < b &lt;c&gt; <unknown>d</unknown></p>", "a < b <c> d"),
        ("<form><p>x</p></form><div hidden>y</div><div role=navigation>z</div><p>k</p>", "k"),
        ("<p title='a>b'>t</p", "t"),
        ("<textarea><p>x</textarea><p>y", "y"),
    ],
)
def test_reading(page, want):
    assert H.main_text(page, NONE) == want


def test_whole_table_against_a_plain_reading(spark):
    d = "/root/testdata/sf0.001"
    got = {r["page_id"]: r for r in Q.op7_html_extract(spark, d).collect()}
    pages = spark.read.parquet(f"{d}/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body))
        want = "\n".join(x for x in parts if x)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


def _site(n):
    return [(i, "http://h.example/x", f"<body><div class=q><div>same links here</div></div><div class=r><p>article {i} {'w' * i}</p></div></body>") for i in range(n)]


def test_repeated_branches_go_only_where_a_host_shows_them(spark):
    rows = [*_site(20), (100, "http://other.example/", _site(1)[0][2]), (101, None, None), (102, "x", "")]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, low string")
    got = {r["page_id"]: r["text"] for r in H.extract(pages).collect()}
    assert got[3] == "article 3 www" and got[100].startswith("same links here\narticle 0") and got[101] == got[102] == ""
    assert H.extract(pages.limit(0)).count() == 0


def test_importance_against_entropy_by_hand(spark):
    pages = spark.createDataFrame(_site(12), "page_id long, url string, html string")
    pages = pages.union(pages)
    rows = {r["branch"]: r for r in H.style_tree(pages.select("url", "html")).collect()}
    seen = Counter()
    shapes, contents = {}, {}
    for page in {page for _, _, page in _site(12)}:
        for b, (shape, content) in H._branches(H.blocks(page)).items():
            seen[b] += 1
            shapes.setdefault(b, Counter())[shape] += 1
            contents.setdefault(b, Counter())[shape, content] += 1

    def ent(c, n):
        return 1.0 if n < 2 else -sum(x / n * math.log(x / n) for x in c.values()) / math.log(n)

    for b, n in seen.items():
        assert rows[b]["pages"] == n
        assert abs(rows[b]["importance"] - (3 * ent(contents[b], n) + ent(shapes[b], n)) / 4) < 1e-9


def test_hosts(spark):
    urls = ["http://User@A.com:80/x", "//b.c", "nothing", None, "https://m.x/?a//b", " HTTP://Q.r#t"]
    assert [H.host_of(u) for u in urls] == ["a.com", "b.c", "", "", "m.x", "q.r"]


def _extract(spark, bodies):
    pages = spark.createDataFrame([(i, "http://h.example/x", f"<body>{b}</body>") for i, b in enumerate(bodies)], "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in H.extract(pages).collect()}


def test_repeated_branches_go_inside_marked_articles_too(spark):
    got = _extract(spark, [f"<article><p>story {i} {'w' * i}</p><div class=q>read our terms</div></article>" for i in range(20)])
    assert all(got[i] == f"story {i} {'w' * i}".strip() for i in got)


def test_copies_of_one_article_among_others_are_no_template(spark):
    bodies = [f"<div class=ad>buy {i}</div><article><h1>T</h1><p>one <b>article</b></p></article>" for i in range(40)]
    got = _extract(spark, bodies + [f"<article><h1>{i}</h1><p>other {i}</p></article>" for i in range(9)])
    assert got[3] == "T\none article" and got[44] == "4\nother 4"


@pytest.mark.parametrize("teaser", ["see our offer", "see our offer {}"])
def test_a_teaser_does_not_hide_the_main_text(spark, teaser):
    got = _extract(spark, [f"<article>{teaser.format(i)}</article><div class=r><p>a long text of page {i} {'w' * i}</p></div>" for i in range(20)])
    assert all(f"a long text of page {i}" in got[i] and ("offer" in got[i]) == ("{" in teaser) for i in got)


def test_the_tree_alone_finds_the_articles_of_real_hosts(spark):
    """Pages whose elements and classes name nothing: on every host that can be judged
    the tree gives the text that the marked pages give."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").collect()
    many = {h for h, n in Counter(H.host_of(r["url"]) for r in pages).items() if n >= 30}
    mine = [r for r in pages if H.host_of(r["url"]) in many]
    names = {"nav": "k1", "article": "k2", "footer": "k3", "ad": "k4"}

    def bare(page):
        page = re.sub(r'<div class="ad">', '<div class="k4">', page)
        page = re.sub(r"<(nav|article|footer)>", lambda m: f'<div class="{names[m[1]]}">', page)
        return re.sub(r"</(?:nav|article|footer)>", "</div>", page)

    frame = lambda rows: spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in H.extract(frame([(r["page_id"], r["url"], bare(r["html"])) for r in mine])).collect()}
    want = {r["page_id"]: H.main_text(r["html"], NONE) for r in mine}
    assert len(mine) > 500 and sum(got[k] == want[k] for k in want) / len(want) > 0.95
    assert all(H.main_text(bare(r["html"]), NONE) != want[r["page_id"]] for r in mine)


def test_long_and_repeated_pages(spark):
    page = "<article>" + "".join(f"<p>paragraph {i} &amp; more</p>" for i in range(20000)) + "</article>"
    rows = [(1, "http://a.b/c", page)] * 3 + [(2, None, page)]
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    want = "\n".join(f"paragraph {i} & more" for i in range(20000))
    assert len(got) == 4 and {(r["text"], r["n_chars"]) for r in got} == {(want, len(want))}


def test_a_large_tree_meets_the_pages_by_host(spark, monkeypatch):
    rows = spark.createDataFrame(_site(20), "page_id long, url string, html string")
    few = sorted(map(tuple, H.extract(rows).collect()))
    monkeypatch.setattr(H, "BROADCAST_BRANCHES", -1)
    assert sorted(map(tuple, H.extract(rows).collect())) == few
