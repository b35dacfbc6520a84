"""Page extraction: parsing, scoring, votes by host, odd rows, and whole pages against a plain reading."""

import html as references
import re

import pytest

from seqwright.llm import html
from seqwright.llm.queries import QUERIES


def own(text):
    return html.text_of(html.parse(text), None)


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("", ""),
        ("just text &amp; more &lt;b&gt;", "just text & more <b>"),
        ("<p>a<p>b  \n c<br>d&nbsp;e", "a\n\nb c d e"),
        ("<article><h1>T &am</h1><p><b>x.<br></article><p>out", "T &am\n\nx."),
        ("<nav>menu</nav><div><p>one two three</p></div><footer>f</footer>", "one two three"),
        ('<script>var t="<p>no</p>";</script><style>p{}</style><p>yes</p>', "yes"),
        ("<article>a <!-- no --> b<!-- <p>no</p> --></article>", "a b"),
        ('<article><a href="x>y">li</a>nk</article>', "link"),
        ("<article><form><p>f</p></form><aside>s</aside><button>b</button><p>t</p><section class='comments'><p>long comment here, long comment here</p></section></article>", "t"),
        ("<article><header><h1>Title</h1><p>by me</p></header><p>text</p><footer>f</footer></article>", "Title\n\ntext"),
        ("<body class='no-sidebar'><div class='content'><p>kept text</p></div><div id='cookie-notice'>We use cookies on this site, a lot of them</div>", "kept text"),
        ("<article><ul><li>a<li>b<ul><li>c</ul></ul><table><tr><td>d<td>e</table></article>", "a\n\nb\n\nc\n\nd\n\ne"),
        ("<ARTICLE><P>Up</P></ARTICLE>", "Up"),
        ("<article><p>a < b and <3 </p></article>", "a < b and <3"),
        ("<article><p>x</i></div></p>y</article>", "x\n\ny"),
        ("<article><p hidden>no</p><p>yes</p><p style='display: none'>maybe</p></article>", "yes\n\nmaybe"),
        ("<div><h2>Head</h2><div class=t><p>body text, long enough</p></div></div><div><p>x</p></div>", "Head\n\nbody text, long enough"),
        ("<script>never closed <p>x</p>", ""),
        ("<article>a<!-- never closed", "a"),
        ("<article><p>&eacute;&#233;&#xe9;&copy &unknown; &#0;</p></article>", "ééé© &unknown; �"),
    ],
)
def test_text(text, wanted):
    assert own(text) == wanted


def test_deep_and_long_pages():
    assert own("<div>" * 3000 + "x" + "</div>" * 3000) == "x"
    assert len(own("<article>" + "<p>word word</p>" * 20000 + "</article>")) == 20000 * 11 - 2
    assert own("<article><p>" + "<" * 20000 + "</p></article>").count("<") == 20000


def test_paths_are_general():
    a, b = (html.parse(f'<html><body><div class="b a{k}"><div class="post-{k}"><p>text of some length</p></div></div></body></html>') for k in (1, 22))
    assert html.path_of(a, html.best(a)) == html.path_of(b, html.best(b)) == "/div.a#.b/div.post-#"


def test_host_decides(spark):
    """A page whose longest container is not the host's takes the host's; one without it takes its own."""
    usual = '<div class="story"><p>{}</p></div><div class="extra"><p>x</p></div>'
    odd = '<div class="story"><p>short</p></div><div class="extra"><p>a longer text than the story has, here</p></div>'
    rows = [(k, f"http://u@A.example.org:80/{k}", usual.format(f"text of page {k}, of some length")) for k in range(5)]
    rows += [(9, "https://a.example.org?x", odd), (10, "http://b.example.org/", odd), (11, "http://a.example.org/", "<main><p>else</p></main>"), (12, None, odd)]
    found = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[9] == "short" and found[10] == found[12] == "a longer text than the story has, here" and found[11] == "else" and found[0] == "text of page 0, of some length"


def test_ties_and_odd_rows(spark):
    rows = [(1, None, None), (2, "", ""), (3, "no host", "<p>a</p>"), (4, "http://h/x", None), (None, "http://h/x", "<div class=b><p>bb</p></div>"), (5, "http://h/y", "<div class=a><p>aa</p></div>"), (5, "http://h/y", "<div class=a><p>aa</p></div>"), (6, "http://h/z", "<div class=b><p>cc</p></div>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'p' AS path", "'h' AS host", "1 AS text", "2 AS score")
    found = sorted(((r.page_id, r.text) for r in html.extract(pages).collect()), key=repr)
    assert found == sorted([(1, ""), (2, ""), (3, "a"), (4, ""), (None, "bb"), (5, "aa"), (5, "aa"), (6, "cc")], key=repr)
    won = html.winners(html.votes(pages.select("page_id", "url", "html"))).collect()
    assert [(r.host, r.path) for r in won] == [("h", "/div.a")]  # two votes each of equal score: the least path
    assert html.extract(pages.limit(0)).collect() == []


def test_query_against_plain_reading(spark):
    """The pages of the table have one article each, in p and h1."""
    path = "/root/testdata/sf0.01"
    got = {r.page_id: r for r in QUERIES["op13_page_text"](spark, path).collect()}
    pages = spark.read.parquet(f"{path}/pages.parquet").collect()
    assert len(pages) == len(got)
    for r in pages:
        inner = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(references.unescape(re.sub("<[^>]*>", " ", b.replace("<b>", ""))).split()) for b in re.split("</?(?:p|h1)>", inner)]
        wanted = "\n\n".join(b for b in blocks if b)
        assert got[r.page_id].text == wanted and got[r.page_id].n_chars == len(wanted) and got[r.page_id].url == r.url
