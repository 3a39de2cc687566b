import html
import re

import pytest

from surveyspark.llm import html_extract as H
from surveyspark.llm.common import table
from surveyspark.llm.html_tree import parse
from surveyspark.llm.queries import op12_html_extract

SMOKE = "/root/testdata/sf0.001"
NONE = frozenset()


def text(page, low=NONE):
    return H.main_text(parse(page)[0], low, 0)[0]


def rows(ready, pages):
    df = ready.createDataFrame([(i, u, h, "kept") for i, (u, h) in enumerate(pages)], "page_id long, url string, html string, text string")
    return {r.page_id: r for r in H.extract(df).collect()}


def test_given_pages_hold_their_article(ready):
    """The given pages' article is a heading and paragraphs; a plain pattern finds the same blocks."""
    got = {r.page_id: r for r in op12_html_extract(ready, SMOKE).collect()}
    pages = table(ready, SMOKE, "pages").collect()
    assert len(got) == len(pages)
    for p in pages:
        body = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("</?b>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        want = "\n".join(b for b in blocks if b)
        assert got[p.page_id].text == want and got[p.page_id].n_chars == len(want) and got[p.page_id].url == p.url


@pytest.mark.parametrize("page,want", [
    (None or "", ""),
    ("plain text", "plain text"),
    ("<p>a<p>b <i>c</i>\n d<br>e</p>f", "a\nb c d e\nf"),
    ("<ul><li>a<li>b</ul>", "a\nb"),
    ("<table><tr><td>1<td>2<tr><th>3</table>", "1\n2\n3"),
    ("<div>a &amp;&lt;b&gt; &eacute;&#233;&#xe9; &nbsp; &am &amp</div>", "a &<b> ééé &am &"),
    ("<script>var t='</p>';</script><style>p{}</style><p>x</p><noscript>n</noscript>", "x"),
    ("<!-- <p>no</p> --><p>yes<!-- cut", "yes"),
    ("<head><title>t</title><meta charset=x><p>body without a body tag</p>", "body without a body tag"),
    ("<nav><a href='/'>menu</a></nav><header>h</header><p>x</p><aside>s</aside><footer>f</footer>", "x"),
    ("<article><header><h1>T</h1></header><p>x</p></article>", "T\nx"),
    ("<form><input><p>f</p></form><p>x <button>b</button>y</p>", "x y"),
    ("<form id=all><article><p>x</p></article><p>y</p></form>", "x\ny"),
    ("<div class='has-sidebar'><p>x</p></div><div class='left sidebar'>s</div>", "x"),
    ("<article><p>x</p><section id='comments'><article class='comment'><p>c</p></article></section></article>", "x"),
    ("<article><p>x <span class=\"ad\">buy</span> y</p><div class=\"share-buttons\">s</div></article>", "x y"),
    ("<div class='article-main'><p>x</p></div><div class=cookieNotice>c</div><div hidden>h</div><p style='display: none'>h</p>", "x"),
    ("<nav><ul><li>menu<article><p>x</p></article>", "x"),
    ("<p title='a > b' data-x=\"</p>\">x</p>", "x"),
    ("<p>a < b and c<d</p>", "a < b and c"),
    ("</div></p></b>x</i>", "x"),
    ("<div>" * 500 + "deep" + "</div>" * 500, "deep"),
])
def test_pages_as_browsers_read_them(page, want):
    assert text(page) == want


def test_long_pages_stay_whole():
    page = "<article>" + "".join(f"<p>paragraph {i} <b>of a long page" for i in range(20_000))
    got = text(page)
    assert got.count("\n") == 19_999 and got.endswith("paragraph 19999 of a long page")


def site(i, host="a.example", article=None):
    """A page without any telling name: only what its site repeats tells the frame from the article."""
    words = article or [f"Sentence {k} of page {i} says {i * 7919 + k}." for k in range(2 + i % 4)]
    return (f"https://{host}/{i}",
            "<html><head><title>" + words[0] + "</title></head><body><div class=k1><ul><li>Home</li><li>About us</li></ul></div>"
            "<div class=k2><div class=k3><h1>" + words[0] + "</h1>" + "".join(f"<p>{w}</p>" for w in words[1:]) + "</div>"
            "<div class=k4>Subscribe now.</div></div><div class=k5>All rights kept.</div></body></html>"), "\n".join(words)


def test_the_tree_alone_tells_frame_from_article(ready):
    pages = [site(i) for i in range(40)]
    got = rows(ready, [p for p, _ in pages])
    assert all(got[i].text == want for i, (_, want) in enumerate(pages))
    assert all(r.n_low == 3 and r.n_rule == 0 for r in got.values())


def test_copies_of_an_article_are_kept(ready):
    """Most pages of the host are one article; it is told once, so it repeats nothing."""
    same = ["The same story.", "It stands on very many pages.", "Word by word."]
    pages = [site(i) for i in range(20)] + [site(100 + i, article=same) for i in range(60)]
    got = rows(ready, [p for p, _ in pages])
    assert all(got[i].text == want for i, (_, want) in enumerate(pages))


def test_hosts_with_few_pages_are_judged_by_all_pages(ready):
    pages = [site(i, host=f"h{i}.example") for i in range(30)]
    got = rows(ready, [p for p, _ in pages])
    assert all(got[i].text == want for i, (_, want) in enumerate(pages))


def test_without_support_nothing_is_judged(ready):
    pages = [site(i) for i in range(3)]
    got = rows(ready, [p for p, _ in pages])
    assert all("Home" in r.text and r.n_low == 0 for r in got.values())


def test_odd_pages(ready):
    odd = [(None, None), ("", ""), ("no url", "<p>x"), ("http://h/1", None), (None, "<p>y</p>"), ("http://h/1", " \n "), ("http://h/1", "<p>x"), ("http://h/1", "<p>x")]
    got = rows(ready, odd)
    assert [got[i].text for i in range(len(odd))] == ["", "", "x", "", "y", "", "x", "x"]
    assert [got[i].n_chars for i in range(len(odd))] == [0, 0, 1, 0, 1, 0, 1, 1]
    empty = ready.createDataFrame([], "page_id long, url string, html string")
    assert H.extract(empty).collect() == []
