import re

import pytest

from tessera.llm.html_text import Shape, extract, induce, main_text, matched, observed
from tessera.llm.html_tree import parse

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><article>no";</script></head><body>
<nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav><!-- x --><div class="ad">Buy</div>
<div class="page"><article><h1>Title &amp; more</h1><p><b>First  par.<br>Same block.<p>Second&nbsp;par &lt;x&gt; &#233;.</p>
<aside>Side</aside><div class="cookie-notice">Notice</div><form><input>Form</form><section class="comments"><p>A reader.</p></section>
<ul><li>One<li>Two</ul><table><tr><td>c1<td>c2</table><p hidden>gone</p></article></div><footer>&copy; f</footer></body></html>"""


def test_blocks_of_an_article():
    want = ["Title & more", "First par. Same block.", "Second par <x> é.", "One", "Two", "c1", "c2"]
    assert extract(PAGE) == "\n\n".join(want)


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("just text", "just text"),
        ("<p>a<p>b", "a\n\nb"),
        ("<article><p>open <b>tags", "open tags"),
        ("<main><p>m</p></main><p>outside</p>", "m"),
        ("<body><nav>n</nav><p>no article</p><footer>f</footer>", "no article"),
        ("<article>1 < 2 &am; &amp", "1 < 2 &am; &"),
        ("<article><p>cut <a href='x", "cut"),
        ("<article><pre>a\n b</pre><script>x</script>", "a b"),
        ("<article><p>in<!-- c -->side <i>w</i>ord</article>", "inside word"),
        ("<div " * 3, ""),
        ('<body class="has-sidebar"><div class="with-sidebar"><article>a<article class="comment">c</article></article><div class="sidebar">s</div></div>', "a"),
        ('<body class="search"><p>text</p>', "text"),
        ('<article class="promo">buy</article><article><p>x</article><article><p>y</article>', "x\n\ny"),
        ("<article>" + "<div>" * 3000 + "deep", "deep"),
    ],
)
def test_odd_pages(page, text):
    assert extract(page) == text


def test_simple_tree_matching_is_the_largest_matching():
    def size(a, b, x, y):
        if a.labels[x] != b.labels[y]:
            return 0

        def best(i, j):
            if i == len(a.children[x]) or j == len(b.children[y]):
                return 0
            return max(best(i + 1, j), best(i, j + 1), best(i + 1, j + 1) + size(a, b, a.children[x][i], b.children[y][j]))

        return 1 + best(0, 0)

    one = Shape(parse("<div><p>a</p><ul><li>x</li></ul><h2>t</h2><p>b</p><table></table></div>"))
    other = Shape(parse("<div><h2>t</h2><ul><li>x</li><li>y</li></ul><p>c</p><h2>u</h2></div>"))
    pairs = matched(one, other)
    assert sum(j >= 0 for j in pairs) == size(one, other, 0, 0)
    assert all(one.labels[i] == other.labels[j] for i, j in enumerate(pairs) if j >= 0)
    kept = [j for j in pairs if j >= 0]
    assert len(kept) == len(set(kept))


def test_wrapper_tells_template_from_slot():
    """Pages without an article: what stays the same over the host's pages goes, what varies is the text."""
    body = "<div id=top>My site</div><div id=box><div id=x><p>{0} text one.</p><p>{0} text two.</p></div><div id=end>All rights reserved by us</div></div>"
    pages = [f"<html><body>{body.format(word)}</body></html>" for word in ("alpha", "beta", "gamma", "delta")]
    seen = {}
    for page in pages:
        for node, same, chars in observed(page, pages[0]):
            total = seen.setdefault(node, [0, 0, 0])
            total[0] += 1
            total[1] += same
            total[2] += chars
    # the reference is as good as any other of the host's pages: its varying nodes differ in most of them
    template, slot = induce(pages[0], {k: tuple(v) for k, v in seen.items()})
    assert extract(pages[1], pages[0], template, slot) == "beta text one.\n\nbeta text two."


def test_given_pages(spark):
    """The article's text as a plain search of these regular pages finds it."""
    import html

    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/pages.parquet").collect()
    got = {r.page_id: r for r in main_text(spark.read.parquet(f"{folder}/pages.parquet")).collect()}
    assert len(got) == len(rows)
    for r in rows:
        article = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.DOTALL)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        want = "\n\n".join(x for x in parts if x)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want) and got[r.page_id].url == r.url


def test_edge_cases(spark):
    rows = [(1, None, None), (2, "http://a.b/", None), (3, "http://a.b/", ""), (4, "http://a.b/x", "<article>x"), (4, "http://a.b/x", "<article>x"), (None, "no host", "<p>y")]
    frame = spark.createDataFrame([(*r, "c", 1) for r in rows], "page_id long, url string, html string, host string, slot int")
    got = sorted((repr(r.page_id), r.text, r.n_chars) for r in main_text(frame).collect())
    assert got == [("1", "", 0), ("2", "", 0), ("3", "", 0), ("4", "x", 1), ("4", "x", 1), ("None", "y", 1)]
    assert main_text(frame.limit(0)).count() == 0


def test_copies_and_partly_equal_pages_keep_their_text(spark):
    """Of a host without articles: copies count once, and template is left out only where a page has the template's text."""
    page = "<html><body><div id=top>My site</div><div id=box><p>{0}</p></div><div id=end>{1}</div></body></html>"
    copies = [(i, "http://a.b/", page.format("same words", "rights")) for i in range(16)]
    copies += [(16 + i, "http://a.b/", page.format(f"own words {i}", "rights")) for i in range(4)]
    mostly = [(100 + i, "http://c.d/", page.format(f"words {i}", "rights" if i < 9 else "a note of this page only")) for i in range(10)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(copies + mostly, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(20)] == ["same words"] * 16 + [f"own words {i}" for i in range(4)]
    slots = [got[100 + i] for i in range(10)]
    assert slots[:9] == [f"words {i}" for i in range(9)] and slots[9].startswith("words 9")


def test_an_element_is_left_out_only_with_the_text_of_the_template():
    pages = ["<body><div id=box>{}</div><div id=end>{}</div></body>".format("text", "rights" if i else "other") for i in range(2)]
    assert extract(pages[0], pages[1], [2, 3], -1) == "other"
    # a page that differs where 80% agree is not empty, the root isn't template
    seen = {node: (5, 4, 20) for node in range(len(Shape(parse(pages[1])).labels))}
    template, slot = induce(pages[1], seen)
    assert 0 not in template and "other" in extract(pages[0], pages[1], template, slot)


def test_what_repeats_within_articles_goes(spark):
    """A block of its own and a paragraph among others that the host's pages share go, what varies stays, as does an article that is template itself."""
    page = "<body><nav>n</nav><article><h1>Title {0}</h1><p>The {0}th page has words of its own here.</p><p>Follow us for more.</p><p>Own {0} two.</p><ul><li>Terms</li><li>Shop</li></ul></article></body>"
    rows = [(i, "http://a.b/", page.format(i)) for i in range(10)]
    rows.append((10, "http://a.b/", page.format(10).replace("Follow us for more.", "No notice here.")))
    rows.append((11, "http://a.b/", page.format(11).replace("<li>Shop</li>", "<li>A list of its own</li>")))
    # two pages are too few to tell
    rows += [(20 + i, "http://c.d/", page.format(i)) for i in range(2)]
    # near copies of one article, and one article under different menus
    near = "<article><h1>Copy {0}</h1><p>Same long paragraph in all of them.</p><div>And another block.</div></article>"
    rows += [(40 + i, "http://g.h/", near.format(i)) for i in range(5)]
    rows += [(30 + i, "http://e.f/", f"<body><nav>menu {i}</nav><article><p>Same one.</p><p>Same two.</p></article></body>") for i in range(5)]
    got = {r.page_id: r.text.split("\n\n") for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(10):
        assert got[i] == [f"Title {i}", f"The {i}th page has words of its own here.", f"Own {i} two."]
    assert got[10] == ["Title 10", "The 10th page has words of its own here.", "No notice here.", "Own 10 two."]
    assert got[11] == ["Title 11", "The 11th page has words of its own here.", "Own 11 two.", "A list of its own"]
    assert all(got[20 + i] == [f"Title {i}", f"The {i}th page has words of its own here.", "Follow us for more.", f"Own {i} two.", "Terms", "Shop"] for i in range(2))
    assert all(got[40 + i] == [f"Copy {i}", "Same long paragraph in all of them.", "And another block."] for i in range(5))
    assert all(got[30 + i] == ["Same one.", "Same two."] for i in range(5))
