"""Main texts of made pages, and the differencing against plain dynamic programming."""

import random

import pytest

from orrery.llm import pagediff


def lines(html):
    return [line for line, _ in pagediff.page_lines(html)]


def test_article_pages():
    page = (
        '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body><header>Site</header>'
        "<nav><ul><li><a href=/>Home</a></ul></nav><!-- <p>no</p> --><div class=\"ad\">Buy</div><main><article class='post has-sidebar'><header><h1>Ti&amp;tle</h1>"
        '</header><p><b>One\n  two&nbsp;three<br>four<p>x &lt; y &copy 1<p class="cookie-notice">Accept</p><ul><li>a<li>b</ul><form>Name <input></form>'
        "<table><tr><td>1<td>2<tr><td>3</table><pre> k  l </pre><section id=comments><article><p>First!</p></article></section></article></main>"
        "<aside>More</aside><footer>&copy; Us</footer>"
    )
    assert lines(page) == ["Ti&tle", "One two three four", "x < y © 1", "a", "b", "1 2", "3", "k l"]
    assert all(safe for _, safe in pagediff.page_lines(page))


def test_odd_pages():
    assert lines(None) == lines("") == lines("<p>  </p>") == lines("<script>never closed") == []
    assert lines("just text & more") == ["just text & more"]
    assert lines('<p title="a > b">in</p><p>after <b>bold</p>tail <') == ["in", "after bold", "tail <"]
    assert lines("<p>cut off <a href='x") == ["cut off"]
    assert lines("<div><a>Menu</a></div><p>body <a>link</a></p>") == ["body link"]
    assert lines("<p>" + "word " * 50_000 + "</p>") == [" ".join(["word"] * 50_000)]
    assert lines("<p>" + "<a '" * 2000) == []
    assert lines("<b>" * 3000 + "deep") == ["deep"]


def lcs_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def test_common_lines():
    rng = random.Random(3)
    for _ in range(400):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(14))] for _ in range(2))
        found = sorted(pagediff.common_lines(a, b))
        assert len(found) == lcs_length(a, b)
        rest = iter(b)
        assert all(any(x == y for y in rest) for x in (a[i] for i in found))


def page(title, body, wrap="div"):
    return f"<html><body><div>Top of site</div><div>Menu text</div><{wrap}><h1>{title}</h1>{body}</{wrap}><div>All rights kept</div></body></html>"


def test_neighbours_share_the_template(spark):
    body = lambda i: "".join(f"<p>Sentence {i} {j}.</p>" for j in range(6)) + "<p>A passage that articles share.</p>"
    rows = [(i, f"https://a.example.com/x/{i:03d}?q={i}", page(f"T{i}", body(i))) for i in range(90)]
    rows += [(200 + i, f"http://b.example.com/{i}", page(f"T{i}", body(i), "article")) for i in range(3)]
    rows += [(300, "http://alone.example.com/", page("T", body(0))), (301, None, None), (302, "", ""), (303, None, "<p>no address</p>")]
    rows += [(0, rows[0][1], rows[0][2]), (None, "https://a.example.com/x/000?q=copy", rows[0][2])]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, text string, lines int")
    found = pagediff.main_texts(pages.repartition(4)).collect()
    assert len(found) == len(rows)
    own = lambda i: "\n\n".join([f"T{i}", *(f"Sentence {i} {j}." for j in range(6))])
    texts = {}
    for r in found:
        texts.setdefault(r.page_id, set()).add(r.text)
    for i in range(90):
        assert texts[i] == {own(i)}
    assert texts[None] == {own(0)}
    for i in range(3):
        assert texts[200 + i] == {own(i) + "\n\nA passage that articles share."}
    assert "Menu text" in texts[300].pop()
    assert texts[301] == texts[302] == {""} and texts[303] == {"no address"}
    assert pagediff.main_texts(pages.limit(0)).count() == 0
    assert spark.createDataFrame(found).columns[:3] == ["page_id", "url", "html"]


def test_template_with_more_lines_than_the_articles():
    template = list(range(20))
    pages = [[*template[:10], 100 + 3 * i, 101 + 3 * i, 102 + 3 * i, *template[10:]] for i in range(6)]
    paths = [f"/x/{i}" for i in range(6)]
    for n in (2, 3, 6):
        found = pagediff.shared_lines(paths[:n], pages[:n], [True] * n)
        assert found == [{*range(10), *range(13, 23)}] * n
    # A copy of an article with another line, beside other articles, is passed over.
    long = [[*range(20), *range(200, 240)], [*range(20), 900, *range(201, 240)], [*range(20), *range(300, 340)], [*range(20), *range(400, 440)]]
    assert pagediff.shared_lines(paths[:4], long, [True] * 4) == [set(range(20))] * 4
    assert pagediff.shared_lines(paths[:2], [pages[0], pages[0]], [True, True]) == [None, None]


def test_every_page_of_a_long_host_finds_a_partner(spark):
    body = lambda i: "".join(f"<p>Sentence {i} {j}.</p>" for j in range(6))
    near = lambda i: "".join(f"<p>Same {j}.</p>" for j in range(40)) + f"<p>Printed {i} times.</p>"
    rows = [(i, f"https://a.example.com/{i:03d}", page(f"T{i}", body(i))) for i in range(65)]
    rows += [(1000 + i, f"https://b.example.com/{i:03d}", page("T", body(0))) for i in range(70)]
    rows += [(1100 + i, f"https://b.example.com/z{i:03d}", page(f"T{i}", body(i))) for i in range(5)]
    rows += [(2000 + i, f"https://c.example.com/{i:03d}", page("T", near(i))) for i in range(100)]
    rows += [(2100 + i, f"https://c.example.com/z{i:03d}", page(f"T{i}", body(i))) for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: r.text for r in pagediff.main_texts(pages.repartition(4)).collect()}
    own = lambda title, i: "\n\n".join([title, *(f"Sentence {i} {j}." for j in range(6))])
    assert all(found[i] == own(f"T{i}", i) for i in range(65))
    assert all(found[1000 + i] == own("T", 0) for i in range(70))
    assert all("Menu text" not in text and text.startswith("T") for text in found.values())
    assert all(found[2000 + i] == "\n\n".join(["T", *(f"Same {j}." for j in range(40)), f"Printed {i} times."]) for i in range(100))


@pytest.mark.parametrize(
    "inner, expected",
    [
        ('<div style="overflow:hidden"><p>Body text</p></div>', ["Body text"]),
        ('<p data-hidden="false">Shown</p><p hidden>Not shown</p>', ["Shown"]),
        ('<p title="a hidden gem">Gem</p>', ["Gem"]),
        ('<p><a href="/p?id=share">the link</a> stays</p>', ["the link stays"]),
        ("<p><a href=/p?class=menu>bare</a> value</p>", ["bare value"]),
        ('<section class="related work"><p>Earlier studies</p></section>', ["Earlier studies"]),
        ('<h1 class="entry-header">Title</h1><p>Text</p>', ["Title", "Text"]),
        ('<div class="related-posts"><p>More</p></div><p>Text</p>', ["Text"]),
        ('<div id="comments"><p>First!</p></div><div class="ad">Buy</div><p>Text</p>', ["Text"]),
        ("<p>Let <math><mi>x</mi></math> be</p>", ["Let x be"]),
        ('<p class="has-sidebar">Wide</p><p CLASS=share-bar>Tweet</p>', ["Wide"]),
        ('<p class="text" class="ad">First value holds</p>', ["First value holds"]),
    ],
)
def test_attributes(inner, expected):
    assert lines(f"<body><article>{inner}</article></body>") == expected
