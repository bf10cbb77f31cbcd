from itertools import product
from random import Random

import duckdb

from tallyspark.llm.html_cut import GIVEN, cut_changes, edges_of, extract, fit_costs, main_text, min_cut, pattern, read_blocks

PAGE = """<!DOCTYPE html><html class="sidebar-left"><head><title>T</title><style>p{}</style></head><body class="has-comments"><header class="site-header"><a href="/">Home</a><h2>Site</h2></header>
<div id="cookie-banner">We use cookies. <button>Accept</button></div><div class="wrapper with-sidebar"><ul class="menu"><li><a href=a>One</a><li><a href=b>Two</a></ul>
<main><article><header><h1>Title &amp; more</h1></header><p>First paragraph, with <a href=x>a link</a> and text&nbsp;here.</p><div class="ad">Buy now!</div><p>Short.</p><pre>code
  here</pre><aside>See also</aside><form><label>Mail</label><input><button>Go</button></form><p>All rights reserved.<script>var x = "</p>";</script>
<section id="comments"><h3>Comments</h3><article class="comment"><p>Great article, I liked it a lot indeed, all of it. It is long enough to pass.</p></article></section><footer>Tags</footer></article></main>
<aside class="sidebar"><p>Some long text in the side bar that is long enough to be content, and it ends well.</p></aside></div><noscript>Turn it on</noscript><footer>&copy; 2024 me</footer></body></html>"""


def brute(costs, edges):
    """Least cost over all labellings; of equal ones that with the fewest content blocks."""
    best = min(product((False, True), repeat=len(costs)), key=lambda x: (sum(-c if k else 0 for c, k in zip(costs, x)) + sum(w for a, b, w in edges if x[a] != x[b]), sum(x)))
    return list(best)


def test_the_cut_is_minimal():
    rng = Random(3)
    for _ in range(150):
        n = rng.randint(1, 9)
        costs = [rng.randint(-40, 40) / 10 for _ in range(n)]
        edges = [(i, i + 1, rng.randint(0, 30) / 10) for i in range(n - 1)] + [(rng.randrange(n), rng.randrange(n), rng.randint(0, 20) / 10) for _ in range(n // 2)]
        edges = [e for e in edges if e[0] != e[1]]
        value = lambda x: round(sum(-c if k else 0 for c, k in zip(costs, x)) + sum(w for a, b, w in edges if x[a] != x[b]), 6)
        assert value(min_cut(costs, edges)) == value(brute(costs, edges))


def test_an_article_among_everything_else():
    assert main_text(PAGE).split("\n") == ["Title & more", "First paragraph, with a link and text here.", "Short.", "code here", "All rights reserved."]


def test_pages_without_an_article_element():
    page = """<body><div class="topbar"><a href=/>Home</a> | <a href=/x>About</a></div><div id="content"><h2>Heading</h2><div>Text without paragraphs that goes on for a while, and it ends here at last.<br>Next line.</div></div>
<div class="comments"><p>nice one, thanks for all of that, I learned a great deal today.</p></div><div>© 2020 Someone. All rights reserved.</div>"""
    assert main_text(page) == "Heading\nText without paragraphs that goes on for a while, and it ends here at last.\nNext line."
    assert main_text("just text <b>bold") == "just text bold" and main_text("<p>a < b &lt; c</p>") == "a < b < c"
    assert main_text(None) == main_text("") == main_text("<nav>x</nav>") == main_text("<!-- <p>x</p>") == ""


RELATED = """<article><h1>T</h1><p>Long text of an article that goes on for a while here.</p><div class="related-work"><h2>Related work</h2><p>Other people did this before.</p></div>
<section class="notice-period"><p>Three months of notice.</p></section><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> and <label>a label</label> stay.</p><div class="ad-slot">Buy it!</div></article>"""


def test_a_class_name_does_not_take_text_from_an_article():
    assert main_text(RELATED).split("\n") == ["T", "Long text of an article that goes on for a while here.", "Related work", "Other people did this before.", "Three months of notice.", "So x=2 and a label stay."]


#: No mark tells the article here: a list and short lines inside it are content by their neighbours only.
UNMARKED = "<div><h2>Heading</h2><p>Some text that is long enough to be read as a paragraph of it all.</p><ul><li>one</li></ul><p>More text that is long enough to be read as a paragraph of it all.</p></div><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul>"


def test_neighbours_decide_where_a_block_alone_would_not(spark):
    blocks = read_blocks(UNMARKED)
    own = [GIVEN.of(pattern(b, i, len(blocks))) > 0 for i, b in enumerate(blocks)]
    assert [b.text for b, k in zip(blocks, own) if k] != main_text(UNMARKED).split("\n")
    assert main_text(UNMARKED).split("\n")[-3:] == [blocks[1].text, "one", blocks[3].text]
    got = cut_changes(spark.createDataFrame([(UNMARKED,), (PAGE,), (None,)], "html string"), GIVEN).first()
    assert got.changed >= 1 and got.pages_changed == 1


def test_whole_pages_are_cut_at_least_cost():
    for page in (RELATED, UNMARKED):
        blocks = read_blocks(page)
        costs = [GIVEN.of(pattern(b, i, len(blocks))) for i, b in enumerate(blocks)]
        edges = [(a, b, GIVEN.smooth[k]) for a, b, k in edges_of(blocks)]
        value = lambda x: sum(-round(100 * c) if k else 0 for c, k in zip(costs, x)) + sum(round(100 * w) for a, b, w in edges if x[a] != x[b])  # noqa: B023, E731
        assert 5 < len(blocks) < 12 and value(GIVEN.labels(blocks)) == min(value(x) for x in product((False, True), repeat=len(blocks)))


def test_costs_are_fitted_to_the_table(spark):
    d = "/root/testdata/sf0.01"
    fitted = fit_costs(spark.read.parquet(f"{d}/pages.parquet"))
    assert fitted != GIVEN and fitted.odds[0][1] > 0 > fitted.odds[0][2] and fitted.odds[2][0] < 0 < fitted.odds[2][3] and fitted.smooth[2] > fitted.smooth[7]
    # layouts that the table does not have are read as before: no mark is no evidence, a class name is not learned away
    for page in (PAGE, RELATED, UNMARKED, "just text <b>bold", "<p>a < b &lt; c</p>"):
        assert main_text(page, fitted) == main_text(page)
    assert fit_costs(spark.createDataFrame([(None,), ("",)], "html string")) == GIVEN


def test_broken_markup_and_a_long_page_are_read_whole():
    assert [b.text for b in read_blocks("<p>a<p>b<li>c</i></div>d<td title='>'>e")] == ["a", "b", "c", "d", "e"]
    page = "<article>" + "".join(f"<p>Paragraph number {i} of a long page, with words enough.</p><div class=ad>Buy {i}</div>" for i in range(20_000)) + "</article>"
    assert main_text(page).count("\n") == 19_999
    main_text("<div>" * 50_000 + "x" + '<a href="' * 2000)


def test_given_pages_give_their_articles(spark):
    import html
    import re

    d = "/root/testdata/sf0.01"
    got = {r.page_id: r for r in extract(spark.read.parquet(f"{d}/pages.parquet")).collect()}
    rows = duckdb.connect().execute(f"SELECT page_id, html FROM '{d}/pages.parquet'").fetchall()
    assert len(got) == len(rows)
    for i, page in rows:
        parts = re.split(r"</?(?:p|h1|br)>", re.search(r"<article>(.*?)</article>", page, re.S)[1])
        want = "\n".join(x for x in (" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in parts) if x)
        assert got[i].text == want and got[i].n_chars == len(want)


def test_odd_rows(spark):
    rows = spark.createDataFrame([(None, None, None, 1), (1, "u", "", 2), (1, "u", "<p>Text of a page.</p>", 3), (1, "u", "<p>Text of a page.</p>", 3)], "page_id long, url string, html string, text int")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in extract(rows).collect()), key=str)
    assert got == sorted([(None, None, "", 0), (1, "u", "", 0), (1, "u", "Text of a page.", 15), (1, "u", "Text of a page.", 15)], key=str)
    assert extract(rows.limit(0)).count() == 0
