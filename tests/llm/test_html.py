"""Main text: layouts that names speak against, composed pages with known content, the cut against brute force."""

import itertools
import random
import time

import pytest

from graphloom.llm import op7_html

BODY = "<h1>A title of words</h1><p>The first paragraph of the article has a number of words. It goes on.</p><p>And the second one, which is as long as the first, ends here.</p>"
WANT = "A title of words\nThe first paragraph of the article has a number of words. It goes on.\nAnd the second one, which is as long as the first, ends here."
NAV = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>'
FOOT = "<footer>&copy; somebody</footer>"
LAYOUTS = [
    '<body class="has-sidebar">{}</body>',
    '<body class="layout no-ads">{}</body>',
    '<body class="single-post comment-open">{}</body>',
    '<body id="page-legal">{}</body>',
    '<body><div class="content-with-sidebar">{}</div></body>',
    '<body><form id="aspnetForm" action="/x">{}</form></body>',
]


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<div>{}</div>"])
def test_names_are_no_verdict(layout, wrap):
    assert op7_html.main_text("<html>" + layout.format(NAV + wrap.format(BODY) + FOOT) + "</html>") == WANT


def f1(pages) -> float:
    right = got = wanted = 0
    for page, marks in pages:
        found = {w for w in op7_html.main_text(page).split() if w[0] in "cx" and w[-1] == "q" and w[1:-1].isdigit()}
        right, got, wanted = right + len(found & set(marks)), got + len(found), wanted + len(marks)
    return 2 * right / (got + wanted)


def test_composed_pages():
    """Other pages than those that the weights were fitted on."""
    assert f1(op7_html.examples(150, seed=77)) > 0.97


def test_blocks_and_references():
    page = "<p>a &amp; b<br>c&nbsp;d</p><script>x<p>y</script><div>e<b>f</b> g<p>h</div><!-- i --><p>&lt;j&gt;"
    assert [b.text for b in op7_html.blocks_of(page)] == ["a & b c d", "ef g", "h", "<j>"]


def test_minimum_cut():
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randrange(1, 8)
        source, sink = [rng.random() * 3 for _ in range(n)], [rng.random() * 3 for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.random() * 2) for _ in range(rng.randrange(12))]
        cost = lambda side: sum(sink[i] if s else source[i] for i, s in enumerate(side)) + sum(c for i, j, c in edges if side[i] != side[j])  # noqa: B023, E731
        assert cost(op7_html.min_cut(source, sink, edges)) == pytest.approx(min(map(cost, itertools.product([False, True], repeat=n))))


def test_many_closers_are_linear():
    took = []
    for n in (20_000, 80_000):
        start = time.time()
        op7_html.main_text("<div><b>" * 2000 + "</i></section>" * n + "<p>text</p>")
        took.append(time.time() - start)
    assert took[1] < 12 * took[0] + 1


def test_rows(spark):
    rows = [(1, "u", "<p>One sentence with some words in it. And another one.</p>", "x"), (2, None, None, "y"), (3, "v", "", "z"), (None, "w", "<nav><a href='/'>x</a></nav>", "q"), (1, "u", "<p>One sentence with some words in it. And another one.</p>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(map(tuple, op7_html.extract(df, keep=("url", "text")).collect()), key=repr)
    one = "One sentence with some words in it. And another one."
    assert got == sorted([(1, "u", one, len(one))] * 2 + [(2, None, "", 0), (3, "v", "", 0), (None, "w", "", 0)], key=repr)
    assert op7_html.extract(df.limit(0)).count() == 0
