import time

import pytest

from shelfwise.llm import html
from shelfwise.llm.html import extract_main_text, main_text

LONG = "A sentence of the article, with commas, and more words. " * 4


@pytest.mark.parametrize(
    "page, want",
    [
        ("", ""),
        ("<html><body></body></html>", ""),
        ("just  text &amp; no\ttags", "just text & no tags"),
        (f"<nav><a href=x>Menu</a></nav><article><h1>T&eacute;st</h1><p>{LONG}<p>two<br>lines</article><footer>&copy; {LONG}</footer>", f"Tést\n{LONG.strip()}\ntwo lines"),
        ("<nav>a</nav><div class='ad'>An advert of many words, and marks. Much longer.</div><article><h1>Hi</h1><p><b>Hi<br><p>Yo.</p></article><footer>x</footer>", "Hi\nHi\nYo."),
        (f"<header>Site</header><div class=sidebar><p>{LONG}</p></div><div id=content><h2>Title</h2><p>{LONG}</p><p>b</p></div><div class='cookie-notice'>{LONG}</div>", f"Title\n{LONG.strip()}\nb"),
        (f"<main><header><h1>T</h1></header><p>{LONG}</p><form><p>Your name</p><input></form><section class='comments'><p>{LONG}</p></section></main>", f"T\n{LONG.strip()}"),
        (f"<article><p>a <script>var t='</p>';</script>b<style>p{{}}</style> {LONG}</p><!-- <p>no</p> --><ul><li>one<li>two</ul><table><tr><td>c<td>d</table></article>", f"a b {LONG.strip()}\none\ntwo\nc\nd"),
        (f"<article><p>{LONG}<span class=ad>Buy!</span> end</p><aside>{LONG}</aside>", f"{LONG.strip()} end"),
        (f"<article><p title='a>b'>{LONG}</p><p>1 < 2 &lt;b&gt; &#8364;&#x41;</p>", f"{LONG.strip()}\n1 < 2 <b> €A"),
    ],
)
def test_pages(page, want):
    assert main_text(page) == want


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<article><h2 id='related-work'>Related work</h2><p>{LONG}</p><section id='legal'><p>{LONG}</p></section><section id='search-results'><p>{LONG}</p></section><h2 id='share-prices'>Share prices</h2>"
         f"<div class='widget-text'>{LONG}</div><p class='notice'>Prices are in euros, before tax.</p></article>", "\n".join(["Related work", LONG.strip(), LONG.strip(), LONG.strip(), "Share prices", LONG.strip(), "Prices are in euros, before tax."])),
        (f"<article><p>{LONG}</p><div class='related'><ul><li><a href=x>Another article of the same site, to read</a></ul></div><div id='share-buttons'>Share</div></article>", LONG.strip()),
        (f"<body><nav>x</nav><div id=post><h1>T</h1><p>lead</p><div class=body><p>{LONG * 3}</p><p>{LONG * 3}</p></div></div><div id=bottom>All of it</div></body>", f"T\nlead\n{(LONG * 3).strip()}\n{(LONG * 3).strip()}"),
        (f"<body><div id=post><h2 id='legal'>Legal</h2><p>{LONG}</p><div class='widget-text'><p>{LONG}</p></div></div></body>", f"Legal\n{LONG.strip()}\n{LONG.strip()}"),
    ],
)
def test_articles_are_kept_whole(page, want):
    assert main_text(page) == want


def naive_scores(page):
    """The scores by their definition, path by path."""
    marks = lambda text: sum(c in ".,;:!?…。，、；：！？" for c in text)
    chain = lambda path: [path, *(chain(path.above) if path.above else [])]
    texts = [(node.path, text, linked) for node, text, linked in page.blocks]
    order = list(dict.fromkeys(p.at for p, _, _ in texts))
    mean = lambda at, f: sum(f(t) for p, t, _ in texts if p.at == at) / sum(p.at == at for p, _, _ in texts)
    share = lambda at: sum(k for p, _, k in texts if p.at == at) / sum(len(t) for p, t, _ in texts if p.at == at)
    own = {}
    for i, at in enumerate(order):
        near = [at] + order[max(0, i - 1) : i + 2]
        own[at] = (html.fused(sum(mean(x, len) for x in near) / len(near), sum(mean(x, marks) for x in near) / len(near)) * html.fused(mean(at, len), mean(at, marks))) ** 0.5

    def below(path):
        return [(p, t, k) for p, t, k in texts if path in chain(p)]

    def against(path):
        found = below(path)
        bad = path.doubtful and found and html.is_boilerplate(sum(len(t) for _, t, _ in found), sum(k for _, _, k in found), sum(marks(t) for _, t, _ in found), len(found))
        return (html.NAMED if bad else 1.0) * (against(path.above) if path.above else 1.0)

    return {at: own[at] * (1 - share(at)) * page.paths[at].prior * against(page.paths[at]) for at in order}


PAGES = [f"<nav>x</nav><article><h1 class=title>Hi</h1><p>{LONG}<p>b <a href=x>link, here</a></p><div class='related'><p>{LONG}</p><ul><li>one<li>two, three.</ul></div><div class=ad>Buy!</div></article><div class='side notice'>No</div>",
         "<div>" * 8 + "<b>a, b.</b>" + "<p>text. " * 5, f"<main><section id=legal><p>{LONG}</section><table><tr><td>1<td>2</table></main><p class=share><a>x</a></p>"]


def test_scores_equal_their_definition():
    for text in PAGES:
        page = html.read_page(text)
        got, want = html.path_scores(page), naive_scores(page)
        assert got == pytest.approx(want) and len(got) > 1


UNNAMED = [
    f"<body><div>{'<div><a href=1>News of today</a></div>' * 20}</div><div><h1>T</h1><p>{LONG}</p><p>{LONG}</p><p>b</p></div><div>{'<div>Buy two for one</div>' * 9}</div></body>",
    f"<body><table><tr><td>{'<div>Ad of the day</div>' * 20}</td><td><div><h2>T</h2><p>{LONG}</p><ul><li>one<li>two</ul><p>{LONG}</p></div></td></tr></table></body>",
    f"<body><div><p>{LONG}</p><p>{LONG}</p><div>{'<div><div>Ann, on Monday</div><p>Well said.</p></div>' * 12}</div></div></body>",
    f"<body><div>{'<span>All rights reserved by us</span><br>' * 9}</div><div><p>{LONG}</p><p>short</p><p>{LONG}</p></div></body>",
]
UNNAMED_TEXTS = [f"T\n{LONG.strip()}\n{LONG.strip()}\nb", f"T\n{LONG.strip()}\none\ntwo\n{LONG.strip()}", f"{LONG.strip()}\n{LONG.strip()}", f"{LONG.strip()}\nshort\n{LONG.strip()}"]


def test_scores_choose_the_text(monkeypatch):
    """Pages without a name or element that tells what is what: with constant scores they come out wrong."""
    assert [main_text(page) for page in UNNAMED] == UNNAMED_TEXTS
    assert [main_text(page, by_name=False) for page in UNNAMED] == UNNAMED_TEXTS
    scores = html.path_scores
    monkeypatch.setattr(html, "path_scores", lambda page, *x, **y: dict.fromkeys(scores(page, *x, **y), 1.0))
    assert sum(main_text(page) == text for page, text in zip(UNNAMED, UNNAMED_TEXTS)) == 0


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<body><form action=x><div><a href=y>Menu</a></div><article><h1>T</h1><p>{LONG}</p><p>{LONG}</p></article></form></body>", f"T\n{LONG.strip()}\n{LONG.strip()}"),
        (f"<body><aside><p>{LONG[:60]}</p><article><p>{LONG}</p></article></body>", LONG.strip()),
        (f"<article><p>{LONG}</p><section><h2>Comments</h2><ul><li>First!</li><li>{LONG}</li></ul></section></article>", LONG.strip()),
        (f"<article><p>{LONG}</p><h2>3 Kommentare</h2><p>Gut.</p><h2>Next</h2><p>{LONG}</p></article>", f"{LONG.strip()}\nNext\n{LONG.strip()}"),
        (f"<article><header><h1>T</h1><span>By Ann, today</span></header><p>{LONG}</p></article>", f"T\n{LONG.strip()}"),
        (f"<article><p>{LONG}</p><div><div><div><div><table><tbody><tr><td>Cell one<td>2</table></div></div></div></div><p><a href=x>A linked paragraph</a></p><ul><li><a href=y>Smith 2010</a><li><a href=z>Jones 2011</a></ul></article>",
         f"{LONG.strip()}\nCell one\n2\nA linked paragraph\nSmith 2010\nJones 2011"),
        ("<article><p>" + LONG + "</p>" + "<div>" * 9 + "<p>D</p></article>", f"{LONG.strip()}\nD"),
        (f"<body><header>Site of ours</header><main><p>{LONG}</p><form><p>Your name</p><p>Your mail</p></form></main><footer>{LONG}</footer></body>", LONG.strip()),
    ],
)
def test_nothing_of_the_article_is_lost_and_nothing_else_kept(page, want):
    assert main_text(page) == want


@pytest.mark.parametrize("name", ["class=side-effects", "class=related-work", "id=notice-of-motion", "class=form"])
def test_doubtful_names_of_article_parts(name):
    assert main_text(f"<article><p>{LONG}</p><div {name}><p>{LONG}</p><p>And so on, it says.</p></div></article>").count("\n") == 2


def test_odd_pages_take_linear_time():
    start = time.time()
    for page in ("<div>text, of it. " * 100_000, "<div class=widget-text>text, of it. " * 50_000, "<p><b>" + "<i>" * 50_000 + "<li>x" * 1000, "<div>" * 50_000 + "x", "<p>" * 100_000, "<a href='" * 30_000, "<" * 200_000, "<b" * 100_000, "</p>" * 100_000, "<!--" * 50_000):
        main_text(page)
    assert time.time() - start < 30


def test_query_on_odd_rows(spark):
    rows = [(1, "u", None, "x"), (1, "u", "", "x"), (2, None, f"<p>{LONG * 5000}</p>", None), (None, "u", "<p>a</p>", "x"), (None, "u", "<p>a</p>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r.page_id or 0, r.n_chars) for r in extract_main_text(pages).collect())
    assert got == [(0, 1), (0, 1), (1, 0), (1, 0), (2, len((LONG * 5000).strip()))]
    assert extract_main_text(pages.limit(0)).count() == 0
