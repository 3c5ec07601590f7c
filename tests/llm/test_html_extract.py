import itertools
import random

import pytest

from ledgerloom.llm import html_extract
from ledgerloom.llm.html_extract import Weights, best_stretch, extract_main_text, learned_weights, main_text, tokens
from ledgerloom.llm.labelled_pages import BEGIN, END, PAGES

#: Pages that no weight is learned from.
HELD = {
"blog": """<!doctype html><html><head><title>x</title><script>if (a < b) { document.write("<p>no</p>"); }</script></head><body class="has-sidebar"><div class="Header"><h1>My Travels</h1></div><div id="NavBar"><a href="/">Home</a><a href="/about">About</a></div>
<div class="blog-post">⟦<h2>Night train to the coast</h2><p>We left at ten &amp; slept until the border. Tickets cost &lt;40 euros.</p><p>Breakfast was coffee, <a href="/x">bread</a> and an orange.</p>⟧<div class="AdSlot"><p>Cheap hotels near you, book before midnight and save a third.</p></div>⟦<p>From the window one sees the sea for the first time behind the last tunnel.</p><p>Go.</p>⟧</div>
<div id="comments-area"><p>I took the same train last year and it was four hours late but I would do it again at once.</p></div><div class="right sidebar-widget"><p>Subscribe to my letter and never miss a trip that I make anywhere.</p></div><footer>Written on trains</footer></body></html>""",
"form": """<html><body><form id="all"><div class="menu"><a href=a>One</a></div><div id="main-content">⟦<h1>Notice to swimmers</h1><p>The pool is shut until the tiles are mended, which will take nine days at least.</p><p>Season tickets stay valid for nine days more.</p>⟧</div></form></body></html>""",
"plain": """⟦Only words here, and no tags at all, so all of them are the text.⟧""",
"news": """<html><body><header><a href="/">Paper</a></header><main><article><header>⟦<h1>Mill burns down</h1><p>Nobody was hurt.</p>⟧</header>⟦<p>Firemen from four villages came &mdash; the roof fell in at three o'clock.</p>⟧<aside><h4>Also today</h4><p>Ten other fires that this county will not soon forget, in pictures.</p></aside>⟦<p>The owner wants to build again.</p>⟧<form><label>Send us your pictures of the fire here</label><input></form></article><section class="comment-list"><article class="comment"><p>My grandfather worked there for forty years and he wept when he heard of it this morning.</p></article><article class="comment"><p>Build it again please, in stone this time and with a proper roof.</p></article></section></main><footer><p>&copy; Paper</p></footer></body></html>""",
"bare": """<html><body><ul><li><a href="/">Home</a></li><li><a href="/b">Boats</a></li><li><a href="/c">Charts and maps</a></li></ul><div>⟦<h1>Reading a tide table</h1><p>Find the day, then the two high waters.</p><p>Add an hour in summer.</p>⟧</div><div><a href="/1">Buy a chart of the bay</a> <a href="/2">Boats for hire by the day</a></div></body></html>""",
"cut": """<html><body><nav><a href="/">x</a></nav><div class="ad">buy now</div><article>⟦<h1>Half a page</h1><p>This page ends in the middle of a sentence that nobody will ever⟧""",
"none": """<html><body><nav><ul><li><a href="/">Home</a></li></ul></nav><footer>All rights reserved by the owner of this site.</footer></body></html>""",
}


@pytest.fixture(scope="module")
def weights(spark) -> Weights:
    return learned_weights(spark.createDataFrame([(p,) for p in PAGES], "html string"))


def plain(page):
    return page.replace(BEGIN, "").replace(END, "")


def marked(page, weights):
    """The text of what stands between the signs."""
    spans = [s.split(END)[0] for s in page.split(BEGIN)[1:]]
    return "\n".join(main_text("<article>" + s, weights) for s in spans)


@pytest.mark.parametrize("name", HELD)
def test_held_out_pages(weights, name):
    assert main_text(plain(HELD[name]), weights) == marked(HELD[name], weights)


def test_labelled_pages(weights):
    wrong = [p for p in PAGES if main_text(plain(p), weights) != marked(p, weights)]
    assert len(wrong) <= 1  # a page laid out as a table keeps its site's name


def test_best_stretch_is_the_best():
    rng = random.Random(1)
    for _ in range(300):
        x = [rng.randint(-4, 4) for _ in range(rng.randint(0, 12))]
        sums = {(i, j): sum(x[i:j]) for i, j in itertools.combinations(range(len(x) + 1), 2)}
        top = max([0, *sums.values()])
        start, end, score = best_stretch(iter(map(float, x)))
        assert score == top and sum(x[start:end]) == top


def test_short_and_long_pages_alike(weights, monkeypatch):
    whole = {k: main_text(plain(p), weights) for k, p in HELD.items()}
    monkeypatch.setattr(html_extract, "KEPT_CHARS", 0)
    assert {k: main_text(plain(p), weights) for k, p in HELD.items()} == whole


@pytest.mark.parametrize(
    "page,text",
    [
        ("<article><p>a&nbsp;&nbsp;b &lt;c&gt; &#233;&eacute &amp;amp;</p></article>", "a b <c> éé &amp;"),
        ("<article><p>one<br>two</p>three<b>four</b></article>", "one two\nthreefour"),
        ("<article><p title='a > b'>kept</p><!-- <p>not</p> --><script>'</p>'</script></article>", "kept"),
        ("<article><p>a < b and 3<4</p></article>", "a < b and 3<4"),
        ("<ARTICLE><P>upper case</ARTICLE>", "upper case"),
        ("<article>ends in a tag <p clas", "ends in a tag"),
        ("<article>ends in a script<script>x", "ends in a script"),
        ("<article>see <a href=x>this link</a> here</article>", "see this link here"),
        ("", ""),
        ("<", "<"),
        ("<p></p>", ""),
    ],
)
def test_markup(weights, page, text):
    assert main_text(page, weights) == text


def test_tokens_break_off_anywhere(weights):
    page = plain(HELD["news"])
    for at in range(0, len(page), 7):
        list(tokens(page[:at]))
        main_text(page[:at], weights)


@pytest.mark.parametrize("page", ["<b>" * 100_000 + "x", "<p>" * 100_000 + "x", '<a title="' * 50_000, "<!-- " * 50_000, "a < b " * 50_000, "<article>" * 20_000 + "w" + "</article>" * 20_000])
def test_long_pages_take_linear_time(weights, page):
    main_text(page, weights)


def test_rows(spark, weights):
    rows = [(1, "u", plain(HELD["news"]), "t", 1), (1, None, None, "t", 1), (None, "v", "", "t", 1), (3, "w", "<p>" + "word " * 200_000, "t", 1)]
    got = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")).collect()
    want = [(i, u, main_text(h or "", weights)) for i, u, h, _, _ in rows]
    assert [tuple(r) for r in got] == [(i, u, t, len(t)) for i, u, t in want]
    assert extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_own_labels(spark):
    own = spark.createDataFrame([(f"<div class=junk>{'x ' * 20}</div><div class=prose>{BEGIN}{'y ' * 20}{END}</div>",)] * 3 + [(None,)], "html string")
    page = spark.createDataFrame([(1, "u", "<div class=junk>" + "lots of words " * 30 + "</div><div class=prose>the text</div>")], "page_id long, url string, html string")
    assert extract_main_text(page, own).first().text == "the text"
