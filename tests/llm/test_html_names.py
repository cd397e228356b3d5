"""Main text: names inside and around articles, pages of odd make, and the fitted classifier."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm import html

PARA = "<p>" + "Some words of running text stand here, as they do in articles. " * 5 + "</p>"
LONG = PARA * 4
AROUND = "<body><header><h2>Site</h2></header><nav><ul><li><a href=/>Home</a></li><li><a href=/x>More of it</a></li></ul></nav>{}<div class='comments'><p>A reader says at length that all of this is very well written, and thanks.</p></div><footer>Imprint and so on</footer></body>"
LISTED = sorted(html.WORDS_AGAINST | html.WORDS_READERS)
WORDS = st.one_of(st.sampled_from(LISTED), st.from_regex("[a-z]{1,12}", fullmatch=True))
NAMES = st.lists(WORDS, min_size=1, max_size=3).map("-".join)
KINDS = st.sampled_from(["id", "class"])


def lines(page, weights=html.PRIOR):
    return html.main_text(page, weights).split("\n")


@settings(max_examples=150, deadline=None)
@given(NAMES, KINDS, st.sampled_from(["h1", "h2", "h3", "h4"]), st.sampled_from(["article", "main"]))
def test_any_name_of_a_heading_leaves_its_text(name, kind, tag, article):
    got = lines(AROUND.format(f"<{article}><h1>The title</h1>{LONG}<{tag} {kind}='{name}'>What it is about</{tag}>{LONG}</{article}>"))
    assert got[0] == "The title" and "What it is about" in got and len(got) == 10


@settings(max_examples=150, deadline=None)
@given(NAMES, KINDS, st.sampled_from(["section", "div class='section'", "div class='section level2'"]), st.booleans())
def test_any_name_of_a_section_in_an_article_leaves_its_text(name, kind, tag, alone):
    if tag != "section":
        kind = "id"
    part = f"<{tag} {kind}='{name}'><h2>What it is about</h2>{PARA if alone else LONG}</{tag.split()[0]}>"
    got = lines(AROUND.format(f"<article><h1>The title</h1>{LONG}{part}</article>"))
    assert "What it is about" in got and len(got) == (7 if alone else 10)


@settings(max_examples=150, deadline=None)
@given(st.lists(NAMES, min_size=1, max_size=3), KINDS, st.sampled_from(["article", "main"]))
def test_any_names_around_an_article_leave_its_text(names, kind, article):
    inner = f"<{article}><h1>The title</h1>{LONG}</{article}>"
    for name in names:
        inner = f"<div {kind}='{name}'>{inner}</div>"
    assert lines(AROUND.format(inner))[0] == "The title" and len(lines(AROUND.format(inner))) == 5


@pytest.mark.parametrize("article", ["article", "main", "div class='entry-content'", "div id=content"])
@pytest.mark.parametrize("part", ["<div class='{}'>{}</div>", "<div id='{}'>{}</div>", "<ul class='{}'><li>{}</li></ul>"])
@pytest.mark.parametrize("name", ["comments", "user-replies", "ad", "ad-box", "sidebar", "cookie-notice", "related", "share", "newsletter", "main-menu"])
def test_what_is_no_text_goes_inside_and_outside(article, part, name):
    other = part.format(name, PARA)
    got = lines(AROUND.format(f"<{article}><h1>The title</h1>{LONG}{other}</{article.split()[0]}>{other}"))
    assert got[0] == "The title" and len(got) == 5


def test_a_short_article_among_long_comments_is_the_article():
    comments = "".join(f"<article class='comment'>{PARA}</article>" for _ in range(8))
    page = f"<body><article><h1>The title</h1><p>A short piece of news that has one sentence only.</p></article><div class='comments'>{comments}</div></body>"
    assert lines(page) == ["The title", "A short piece of news that has one sentence only."]


@pytest.mark.parametrize("wrap", ["<form action=/x>{}</form>", "<form><div class='page-wrap'>{}</div></form>", "<div class='sidebar-layout'>{}</div>", "<div class='header'>{}</div>"])
def test_what_surrounds_the_page_says_nothing(wrap):
    page = "<body>" + wrap.format(f"<nav><a href=/>Home</a></nav><h1>The title</h1>{LONG}<div class='ad'>Buy this thing today, for it is cheap.</div><footer>Imprint</footer>") + "</body>"
    assert lines(page)[0] == "The title" and len(lines(page)) == 5


@pytest.mark.parametrize("page, want", [
    ("plain text without tags", ["plain text without tags"]), ("<p>Short only</p>", ["Short only"]), ("<div>a b c</div>", ["a b c"]), ("<body><h1>One</h1><p>two</p></body>", ["One", "two"]),
    ("<nav><a href=/>Home</a></nav><p>Short only</p><footer>Imprint</footer>", ["Short only"]), ("<p>é</p>", ["é"]), ("<p>|</p>", [""]), ("<nav>Home</nav>", [""]), ("<ul><li><a href=/>All links</a></li></ul>", [""]),
])
def test_short_pages_give_what_they_have(page, want):
    assert lines(page) == want


def test_a_form_beside_text_is_a_form():
    page = f"<body><h1>The title</h1>{LONG}<form>{LONG}</form></body>"
    assert len(lines(page)) == 5


# The classifier


def test_fit_equals_the_stationary_point():
    rng = np.random.default_rng(4)
    x = np.c_[np.ones(300), rng.standard_normal((300, 8))]
    y = (rng.random(300) < 1 / (1 + np.exp(-x @ rng.standard_normal(9)))).astype(float)
    weight = rng.random(300)
    w = html.fit(x, y, weight)
    slope = x.T @ (weight * (1 / (1 + np.exp(-x @ w)) - y)) + (w - html.PRIOR)
    assert np.abs(slope).max() < 1e-7
    assert np.array_equal(html.fit(x[:0], y[:0], weight[:0]), html.PRIOR)


def test_separable_and_repeated_blocks_fit():
    x = np.repeat(html.features(html.blocks(AROUND.format(f"<article>{LONG}</article>"))), 50, axis=0)
    y = np.repeat([b.labelled for b in html.blocks(AROUND.format(f"<article>{LONG}</article>"))], 50).astype(float)
    w = html.fit(x, y, np.ones(len(x)))
    assert np.isfinite(w).all() and ((x @ w > 0) == (y > 0)).all()


def test_weights_are_learned_from_articles_and_move_results(spark):
    """Pages whose boilerplate is long and whose articles are short turn the weight of length."""
    rng = np.random.default_rng(5)
    pages = [(i, "u", AROUND.format(f"<article><p>{'Word ' * int(rng.integers(2, 6))}.</p></article><div>{'promo ' * 60}</div>")) for i in range(60)]
    df = spark.createDataFrame(pages + [(None, "u", None), (70, "u", ""), (71, "u", "<p>none</p>"), (71, "u", "<p>none</p>")], "page_id long, url string, html string")
    w = html.learn(df)
    assert w[1] < html.PRIOR[1] - 1 and not np.array_equal(w, html.PRIOR)
    assert np.allclose(w, html.learn(df.repartition(7)))
    assert np.array_equal(html.learn(df.where("page_id > 65")), html.PRIOR) and np.array_equal(html.learn(df.limit(0)), html.PRIOR)
    assert html.extract(df).count() == 64


@settings(max_examples=40, deadline=None)
@given(NAMES, KINDS)
def test_names_inside_articles_also_with_weights_of_the_test_pages(weights_of_pages, name, kind):
    page = AROUND.format(f"<article><h1>The title</h1>{LONG}<h2 {kind}='{name}'>What it is about</h2><section {kind}='{name}'><h3>One part</h3>{LONG}</section></article>")
    got = lines(page, weights_of_pages)
    assert "What it is about" in got and "One part" in got and len(got) == 11


@pytest.fixture(scope="module")
def weights_of_pages(spark):
    return html.learn(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
