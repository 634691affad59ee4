"""Main text on templates without semantic tags, without classes, or with either; the ratios decide."""

import random
import time
from collections import Counter

import pytest

from factloom.llm import html_text


def _words(rng, n):
    return " ".join("".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(n)).capitalize()


def _sentences(rng, n):
    return " ".join(_words(rng, rng.randint(5, 14)) + rng.choice(".,.;.!") for _ in range(n))


def _menu(rng, tag="div"):
    return "".join(f"<{tag}><a href='/{k}'>{_words(rng, rng.randint(1, 3))}</a></{tag}>" for k in range(rng.randint(4, 9)))


def _page(rng, kind):
    """(html, blocks of the article)."""
    title = _words(rng, 5)
    parts = [_sentences(rng, rng.randint(3, 8)) for _ in range(rng.randint(4, 9))]
    points = [_words(rng, 4) for _ in range(3)]
    body = f"<h1>{title}</h1>" + "".join(f"<p>{p}</p>" for p in parts[:2]) + "<ul>" + "".join(f"<li>{x}</li>" for x in points) + "</ul>" + "".join(f"<p>{p}</p>" for p in parts[2:])
    want = [title, *parts[:2], *points, *parts[2:]]
    side, foot = _words(rng, 6), _words(rng, 5)
    if kind == "divs":  # neither semantic tags nor classes
        return f"<html><body><div>{_menu(rng)}</div><div><div>{body}</div></div><div>{side}</div><div>{foot}</div></body></html>", want
    if kind == "flat":  # the article's blocks stand in the body itself
        return f"<body><div>{_menu(rng)}</div>{body}<div>{side}</div><div><a href=/>{foot}</a></div></body>", want
    if kind == "table":
        return f"<body><table><tr><td>{_menu(rng)}</td><td>{body}</td><td><div>{side}</div><div>{foot}</div></td></tr></table></body>", want
    if kind == "classes":
        comments = "".join(f"<div class='comment'><p>{_sentences(rng, 2)}</p></div>" for _ in range(3))
        return f"<body><div class='top-nav'>{_menu(rng)}</div><div id=content>{body}<div class='ad-box'>{_sentences(rng, 2)}</div></div><div class='comments'>{comments}</div></body>", want
    if kind == "semantic":
        return f"<body><header><p>{_sentences(rng, 1)}</p></header><nav>{_menu(rng)}</nav><main><article>{body}</article></main><aside>{_sentences(rng, 2)}</aside><footer>{_sentences(rng, 1)}</footer></body>", want
    lines = "<br>".join(parts)
    return f"<body><div>{_menu(rng, 'span')}</div><div><div>{lines}</div></div><div>{side}</div></body>", [" ".join(parts)]


def _score(share, seed=5):
    rng, hit, got, want = random.Random(seed), 0, 0, 0
    for k in range(60):
        page, blocks = _page(rng, ["divs", "flat", "table", "classes", "semantic", "breaks"][k % 6])
        a, b = Counter(html_text.main_text(page, share).split()), Counter(" ".join(blocks).split())
        hit, got, want = hit + (a & b).total(), got + a.total(), want + b.total()
    return hit / got, hit / want


def test_templates():
    precision, recall = _score(0.5)
    assert precision > 0.97 and recall > 0.97, (precision, recall)


def test_the_threshold_decides():
    assert _score(0.0)[0] < _score(0.5)[0] - 0.01


@pytest.mark.parametrize("kind", ["divs", "flat", "table", "classes", "semantic"])
def test_blocks_are_in_order(kind):
    page, blocks = _page(random.Random(kind), kind)
    assert html_text.main_text(page).split("\n") == blocks


@pytest.mark.parametrize(
    "page,want",
    [
        ('<p title="x>A</p>', "A"),
        ("a < b <p", "a < b"),
        ("", ""),
        ("<article><header><h1>T</h1><p>By Joe, share this</p></header><p>Long enough, text. And more of it.</p><ul><li><a href=x>linked</a></ul></article>", "T\nLong enough, text. And more of it.\nlinked"),
        ("<p>one &amp; &#116;wo&nbsp;three", "one & two three"),
        ("<p>x</p>" * 3, "x\nx\nx"),
        ("<div>" * 3000 + "<p>deep, text.", "deep, text."),
    ],
)
def test_odd_pages(page, want):
    assert html_text.main_text(page) == want


def test_tables(spark):
    rows = [(1, "u", "<p>" + "word, " * 200_000, "x"), (2, None, None, "y"), (2, None, None, "y"), (None, "v", "", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {(r.page_id, r.url, r.n_chars) for r in html_text.extract(pages).collect()}
    assert got == {(1, "u", 6 * 200_000 - 1), (2, None, 0), (None, "v", 0)} and html_text.extract(pages).count() == 4
    assert html_text.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    "page",
    [
        "<p " + 'a="x" ' * 10_000 + "<b>hi</b>",
        "<div>" * 50_000 + "deep",
        "<div>t " * 50_000,
        '<p "a>" ' * 20_000,
        "<p \"<p b='>\" " * 20_000,
        "<noscript>" * 20_000 + "x",
        "<b>" * 50_000 + "<hr>" * 50_000,
        "<div>" * 20_000 + "<li>" * 20_000 + "x",
        "<div>" * 20_000 + "</span>" * 50_000,
        "<a " * 50_000,
    ],
)
def test_malformed_pages_take_linear_time(page):
    start = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - start < 8  # about half a second each; a quadratic reading takes minutes


_LONG = "A sentence of some length, with commas. Another one follows it; and a third."


@pytest.mark.parametrize(
    "page,want",
    [
        (f'<article><div class="article-header"><h1>Title</h1></div><p>{_LONG}</p></article>', f"Title\n{_LONG}"),
        (f'<article><h1>T</h1><p>{_LONG}</p><section class="related-work"><h2>Others</h2><p>{_LONG}</p></section></article>', f"T\n{_LONG}\nOthers\n{_LONG}"),
        (f'<article><p>{_LONG}</p><div class="related"><h3>More</h3><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></div></article>', _LONG),
        (f'<article><p>{_LONG}</p><div class="feedback"><p>{_LONG}</p></div></article>', _LONG),
        (f"<article><p>{_LONG}</p><p>Here <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds.</p></article>", f"{_LONG}\nHere x=1 holds."),
        (f"<article><p>{_LONG}</p><p>{_LONG}</p><h4>See</h4><p>also</p><div><a href=a>One</a></div><div><a href=b>Two</a></div></article>", f"{_LONG}\n{_LONG}\nSee\nalso"),
        (f"<p title='a' b=\"c>d\">{_LONG}</p><p 'x>{_LONG}</p>", f"{_LONG}\n{_LONG}"),
    ],
)
def test_names_and_ratios(page, want):
    assert html_text.main_text(page) == want


def test_ratios_decide_on_given_pages(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    assert sum(html_text.main_text(p, share=0) != html_text.main_text(p) for p in pages) > 0
