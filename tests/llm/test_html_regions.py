"""Pages whose marks mislead, the windows inside a marked article, and long broken pages."""

import random
import time

import pytest

from kinetable.llm import html_text

LONG = " ".join(f"word{i} of a sentence that runs on." for i in range(12))
NEXT = " ".join(f"more{i} of the same kind of text." for i in range(12))


@pytest.mark.parametrize("page, text", [
    # The article is in plain elements; comments and teasers are marked as articles.
    (f"<div class=entry><h1>T</h1><p>{LONG}</p></div><ol class=comment-list><li><article class=comment-body><p>Reader comment here.</p></article></li></ol>", f"T\n{LONG}"),
    (f"<div class=entry><h1>T</h1><p>{LONG}</p></div><ol><li><article class=comment-body><p>Reader {NEXT}</p></article></li></ol>", f"T\n{LONG}"),
    (f"<div class=entry><h1>T</h1><p>{LONG}</p></div><section class=related-posts><article><p>{NEXT}</p></article></section>", f"T\n{LONG}"),
    (f"<div class=entry><h1>T</h1><p>{LONG}</p><p>{NEXT}</p></div><div><article><p>Another page.</p></article></div>", f"T\n{LONG}\n{NEXT}"),
    # A teaser after the article, and an article in two parts.
    (f"<article><h1>T</h1><p>{LONG}</p></article><article><p>Read this next, it is short.</p></article>", f"T\n{LONG}"),
    (f"<article><p>{LONG}</p></article><article><p>{NEXT}</p></article>", f"{LONG}\n{NEXT}"),
    # Unwrapping is a last resort.
    (f"<div class=sidebar><article><p>{NEXT}</p></article></div><div><p>{LONG}</p></div>", LONG),
    (f"<div class=sidebar><article><p>{LONG}</p></article></div>", LONG),
    # Notices in plain elements at the edges of a marked article.
    (f"<article><h1>T</h1><p>{LONG}</p><p>Short end.</p><div>Share this on Foo</div><div>Subscribe now</div></article>", f"T\n{LONG}\nShort end."),
    (f"<article><div>Share this on Foo</div><h1>T</h1><p>{LONG}</p><p>In between.</p><p>{NEXT}</p></article>", f"T\n{LONG}\nIn between.\n{NEXT}"),
])
def test_pages_whose_marks_mislead(page, text):
    assert html_text.main_text(f"<html><body>{page}</body></html>") == text


def brute_windows(lengths):
    """Surge and dive by definition: from the first to the last window that is full, without lines it does not need."""
    window, surge = html_text.WINDOW, min(html_text.SURGE, max((sum(lengths[i: i + html_text.WINDOW]) for i in range(len(lengths))), default=0))
    if not surge:
        return 0, len(lengths)
    full = [i for i in range(len(lengths)) if sum(lengths[i: i + window]) >= surge]
    first = max(k for k in range(full[0], full[0] + window) if sum(lengths[k: full[0] + window]) >= surge)
    last = min(k for k in range(full[-1] + 1, min(full[-1] + window, len(lengths)) + 1) if sum(lengths[full[-1]: k]) >= surge)
    return first, last


def test_span_is_that_of_the_windows():
    rnd = random.Random(4)
    for _ in range(400):
        lengths = [rnd.choice([0, 5, 20, 45, 90, 200]) for _ in range(rnd.randint(0, 14))]
        lines = [html_text._Line("x" * n, n, 0, "div", 2 * i, -1) if n else html_text._GAP for i, n in enumerate(lengths)]
        assert html_text._span(lines) == brute_windows(lengths), lengths


def test_results_depend_on_the_distribution(monkeypatch):
    page = f"<article><div>Share</div><p>{LONG}</p><div>Subscribe</div></article>"
    plain = f"<div>Menu</div><div><p>{LONG}</p></div><div>Imprint</div>"
    assert html_text.main_text(page) == html_text.main_text(plain) == LONG
    monkeypatch.setattr(html_text, "_span", lambda lines: (0, len(lines)))
    assert html_text.main_text(page) == f"Share\n{LONG}\nSubscribe" and html_text.main_text(plain) == f"Menu\n{LONG}\nImprint"


@pytest.mark.parametrize("page", [
    "<i>" * 200_000 + "</b>" * 200_000, "<p>" + "<div>" * 100_000 + "</p>" * 100_000, "<i>" * 100_000 + "<p>a</p>" * 100_000,
    "<div class=ad>" + "<article>" * 100_000, "<article>" + "<div class=ad><h1>x</h1>" * 50_000,
])
def test_long_broken_pages_take_linear_time(page):
    began = time.time()
    html_text.main_text(page)
    assert time.time() - began < 20


def test_extracted_cases(spark):
    rows = [(1, None, "a", 1), (2, "", "b", 2), (3, f"<p>{LONG}</p>", "c", 3), (3, f"<p>{LONG}</p>", "c", 3), (None, "<script>x</script>", None, None)]
    df = spark.createDataFrame(rows, "page_id long, html string, main_text string, row int")
    out = html_text.extracted(df)
    assert out.columns == ["row", "main_text"]
    got = sorted((str(r.row.page_id), r.main_text, r.row.main_text) for r in out.collect())
    assert got == sorted([("1", "", "a"), ("2", "", "b"), ("3", LONG, "c"), ("3", LONG, "c"), ("None", "", None)], key=str)
    assert html_text.extracted(df.limit(0)).collect() == []
