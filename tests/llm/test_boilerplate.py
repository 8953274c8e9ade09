import os
from datetime import datetime

import pytest

from lumenar.llm import boilerplate
from lumenar.llm.boilerplate import aligned, content_lines, main_text, page_lines, page_regions

MENU = "<nav><ul>" + "".join(f"<li><a>{x}</a></li>" for x in ("Home", "News", "About")) + "</ul></nav>"
TAIL = "<footer><p>All rights reserved</p><span>© 2024</span></footer>"
LONG = "The coast guard found the original recording and compared the travel permits near the river."


def page(body, n=3):
    return f"<html><body>{MENU}{body}{TAIL}</body></html>"


def article(title, n=3, extra=""):
    return f"<div class='x'><h1>{title}</h1><div class='by'><span>By Ana Lima</span></div>" + "".join(f"<p>{LONG} {title} {i}</p>" for i in range(n)) + extra + "</div>"


def kept(html):
    """Content of a page that no other page votes on."""
    events = page_lines(html)
    threshold, _, found = page_regions(events)
    return [events.lines[k][0] for c in found if c.won and c.peak > boilerplate.REACH * threshold for k in c.lines]


def test_article_only():
    teaser = "<aside><h3>Most read</h3>" + "".join(f"<a>{LONG} {i}</a>" for i in range(6)) + f"<p>{LONG}</p></aside>"
    html = page(teaser + article("Title", 3, "<ul><li>One point</li></ul><p class='s'><b>See also:</b><a>Another story of some length</a></p>"))
    assert kept(html) == ["Title", *[f"{LONG} Title {i}" for i in range(3)], "One point"]


def test_headline_in_the_page_header():
    """The site's name as the headline of its header doesn't make the header the article."""
    head = "<header><h1>The River Archive</h1><p>Voices, letters and films</p></header>"
    text = "".join(f"<p>{LONG} {i}</p>" for i in range(5))
    assert kept(page(f"{head}<div>{text}</div>")) == [f"{LONG} {i}" for i in range(5)]


@pytest.mark.parametrize("n", [1, 2, 4])
def test_no_headline_but_running_text(n):
    assert kept(page("<div>" + "".join(f"<p>{LONG} {i}</p>" for i in range(n)) + "</div>")) == [f"{LONG} {i}" for i in range(n)]


def test_pages_without_content():
    assert kept(page("<div><p>Page not found</p><p>The address has changed.</p></div>")) == []
    for html in ("", "   ", "<p", "<html></html>", "<script>var a = 'x'</script>", "</p></div>", "<!doctype html><!-- x -->"):
        assert kept(html) == []


def test_deep_and_long_pages():
    assert kept("<div>" * 3000 + f"<p>{LONG}</p>" * 3) == [LONG] * 3
    assert len(kept(page(article("Long", 3000)))) == 3001


def _short_pages(n):
    """Articles of one paragraph or six, two thirds of them beside four comments; every fifth page is an error page."""
    rows, want = [], {}
    for i in range(n):
        side = "<section class='talk'>" + "".join(f"<b>Ana</b><p>{LONG} {k}</p>" for k in range(0 if i % 3 == 1 or i % 5 == 4 else 4)) + "</section>"
        body = "<div class='x'><p>Page not found</p><p>The address has changed.</p></div>" if i % 5 == 4 else article(f"Story {i}", 1 if i % 3 == 0 else 6)
        html = page(body + side)
        lines = [x[0] for x in page_lines(html).lines]
        rows.append((i, datetime(2024, 1, 1), "b.example", html, "\n".join(lines)))
        want[i] = [k for k, x in enumerate(lines) if f"Story {i}" in x]
    return rows, want


SCHEMA = "page_id bigint, ingested_at timestamp, site string, raw_html string, plain_text string"


def test_short_articles_by_the_votes_of_their_site(spark):
    rows, want = _short_pages(60)
    found = {r.page_id: list(r.line_nos) for r in content_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == want


@pytest.mark.parametrize("scale", [0.0, 3.0])
def test_the_threshold_decides(spark, monkeypatch, scale):
    """Without a threshold error pages have content; with one that no line reaches nothing has."""
    rows, want = _short_pages(60)
    pages = [page_lines(r[3]) for r in rows]
    before = [page_regions(x) for x in pages]
    found = boilerplate._two_means
    monkeypatch.setattr(boilerplate, "_two_means", lambda v: scale * found(v))
    after = [page_regions(x) for x in pages]
    reached = lambda x: [c.lines for c in x[2] if c.won and c.peak > boilerplate.REACH * x[0]]
    assert [c.mass for x in before for c in x[2]] != [c.mass for x in after for c in x[2]]
    assert all(bool(c.won) <= bool(c.mass) for x in after for c in x[2])
    assert scale == 0.0 or not any(reached(x) for x in after) and any(reached(x) for x in before)


def test_alignment_with_a_long_menu_missing_from_the_text():
    menu, body = [f"Menu {i}" for i in range(60)], [f"{LONG} {i}" for i in range(7)]
    assert aligned(menu + body, body) == {60 + i: i for i in range(7)}
    assert aligned(body, ["x", *body[:3], "", "y  z", *body[3:]]) == {0: 1, 1: 2, 2: 3, 3: 6, 4: 7, 5: 8, 6: 9}
    assert aligned(["a", "b", "a", "c"], ["a", "c", "a"]) in ({0: 0, 2: 2}, {0: 0, 3: 1}) and aligned([], ["a"]) == aligned(["a"], []) == {}


def test_operator(spark):
    at = lambda d: datetime(2024, 1, d)
    text = lambda h: "\n".join(x[0] for x in page_lines(h).lines)
    rows = []
    for i in range(40):
        html = page(article(f"Story {i}", 2 + i % 3))
        rows.append((i, at(1), "a.example", html if i % 8 else None, text(html), "k"))
    rows += [(100, at(1), "a.example", page(article("Gone")), None, "k"), (101, at(1), None, None, None, "k"), (102, at(1), "a.example", None, "", "k"), (103, at(1), "a.example", "", "One line", "k")]
    rows += [(104, at(1), "a.example", page(article("Old")), text(page(article("Old"))), "k"), (104, at(2), "a.example", page(article("New", 1)), text(page(article("New", 1))), "k")]
    df = spark.createDataFrame(rows, "page_id bigint, ingested_at timestamp, site string, raw_html string, plain_text string, flags string")
    found = {r.page_id: list(r.line_nos) for r in content_lines(df).collect()}
    rows_without = [(200 + i, at(1), "a.example", page("<ul>" + "".join(f"<li><a>Link {k}</a></li>" for k in range(60)) + "</ul>" + article(f"Cut {i}", 3)), "\n".join(f"{LONG} Cut {i} {k}" for k in range(3)), "k") for i in range(3)]
    cut = content_lines(spark.createDataFrame(rows + rows_without, df.schema)).filter("page_id >= 200").collect()
    assert [list(r.line_nos) for r in cut] == [[0, 1, 2]] * 3
    assert 100 not in found and 101 not in found and found[102] == [] and found[103] == []
    for i in range(40):
        assert found[i] == [3, *range(5, 7 + i % 3)] or i % 8 == 0 and set(found[i]) >= set(range(5, 7 + i % 3)), (i, found[i])
    assert found[104] == [3, 5]
    texts = {r.page_id: r.main_text for r in main_text(df).collect()}
    assert texts[104] == f"New\n{LONG} New 0" and texts[103] == ""
    assert content_lines(df.limit(0)).count() == 0


TABLES = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
def test_lines_of_the_tables_by_their_markup(spark):
    """Against labels from the markup of the given pages: there an article is what lies directly in its headline's element."""
    pages = spark.read.parquet(f"{TABLES}/page_captures.parquet").filter("raw_html is not null and plain_text is not null")
    want = set()
    for r in pages.collect():
        events = page_lines(r.raw_html)
        if len(events.lines) == len(r.plain_text.split("\n")):
            headed = _Headline(r.raw_html).container
            linked = {x[3] for x in events.lines if x[4] and sum(len(y[0]) for y in events.lines if y[3] == x[3] and y[4]) * 2 >= sum(len(y[0]) for y in events.lines if y[3] == x[3])}
            want |= {(r.page_id, k) for k, x in enumerate(events.lines) if x[2] == headed and x[3] not in linked}
    found = {(r.page_id, k) for r in content_lines(pages).collect() for k in r.line_nos}
    hits = len(want & found)
    assert hits / len(found) > 0.97 and hits / len(want) > 0.97, (hits, len(found), len(want))


class _Headline(boilerplate.LineEvents):
    """The container of a page's headline."""

    def __init__(self, html):
        super().__init__()
        self.container = None
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag == "h1" and self.container is None:
            self.container = self._container
        super().handle_starttag(tag, attrs)
