"""HTML extraction: broken markup in linear time, and the whole query against a brute-force version."""

import random
import re
import time
from collections import Counter
from html.parser import HTMLParser

import pytest

from pointline.llm import htmltext
from pointline.llm.htmltext import aligned, extract_text, page_blocks


def lcs_length(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@pytest.mark.parametrize("matches", [0, 10, 10**6])
def test_alignment_is_longest(matches, monkeypatch):
    monkeypatch.setattr(htmltext, "MATCHES", matches)
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(15))] for _ in range(2))
        got = aligned(a, b)
        rest = iter(b)
        assert len(got) == lcs_length(a, b) and got == sorted(set(got)) and all(a[i] in rest for i in got)


BROKEN = ["x <b " * 100_000, "<b>" * 100_000 + "</i>" * 100_000, "<b>" + "<div>" * 50_000 + "</b>" * 50_000, '<b "> ' * 100_000 + '"', "<head>" * 50_000, "<a '" * 100_000 + ">", "<!--" * 100_000, "<p><b>x<br>" * 50_000]


@pytest.mark.parametrize("page", BROKEN, ids=range(len(BROKEN)))
def test_broken_pages_take_linear_time(page):
    start = time.perf_counter()
    page_blocks(page)
    assert time.perf_counter() - start < 10  # quadratic work takes minutes


def test_nothing_is_lost():
    assert [x for x, z in page_blocks("<div>" * 10_050 + "<nav>menu</nav><p>kept text</p>") if z > 0] == ["kept text"]
    assert [x for x, _ in page_blocks("İ" * 40 + "<p>a</p><script>x</script><p>b</p><p>c</p>")][1:] == ["a", "b", "c"]
    inside = "<article>" + "".join(f'<div class="{c}">{c}</div>' for c in ("social-history", "search-results", "copyright-law", "related-work")) + '<div class="comments">said</div></article>'
    assert [x for x, z in page_blocks(inside) if z == 2] == ["social-history", "search-results", "copyright-law", "related-work"]
    assert [x for x, z in page_blocks('<p class="ad">buy<p>real') if z > 0] == ["real"]


GONE = ("sidebar", "user-comments", "notice", "comments-section", "commentlist", "ad-slot", "ad-banner", "newsletter-signup", "cookie-notice", "share-buttons", "related-posts", "teaser-2", "sidebar-left", "usercomments")
KEPT = ("social-history", "search-results", "copyright-law", "related-work", "has-sidebar", "address", "post-content", "news-item")


@pytest.mark.parametrize("body", ["main", "article"])
def test_blocks_of_the_page_inside_an_article(body):
    page = f"<{body}>" + "".join(f'<div class="{c}">{c}</div>' for c in GONE + KEPT) + f'<article class="teaser">next</article><p>x <math><mi>a</mi><mo>+</mo><mi>b</mi></math></p></{body}>'
    assert [x for x, z in page_blocks(page) if z == 2] == [*KEPT, "x a+b"]
    assert [x for x, z in page_blocks(f'<{body}><div class="sidebar-wrap"><article>told</article></div></{body}>') if z == 2] == ["told"]
    asked = page_blocks(f'<{body}><p>told</p><div class="disclaimer">said</div><section id="alert">warned</section></{body}>')
    assert asked == [("told", 2), ("said", 3), ("warned", 3)]


class Plain(HTMLParser):
    """Lines and zones of the whole, well-formed pages that this test writes."""

    ZONES = {"nav": 0, "footer": 0, "sidebar": -1, "comments": 0, "ad-slot": 0, "disclaimer": 3, "alert": 3}

    def __init__(self, page):
        super().__init__()
        self.zones, self.lines = [1], []
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        here = self.zones[-1]
        self.zones.append(here if here <= 0 else self.ZONES.get(dict(attrs).get("class") or tag, 2 if tag == "article" else here))

    def handle_endtag(self, tag):
        self.zones.pop()

    def handle_data(self, data):
        if data.strip():
            self.lines.append((data.strip(), self.zones[-1]))


def brute(pages, neighbours=4):
    """Texts by the stated rule, page by page, with a parser and an alignment of its own."""
    parsed, classes = [], {}
    for _, url, page in pages:
        m = re.match(r"([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]*)([^?#]*)", url or "")
        host, path = (m.group(2).lower(), m.group(3)) if m else ("", re.match(r"[^?#]*", url or "").group())
        own = tuple(Plain(page or "").lines)
        parsed.append((host, path, own))
        classes[host, own] = min(path, classes.get((host, own), path))
    texts = []
    for host, _, own in parsed:
        body = any(z >= 2 for _, z in own)
        mine = [(x, z) for x, z in own if z != 2]
        # paths of classes are distinct in these pages, so the order is the operator's
        order = sorted((k for k in classes if k[0] == host), key=lambda k: classes[k])
        at = order.index((host, own))
        near = [order[j][1] for j in range(at - neighbours // 2, at + neighbours // 2 + 1) if 0 <= j < len(order) and j != at]
        votes = Counter()
        for other in near if len(own) < 10_000 else ():
            for k in longest([x for x, _ in mine], [x for x, z in other if z != 2]):
                votes[k] += 1
        gone = {k for k, n in votes.items() if 2 * n > len(near)}
        out, k = [], -1
        for x, z in own:
            k += z != 2
            if z == 2 or z == (3 if body else 1) and k not in gone:
                out.append(x)
        texts.append("\n".join(out))
    return texts


def longest(a, b):
    """Places in a of a longest common subsequence; lines of a page are distinct in these tests, so it is the only one that matters."""
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in reversed(range(len(a))):
        for j in reversed(range(len(b))):
            table[i][j] = table[i + 1][j + 1] + 1 if a[i] == b[j] else max(table[i + 1][j], table[i][j + 1])
    i = j = 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            yield i
            i, j = i + 1, j + 1
        elif table[i + 1][j] >= table[i][j + 1]:
            i += 1
        else:
            j += 1


def test_query_equals_brute_force(spark):
    rng = random.Random(5)
    pages = []
    for k in range(120):
        host = f"h{k % 3}.example"
        top = "".join(f"<p>{host} line {j}</p>" for j in range(3))
        text = "".join(f"<p>text {rng.randrange(10**6)}</p>" for _ in range(rng.randrange(4)))
        shared = "<p>said before</p>" if rng.random() < 0.2 else ""
        inside = f'<div class="sidebar">side {k}</div><div class="disclaimer">no liability</div><div class="alert">warning {k}</div><div class="comments">said {k}</div><div class="ad-slot">buy {k}</div>'
        body = f"<article>{text}{shared}{inside}</article>" if k % 3 == 0 or k % 5 == 0 else text + shared
        pages.append((k, f"http://{host}/{k:04d}?q={k}", f"<nav>menu {k}</nav>{top}{body}<p>end of {host}</p><footer>f</footer>"))
    copy = pages[7][2]
    pages += [(1000 + k, f"http://h1.example/0007/{k}", copy) for k in range(9)]
    pages += [(2000, None, None), (2001, "odd", ""), (2002, "http://lone.example/a", "<p>only</p>"), (None, "http://lone.example/a", "<p>only</p>"), (2003, "http://long.example/", "<p>w</p>" * 50_000)]
    # one frame around different articles: each counts as a page of its own
    pages += [(3000 + k, f"http://same.example/{k}", f'<nav>n</nav><article><p>told {k}</p><div class="disclaimer">no liability</div></article>') for k in range(5)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {(r.page_id, r.url): r.text for r in extract_text(table.repartition(5)).collect()}
    want = brute(pages)
    assert len(got) == len(pages)
    assert got == {(p[0], p[1]): t for p, t in zip(pages, want, strict=True)}
    # the frame is gone from every page without an article, and only there is it a matter of alignment
    assert all("line 0" not in got[p[0], p[1]] for p in pages[:120])
    # in articles the standing disclaimer goes by alignment and warnings of one page alone stay
    assert got[3000, "http://same.example/0"] == "told 0"
    assert all("no liability" not in got[p[0], p[1]] and f"warning {p[0]}" in got[p[0], p[1]] for p in pages[:120:3])


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert extract_text(empty).collect() == []
    clash = spark.createDataFrame([(1, "http://a/b", "<p>x</p>", "t", 5)], "page_id long, url string, html string, text string, __host int")
    assert [tuple(r) for r in extract_text(clash).collect()] == [(1, "http://a/b", "x", 1)]
