"""Main text of pages: frames, marked articles, pairs and alignment."""

import html
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SF
from rasterqa.llm import pages

SCHEMA = "page_id long, url string, html string"


def text_of(spark, rows):
    d = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("host", "path", "text", "n_chars", "lines")}).coalesce(1)
    return {r.page_id: r.text for r in pages.main_text(d).collect()}


def plain_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=25), st.lists(st.sampled_from("abcd"), max_size=25), st.sampled_from([1, 20, 1 << 28]))
def test_longest_common_subsequence(a, b, bits):
    kept, pages.TABLE_BITS = pages.TABLE_BITS, bits
    try:
        found = pages.common_lines(a, b)
    finally:
        pages.TABLE_BITS = kept
    assert all(a[i] == b[j] for i, j in found) and len(found) == plain_lcs(a, b)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(found, found[1:]))


def test_given_pages_yield_their_articles(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    want = {}
    for r in rows:
        body = r.html[r.html.index("<article>"):r.html.index("</article>")]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", " " if b.startswith("br") else "", b)).split()) for b in re.split(r"</?(?:p|h1)>", body.replace("<br>", " "))]
        want[r.page_id] = (r.url, "\n\n".join(b for b in blocks if b))
    got = entry.queries()["op12_main_text"](spark, SF).collect()
    assert {r.page_id: (r.url, r.text) for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def frame(body, note="", n=0):
    return (f"<div><div>Home</div><div>About us &amp; more</div></div><div>{body}</div><div>Read our terms of use</div>"
            f"<div>All rights reserved</div>{note}<script>x({n}) < 3</script>")


def test_unmarked_pages_lose_what_they_share(spark):
    rows = [(i, f"http://h.example/de/{i}", frame(f"<h2>Title {i}</h2><p>Story\n number&nbsp;{i} <b>here</b><br>now", n=i)) for i in range(5)]
    rows += [(9, "http://other.example/x", frame("<p>Alone"))]
    got = text_of(spark, rows)
    assert all(got[i] == f"Title {i}\n\nStory number {i} here now" for i in range(5))
    assert got[9] == "Home\n\nAbout us & more\n\nAlone\n\nRead our terms of use\n\nAll rights reserved"


def test_named_frames_go_without_a_neighbour(spark):
    page = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header>
      <nav><a>Menu</a></nav><div class="cookie-banner">We use <p>cookies</div><main><article><header><h1>Real &lt;title&gt;</h1></header>
      <p>One<p>Two <i>words</i></p><div class="ad">Buy</div><form>Name <input> <button>Go</button></form><ul><li>a</li><li>b</li></ul>
      <section id="comments"><article class="comment"><p>First!</p></article></section><!-- not <p>this</p> --></article></main>
      <aside>Side</aside><div class="sponsored">S</div><div role="contentinfo">C</div><footer>F</footer></body></html>"""
    got = text_of(spark, [(1, "http://a.example/1", page), (2, None, page), (3, "no url", page + "<p>tail")])
    assert set(got.values()) == {"Real <title>\n\nOne\n\nTwo words\n\na\n\nb"}


def test_passages_both_articles_mark_stay_and_copies_stay(spark):
    page = lambda i: f"<div>Home</div><article><p>Quoted passage of two articles</p><p>Own {i}</p></article><p>Call us</p>"
    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(3)]
    rows += [(10 + i, f"http://copy.example/same?v={i}", "<p>Just one</p><p>And the same</p>") for i in range(3)]
    got = text_of(spark, rows)
    assert all(got[i] == f"Quoted passage of two articles\n\nOwn {i}" for i in range(3))
    assert all(got[10 + i] == "Just one\n\nAnd the same" for i in range(3))


def test_nearest_path_counts(spark):
    a, b = "<p>Menu A</p>", "<p>Menu B</p>"
    rows = [(1, "http://h.example/aaa/1", a + "<p>one</p>"), (2, "http://h.example/aaa/2", a + "<p>two</p>" + b), (3, "http://h.example/bbb/1", b + "<p>three</p>")]
    assert text_of(spark, rows) == {1: "one", 2: "two\n\nMenu B", 3: "three"}


@pytest.mark.parametrize("bad", ["<", "<p", "<article", "</p></div>x", "<script>never closed <p>x", "&#xZZ; &bogus; &#1114112;", "<p>a\x00b", "<!DOCTYPE", "<![CDATA[x]]>", "<a <b>c"])
def test_broken_pages_do_not_fail(spark, bad):
    assert isinstance("\n\n".join(pages.read_page(1, "", "", "", bad).lines), str)


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "http://e.example/", ""), (None, "http://e.example/x", "<p>t"), (3, "http://e.example/y", "<p>" + "word " * 300_000), (3, "http://e.example/y", "<p>same row"),
            (4, "http://e.example/z", "<p>l</p>" * 20_000), (5, "http://e.example/zz", "<p>l</p>" * 20_000 + "<p>m")]
    d = spark.createDataFrame(rows, SCHEMA)
    got = pages.main_text(d).collect()
    assert len(got) == len(rows) and {r.page_id: r.n_chars for r in got}[1] == 0
    assert next(r for r in got if r.n_chars > 1_000_000).n_chars == 300_000 * 5 - 1
    assert pages.main_text(d.limit(0)).count() == 0
