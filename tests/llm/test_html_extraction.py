"""Operator 8: hand-written pages, plain templates, wrapper inference."""

import html
import re
import time

import numpy as np
from pyspark.sql import functions as F

from posekeel.llm import html_extraction as module
from posekeel.llm.html_extraction import Places, _infer, extract_text, kept_slots, page_tokens, show

PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var a="</p><article>no";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href=x>Menu</a><li>Two</ul></nav><div class="cookie-notice">We use cookies</div>
<!-- <article>hidden</article> --><main><article><h1>Head&eacute;r &amp; co</h1><div class="ad">Buy</div><p>One <b>bo</b>ld
 line<br>next<p>Second &#x41;<ul><li>i1<li>i2</ul><aside>Related</aside><form>Name <input name=q><button>Go</button></form>
<table><tr><td>c1<td>c2</table><section class="comments"><p>Reader says hi</p></section></article></main>
<div id="sidebar">Links</div><footer>&copy; 2024</footer></body></html>"""


def text_of(page):
    tokens, texts = page_tokens(page)
    return " ".join(t for t, k in zip(texts, kept_slots(tokens)) if k)


def test_full_page():
    assert text_of(PAGE) == "Headér & co One bold line next Second A i1 i2 c1 c2"


def test_odd_pages():
    assert text_of("") == ""
    assert text_of("no tags < here &lt;b&gt;") == "no tags < here <b>"
    assert text_of("<p>a<p>b</div></p>c") == "a b c"
    assert text_of("<article><p>cut of") == "cut of"
    assert text_of("<script>never ends <p>x") == ""
    assert text_of("<div role=main><p>m</p></div><div>rest</div>") == "m"
    assert text_of("<div class='page with-sidebar'><article><p>in</p></article></div>") == "in"
    assert text_of("<article><p>in</p></article><section class=comments><article>reader</article></section>") == "in"
    assert text_of("<article><p>in<section class=discussion><p>we find</p></section><div class=alert>take care</div></article>") == "in we find take care"
    assert text_of("<div class=banner>site</div><ul><li><a href=x>Home</a><li><a href=y>News</a></ul><p>plain</p><ul><li>point <a href=z>one</a></ul>") == "plain point one"
    assert text_of("<article><p title='x>in <p>not \"closed</p></article>") == 'in not "closed'


def test_broken_pages_take_linear_time():
    """Unclosed quotes and elements, ten times as many, take about ten times as long."""
    for piece in ("<p title=\"x' >a ", "<div>a", "<section><p>a", "<p><table>a", "<li>a</x>"):
        took = []
        for n in (3000, 30000):
            page = "<p alt='" + piece * n
            began = time.perf_counter()
            tokens, texts = page_tokens(page)
            kept_slots(tokens)
            took.append(time.perf_counter() - began)
        assert took[1] < 40 * took[0] + 0.5


def test_long_alignments_are_halved(monkeypatch):
    rnd = np.random.default_rng(1)
    for _ in range(60):
        a, b = (rnd.integers(0, 4, rnd.integers(0, 40)).astype(np.int32) for _ in "ab")
        whole = module._aligned(a, b)
        monkeypatch.setattr(module, "CELLS", 16)
        halved = module._aligned(a, b)
        monkeypatch.undo()
        for pairs in (whole, halved):
            assert all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
        *_, last = module._common_rows(a, b)
        assert len(whole) == len(halved) == last[-1]


def test_repeats_of_any_size_are_folded():
    block = "".join(f"<div><h{k}>t</h{k}><p>x</p></div>" for k in (1, 2, 3, 4, 5, 6))
    tokens = page_tokens(f"<section>{block}</section>" * 3)[0]
    assert show(_infer([" ".join(tokens)])).endswith("</section>)+")


def test_wrapper_is_a_union_free_expression():
    pages = [f"<div><h1>t{i}</h1>{'<p>x</p>' * i}{'<h2>s</h2>' if i % 2 else ''}</div>" for i in range(1, 5)]
    assert show(_infer([" ".join(page_tokens(p)[0]) for p in pages])) == "<div><h1>#</h1>(<p>#</p>)+(<h2>)?(#)?(</h2>)?</div>"


def plain(page):
    body = re.search(r"<article>(.*?)(</article>|\Z)", page or "", re.S)
    return " ".join(html.unescape(re.sub(r"<[^>]+>", "\n", re.sub(r"</?b>", "", body[1]))).split()) if body else ""


def test_against_plain_templates(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    expected = {r.page_id: plain(r.html) for r in frame.collect()}
    got = extract_text(frame).collect()
    assert len(got) == len(expected)
    assert all(r.text == expected[r.page_id] and r.n_chars == len(r.text) for r in got)


def test_odd_rows(spark):
    rows = [(1, None, None), (1, None, None), (None, "http://[", "<p>a</p>"), (2, "http://h/", PAGE), (3, "http://h/", "<p>" + "é" * 100000)]
    got = extract_text(spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")).collect()
    assert sorted(r.n_chars for r in got) == [0, 0, 1, 51, 100000]
    assert extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_places_are_those_of_the_wrapper():
    pages = [f"<div><h1>t{i}</h1>{'<p>x</p>' * i}{'<h2>s</h2>' if i % 2 else ''}</div>" for i in range(1, 5)]
    streams = [page_tokens(p)[0] for p in pages]
    places = Places(_infer([" ".join(t) for t in streams]))
    got = [places.of_slots(t) for t in streams]
    assert got == [[2, 5, 8], [2, 5, 5], [2, 5, 5, 5, 8], [2, 5, 5, 5, 5]]
    assert places.of_slots(["table", "#", "/table"]) == [-1] and places.of_slots([]) == []


def test_what_repeats_on_a_host_is_template(spark, monkeypatch):
    notice, menu = "<div class=c1>We keep your data</div>", "<div><ul><li>Home<li>News<li>Contact</ul></div>"
    advert = lambda i: f"<div><h3>Buy {i % 3}</h3></div>"
    inside = [(i, "http://a/", f"<article>{notice}<h1>T{i}</h1><p>one {i}<p>two {i}{advert(i)}</article>") for i in range(40)]
    plain = [(100 + i, "http://b/", f"<body>{menu}<p>only {i}</p>{'<p>more %d</p>' % i if i % 2 else ''}{notice}</body>") for i in range(40)]
    few = [(200 + i, "http://c/", f"<body>{menu}<p>only {i}</p></body>") for i in range(3)]
    copies = [(300 + i, "http://d/", f"<body><div class=menu>{i}</div><article><p>copied</p></article></body>") for i in range(9)]
    near = [(400 + i, "http://e/", f"<article><h1>N{i}</h1><p>{'a long one ' * 9}<p>{'and another ' * 9}<p>end {i}</article>") for i in range(9)]
    frame = spark.createDataFrame(inside + plain + few + copies + near, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract_text(frame).collect()}
    assert all(got[i] == f"T{i} one {i} two {i}" for i in range(40))
    assert all(got[100 + i] == f"only {i}" + (f" more {i}" if i % 2 else "") for i in range(40))
    assert all(got[200 + i] == f"Home News Contact only {i}" for i in range(3))
    assert all(got[300 + i] == "copied" for i in range(9))
    assert all(got[400 + i].count("a long one") == 9 for i in range(9))
    # without wrappers every page is judged by tags alone, and keeps its template
    monkeypatch.setattr(module, "infer_wrappers", lambda work, skeletons: skeletons.select("host", F.lit("[]").alias("wrapper")).distinct())
    bare = {r.page_id: r.text for r in extract_text(frame).collect()}
    assert all("We keep your data" in bare[i] for i in (*range(40), *range(100, 140)))


def test_a_host_of_many_shards(spark, monkeypatch):
    monkeypatch.setattr(module, "FAN_IN", 3)
    pages = [(i, "http://h/", "<div>Menu of all</div>" + "".join(f"<h{1 + (i >> k) % 2}>w{i} {k}</h{1 + (i >> k) % 2}>" for k in range(5))) for i in range(32)]
    got = {r.page_id: r.text for r in extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {i: " ".join(f"w{i} {k}" for k in range(5)) for i in range(32)}
