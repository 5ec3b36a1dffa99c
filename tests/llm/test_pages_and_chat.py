"""Operators on pages and conversations."""

import gzip
import hashlib
import io
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from almanac.llm import chat, html, warc

BODY = "<p>Some longer payload that is stored once.</p>" * 40
PAGES = [
    (1, "http://a/1", "<html><body><nav><ul><li><a href='/x'>Menu</a></li><li><a href='/y'>More</a></li></ul></nav><article><h1>Head &amp; more</h1><p>First  para\ngraph.</p><p><b>Bold<br><p>Second.</article><footer>&copy; site</footer></body></html>"),
    (2, "http://a/2", BODY),
    (3, "http://a/3", BODY),
    (4, None, BODY),
    (4, None, BODY),
    (5, "http://a/5", None),
    (6, "http://a/6", ""),
    (7, "http://a/7", "short"),
    (8, "http://a/8", "short"),
    (None, "http://a/9", "é" * 600),
    (10, "http://a/10", "<div>\x1f\x8b\x08 not a member" + "x" * 100_000),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "x", 1) for p in PAGES], "page_id long, url string, html string, payload string, digest int")


def test_round_trip(spark, pages):
    rows = warc.round_trip(pages).collect()
    assert len(rows) == len(PAGES)
    for r in rows:
        raw = next(h or "" for p, _, h in PAGES if p == r.page_id).encode()
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert r.record_type == ("revisit" if r.page_id in (2, 3) else "response")
        assert r.refers_to == (4 if r.page_id in (2, 3) else None)
        assert r.payload is None if r.record_type == "revisit" else r.payload == raw
    assert warc.round_trip(pages.limit(0)).count() == 0


@pytest.mark.parametrize("size", [1, 37, 1000, 1 << 20])
def test_every_record_is_read_once(size):
    records = [warc.record(k, f"http://x/{k}", bytes([k]) * (k * 50) + b"\x1f\x8b\x08\x00", "00", None) for k in range(12)]
    data = b"".join(map(warc._member, records)) + gzip.compress(b"no record") + warc._member(records[0])
    file = pa.PythonFile(io.BytesIO(data), mode="r")
    got = [c for lo in range(0, len(data), size) for c in warc.members(file, len(data), lo, min(len(data), lo + size))]
    assert got == [*records, records[0]]


def test_main_text(spark, pages):
    filler = spark.createDataFrame([(k, "u", f"<p>Words of sentence number {k} stand here. And some more words follow.</p>") for k in range(40)], "page_id long, url string, html string")
    model = html.fit(filler, layouts=300)
    got = {r.page_id: r.text for r in html.extract(pages.where("page_id in (1, 5, 6)"), model).collect()}
    assert got == {1: "Head & more\nFirst para graph.\nBold\nSecond.", 5: "", 6: ""}
    side = "<html><body><header class='masthead'><a href='/'>Site</a></header><div class='post-body'><h1>Title</h1><p>The story has some words. It goes on for a while.</p><ul><li>point one</li><li>point two</li></ul></div><div class='sidebar'><h3>Related</h3><ul><li><a>one</a></li><li><a>two</a></li></ul></div><section class='comments'><h3>Comments</h3><div class='comment'><b>Ann</b><p>I like it very much.</p></div></section><div class='cookie-notice'><p>We use cookies.</p><button>OK</button></div><script>var x='<p>no</p>'</script></body></html>"
    page = html.Page(side)
    assert html.main_text(page, html.decode(page, model.margin(html.features(page)))) == "Title\nThe story has some words. It goes on for a while.\npoint one\npoint two"


def test_decoding_never_keeps_below_what_is_dropped(spark):
    import numpy as np

    page = html.Page("<div><p>a</p><div><p>b</p><p>c</p></div></div><p>d</p>")
    rng = np.random.default_rng(0)
    for _ in range(50):
        keep = html.decode(page, rng.standard_normal(len(page.tag)))
        assert all(keep[page.parent[e]] for e in range(1, len(keep)) if keep[e])


@pytest.mark.parametrize("text", ["", "<", "<p", "</p>", "<!--", "<script>x", "<p><p></div></span>", "a&lt;b &nbsp; c", "<a href='x>y'>t</a>", "<div/>x" * 50])
def test_parser_takes_anything(text):
    page = html.Page(text)
    assert len(html.features(page)) == len(page.tag) == len(page.parent)


def brute(rows):
    talks = {}
    for c, t, r, x in dict.fromkeys(rows):
        if c is not None:
            talks.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    talks = {c: [(r, x) for _, r, x in sorted(v)] for c, v in talks.items()}
    return {c for c, v in talks.items() if not any(v == w[: len(v)] and (len(w) > len(v) or d < c) for d, w in talks.items() if d != c)}


def test_snapshots_collapse(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (3, 2, "user", "more"), (4, 0, "user", "hi"), (4, 1, "assistant", "other"), (5, 0, "user", "alone"), (6, 0, "user", "alone"), (6, 0, "user", "alone"), (7, 3, None, None), (7, None, "user", ""), (None, 0, "user", "lost"), (8, 0, "assistant", "hi")]
    rows += [(9, k, "user", str(k % 5)) for k in range(600)] + [(10, k, "user", str(k % 5)) for k in range(300)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, part string")
    turns = chat.turns(table)
    got = chat.render(turns, chat.maximal(turns)).collect()
    assert {r.conv_id for r in got} == brute(rows)
    assert all(r.part == 0 for r in got) and len({r.conv_id for r in got}) == len(got)
    long = next(r.text for r in got if r.conv_id == 9)
    pieces = sorted((r.part, r.text) for r in chat.render(turns, chat.maximal(turns), whole=2000).collect() if r.conv_id == 9)
    assert len(pieces) > 1 and "".join(t for _, t in pieces) == long
    assert next(r.text for r in got if r.conv_id == 4) == "<|user|>\nhi\n<|end|>\n<|assistant|>\nother\n<|end|>\n"
    assert next(r.n_same for r in got if r.conv_id == 5) == 2
    none = chat.turns(table.limit(0))
    assert chat.render(none, chat.maximal(none)).count() == 0


def test_reading_tasks_follow_the_ranges(spark, tmp_path):
    rng = np.random.default_rng(2)
    pages = spark.createDataFrame([(k, f"http://x/{k}", rng.bytes(3000).hex()) for k in range(40)] + [(40, None, "x" * 5_000_000), (41, None, rng.bytes(1_500_000).hex())], "page_id long, url string, html string").repartition(2)
    files = warc.write(warc.plan(pages), f"file://{tmp_path}/w").cache()
    n = sum(-(-r["size"] // 20_000) for r in files.collect())
    read = warc.read(files, f"file://{tmp_path}/w", range_bytes=20_000)
    assert n > 50 and read.rdd.getNumPartitions() == n
    want = {r.page_id: r.html.encode() for r in pages.collect()}
    assert {r.page_id: bytes(r.payload) for r in read.collect()} == want


P = "The council met on Tuesday to discuss the new bridge over the river. Members said the work would take two years. Costs have risen since the plan was first drawn up."
Q = "Residents who live near the old crossing told reporters that they had waited long enough. The mayor promised a full report before the end of the month."
ARTICLE = f"<h1>Bridge plan</h1><p>{P}</p><p>{Q}</p>"
#: Pages of other makes than the training layouts, most with names that mislead.
ORDINARY = [
    f'<html><body class="has-sidebar has-footer nav-open"><nav><ul><li><a>Home</a></li><li><a>About</a></li></ul></nav><div id="primary">{ARTICLE}</div><footer>Copyright us</footer></body></html>',
    f'<html><body><article class="share-story">{ARTICLE}</article><div class="related"><a>Other</a></div></body></html>',
    f"<html><body><div><div><a href=/>Home</a> <a href=/w>World</a> <a href=/s>Sport</a></div><div><h1>Bridge plan</h1><div>{P}</div><div>{Q}</div></div><div>Contact us | Terms</div></div></body></html>",
    f"<html><body><table><tr><td><a>Home</a><br><a>News</a><br><a>Sport</a></td><td>{ARTICLE}</td></tr></table></body></html>",
    f'<html><body class="single wp-custom-logo header-fixed"><header id="masthead"><a>My Blog</a></header><div id="content" class="site-content has-sidebar"><div class="content-area"><main id="main"><article class="post hentry">{ARTICLE}</article><div id="comments" class="comments-area"><h2>2 thoughts</h2><ol class="comment-list"><li>Nice text, thank you for it.</li></ol></div></main></div><aside id="secondary" class="widget-area"><h2>Recent Posts</h2><ul><li><a>One</a></li></ul></aside></div><footer class="site-footer">Powered by x</footer></body></html>',
    f'<html><body><header><h2>Daily</h2></header><section class="story-wrap sidebar-right">{ARTICLE}</section><div class="cookie-banner"><p>We use cookies.</p></div></body></html>',
]


def test_ordinary_pages_repeats_and_malformed_ones(spark):
    filler = [(k, "http://x", f"<p>{P} {Q} Item {k} was sold in the town.</p><p>Another thing that happened on day {k}, as people say.</p>") for k in range(60)]
    model = html.fit(spark.createDataFrame(filler, "page_id long, url string, html string"))
    broken = "</b></i>" * 60_000 + "<div class=x>" * 20_000 + "<p>text " * 20_000
    pages = spark.createDataFrame([*enumerate([*ORDINARY, ORDINARY[0], broken, None])], "page_id long, html string").withColumn("url", F.lit("u")).repartition(1)
    pages = pages.unionByName(pages.where("page_id = 1"))
    began = time.time()
    got = [(r.page_id, r.text) for r in html.extract(pages, model).collect()]
    assert time.time() - began < 30
    assert [t for k, t in got if k <= len(ORDINARY)] == [f"Bridge plan\n{P}\n{Q}"] * (len(ORDINARY) + 2)
    assert dict(got)[len(ORDINARY) + 2] == ""
    assert html.extract(pages.limit(0), model).count() == 0
