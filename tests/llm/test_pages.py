import base64
import collections
import hashlib
import html as H
import io
import re
import time
import zlib

import numpy as np
import pytest
import zstandard

from tokenloom.llm import html, urls, warc

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><p>Site name here</p></header>
<div id="main-menu"><a href="/">Home</a></div><div class="cookie-notice">We use cookies a lot of them</div>
<div class="content"><article><h1>Head &amp; line</h1><p>First  para
graph &eacute;t&#233;.<p>Second <b>para</b>graph long enough to count as the running text of the page.
<script>var x = "<p>no</p>";</script><form><p>Sign up</p></form><ul><li>one<li>two</ul></article>
<div class="comments"><p>First reader comment that is long enough to look like running text, indeed very long.</p></div></div>
<aside>Side bar text</aside><footer>Foot</footer></body></html>"""


def test_article_only():
    blocks, nodes = html.read_page(PAGE)
    best = html.best_container(blocks, nodes)
    assert html.container_text(blocks, {id(best)}) == (
        "Head & line\nFirst para graph été.\nSecond paragraph long enough to count as the running text of the page.\none\ntwo")


def test_pages_table(pages):
    got = {r.page_id: r for r in html.op1(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = (" ".join(H.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)\b[^>]*>", body))
        want = "\n".join(x for x in parts if x)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


def test_consensus_overrules_a_page(spark):
    """A page whose own best container is a teaser follows its host's vote."""
    long = "running text of an ordinary article that goes on for quite a while " * 4
    rows = [(i, "http://h.x/a", f"<body><div class='c1'><p>{long}</p></div><div class='c2'><p>short</p></div></body>") for i in range(5)]
    rows.append((9, "http://h.x/b", f"<body><div class='c1'><p>tiny</p></div><div class='c2'><p>{long}</p></div></body>"))
    got = {r.page_id: r.text for r in html.op1(spark.createDataFrame(
        [(a, b, c.replace("c1", "story").replace("c2", "teaser")) for a, b, c in rows],
        "page_id long, url string, html string")).collect()}
    assert got[9] == "tiny"


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "x", ""), (3, "http://a/", "plain text only"), (4, "http://a/", "<p>open <b>tags"),
            (5, "http://a/", "<div><" + "a " * 5000 + "\"unclosed"), (5, "http://a/", "<!-- never closed"), (None, "http://b/", "<p>x</p>")]
    df = spark.createDataFrame([(*r, "path", 1) for r in rows], "page_id long, url string, html string, path string, host int")
    got = {(r.page_id, r.text[:10]) for r in html.op1(df).collect()}
    assert {(1, ""), (2, ""), (3, "plain text"), (4, "open tags"), (5, ""), (None, "x")} <= got
    assert html.op1(df.where("false")).count() == 0
    w = warc.op5(df).collect()
    assert len(w) == 7
    u = urls.op10(df).collect()
    assert {(r.host, r.path) for r in u if r.page_id in (1, 2)} == {("", "")} and all(r.verdict in ("allow", "block") for r in u)
    assert urls.op10(df.where("false")).count() == 0 and warc.op5(df.where("false")).count() == 0


def test_warc_round_trip(spark, pages, tmp_path):
    doubled = pages.unionByName(pages.selectExpr("page_id + 100000 as page_id", "url", "html"))
    bundles = warc.write_bundles(doubled).cache()
    got = {r.page_id: r for r in warc.read_bundles(bundles).collect()}
    first = {}
    for r in sorted(doubled.collect(), key=lambda r: r.page_id):
        raw = r.html.encode()
        g = got[r.page_id]
        owner = first.setdefault(raw, r.page_id)
        assert g.payload_bytes == len(raw)
        assert g.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert (g.record_type, g.refers_to) == (("response", None) if owner == r.page_id else ("revisit", owner))
        assert g.record_type == "revisit" or bytes(g.payload) == raw
    some = sorted(got)[3:9]
    assert sorted(r.page_id for r in warc.lookup(bundles, some).collect()) == some
    paths = [r.path for r in warc.export_bundles(bundles, str(tmp_path)).collect()]
    data = b""
    for p in paths:      # any zstd reader reads the file front to back
        with open(p, "rb") as f:
            data += zstandard.ZstdDecompressor().stream_reader(io.BytesIO(f.read()), read_across_frames=True).read()
    assert data.count(b"WARC/1.1\r\n") == len(got)
    large = {r.record_type for r in warc.read_bundles(warc.write_bundles(doubled, 10 ** 9)).collect()}
    assert large == {"response"}


def test_url_parts_and_rules(spark):
    rows = [(1, "HTTP://Sub.Example.NET/en/1?q#f"), (2, "http://example.com/de/x"), (3, "http://a.org/fr/"), (4, "http://net"),
            (5, "http://x.net?a=/en/"), (6, "http://EXAMPLE.net/fr/1"), (7, "noscheme/en/"), (8, None), (9, "http://notexample.com/de/")]
    got = {r.page_id: r for r in urls.op10(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("sub.example.net", "/en/1", "example.net/en/", "allow")
    assert (got[2].rule, got[2].verdict) == ("example.com/de/", "block")
    assert (got[3].rule, got[3].verdict) == ("org/fr/", "allow")
    assert (got[4].host, got[4].path, got[4].rule) == ("net", "", None)
    assert (got[5].host, got[5].path, got[5].rule) == ("x.net", "", None)
    assert (got[6].rule, got[6].verdict) == ("net/", "block")
    assert (got[7].host, got[7].path) == ("", "") and got[8].host == "" and got[9].rule is None


def test_language_models_separate(spark):
    good = [(i, f"http://news{i % 7}.org/fr/article-{i}.html") for i in range(200)]
    bad = [(1000 + i, f"http://x{i}.net/click?id={i}&promo=win") for i in range(200)]
    rest = [(2000, "http://news9.info/article-77.html"), (2001, "http://x9.info/click?id=5&promo=win")]
    got = {r.page_id: r for r in urls.op10(spark.createDataFrame(good + bad + rest, "page_id long, url string")).collect()}
    assert got[2000].verdict == "allow" and got[2001].verdict == "block"


def test_language_models_count_exactly(spark):
    """More distinct n-grams than any fixed table of counters: differences equal plain counting."""
    rng = np.random.default_rng(3)
    text = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz0123456789"), 40))
    rows = [(i, ("http://example.net/en/" if i % 2 else "http://net/de/") + text()) for i in range(5000)]
    free = [(9000 + i, f"http://other.com/{rows[i][1][-30:]}") for i in range(20)]
    got = {r.page_id: r.difference for r in urls.op10(spark.createDataFrame(rows + free, "page_id long, url string")).collect()}
    counts = [collections.Counter(), collections.Counter()]
    grams = lambda u: [(k, ("^" * 5 + u)[n + 5 - k:n + 5], c) for n, c in enumerate(u) for k in range(6)]
    for i, u in rows:
        if zlib.crc32(u.encode()) % 5:
            for k, before, c in grams(u[7:]):
                counts[i % 2][k, before, c] += 1
                counts[i % 2][k, before] += 1
    for i, u in free:
        total = 0.0
        for label, sign in ((1, 1), (0, -1)):
            for k, before, c in grams(u[7:]):
                p = 1 / 256 if k == 0 else p
                p = (counts[label][k, before, c] + 3 * p) / (counts[label][k, before] + 3)
                total += sign * np.log(p) if k == 5 else 0
        assert abs(got[i] - total / len(u[7:])) < 1e-9


ARTICLE = "<h1>Title</h1>" + "".join(
    f"<p>Paragraph number {i} of running text that goes on for a while, as articles do.</p>" for i in range(8))
COMMENTS = "<div class='comments'>" + "<p>A reader's comment, long enough to count as running text by any rule.</p>" * 30 + "</div>"


def main_text(page):
    blocks, nodes = html.read_page(page)
    best = html.best_container(blocks, nodes)
    return html.container_text(blocks, {id(n) for n in nodes if n.key == best.key}) if best else ""


@pytest.mark.parametrize("wrapper", [
    "<div class='content has-sidebar'>%s</div>", "<div class='entry no-comments'>%s</div>",
    "<article class='post comments-open'>%s</article>", "<div id='main' class='share-enabled'>%s</div>",
    "<div class='sidebar-page'>%s</div>", "<div class='promo'><div class='widget'>%s</div></div>"])
def test_class_words_don_t_drop_the_article(wrapper):
    got = main_text(f"<body><nav>menu</nav>{wrapper % ARTICLE}{COMMENTS}<div class='ad'>Buy</div></body>")
    assert got.split("\n")[0] == "Title" and got.count("Paragraph") == 8 and "comment" not in got and "Buy" not in got


def test_furniture_without_content_elsewhere():
    """A longer advert beside a short article, comments alone, furniture inside a line, hidden text, labels."""
    advert = "<div class='ad'>" + "Long advert text that never seems to end. " * 9 + "</div>"
    assert main_text(f"<body>{advert}<article><h1>Short.</h1></article></body>") == "Short."
    assert main_text(f"<body>{COMMENTS}</body>") == ""
    assert main_text("<body><p>We <span class='search-term'>found</span> it.<span class='ad'><span>x</span>BUY</span> ok</p>"
                     "<label>Name</label><div style='display: none'>hid</div></body>") == "We found it. ok"


@pytest.mark.parametrize("piece", ["<a ", "x <b \"", "<b \">\" ", "<div>some text ", "<div></p>", "<li class=ad>x", "<!-- ",
                                   "</script <script>", "<span class='ad'>x", "<div class='ad has'><p>x"])
def test_broken_markup_is_linear(piece):
    def seconds(n):
        start = time.perf_counter()
        main_text(piece * (n // len(piece)))
        return time.perf_counter() - start
    assert seconds(1 << 20) < 10 and seconds(1 << 20) < 12 * seconds(1 << 18) + 0.5
