import json
import random
import re

from framewell.llm import wrappers
from framewell.llm import wrappers as w

PAGE = """<!DOCTYPE html><html><head><title>no</title><script>var t="</p><article>no";</script><style>p{}</style></head><body class="has-sidebar">
<header><h1>no</h1></header><nav><ul><li><a href="/">no</a><li>no</ul></nav><div class="ad-box">no</div><!-- <article>no</article> --><div id="cookieNotice">no</div>
<article class="post"><header><h1>Title &amp; &eacute;</h1></header><p><b>Lead
   text.<br>More<p>One <i>t</i>wo <a href=x>link</a>.</p><ul><li>i1<li>i2</ul><form><label>no</label><input value="no"></form><p class="share">no</p>
<div class="comments"><article>no</article></div><p>End&nbsp;&#8212; 3 < 4</p></article><aside><p>no</p></aside><section class="related"><article><p>no</p></article></section><footer>no"""
TEXT = "Title & é Lead text. More One two link. i1 i2 End — 3 < 4"


def read(page, *more):
    wrapper = ()
    for k, p in enumerate([page, *more]):
        wrapper = w.align(wrapper, w.shape(p)) if k else w.shape(p)
    assert w.loads(w.dumps(wrapper)) == wrapper
    return w.extract(page, w.compiled(wrapper))


def test_article_without_its_surroundings():
    other = PAGE.replace("<ul><li>i1<li>i2</ul>", "<table><tr><td>a<td>b</table>").replace('<div class="ad-box">no</div>', "")
    for more in [(), (other,), (other, "", "plain text", PAGE)]:
        assert read(PAGE, *more) == TEXT
    assert read(other, PAGE) == TEXT.replace("i1 i2", "a b")


def test_pages_without_an_article():
    page = '<body><nav>no</nav><div><p>One text here.</p><p><a href="/">no</a></p></div><div class="footer">no</div></body>'
    assert read(page) == "One text here."
    assert read("plain &lt;text&gt;") == "plain <text>" and read("") == "" and read("<p") == "" and read("a < b") == "a < b"
    assert read("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    deep = "<div>" * 400 + "<nav>menu</nav><aside>more</aside><p>body</p><form>x</form><div class=footer>y</div>" + "</div>" * 400
    assert read(deep) == read(deep, deep.replace("body", "other")) == "body"
    assert read("<article>" + "<p>x</p>" * 50_000) == " ".join("x" * 50_000)


def test_inference_finds_groups_and_optionals():
    a, b = w.shape("<ul><li>a<li>b<li>c</ul><p>x</p>"), w.shape("<h2>t</h2><ul><li>a</ul><p>x</p>")
    got = w.align(a, b)
    assert got == (("e", "?", "h2", (("#", ""),)), ("e", "", "ul", (("e", "+", "li", (("#", ""),)),)), ("e", "", "p", (("#", ""),)))
    pairs = w.shape("<dl><dt>a<dd>b<dt>a<dd>b<dt>a<dd>b</dl>")
    assert pairs == (("e", "", "dl", (("g", "+", (("e", "", "dt", (("#", ""),)), ("e", "", "dd", (("#", ""),)))),)),)
    long = w._common([("#",)] * 400 + [("e", "p")], [("#",)] * 399 + [("e", "p")])
    assert all(i < j for (i, _), (j, _) in zip(long, long[1:])) and len(long) >= 399


def test_common_runs_are_longest_at_any_length(monkeypatch):
    for bits in (1 << 28, 50, 1):
        monkeypatch.setattr(w, "TABLE_BITS", bits)
        for seed in range(60):
            rng = random.Random(seed)
            a, b = (rng.choices("abcd", k=rng.randint(0, 25)) for _ in range(2))
            best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for i in range(len(a)):
                for j in range(len(b)):
                    best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
            got = w._common(a, b)
            assert len(got) == best[-1][-1] and all(a[i] == b[j] for i, j in got)
            assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))


def test_parts_of_a_host_are_merged_in_steps(spark, monkeypatch):
    monkeypatch.setattr(w, "PART", 3)
    monkeypatch.setattr(w, "MERGED", 2)
    pages = [(k, "http://big/" if k % 3 else "http://small/", f"<body>{'<p>a</p><h2>b</h2>' * (k % 7)}<div class=c{k % 50}x{'y' * (k % 40)}>x</div></body>") for k in range(200)]
    got = {r.host: w.loads(r.shape) for r in w.wrappers(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert set(got) == {"big", "small"}
    for _, url, html in pages:  # every page follows its host's wrapper: aligning it again adds nothing
        wrapper = got[w.host_of(url)]
        assert {x for x in json.dumps(w.align(wrapper, w.shape(html))).split('"')} == {x for x in json.dumps(wrapper).split('"')}


def test_slots_do_not_depend_on_the_order(spark):
    random.seed(8)
    parts = ["<p>a</p>", "<h2>b</h2>", '<div class="ad">no</div>', "<ul><li>c</ul>", "<nav>no</nav>", "<blockquote><p>d</p></blockquote>", "x <a href=/>y</a> z"]
    pages = ["<html><body>" + "".join(random.choices(parts, k=3)) + "<article>" + "".join(random.choices(parts, k=6)) + "</article></body>" for _ in range(60)]
    want = [w.extract(p, w.compiled(w.shape(p))) for p in pages]
    rows = [(k, "https://A.example/x" if k % 2 else "http://b.example:80/", p, "t", 0) for k, p in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, host int").repartition(5)
    for limit in (w.BROADCAST_CHARS, 0):
        w.BROADCAST_CHARS, saved = limit, w.BROADCAST_CHARS
        got = {r.page_id: r.text for r in w.main_text(df).collect()}
        w.BROADCAST_CHARS = saved
        assert [got[k] for k in range(60)] == want
    shapes = {r.host: json.loads(r.shape) for r in w.wrappers(df).collect()}
    assert set(shapes) == {"a.example", "b.example"}


def test_odd_rows(spark):
    rows = [(1, None, PAGE), (None, "x", PAGE), (2, "http://[bad", None), (3, "http://a/", ""), (3, "http://a/", "")]
    got = w.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(((r.page_id, r.url, r.text, r.n_chars) for r in got), key=repr) == sorted(((i, u, TEXT if h else "", len(TEXT) if h else 0) for i, u, h in rows), key=repr)
    assert w.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = w.op9_html_extraction(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        body = pages[r.page_id].html.split("<article>", 1)[1].split("</article>")[0]
        assert r.text == " ".join(w.html_lib.unescape(re.sub(r"<[^>]*>", " ", body)).split()) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_template_texts_are_told_by_the_host_s_pages(spark):
    words = "ash birch cedar elm fir hazel larch maple oak pine rowan yew".split()

    def page(k, article):
        own = " ".join(words[(k * 7 + i * i + k // 3) % 12] for i in range(9)) + f" {k}"
        more = "<h2>Offer</h2>" if k % 2 else ""
        named = ("<article>", "<p>Written for you.</p></article>") if article else ("<div>", "</div>")
        return own, f"<body><div>All our trees</div>{more}{named[0]}<p>{own}</p>{named[1]}<div>Call 555 now</div></body>"

    hosts = {"plain": lambda k: page(k, False), "named": lambda k: page(k, True), "form": lambda k: (page(k, False)[0], "<form>" + page(k, False)[1] + "</form>")}
    rows = [(k, f"http://{h}/{k}", make(k)[1]) for h, make in hosts.items() for k in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    for limit in (w.BROADCAST_CHARS, 0):
        w.BROADCAST_CHARS, saved = limit, w.BROADCAST_CHARS
        got = {r.url: r.text for r in w.main_text(df).collect()}
        w.BROADCAST_CHARS = saved
        # what every named article bears is part of it
        assert got == {f"http://{h}/{k}": make(k)[0] + (" Written for you." if h == "named" else "") for h, make in hosts.items() for k in range(12)}
    assert all(w.extract(html, w.compiled(())) != got[url] for _, url, html in rows if "named" not in url)


def test_articles_that_a_host_repeats_are_kept(spark):
    """Near-copied pages of one host, a byline on all of them, and a counter outside that changes."""
    page = "<html><body><div class='views'><p>Viewed {} times</p></div><article><h1>One title</h1><p class='by'>By Ann Author</p><p>The whole text stands here on every page.</p><p>Its second part does too.</p></article></body></html>"
    rows = [(k, f"http://mirror.example/{k}", page.format(k * 7)) for k in range(12)]
    got = {r.text for r in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {"One title By Ann Author The whole text stands here on every page. Its second part does too."}


def test_odd_markup_takes_time_in_proportion(spark):
    import time

    pages = ["<a href=x>" * 5000 + "end", "<b>" * 150_000 + "</i>" * 150_000 + "end", "<![CDATA[ x" * 90_000 + "end", "<div class=a><nav>" * 3000 + "end", "<ul><li>" * 20_000 + "end", "<p>" * 100_000 + "</div>" * 100_000]
    start = time.time()
    for page in pages:
        assert wrappers.loads(wrappers.dumps(wrappers.shape(page))) == wrappers.shape(page)
        for _, _ in wrappers.events(page):
            pass
    assert time.time() - start < 60
    rows = [(k, "http://odd.example/", p) for k, p in enumerate(pages)] + [(99, "http://odd.example/", "<article>" + "<a href=x>" * 3000 + "words</article>")]
    got = {r.page_id: r.text for r in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[99] == "words" and len(got) == 7
