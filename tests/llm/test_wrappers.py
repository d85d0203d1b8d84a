import html as H
import re

from paths import SF_SMALL

from gatelens.llm import wrappers
from gatelens.sources.tables import table


def texts(df):
    return {r["page_id"]: r["text"] for r in df.collect()}


def article(page):
    """What stands in the article of the synthetic pages."""
    m = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)
    parts = (" ".join(H.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", m[1] if m else ""))
    return "\n".join(x for x in parts if x)


def test_small_table(spark):
    pages = table(spark, SF_SMALL, "pages")
    rows = {r["page_id"]: r["html"] for r in pages.collect()}
    assert texts(wrappers.extract_articles(pages)) == {i: article(h) for i, h in rows.items()}


PAGE = """<html><head><title>T{n}</title><script>if (a < b) {{ x("</p>") }}</script></head><body class="home">
<header><h1>Site</h1></header><ul class="main-menu"><li>Home<li>About</ul><div class="cookie-notice"><p>We use cookies</div>
<{tag}><h2>Head {n}</h2><p>First &amp; <b>bold</b>&#233; {n}<p>Second
  line<br>more {n}<ul><li>one<li>two</ul><form><input name=q>search</form><!-- no > --></{end}>
<div id="sidebar"><p>Links {n}</div><section class="comments"><p>Reader {n}</section><footer>&copy; {n}</footer>"""
WANT = "Head {n}\nFirst & boldé {n}\nSecond line more {n}\none\ntwo"


def test_landmarks_names_and_plain_containers(spark):
    rows = []
    for h, (tag, end) in enumerate([("article", "article"), ("main", "main"), ('div class="post-content"', "div"), ("div", "div")]):
        rows += [(h * 100 + n, f"http://h{h}.org/{n}", PAGE.format(n=n, tag=tag, end=end)) for n in range(5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = texts(wrappers.extract_articles(pages))
    assert got == {i: WANT.format(n=i % 100) for i, _, _ in rows}


def test_wrapper_has_optional_and_repeated_groups():
    pages = ["<body><p>a<p>b<div class=x>same</div></body>", "<body><h1>t</h1><p>c<div class=x>same</div></body>", "<body><p>d<p>e<p>f</body>"]
    w = wrappers.page_wrapper(pages[0])
    for p in pages[1:]:
        w = wrappers.add_pages(w, wrappers.page_wrapper(p))
    text = wrappers.expression(w)
    assert re.fullmatch(r"<body>\(<h1>\[\w+\]</h1>\)\?\(<p>#</p>\)\+\(<div\.x>\[\w+\]</div>\)\?</body>", text), text


def test_odd_pages(spark):
    deep = "<div>" * 300 + "deep" + "</div>" * 300
    rows = [(1, None, None), (2, "x", ""), (3, "http://a.org/", "just text &am"), (4, "http://b.org/", deep), (4, "http://b.org/", deep),
            (None, "http://c.org/", "<article>x</article><article>y"), (6, "http://d.org/", "<p>a < b <c d=\"e>f"), (7, "http://e.org/", "<article>" + "<p>w" * 30_000)]
    pages = spark.createDataFrame([r + ("z",) for r in rows], "page_id long, url string, html string, host string")
    got = sorted((r["page_id"] or 0, r["url"] or "", r["text"], r["n_chars"]) for r in wrappers.extract_articles(pages).collect())
    want = {1: "", 2: "", 3: "just text &am", 4: "deep", 0: "x\ny", 6: "a < b", 7: "\n".join(["w"] * 30_000)}
    assert [(i, t) for i, _, t, _ in got] == sorted((r[0] or 0, want[r[0] or 0]) for r in rows)
    assert all(n == len(t) for _, _, t, n in got)
    assert wrappers.extract_articles(pages.limit(0)).count() == 0


def read(pages):
    w = wrappers.page_wrapper(pages[0])
    for p in pages[1:]:
        w = wrappers.add_pages(w, wrappers.page_wrapper(p))
    first, other = wrappers.content_paths(w)
    return [wrappers.extract(p, frozenset(first)) or wrappers.extract(p, frozenset(other)) for p in pages]


def test_names_that_only_hold_an_aside_word():
    for attributes in ('class="page overflow-hidden"', 'class="content no-sidebar"', 'class="has-sidebar"', 'class="float-none"',
                       'class="wrap hidden md:block"', 'id="page" class="layout sidebar"', 'title="a hidden gem"', 'data-x="1" class="content-header"'):
        for tag in ("article", "main", "div"):
            page = f'<body><div {attributes}><{tag}><h1>Head {{n}}</h1><p>Text {{n}}</{tag}></div><div class="sidebar"><p>Links {{n}}</div></body>'
            assert read([page.format(n=n) for n in range(4)]) == [f"Head {n}\nText {n}" for n in range(4)], (attributes, tag)


def test_asides_stay_asides():
    for attributes in ('class="main-menu"', 'id="left-sidebar"', 'class="comments-area"', 'class="ad-slot-3"', 'class="post-navigation"',
                       'hidden', 'class="x" hidden', 'style="color: red; display : none"', 'aria-hidden="true"', 'class="related posts"'):
        page = f'<body><div class="page"><h1>Head {{n}}</h1><p>Text {{n}}</div><div {attributes}><p>Other {{n}}<p>Other</div></body>'
        assert read([page.format(n=n) for n in range(4)]) == [f"Head {n}\nText {n}" for n in range(4)], attributes
    page = '<body><article><p>Text {n}</article><div id="comments"><article><p>Reader {n}</article></div></body>'
    assert read([page.format(n=n) for n in range(4)]) == [f"Text {n}" for n in range(4)]


def test_names_of_single_pages_do_not_grow_the_wrapper(spark):
    """Slugs as ids and classes: the wrapper of 300 pages is no larger than that of 100, and the texts are whole."""
    def slug(n):
        return "".join(chr(97 + int(d)) for d in str(n))
    page = """<body class="page post-{s}"><nav id="menu-{s}"><p>Menu</nav><div class="text {s}"><h2 id="how-to-{s}">Head {n}</h2><p class="tag-{s} x">First {n}
<h3 id="why-{s}">Why {n}</h3><p>Second {n}</div><div class="comments for-{s}"><p>Reader {n}</div></body>"""
    sizes = []
    for number in (100, 300):
        rows = [(n, f"http://a.org/{n}", page.format(n=n, s=slug(n))) for n in range(number)]
        pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
        sizes.append(len(wrappers.infer_wrappers(pages).first()["wrapper"]))
        if number == 100:
            assert texts(wrappers.extract_articles(pages)) == {n: f"Head {n}\nFirst {n}\nWhy {n}\nSecond {n}" for n in range(number)}
    assert sizes[0] == sizes[1]
