import html
import random
import re
import time

from hypothesis import given
from hypothesis import strategies as st

from galena.llm import html_main as H


LONG = "a sentence that is long enough to be most of what the page says, and then some more of it, up to here"


def page(i, body, nav="Home", extra=""):
    return f'<!DOCTYPE html><html><head><title>T{i}</title><style>p{{a:b}}</style><script>var x="</p><article>";</script></head><body><div id="top-menu"><a href="/">{nav}</a></div><div class="story"><p class="promo-line">Follow us &amp; read</p>{body}<p>Written by the desk</p></div><div class="cookie-notice">We use cookies</div><section class="comments"><p>First!</p></section>{extra}<footer>&copy; {i}</footer></body></html>'


def test_wrapper_takes_constant_nodes_out_and_varying_ones_in():
    pages = [page(i, f"<h2>Head {i}</h2><p>Body {i} one, {LONG}.</p><p>Body {i}<br>two &lt;b&gt;.</p>") for i in range(6)]
    w = H.induce(pages)
    assert H.extract(pages[2], w) == f"Head 2\n\nBody 2 one, {LONG}.\n\nBody 2 two <b>."
    assert "Written by the desk" in H.extract(pages[2], None)
    assert H.extract(page(9, f"<p>Only\n  this and {LONG}</p>"), w) == f"Only this and {LONG}"


def test_copies_within_a_host_keep_what_they_share():
    shared = "".join(f"<p>Paragraph {k} that all copies share.</p>" for k in range(9))
    pages = [page(i, f"{shared}<p>Edit {i}</p>") for i in range(6)]
    assert "Paragraph 3" in H.extract(pages[1], H.induce(pages)) and "Edit 1" in H.extract(pages[1], H.induce(pages))


def test_pages_of_which_all_is_template_keep_their_text():
    pages = [page(i, "<p>The same</p>") for i in range(5)]
    assert "The same" in H.extract(pages[0], H.induce(pages))
    assert H.induce(pages[:1] * 9) is None


def test_unclosed_elements_and_odd_markup():
    src = "<article><h1>A</h1><p><b>one<br><p>two<ul><li>x<li>y</ul><table><tr><td>1<td>2<tr><td>3</table><p>last<!-- <p>no --> &#233;&nbsp;&eacute; a < b</article><p>out"
    assert H.extract(src, None).split("\n\n") == ["A", "one", "two", "x", "y", "1", "2", "3", "last é é a < b"]
    assert H.extract("plain words", None) == "plain words"
    assert H.extract("<div>" * 5000 + "deep" + "</div>" * 5000, None) == "deep"
    assert H.extract("<article><script>never closed <p>x", None) == ""
    assert H.extract('<p title="a>b">t</p>', None) == "t"


def test_many_siblings_align():
    src = "<article>" + "".join(f"<p>p{i}</p><h2>h{i}</h2>" for i in range(1500)) + "</article>"
    w = H.induce([src, src.replace("p1<", "q1<"), src.replace("p2<", "q2<")])
    assert "q9" in H.extract(src.replace("p9<", "q9<"), w)


def test_all_articles_and_what_varies_beside_them_are_content():
    def two(i):
        return f"<body><div><p>Site slogan</p></div><article><p>First {i} {LONG}</p></article><article><p>Second {i}</p></article><div><p>Beside {i}</p></div><nav>n{i}</nav></body>"

    want = f"First 3 {LONG}\n\nSecond 3"
    assert H.extract(two(3), H.induce([two(i) for i in range(6)])) == want + "\n\nBeside 3"
    assert H.extract(two(3), None) == want


def test_a_short_article_does_not_replace_the_main_element():
    def long(i):
        return f"<body><main><h1>Head {i}</h1><p>Text {i} {LONG}</p><article><p>Teaser {i}</p></article><p>More {i} {LONG}</p></main><p>Imprint</p></body>"

    want = f"Head 3\n\nText 3 {LONG}\n\nTeaser 3\n\nMore 3 {LONG}"
    assert H.extract(long(3), H.induce([long(i) for i in range(6)])) == H.extract(long(3), None) == want


def test_states_of_elements_are_no_asides():
    for outer in ('<body class="no-sidebar">', '<body class="header">', '<div id="page" class="header-fixed">', '<article class="post has-comments">', '<main class="with-sidebar">', '<div class="content ad-free">', '<article class="header-large">', '<div class="banner-layout">', '<div class="sidebar-two"><h1></h1>'):
        pages = [f"{outer}<p>Text {i} {LONG}</p><div class='comment-list'><article class='comment-body'>Reply {i}</article></div><p class='ad'>Buy {i}</p>" for i in range(5)]
        assert H.extract(pages[1], H.induce(pages)) == H.extract(pages[1], None) == f"Text 1 {LONG}"
    assert H.extract('<p>Text</p><div class="cookie-notice">c</div><div class="sidebar">s</div><article class="related">r</article>', None) == "Text"


def test_self_closed_drawings_end_at_their_tag():
    assert H.extract('<article><svg class="x" /><p>One</p><math a="b>"/><p>Two</p><svg><path d="/"/>drawn</svg><p>Three</p><svg/></article>', None) == "One\n\nTwo\n\nThree"
    assert H.extract("<article><p>One</p><svg><path/></article>", None) == "One"


def test_asides_do_not_swallow_the_page():
    for outer in ('<body class="has-sidebar single-post">%s</body>', '<body class="with-nav">%s</body>', '<div class="page header-fixed">%s</div>', '<form id="aspnetForm">%s</form>', "<form>%s<input></form>"):
        for inner in ("<article>%s</article>", "<main>%s</main>", '<div class="content">%s</div>'):
            src = outer % (inner % f'<p class="lead promo">Text {LONG}</p><aside>a<nav>n<p>in</p></nav></aside><p class="ad">Buy</p><form><p>Search</p></form>')
            assert H.extract(src, None) == f"Text {LONG}"


def test_markup_that_never_ends_takes_linear_time():
    for part in ("<a x=", '<a x="', "<p class='a\">", "<!--", "</x", "<svg ", '<p class="', "<script>", "<![x", "<a title='>\""):
        took = []
        for n in (20_000, 160_000):
            began = time.perf_counter()
            H.parse(part * n)
            took.append(time.perf_counter() - began)
        assert took[1] < 24 * took[0] + 0.2
    began = time.perf_counter()
    H.parse("<a x=" * 200_000)
    assert time.perf_counter() - began < 1


def test_hosts_of_one_and_two_pages(spark):
    def at(i):
        return f"<body><div><p>Site slogan</p></div><article><h1>Head {i}</h1><p>Text {i} {LONG}</p><p>Imprint</p></article><div class='ad'>x{i}</div></body>"

    rows = [(1, "http://one/", at(1)), (2, "http://two/a", at(2)), (3, "http://two/b", at(3)), (4, "http://two/c", at(3))]
    got = {r["page_id"]: r["text"] for r in H.query(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == f"Head 1\n\nText 1 {LONG}\n\nImprint"
    assert all(got[i] == f"Head {min(i, 3)}\n\nText {min(i, 3)} {LONG}" for i in (2, 3, 4))


def test_each_layout_of_a_host_has_its_template(spark):
    def at(i):
        name = ("blog", "shop", "forum", "wiki")[i % 4]
        return f"<body><div class='{name}-page'><p>Welcome to the {name}</p><article><h1>Head {i}</h1><p>Text {i} {LONG}</p><p>Imprint of the {name}</p></article></div></body>"

    rows = [(i, "http://h/", at(i)) for i in range(80)] + [(99, "http://h/", "<body><section><p>Lone page</p></section></body>")]
    got = {r["page_id"]: r["text"] for r in H.query(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Head {i}\n\nText {i} {LONG}" for i in range(80)) and got[99] == "Lone page"


@given(st.text(st.sampled_from("<>/!-pdivarticle \"'=&;x"), max_size=80))
def test_any_markup_parses(src):
    text = H.extract(src, None)
    assert text == text.strip() and not re.search(r"[ \t]{2}", text)


def simple(src):
    """The article of the driver's pages, whose layout is known."""
    body = src[src.index("<h1>") : src.index("</article>")]
    parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", body)]
    return "\n\n".join(x for x in parts if x)


def test_driver_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r["page_id"]: simple(r["html"]) for r in pages.collect()}
    got = H.query(pages).collect()
    assert {r["page_id"]: r["text"] for r in got} == want and all(r["n_chars"] == len(r["text"]) for r in got)


def test_rows(spark):
    rng = random.Random(1)
    rows = [(i, f"http://h/{i}", page(i, f"<p>Text {rng.random()} {LONG}</p>")) for i in range(9)]
    rows += [(20, None, "<p>no url</p>"), (21, "http://h/x", None), (22, "http://h/y", ""), (None, "http://h/z", page(5, f"<p>no id {LONG}</p>")), (3, *rows[3][1:]), (30, "http://other/", "<p>" + "long " * 300_000 + "</p>")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in H.query(df).collect()}
    assert H.query(df).count() == len(rows) and got[21]["text"] == got[22]["text"] == "" and got[22]["n_chars"] == 0
    assert got[20]["text"] == "no url" and got[None]["text"] == f"no id {LONG}" and got[30]["n_chars"] == 1_499_999 and got[4]["text"].startswith("Text 0.")
    assert H.query(df.where("false")).collect() == []


def test_template_is_counted_over_all_different_pages_of_a_host(spark):
    def at(i, often=""):
        return f"<body><article><h1>Head {i}</h1><p>Text {i} {LONG}</p>{often}<p>Imprint</p></article></body>"

    copies = [(i, "http://copies/", at(0)) for i in range(400)] + [(1000 + i, "http://copies/", at(i)) for i in range(1, 41)]
    often = [(2000 + i, "http://often/", at(i, "" if i % 5 == 0 else "<p>Often said</p>")) for i in range(60)]
    odd = [(3000 + i, "http://odd/", at(i) if i else "<p>Not found</p>") for i in range(60)]
    got = {r["page_id"]: r["text"] for r in H.query(spark.createDataFrame(copies + often + odd, "page_id long, url string, html string")).collect()}
    for i in range(1, 41):
        assert got[1000 + i] == got[3000 + i] == f"Head {i}\n\nText {i} {LONG}"
    assert all(got[2000 + i].endswith("Often said") == (i % 5 > 0) and "Imprint" not in got[2000 + i] for i in range(60))
    assert got[3000] == "Not found" and len(got) == 560


def test_a_passage_that_only_the_sample_shares_is_content(spark, monkeypatch):
    monkeypatch.setattr(H, "SAMPLE_PAGES", 3)
    rows = [(i, "http://h/", f"<article><p>Text {i} {LONG}</p>{'' if i % 10 == 0 else '<p>Often said</p>'}</article>") for i in range(40)]
    got = {r["page_id"]: r["text"] for r in H.query(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i].endswith("Often said") for i in range(40) if i % 10)
