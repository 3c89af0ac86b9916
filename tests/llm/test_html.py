"""HTML extraction: fixed pages with known main text."""

import html
import re
import time

from vigil.llm.html_extract import blocks_of, extract_text, host_of

NAV = "<nav><ul><li><a href='/'>Home</a></li></ul></nav>"


def page(body, head="<title>t</title><script>var a='<p>no</p>';</script><style>p{}</style>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


CASES = [
    (page(NAV + "<article><h1>Title &amp; more</h1><p>One  two\n three<br>four<p><b>five</b> six</p></article><footer>foot</footer>"),
     "Title & more\nOne two three four\nfive six"),
    (page("<div class='ad'>buy</div><main><header><h2>In</h2></header><p>a &lt; b&nbsp;c &#233;</p><aside>x</aside>"
          "<ul><li>u<li>v</ul><form>f<button>go</button></form><section class='comments'><p>c</p></section></main>"),
     "In\na < b c é\nu\nv"),
    (page("<article><p>text</p><article class=\"comment\"><p>reader</p></article></article>"), "text"),
    (page("<header>site</header><p>plain page</p><table><tr><td>1<td>2<tr><td>3</table><!-- no --><p hidden>h</p>"),
     "plain page\n1\n2\n3"),
    ("just text <b>bold</b>, a < b", "just text bold, a < b"), ("", ""), (None, ""), ("<p>", ""), ("<article", "<article"),
]


def test_pages(spark):
    rows = [(k, f"http://h{k}.example/", h) for k, (h, _) in enumerate(CASES)]
    got = {r.page_id: (r.text, r.n_chars) for r in extract_text(
        spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: (t, len(t)) for k, (_, t) in enumerate(CASES)}


def test_template_blocks_go_and_articles_stay(spark):
    rows = []
    for k in range(8):
        rows.append((k, "http://www.site.example/a", page(f"<div><p>Welcome to our site</p></div><p>own text {k}</p>")))
        rows.append((100 + k, "http://site.example/b", page(f"<article><p>quoted passage</p><p>more {k}</p></article>")))
    rows += [(200, None, page("<p>Welcome to our site</p>")), (201, "http://other.example", page("<p>Welcome to our site</p>")),
             (None, "http://other.example", None)]
    rows += [(300 + k, "http://mirror.example/", page("<p>the same page again</p>")) for k in range(9)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in extract_text(df).collect()}
    for k in range(8):
        assert got[k] == f"own text {k}" and got[100 + k] == f"quoted passage\nmore {k}"
    assert got[200] == got[201] == "Welcome to our site" and got[None] == ""
    assert all(got[300 + k] == "the same page again" for k in range(9))  # copies are one page
    assert extract_text(df.limit(0)).count() == 0


def test_given_pages_keep_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in extract_text(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        words = html.unescape(re.sub(r"<[^>]*>", " ", inner)).split()
        assert got[r.page_id].split() == words


def test_hosts_and_broken_markup():
    assert [host_of(u) for u in ("HTTPS://www.A.example:80/x", "//b.example", "no", None, "http://u@c.example?q")] == [
        "a.example", "b.example", None, None, "c.example"]
    assert [b[0] for b in blocks_of("<div><p>a</div>b</p></article>c<p")] == ["a", "b", "c<p"]
    assert len(blocks_of("<a <a " * 20000)) == 1


def test_names_and_forms():
    def texts(h):
        return [t for t, _ in blocks_of(h)]
    inner = "<h1>t</h1><p>a <button>go</button> b</p>"
    assert texts(f"<form><nav>n</nav><div><article>{inner}</article></div></form>") == ["t", "a b"]
    assert texts(f"<article>{inner}<form>name <h1>send</h1></form><p>c</p></article>") == ["t", "a b", "c"]
    assert texts("<form><p>your name</p></form><p>c</p>") == ["c"]
    for name in ("related-work", "notice-period", "comment-on-method", "comments-page-content"):
        assert texts(f"<article><div class='{name}'><p>x</p></div></article>") == ["x"]
        assert texts(f"<div id='{name}'><p>x</p></div>") == ["x"]
    for name in ("ad", "big ad-box", "comments", "related_posts", "cookie-notice", "sidebar-left"):
        assert texts(f"<article><div class='{name}'><p>x</p></div>y</article>") == ["y"]


def test_template_without_known_words_goes_by_counting(spark):
    """No tag, role or name gives the template away; only its recurring tells."""
    def site(k, tag, name):
        top = f"<div class='q1'><p>North Harbour Gazette</p><p>Open {name} from nine</p></div>"
        return page(f"{top}<{tag}><h1>Title {k}</h1><div class='q2'><p>Tell a friend</p><p>Print it</p></div>"
                    f"<p>story {k} of {name}</p><p>{'a line quoted often' if k % 3 == 0 else f'line {k}'}</p></{tag}>")
    rows = [(k + 100 * j, f"http://{n}.example/{k}", site(k, tag, n))
            for j, (n, tag) in enumerate((("one", "div"), ("two", "article"))) for k in range(30)]
    rows += [(500 + k, "http://two.example/x", site(7, "article", "two")) for k in range(40)]  # copies: one page
    rows += [(600 + k, "http://few.example/x", site(k, "article", "few")) for k in range(4)]
    got = {r.page_id: r.text.split("\n") for r in extract_text(
        spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    for k in range(30):
        last = "a line quoted often" if k % 3 == 0 else f"line {k}"
        assert got[k] == [f"Title {k}", f"story {k} of one"] + ([] if k % 3 == 0 else [last])  # outside, three pages are enough
        assert got[100 + k] == [f"Title {k}", f"story {k} of two", last]  # inside, more than half of the pages
    assert got[520] == got[107]
    assert got[601] == ["Title 1", "Tell a friend", "Print it", "story 1 of few", "line 1"]  # too few pages to tell


def test_hinted_names_lower_the_count(spark):
    rows = [(k, "http://h.example/", page(f"<article><div class='{'related-work' if k < 4 else 'x'}'><p>See the list of {k // 4}</p></div>"
                                          f"<p>text {k}</p></article>")) for k in range(12)]
    got = {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == (f"text {k}" if k < 4 else f"See the list of {k // 4}\ntext {k}") for k in range(12))


def test_parsing_is_linear():
    for html, n in (("<div>" * 100_000, 0), ("<div>x" * 100_000, 100_000), ("<b>" * 50_000 + "</i>" * 50_000 + "x", 1),
                    ("<li>a" * 100_000, 100_000), ("<table>" + "<tr><td>a" * 50_000, 50_000), ("<b>" * 50_000 + "<p>" * 50_000, 0)):
        start = time.process_time()
        assert len(blocks_of(html)) == n and time.process_time() - start < 4
