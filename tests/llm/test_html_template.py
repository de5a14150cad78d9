from opsight.llm.html_template import extract_text, main_text, parse

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head>
<body class="has-sidebar"><header>Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><!-- c > -->
<article><header><h1>The  title</h1></header><p>One <b>bo</b>ld &amp; <i>it</i>&eacute;&#33; &lt;x&gt; 3 < 4<br>next
line</p><p>Two<p>Three<form><input name=q>Search</form><aside>Side</aside><div class="ad">Buy</div>
<div class="content">Four &amp</div><section class="comments"><article>Me too</article></section></article>
<div id="sidebar">Side</div><footer>&copy; X</footer></body></html>"""
TEXT = "The title One bold & ité! <x> 3 < 4 next line Two Three Four &"


def test_article_text():
    assert main_text(PAGE, set(), set(), set()) == TEXT


def test_without_an_article():
    page = "<body><div class=menu>Menu</div><div>Body <span>text</span></div><p>More</p><noscript>no</noscript>tail"
    assert main_text(page, set(), set(), set()) == "Body text More tail"


def test_broken_pages():
    assert main_text("", set(), set(), set()) == ""
    assert main_text("just text", set(), set(), set()) == "just text"
    assert main_text("<article><p>cut &am", set(), set(), set()) == "cut &am"
    assert main_text("<p>a</nav></div>b<script>never closed", set(), set(), set()) == "a b"
    assert len(parse("<div>" * 5000)) == 5000


def rows(host, n, body):
    return [(i, f"http://{host}/p{i}", f"<html><body><h2>Welcome back</h2>{body(i)}<p>All rights with us</p></body></html>") for i in range(n)]


def table(spark, data):
    from pyspark.sql import functions as F

    return spark.createDataFrame(data, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("text", "_id", "_host")})


def test_template_text_and_link_slots_are_left_out(spark):
    """Without telling elements, what all pages of the host share goes, and slots that are links."""

    def body(i):
        links = "".join(f"<a href='{j}'>link {i} {j}</a> " for j in range(4))
        return f"<div>{links}</div><table><tr><td>Own text {i} of the page, which is longer than the frame around it</td></tr></table>"

    got = {r["page_id"]: r["text"] for r in extract_text(table(spark, rows("Host.example", 8, body))).collect()}
    assert got == {i: f"Own text {i} of the page, which is longer than the frame around it" for i in range(8)}


def test_few_pages_have_no_template(spark):
    got = extract_text(table(spark, rows("h", 2, lambda i: f"<p>{i}</p>"))).collect()
    assert {r["text"] for r in got} == {"Welcome back 0 All rights with us", "Welcome back 1 All rights with us"}


def test_copies_of_an_article_stay(spark):
    data = [(i, "http://h/", PAGE) for i in range(6)] + [(None, None, None), (7, "no host", ""), (8, "http://h/", PAGE.replace("Two", "2"))]
    got = sorted((tuple(r) for r in extract_text(table(spark, data)).collect()), key=repr)
    assert [r for r in got if r[0] is None] == [(None, None, "", 0)]
    assert len([r for r in got if r[2] == TEXT and r[3] == len(TEXT)]) == 6
    assert extract_text(table(spark, data).limit(0)).count() == 0


def plain(page):
    return main_text(page, set(), set(), set())


def test_scripts_are_skipped_to_their_own_end():
    assert plain("<p>a</p><script>for(var i=0;i<n;i++){x='</p>'}</script><p>b</p>") == "a b"
    assert plain("<p>a</p><script>if (a<b) { <!-- }</script><p>b</p>") == "a b"
    assert plain("<article><p>a</p><SCRIPT>'<article>' </scripted> <p>no</ScRiPt ><p>b</p></article>") == "a b"
    assert plain("<title>x < y <p></title><style>a>b{}<p></style><p>b") == "b"


def test_quoted_attributes_may_hold_any_sign():
    assert plain("<p title=\"a > b\" class='x>y'>c</p><a title='1 > 0' href=x>d</a> e") == "c d e"
    assert plain("<p title=it's>a</p><p alt=\"never closed>b</p>") == "a b"
    assert plain('<div data-x="</article><p>">in</div>') == "in"


def test_marks_of_blocks_and_compound_names():
    page = "<article><p class=notice>We moved</p><p>One<p class='ad'>Buy<p>Two</p><div class='content side-by-side'>Three</div></article>"
    assert plain(page) == "One Two Three"
    assert plain("<article><div class='meta-text tags form'>kept</div></article>") == "kept"


def test_template_of_a_host_goes_inside_articles_too(spark):
    """Neutral names: a notice that all articles of a host hold and a menu outside go, what one page has stays."""

    def page(i):
        links = "".join(f"<a href='/{j}'>part {j}</a> " for j in range(5))
        own = f"Own words {i} of page {i}, enough of them to be the longest block of the page by far"
        only = "<p>Only here</p>" if i == 3 else ""
        return f"<body><div class=a1>{links}</div><article class=b2><p>Read this first.</p><p>{own}</p>{only}<p>Seen on every page</p></article></body>"

    data = [(i, f"http://n.example/{i}", page(i)) for i in range(9)]
    got = {r["page_id"]: r["text"] for r in extract_text(table(spark, data)).collect()}
    for i in range(9):
        own = f"Own words {i} of page {i}, enough of them to be the longest block of the page by far"
        assert got[i] == own + (" Only here" if i == 3 else "")


def test_repeated_rows_and_near_copies_leave_templates_right(spark):
    """An even number of copies of a row does not hide a token, and what near copies share is not the template."""
    body = lambda i: f"<div><p>Frame</p><p>Text {i} is the one long paragraph of its own page here</p></div>"
    data = [(i % 6, "http://r/", f"<body>{body(i % 6)}</body>") for i in range(12)]
    copies = [(100 + i, "http://c/", f"<article><p>A long paragraph that all copies share word for word</p><p>v{i}</p></article>") for i in range(9)]
    got = sorted((r["page_id"], r["text"]) for r in extract_text(table(spark, data + copies)).collect())
    assert [t for i, t in got if i < 100] == [f"Text {i} is the one long paragraph of its own page here" for i in range(6) for _ in range(2)]
    assert [t for i, t in got if i >= 100] == [f"A long paragraph that all copies share word for word v{i}" for i in range(9)]
