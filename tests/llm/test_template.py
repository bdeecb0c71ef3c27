from lorekeep.llm.template import Parser, Settings, extract_text, main_text, text_digest

SCHEMA = "page_id long, url string, html string"


def one(html, template=frozenset()):
    return main_text(Parser(html), template)


def test_article_without_the_rest():
    page = """<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li>m</ul></nav>
    <div class="ad">buy</div><div id="cookie-notice">ok?</div><article class="post"><h1>Head &amp;  more</h1>
    <p>One <b>bo</b>ld.<br>Two<p>Three<script>var x="</article>";</script><aside>side</aside>
    <form><input>send</form><div class="comments"><p>mine!</p></div><ul><li>a<li>b</ul></article>
    <footer>&copy; x</footer></body></html>"""
    assert one(page) == "Head & more One bold. Two Three a b"


def test_unclosed_and_odd_markup():
    assert one("<article><p><b>x.<br><p>y</p><!-- <p>no</p> -->z</article>q") == "x. y z"
    assert one("<article>a &lt;b&gt; &#233; &euro; 1 < 2</article>") == "a <b> é € 1 < 2"
    assert one("") == "" and one("plain words") == "plain words"
    assert one("<article>a</article><p>gap</p><article>b</article>") == "a b"
    assert one("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>") == "deep"
    assert one("<article>never ends <p>x") == "never ends x"


def test_constant_blocks_go_where_no_element_marks_the_article(spark):
    rows = [(i, "http://h/%d" % i, f"<body><div><p>Shared line</p><div><p>Own text number {i} is here and long</p></div>"
             "<p>Read on</p></div></body>") for i in range(8)]
    got = {r.page_id: r.text for r in text_digest(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: f"Own text number {i} is here and long" for i in range(8)}


def test_copies_of_an_article_stay(spark):
    rows = [(i, "http://h/a", "<body><nav>n</nav><article><p>Same on all</p></article></body>") for i in range(9)]
    assert {r.text for r in text_digest(spark.createDataFrame(rows, SCHEMA)).collect()} == {"Same on all"}


def test_awkward_rows(spark):
    rows = [(1, None, None), (2, "", ""), (None, "no host", "<article>x</article>"), (4, "http://h", "<article>x</article>")] * 2
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'old' as text", "1 as n_chars")
    got = sorted(((r.page_id or 0, r.text) for r in extract_text(df, Settings(group_pages=1)).collect()))
    assert got == [(0, "x")] * 2 + [(1, "")] * 2 + [(2, "")] * 2 + [(4, "x")] * 2
    assert extract_text(df.limit(0)).count() == 0


def test_class_marks_do_not_cover_the_article_or_most_of_the_text():
    body = "<div class='ad'>buy</div><article><p>Own words</p></article>"
    for wrap in ("<html class='has-cookie-banner'>%s</html>", "<div class='layout with-sidebar'>%s</div>", "<div id='page' class='no-comments'>%s</div>"):
        assert one(wrap % body) == "Own words"
    assert one("<div class='no-sidebar'><p>Long enough to be the text</p><div class='ad'>buy</div></div>") == "Long enough to be the text"
    assert one("<article class='post no-comments'>Text of it</article><p>x</p>") == "Text of it"
    assert one("<article>Short</article><div class='comments'><p>Comments that are longer</p></div>") == "Short"
    assert one("<article>Own</article><article class='comment'>mine! mine! mine!</article><article class='related'>more</article>") == "Own"
    assert one("<main>Own<article class='comment'>mine!</article></main>") == "Own"
    assert one("<div><p>The text of the page</p></div><article class='comment'>mine!</article>") == "The text of the page"


def test_math_and_object_text_stay():
    assert one("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> be</p>"
               "<object data='a'><p>A chart</p></object></article>") == "Let x=1 be A chart"


def texts(spark, rows, settings=Settings()):
    return {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, SCHEMA), settings).collect()}


def test_constant_blocks_inside_articles_go(spark):
    """A notice on all pages, a share line on most, and a line that repeats on too few."""
    page = "<body><article><h1>Head %d</h1><p>Sign up for our letter</p><p>Own words %d</p>%s%s</article><p>end</p></body>"
    rows = [(i, f"http://h/{i}", page % (i, i, "<p>Tell your friends</p>" if i % 3 else "", "<p>As said</p>" if i < 3 else ""))
            for i in range(12)]
    assert texts(spark, rows) == {i: f"Head {i} Own words {i}" + (" As said" if i < 3 else "") for i in range(12)}


def test_copies_count_once_and_few_pages_lose_nothing(spark):
    page = "<body><nav>n%d</nav><article><p>%s</p><p>Line</p></article></body>"
    rows = [(i, f"http://h/{i}", page % (i, "Same on all")) for i in range(9)]
    rows += [(10 + i, f"http://h/x{i}", page % (i, f"Other {i}")) for i in range(2)]
    rows += [(20 + i, url, page % (i, f"No host {i}")) for i, url in enumerate([None, "", "x", "y", "z"])]
    want = {i: "Same on all Line" for i in range(9)} | {10 + i: f"Other {i} Line" for i in range(2)}
    assert texts(spark, rows) == want | {20 + i: f"No host {i} Line" for i in range(5)}
    assert texts(spark, [(1, "http://one/", "<body><div><p>Alone on its host</p></div></body>")]) == {1: "Alone on its host"}


def test_unclosed_embedded_elements_lose_nothing():
    assert one("<article>a <button>b <p>c</p></article>") == "a b c"
    for tag in ("<video src=x>", "<svg>", "<iframe>", "<select>", "<audio>"):
        assert one(f"<article>a {tag}<p>b</p></article><p>c</p>") == "a b"
        assert one(f"<article>a {tag}<p>b</p></article><div>x {tag}gone</{tag[1:].split()[0].rstrip('>')}></div>") == "a b"
    assert one("<article>a <svg><a><text>t</text></a></svg> b <select><option>x</option></select> c</article>") == "a b c"
    assert one("<article>" + "<video>x " * 3000 + "</article>") == " ".join(["x"] * 3000)


def test_class_words_beside_others_name_something_else():
    assert one("<article><div class='share price'><p>Prices rise</p></div></article>") == "Prices rise"
    assert one("<article><p>a</p><section id='related-work'>b</section></article>") == "a b"
    assert one("<article><p>a</p><div class='share-links'>b</div><div id='ad-2'>c</div><div class='cookie notice'>d</div></article>") == "a"
    assert one("<article><p>a</p><noscript><p>kept</p></noscript></article>") == "a kept"


def test_deep_pages_take_memory_by_their_length():
    import tracemalloc

    tracemalloc.start()
    got = one("<article>" + "<div>" * 200_000 + "deep")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == "deep" and peak < 300e6
    assert one("<b>" * 20_000 + "<p>x" * 20_000).count("x") == 20_000


def test_helper_names_pass_through(spark):
    df = spark.createDataFrame([(1, "http://h", "<article>x</article>")], SCHEMA).selectExpr(
        "*", "1 as host", "2 as `key`", "3 as `group`", "4 as groups", "5 as row", "6 as size", "7 as _host", "8 as `a.b`", "'t' as Text")
    assert [tuple(r) for r in extract_text(df).collect()] == [(1, "http://h", "<article>x</article>", 1, 2, 3, 4, 5, 6, 7, 8, "x")]
