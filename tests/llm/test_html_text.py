import random
from html.parser import HTMLParser

from pyspark.sql import functions as F

from airgrid.llm import html_text as H
from airgrid.llm.registry import QUERIES
from tests.llm.cases import FOLDER, exact, rows_of

SCHEMA = "page_id bigint, url string, html string"


class Article(HTMLParser):
    """Text of article elements by the standard library's parser."""

    def __init__(self, page):
        super().__init__()
        self.depth, self.blocks, self.held = 0, [], ""
        self.feed(page)
        self.close()
        self.end()

    def end(self):
        text = " ".join(self.held.split())
        self.blocks += [text] if text else []
        self.held = ""

    def handle_starttag(self, tag, _):
        self.depth += tag == "article"
        if tag in ("p", "h1", "article"):
            self.end()
        if tag == "br":
            self.held += " "

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "article"):
            self.end()
        self.depth -= tag == "article"

    def handle_data(self, data):
        if self.depth:
            self.held += data


def test_query_beside_the_standard_parser(spark):
    expected = [(i, u, "\n".join(Article(h).blocks)) for i, u, h in rows_of("pages", "page_id, url, html")]
    assert exact(QUERIES["op9_html_text"](spark, FOLDER).collect()) == exact((i, u, t, len(t)) for i, u, t in expected)


def text(page):
    return [t for kind, t in H.lines_of(page) if kind != H.OUTSIDE]


def test_markup():
    assert text("<article><h1>A &amp; B</h1><p>x<br>y&nbsp;z &lt;b&gt; &#233;<p>two <b>bold <i>on</b> it</article><p>after") == ["A & B", "x y z <b> é", "two bold on it"]
    assert text("<body><nav>m<ul><li>k</ul></nav><header><h1>site</h1></header><div class='main-ad ad'>buy<div>now</div></div><p>kept</p><aside>s</aside><form>f</form><footer>c</footer>") == ["kept"]
    assert text("<article><p>one</p><div id=comments><p>hi</p></div><section class='cookie-notice'>c</section><div role=\"navigation\">n</div><p>two</p></article>") == ["one", "two"]
    assert text("<article><p>a</p><nav>unclosed <p>b</article><p>c") == ["a"]
    assert text("<nav>unclosed <article><p>a</article>") == ["a"]
    assert text("<script>if (a < b) '</p>'</script><style>p{}</style><!-- <p>no</p> --><title>t</title>x<p hidden>h</p><textarea>t</textarea>y") == ["x", "y"]
    assert text("<div class='shadow headerless adage'>kept</div>") == ["kept"]
    assert text("1 < 2 &unknown; <") == ["1 < 2 &unknown; <"]
    assert text(None) == text("") == text("<p> \n </p>") == []
    assert text("<p>" + "w " * 100_000) == [("w " * 100_000).strip()]


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_shared_is_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(800):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 14))] for _ in range(2))
        at = H.shared(a, b)
        rest = iter(b)
        assert len(at) == lcs(a, b) and at == sorted(at) and all(a[i] in rest for i in at)


PAGES = [
    (1, "http://a.b/x/1", "<body><p>We use cookies</p><p>One &amp;  two</p><div>end</div>"),
    (2, "http://a.b/x/2?q", "<p>We use cookies<p>Three<div>end</div>"),
    (3, "http://a.b/y", "<p>We use cookies"),
    (4, None, "<p>We use cookies"),
    (5, "http://c.d/", None),
    (6, "http://a.b/x/0", "<article><p>We use cookies</p>loose end<p>One</article><p>x"),
    (7, "not an address", "<nav>z</nav>q"),
    (1, "http://a.b/x/1", "<body><p>We use cookies</p><p>One &amp;  two</p><div>end</div>"),
    (None, "//A.B:80/", ""),
    (8, "https://lone.org", "<p>We use cookies"),
]
EXPECTED = {1: "One & two\nend", 2: "Three", 3: "", 4: "We use cookies", 5: "", 6: "We use cookies\nloose end\nOne", 7: "q", None: "", 8: "We use cookies"}


def test_lines_shared_with_the_nearest_page_go(spark):
    df = spark.createDataFrame(PAGES, SCHEMA).withColumn("row", F.lit("clash")).withColumn("host", F.lit("clash")).withColumn("text", F.lit("clash"))
    assert exact(H.main_text(df).collect()) == exact((i, u, EXPECTED[i], len(EXPECTED[i])) for i, u, _ in PAGES)
    assert H.main_text(df.limit(0)).count() == 0


def test_nearest_pages_do_not_depend_on_partitions(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["hot", "hot", "hot", "cold", "one%d" % i, None]), f"/{rng.randint(0, 30)}/{rng.randint(0, 99)}") for i in range(500)]
    df = spark.createDataFrame(rows, "row bigint, host string, path string")

    def common(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    expected = {}
    order = sorted((h, p, i) for i, h, p in rows if h is not None)
    for k, (h, p, i) in enumerate(order):
        near = [order[j] if 0 <= j < len(order) and order[j][0] == h else None for j in (k - 1, k + 1)]
        if any(near):
            up, down = near
            take = down if up is None or (down and common(p, down[1]) > common(p, up[1])) else up
            expected[i] = take[2]
    for n in ("1", "4", "9"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            assert {r.row: r.mate for r in H.nearest_pages(df).collect()} == expected
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


STORY = "The river rose in the night and by the morning the lower fields stood under water, as they had in the spring."


def test_copies_without_an_article_keep_their_text(spark):
    page = f"<body><p>We use cookies</p><p>{STORY}</p><p>end of it</p>"
    near = f"<body><p>We use cookies</p><p>{STORY}</p><p>end of it</p><p>seen 7 times</p>"
    alone = [(1, "http://a.b/x", page), (2, "http://a.b/x?id=2", page), (3, "http://a.b/x/", page)]
    got = {r.page_id: r.text for r in H.main_text(spark.createDataFrame(alone, SCHEMA)).collect()}
    assert got == dict.fromkeys((1, 2, 3), f"We use cookies\n{STORY}\nend of it")
    # many copies in a row meet the page behind them; a print version is a copy too
    rows = [(i, f"http://a.b/x/{i:03}", near if i % 2 else page) for i in range(60)] + [(60, "http://a.b/x/060", f"<p>{STORY}</p>")]
    rows += [(i, f"http://a.b/y/{i}", f"<p>We use cookies<p>Page {i} tells another story altogether, and at some length, for the sake of it.") for i in (70, 71)]
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            got = {r.page_id: r.text for r in H.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        assert all(STORY in got[i] for i in range(61))
        assert all("another story" in got[i] and "cookies" not in got[i] for i in (70, 71))


def test_names_are_whole():
    for name in ("no-sidebar", "has-sidebar", "ad-free", "side-by-side", "search-result", "entry-header", "entry_header"):
        assert text(f"<body><div class='wide {name}'><p>kept</p></div>") == ["kept"]
        assert text(f"<article><div id={name}><h1>head</h1></div><p>kept</p></article>") == ["head", "kept"]
    assert text("<article><div class='header'><h1>head</h1></div><p>kept</p></article>") == ["head", "kept"]
    for name in ("Sidebar", "cookie_notice", "x ad", "related-posts"):
        assert text(f"<body><div class='{name}'><p>gone</p></div><p>kept</p>") == ["kept"]


def test_wrappers_of_most_running_text_stay():
    more = STORY.upper()
    assert text(f"<body><div class='sidebar'><p>{STORY}</p><div class='ad'>buy</div><p>{more}</p></div><p>{STORY}</p>") == [STORY, more, STORY]
    assert text(f"<body><div class='sidebar'><div id=search><p>{STORY}</p></div></div><p>x") == [STORY, "x"]
    assert text(f"<article><p>{STORY}</p><div class='comments'><p>{more}</p><p>{more}</p></div></article>") == [STORY]
    assert text(f"<article><div class='side'><p>{STORY}</p></div><p>{more} {more}</p></article>") == [f"{more} {more}"]
    assert text(f"<article><div class='overlay'><nav>{more} {more}</nav><p>{STORY}</p></div></article>") == [STORY]
    assert text(f"<body><div hidden><p>{STORY}</p></div><p>x") == ["x"]
    assert text(f"<body><div class=cookie-notice>{STORY}</div><div class=sidebar><a>{STORY}</a></div><p>x") == ["x"]
    assert text(f"<body><h1>x</h1><div class=ad>{'<p>' + STORY}{'<p>' + STORY * 4}</div>") == ["x", STORY, (STORY * 4).strip()]
    assert text(f"<article><div class=side><p>{STORY}</p></div></article><div class=sidebar><p>{STORY * 4}</p></div>") == [STORY]


def test_comments_notices_and_adverts_by_parts_of_their_names():
    post = f"<article><h1>head</h1><p>{STORY}</p>"
    reply = '<li class="comment"><article class="comment-body"><p>A reader says hi'
    assert text(f'{post}</article><div id="comments" class="comments-area">{reply}') == ["head", STORY]
    assert text(f'{post}<div id="comments" class="comments-area">{reply}</article></li></div></article>') == ["head", STORY]
    assert text(f"{post}</article><article class='comment'><p>hi</p></article>") == ["head", STORY]
    for name in ("reader-comments", "user_comments", "cookienotice", "advertisement-wrapper", "top-advert", "sponsored-box", "x-cookie-hint", "newsletter-box"):
        assert text(f"{post}<div class='{name}'><p>gone</p></div><p>kept</p></article>") == ["head", STORY, "kept"], name
    for name in ("no-comments", "comments-off", "commentary", "has-ads", "ad-free", "comment-free", "download", "uploads"):
        assert text(f"{post}<div class='{name}'><p>kept</p></div></article>") == ["head", STORY, "kept"], name
    assert text(f"{post}</article><aside><article class=card><p>other story</p></article></aside>") == ["head", STORY]
    assert text(f"<nav>unclosed <article><p>{STORY}</article>") == [STORY]
    assert text(f"<div class='cookie-wall'><article><p>{STORY * 5}</p></article></div>") == [(STORY * 5).strip()]


#: Three templates: a post's body in a box, a flat article, one in sections; each has its own notice inside the article.
TEMPLATES = {
    "http://a.org": lambda n, body: f"<article class=post><div class=entry-content><h1>Post {n}</h1>{body}</div><div class=byline-box><p>The staff of A write every day.</p></div></article>",
    "http://b.org": lambda n, body: f"<main><h2>Item {n}</h2><div id=lead><p>Save ten percent today, all readers of B.</p></div>{body}</main>",
    "http://c.org": lambda n, body: f"<article><section id=s1>{body}</section><section id=s2><ul class=tags><li>more from C<li>all of C</ul></section><p>End of {n}.</p></article>",
}


def test_alignment_decides_lines_inside_articles(spark):
    shared_by_all = "This passage stands in each of the articles, which cite it, and must be left alone."
    rows, expected, gone = [], {}, 0
    for k, (host, page) in enumerate(TEMPLATES.items()):
        for n in range(6):
            i = 10 * k + n
            own = [f"Story {i} begins here and goes on for a while, so that nobody takes it for another, {'x' * i}.", shared_by_all]
            html = page(n, "".join(f"<p>{t}</p>" for t in own))
            rows.append((i, f"{host}/{n}", html))
            everything = [t for kind, t in H.lines_of(html) if kind != H.OUTSIDE]
            notices = {"The staff of A write every day.", "Save ten percent today, all readers of B.", "more from C", "all of C"}
            expected[i] = "\n".join(t for t in everything if t not in notices)
            gone += sum(t in notices for t in everything)
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.page_id: r.text for r in H.main_text(df).collect()} == expected
    assert gone == 24 and all(shared_by_all in t for t in expected.values())


def test_hostile_pages_take_linear_time():
    import time

    n = 40_000
    pages = ["<a \"" * n, "<a '" * n + "<p>x</p>", "<script" * n, "<!" * n, "<div class=sidebar>" * 3000 + "x" + "</div>" * 3000, "<div class=x><article>" * n + "y",
             "<" * n, "<p a=\"" + "<p>" * n, "&" * n, "<article>" + "<div id=a><section class=b>" * n + "z" + "</section>" * n, "<nav><div hidden>" * n, "<b <i 'x>" * n]
    for page in pages:
        begun = time.monotonic()
        H.lines_of(page)
        assert time.monotonic() - begun < 5, page[:20]
    assert text("<p a=\"x > y\">one</p><p title='<b>'>two</p><p a=\">three</p>") == ["one", "two", "three"]


def test_long_pages_are_aligned_in_halves(monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(H, "TABLE_BITS", 6)
    for _ in range(500):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 14))] for _ in range(2))
        at = H.shared(a, b)
        rest = iter(b)
        assert len(at) == lcs(a, b) and at == sorted(at) and all(a[i] in rest for i in at)
    monkeypatch.undo()
    many = [rng.randint(0, 3) for _ in range(12_000)]
    assert len(H.shared(many, many[::2])) == 6_000


def test_repeated_rows(spark):
    page = f"<article><p>{STORY}</p></article>"
    rows = [(1, "http://a.b/1", page)] * 50 + [(1, "http://a.b/1", None), (None, None, page), (1, "http://a.b/2", page)]
    got = H.main_text(spark.createDataFrame(rows, SCHEMA)).collect()
    assert exact(got) == exact((i, u, STORY if h else "", len(STORY) if h else 0) for i, u, h in rows)
