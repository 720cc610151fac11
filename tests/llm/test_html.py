from annogrid.llm import html_extract
from annogrid.llm.markup import parse, text_of

SITE = """<!DOCTYPE html><html><head><title>T {k}</title><style>p{{margin:0}}</style><script>var t="</p><article>";</script></head>
<body class="has-sidebar"><header><a href="/">Site</a></header><nav><ul><li><a href="/a">Alpha<li>Beta</ul></nav><!-- ad {k} <p>no</p> -->
<div class="top-story">Welcome to the site</div><article><header><h1>Title&nbsp;{k} &amp; more</h1></header>
<p><b>First{k}   line<br>second &lt;line&gt; 3 < 4
<p>Same words on every page</p><div class="ad-slot">Buy {k}</div><ul><li>one<li>two</ul><table><tr><td>x<td>y</table></article>
<div id="comments"><article class="comment"><p>Nice {k}!</p></article></div><form><label>Mail</label></form>
<div class="cookieNotice">We use cookies {k}</div><footer>&copy; Site &middot; text</footer></body>"""


def want(k):
    return f"Title {k} & more First{k} line second <line> 3 < 4 Same words on every page one two x y"


def test_article(spark):
    rows = [(k, f"http://U:p@Site.example:80/{k}", SITE.format(k=k), "x") for k in range(6)] + [(9, None, None, "x"), (10, "nonsense", "", "x"), (None, "http://b/", "plain <i>te</i>xt", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract(pages).collect()}
    assert len(got) == 9 and all(got[k] == (want(k), len(want(k))) for k in range(6))
    assert got[9] == got[10] == ("", 0) and got[None] == ("plain text", 10)
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_templates_without_an_article(spark):
    page = "<body><div><p>Home | About</p></div><div><p>Own words {k}</p><p>More {k}</p></div><div>Powered by site</div></body>"
    rows = [(k, "http://s/%d" % k, page.format(k=k)) for k in range(8)] + [(20, "http://other/", page.format(k=20))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    assert got[3] == "Own words 3 More 3" and got[20] == "Home | About Own words 20 More 20 Powered by site"


def test_templates_inside_an_article(spark):
    page = '<body><article><h1>Title {k}</h1><div class="x7"><p>Suivez nous</p></div><p>Own words {k} that are longer than the rest</p><p class="y">Share this text</p></article></body>'
    copy = "<body><article><section><p>One copied article</p></section><div>Twice</div></article></body>"
    rows = [(k, f"http://s/{k}", page.format(k=k)) for k in range(30)] + [(100 + k, f"http://s/c{k}", copy) for k in range(30)]
    rows += [(200 + k, f"http://few/{k}", page.format(k=k)) for k in range(6)] + [(300, "http://other/", page.format(k=300))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    assert all(got[k] == f"Title {k} Own words {k} that are longer than the rest" for k in range(30))
    assert all(got[100 + k] == "One copied article Twice" for k in range(30))
    assert got[203] == "Title 3 Own words 3 that are longer than the rest Share this text"
    assert got[300] == "Title 300 Suivez nous Own words 300 that are longer than the rest Share this text"


def test_names_alone_never_drop_prose():
    cases = {
        '<article><p>One</p><div class="share-price"><p>Two</p></div><div class="related-work"><p>Three</p></div></article>': "One Two Three",
        '<article><p>One</p><div class="share-box">Post it</div><div class="related-posts top"><p>More</p></div><div id="ad-3">Buy</div></article>': "One",
        '<body><div class="legal-history"><p>One</p></div><div class="cookieNotice">Two</div></body>': "One",
        '<article><div class="ad x"><p>gone</p></div><p class="rail-transport">One</p><ul class="search-results-of-the-study"><li>Two</ul></article>': "One Two",
    }
    for page, text in cases.items():
        assert html_extract.Page(page).text() == text, page


def test_all_content_is_kept():
    cases = {
        '<div class="post"><p>One</div><div class="post">Two</div><section id="entry-3">Three</section>': "One Two Three",
        '<div class="content-top">Teaser</div><div><p>The body that is much longer than the teaser before it</div>': "Teaser The body that is much longer than the teaser before it",
        "<main><p>Main text</main><article>Aside it</article>": "Main text Aside it",
        "<main>One</main><div role=main>Two<main>Three</main></div><p>x": "One Two Three",
        '<div class="content"><p>Menu</p><article>Own text</article></div>': "Own text",
        "<article>Card</article><div>" + "body " * 50 + "</div>": "Card " + " ".join(["body"] * 50),
    }
    for page, text in cases.items():
        assert html_extract.Page(page).text() == text, page


def test_broken_markup():
    cases = {
        "a<b": "a",
        "a < b": "a < b",
        "<p>x<p": "x",
        "<p title='a>b'>x</p>y": "x y",
        '<p title="a>x</p>y': "x y",
        "<script>never ends <p>": "",
        "<!-- open <p>x": "",
        "<p>a<!---->b</p>": "ab",
        "&lt;p&gt; &#233;&eacute;": "<p> éé",
        "</div>x</p>": "x",
        "<div>" * 5000 + "deep": "deep",
        "<ul><li>a<ul><li>b</ul><li>c</ul>": "a b c",
    }
    for page, text in cases.items():
        assert " ".join(text_of(parse(page), lambda node: node.tag in ("script", "style"))) == text, page
    assert html_extract.Page("<p>" + "word " * 200000).text() == " ".join(["word"] * 200000)


def test_counts_decide_over_whole_hosts(spark):
    """Unnamed elements: brute force over the host's pages says which recur, and exactly those go."""
    import random

    rng = random.Random(5)
    blocks = {f"b{k}": f"<div><p>Block {k}</p><span>x{k}</span></div>" for k in range(12)}
    rows, used = [], []
    for i in range(120):
        host = "big" if i % 3 else "small"
        own = [b for k, b in enumerate(sorted(blocks)) if rng.random() < (0.05, 0.15, 0.3, 0.6)[k % 4]]
        inside = i % 2
        parts = "".join(blocks[b] for b in own)
        words = f"<p>Own words number {i} of this page that are longer than what recurs around them and more</p>"
        rows.append((i, f"https://{host}/{i}", f"<body><article>{words}{parts}</article></body>" if inside else f"<body>{parts}<div>{words}</div></body>"))
        used.append((host, inside, own, f"Own words number {i} of this page that are longer than what recurs around them and more"))
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, (host, inside, own, words) in enumerate(used):
        peers = [u for u in used if u[0] == host]
        among = [u for u in peers if u[1] == inside]
        whole = len([u for u in peers if u[1]]) if inside else len(peers)
        kept = []
        for b in own:
            n = sum(b in u[2] for u in among)
            if not (n >= html_extract.MIN_PAGES and n >= whole * html_extract.MIN_SHARE):
                kept.append(f"Block {b[1:]} x{b[1:]}")
        want = [words, *kept] if inside else [*kept, words]
        assert got[i] == " ".join(want), (i, rows[i])
