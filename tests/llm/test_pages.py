"""Main text of pages."""

from tidemark.llm import pages

NOISE = [
    "<nav><ul><li><a href='/a'>Home</a><li>News</ul></nav>", "<header><h2>Site</h2></header>", '<div class="ad">Buy</div>', "<aside>Side</aside>",
    "<footer>&copy; us</footer>", '<div id="cookie-notice">We use</div>', "<form><label>Mail</label><input><button>Go</button></form>",
    '<section class="comments"><article>First!</article></section>', "<script>var t='</p>';</script>", "<style>p{}</style>", "<!-- no <p>x</p> -->",
    '<div class="sideBar">More</div>', "<noscript>turn on</noscript>", '<div role="navigation">Up</div>', "<div hidden>unseen</div>"]


def test_blocks_and_noise():
    body = "<article><h1>A &amp; B</h1><p><b>One\n two.<br><p>Three&nbsp;<a href='x>y'>four</a> &lt;5 < 6<ul><li>x<li>y</ul>"
    want = "A & B\n\nOne two.\n\nThree four <5 < 6\n\nx\n\ny"
    assert pages.main_text(f"<html><body>{body}</article></body></html>") == want
    assert pages.main_text("<!DOCTYPE html><html><head><title>T</title></head><body>" + "".join(NOISE) + body + "</article>" + "".join(NOISE)) == want
    for n in NOISE:
        assert pages.main_text(f"<body>{n}{body}{n}</article>{n}") == want, n
    assert pages.main_text(body + " <p>cut <a hre") == want + "\n\ncut"
    assert pages.main_text("<body><div><p>No article here</p></div>" + "".join(NOISE)) == "No article here"
    assert pages.main_text("") == "" and pages.main_text("plain") == "plain" and pages.main_text("<p></p>") == ""
    assert pages.main_text("<form class='header'><article><header><h1>T</h1></header>x</article></form>") == "T\n\nx"


def html(i, extra=""):
    return (f"<html><body><div class='top'>Welcome to our site</div><div class='text'><h1>Title {i}</h1><p>Own words {i} and {i * i}</p>"
            f"<div class='x7'>Rate this now</div></div><div class='low'>Terms</div>{extra}</body></html>")


def test_style_tree_removes_what_a_site_repeats(spark):
    rows = [(i, f"http://a.com/{i}", html(i)) for i in range(8)] + [(100, "http://b.com/1", html(1))]
    rows += [(200 + i, f"http://c.com/{i}", "<body><article><h1>Same</h1><p>The same article</p><div class='vote'>Vote</div></article></body>") for i in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r.text for r in pages.extract(df).collect()}
    for i in range(8):
        assert got[i] == f"Title {i}\n\nOwn words {i} and {i * i}"
    assert got[100] == "Welcome to our site\n\nTitle 1\n\nOwn words 1 and 1\n\nRate this now\n\nTerms"  # one page tells nothing
    assert {got[200 + i] for i in range(9)} == {"Same\n\nThe same article"}
    tree = {(r.host, r.path): r for r in pages.style_tree(df).collect()}
    assert tree["a.com", path("html", "body", "div#top")].importance == 0
    assert tree["a.com", path("html", "body", "div#text", "p")].content == 1
    assert tree["a.com", path("html", "body", "div#low")].pages == 8


def path(*styles):
    at = pages.hash64("")
    for s in styles:
        at = pages.hash64(f"{at}>{s}")
    return at


def test_given_pages(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in pages.extract(df).collect():
        article = r.html[r.html.index("<article>"):]
        article = article[: article.find("</article>")] if "</article>" in article else article
        import html as library
        import re

        want = [" ".join(library.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(x for x in want if x) and r.n_chars == len(r.text)


def test_odd_rows(spark):
    rows = [(1, None, "<article>a</article>", "t"), (2, "http://a.com", None, "t"), (2, "http://a.com", "", "t"), (3, "x", "<p>" + "long " * 300_000, "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = pages.extract(df)
    assert out.columns == ["page_id", "url", "html", "text", "n_chars"]
    assert sorted((r.page_id, r.n_chars) for r in out.collect()) == [(1, 1), (2, 0), (2, 0), (3, 1_499_999)]
    assert pages.extract(df.limit(0)).count() == 0


def test_names_never_rule_out_the_article():
    body = "<article><h1>T</h1><p>Words</p></article>"
    for page in (f'<body class="cookies-not-set">{body}', f'<body class="nav-open comments">{body}', body.replace("<article", '<article class="post comments-open"'),
                 f'<div id="content-share">{body}</div>', f'<main class="related"><div class="ad">{body}</div></main>', f'<div class="social"><main>{body}</main></div>',
                 f'<main>{body.replace("<article", "<article class=comments-open")}</main>', f'<div class="comments-open">{body}</div>'):
        assert pages.main_text(page + "".join(NOISE)) == "T\n\nWords", page
    for noise in ('<div class="related-posts"><article>Other</article></div>', '<ol class="comment-list"><li><article>Me</article></ol>', '<section id="respond"><main>You</main></section>'):
        assert pages.main_text(f"<body>{noise}{body}{noise}") == "T\n\nWords", noise
    assert pages.main_text(body.replace("</article>", "<article class='comment'>Me too</article></article>")) == "T\n\nWords"
