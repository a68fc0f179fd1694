import duckdb

from cinelake.llm import html
from cinelake.llm.queries import QUERIES
from tests.llm.tools import SF


def test_pages_of_the_table(spark):
    pages = dict(duckdb.sql(f"SELECT page_id, html FROM '{SF}/pages.parquet'").fetchall())
    got = {r["page_id"]: r for r in QUERIES["op7_main_text"](spark, SF).collect()}
    assert set(got) == set(pages)
    import re
    from html import unescape

    for i, page in pages.items():
        article = re.search(r"<article>(.*?)(?:</article>|<footer)", page, re.S).group(1)
        lines = [" ".join(unescape(re.sub(r"<[^>]*>", " " if "br" in x else "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article.replace("<br>", " "))]
        assert got[i]["text"] == "\n".join(x for x in lines if x)
        assert got[i]["n_chars"] == len(got[i]["text"])


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>if (a < b) { "</p>" }</script></head><body class="has-sidebar">
<header class="site-header"><h2>Site</h2><nav><a href=/>Home</a></nav></header>
<div class="cookie-notice">We use cookies, as everybody does, and you may agree.</div>
<main><article><h1>A &amp; B</h1><p class="lead">First   paragraph, with <b>bold</b>&nbsp;text and a <a href="x">link</a>.
<p>Second one<br>goes on; it is long enough to count. &lt;tag&gt; &#233;&#x4e2d;
<ul><li>one, two<li>three.</ul><aside>Related things, here.</aside>
<div class="share-buttons">Share this!</div><!-- hidden <p>no</p> --><pre>x
 y</pre><form><input name=q>Search the site, please.</form></article>
<section id="comments"><p>Nice article, thanks for it, really.</p></section></main>
<div id="sidebar"><p>Popular posts, every day, again.</p></div><footer>&copy; us.</footer></body></html>"""


def test_boilerplate_blocks_and_references():
    assert html.main_text(PAGE).split("\n") == ["A & B", "First paragraph, with bold text and a link.", "Second one goes on; it is long enough to count. <tag> é中", "one, two", "three.", "x y"]


def test_page_without_article_element():
    page = "<html><body><div class=menu><a href=a>Home</a> <a href=b>About</a></div><table><tr><td><a href=1>x</a></td><td><a href=2>y</a></td></tr></table><div class=post><h2>Title</h2>" + "".join(f"<p>Sentence number {i}, which has commas, and ends here. And then another one follows.</p>" for i in range(6)) + "</div></body></html>"
    got = html.main_text(page).split("\n")
    assert [x for x in got if x.startswith("Sentence")] == [f"Sentence number {i}, which has commas, and ends here. And then another one follows." for i in range(6)]
    assert not any(x in ("x", "y", "Home About") for x in got)


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "plain text, no tags"), (4, "u", "<p>one<p>two"), (4, "u", "<p>one<p>two"), (5, "u", "<nav>only</nav>"), (6, "u", "<<<>>> < p"), (7, "u", "<article>" + "<p>word, </p>" * 20000 + "</article>"), (None, "u", "<div><p>x</div>"), (8, "u", "<script>never closed <p>x</p>"), (9, "u", "<p>a</b></i></p></div><p title='>'>b")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'z' as text", "1 as n_chars")
    got = {}
    for r in html.extract(pages).collect():
        got.setdefault(r["page_id"], []).append(r["text"])
    assert got[1] == got[2] == got[5] == got[8] == [""]
    assert got[3] == ["plain text, no tags"] and got[4] == ["one\ntwo"] * 2 and got[None] == ["x"]
    assert got[7][0].count("\n") == 19999 and got[9] == ["a\nb"]
    assert html.extract(pages.filter("false")).count() == 0


ARTICLE = "<h1>The title</h1>" + "".join(f"<p>Sentence {i} of the article, with commas, and an end. Then one more follows it.</p>" for i in range(4))
LINES = ["The title", *[f"Sentence {i} of the article, with commas, and an end. Then one more follows it." for i in range(4)]]


def lines_of(body):
    return html.main_text(f"<html><body><nav><a href=/>Home</a></nav>{body}<footer>Us</footer></body></html>").split("\n")


def test_class_words_do_not_rule_out_what_holds_the_article():
    for wrapper in ("post comments-enabled", "layout has-sidebar", "no-comments", "content search-result", "widget-area", "banner"):
        assert lines_of(f'<div class="{wrapper}"><article>{ARTICLE}</article></div>') == LINES, wrapper
        assert lines_of(f'<div class="{wrapper}">{ARTICLE}</div>') == LINES, wrapper
    assert lines_of(f'<article>{ARTICLE}<div class="related-posts"><p>Read this too, please.</p></div></article><div class="comments"><p>Nice one, thanks.</p></div>') == LINES
    assert lines_of(f'<div id="comments"><article>{ARTICLE}</article></div><div class="sidebar"><p>Popular, every day.</p></div>') == LINES


def test_formulas_noscript_and_named_sections_of_an_article_stay():
    got = lines_of(f'<article>{ARTICLE}<p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p><section class="related-work"><p>Others did it before.</p></section><noscript><p>Told without scripts.</p></noscript></article><noscript>Enable scripts!</noscript>')
    assert got == [*LINES, "So x=2 holds.", "Others did it before.", "Told without scripts."]


def test_nested_asides_and_a_page_without_article_text():
    assert lines_of(f"<main>{ARTICLE}<aside>One <aside>Two</aside> three</aside></main>") == LINES
    assert lines_of('<form><p>Search, please.</p></form><div hidden><p>Not shown.</p></div>') == [""]
