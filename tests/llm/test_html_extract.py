import html
import re

from markscope.llm.html_extract import extract, extract_main_text

PAGE = """<html><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav>
<div class="cookie-notice">We use cookies, please agree.</div>
<div id="content"><article><h1>Title &amp; more</h1><p>First, a   paragraph with <b>bold</b>ness &lt;kept&gt;, and commas, many.</p>
<div class="ad">Buy now, cheap, good.</div><p>Second one<br>after break</p><ul><li>an item</li></ul>
<aside>Side story, not ours.</aside><form>Name <input></form><script>if (a < b) x("</p>")</script></article>
<section class="comments"><p>I disagree, strongly, with all of it, and with more.</p></section></div>
<footer>&copy; us</footer></body></html>"""


def test_page_parts():
    assert extract(PAGE) == "Title & more First, a paragraph with boldness <kept>, and commas, many. Second one after break an item"


def test_without_article_tag():
    page = "<body><div class=menu><a href=1>One</a> <a href=2>Two</a></div><div><p>Some text, long enough, to be scored, as it has commas.</p><p>More text, here.</p></div><div class=sidebar><p>Other, things, to, read, with, many, commas.</p></div></body>"
    assert extract(page) == "Some text, long enough, to be scored, as it has commas. More text, here."


def test_edge_cases():
    assert extract(None) == extract("") == extract("<script>x</script>") == ""
    assert extract("<article><p>broken off <b") == "broken off"
    assert extract("<article><p>a < b and c &amp d") == "a < b and c & d"
    assert extract("<ARTICLE><P>one<P>two</ARTICLE>") == "one two"
    assert extract('<article><p title="unclosed>x</p>') in ("x", "")
    assert len(extract("<article><p>" + "word " * 300_000)) == 5 * 300_000 - 1


def test_inline_boilerplate_and_siblings():
    assert extract('<article><p>one <span class="advert">buy <span>now</span></span> two <b hidden>no</b> three</p></article>') == "one two three"
    assert extract('<article><div class="article-header"><h1>Title</h1></div><p>Text, of it, all.</p><div class="page-header"><p>Menu.</p></div></article>') == "Title Text, of it, all."
    assert extract("<body><div><p>Some text, long enough, to be scored, as it has commas.</p><p>More.</p></div><p>The end.</p></body>") == "Some text, long enough, to be scored, as it has commas. More. The end."
    assert extract("<article><p>" + "<button>" * 20_000 + "x</p>") == "x"


def test_planted_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r for r in extract_main_text(pages.withColumn("text", pages.url)).collect()}
    for r in pages.collect():
        inside = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)
        inside = re.sub(r"<[^<>]*$", "", inside[1])
        want = " ".join(html.unescape(re.sub(r"</?(?:p|h1|br)\b[^>]*>", " ", inside).replace("<b>", "").replace("</b>", "")).split())
        assert got[r.page_id].text == want
        assert got[r.page_id].n_chars == len(want)
    assert extract_main_text(pages.limit(0)).count() == 0
