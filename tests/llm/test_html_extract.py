import html
import math
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from webloom.llm.html_extract import INLINE, extract, extract_pages, measure, parse

SITE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
<header class="site-header"><a href=/>Home</a> Welcome banner</header><nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav>
<div id="cookie-notice">We use cookies, accept them all please now.</div>
%s
<aside class=sidebar>Popular posts are listed here</aside><div class="comments"><p>First! I disagree with everything that was said.</p></div>
<form><label>Mail</label><input name=x><button>Send</button></form><footer>&copy; 2020 footer</footer></body></html>"""
BODY = "<h1>Head &amp; title</h1><p>One <b>bold</b> and\n  <i>it</i>alic &lt;text&gt;.<p>Second para<br>line two.</p><ul><li>item a<li>item b</ul>"
WANT = "Head & title\n\nOne bold and italic <text>.\n\nSecond para line two.\n\nitem a\n\nitem b"


def test_article_without_furniture():
    assert extract(SITE % f"<article>{BODY}<div class=ad>Buy now</div><script>var t='</p>';</script></article>") == WANT
    assert extract(SITE % f"<main>{BODY}</main>") == WANT


def test_density_finds_the_article_without_semantic_tags():
    long = "".join(f"<p>Paragraph {i} has a good number of words, as an article has, and goes on for a while.</p>" for i in range(5))
    page = SITE % f"<div><div><a href=1>x</a> <a href=2>y</a></div><div><div>{long}</div><div>{long}</div></div></div>"
    got = extract(page)
    assert got.count("Paragraph") == 10 and got.startswith("Paragraph 0") and "cookies" not in got and "Popular" not in got and "disagree" not in got


def test_density_decides_beside_an_article_tag():
    long = "".join(f"<p>Paragraph {i} has a good number of words, as an article has, and goes on for a while.</p>" for i in range(9))
    teaser = "<article><a href=/x>More</a> <a href=/y>stories</a> to read</article>"
    got = extract(SITE % f"<div>{teaser}</div><div>{long}</div>")
    assert got.count("Paragraph") == 9 and "cookies" not in got
    got = extract(SITE % f"<article><p>A short lead of some words.</p></article><div>{long}</div>")
    assert got.count("Paragraph") == 9 and "disagree" not in got
    assert extract(SITE % f"<article>{BODY}</article><ul><li><a href=/a>Other</a><li><a href=/b>pages</a><li><a href=/c>here</a></ul>") == WANT


def test_reader_comments_under_many_names():
    for attributes in ("id=readerComments", 'class="user-comments"', "class=usercomments", 'class="comment-list wp"', "id=disqus_thread"):
        assert extract(SITE % f"<article>{BODY}<div {attributes}><p>Nonsense, all of it!</p></div></article>") == WANT
    assert extract(SITE % f"<article>{BODY}</article><section><article class='comment-body'><p>Me too</p></article></section>") == WANT
    assert extract(SITE % f"<article class='post no-comments'>{BODY}<p class=commentary>Kept.</p></article>") == WANT + "\n\nKept."


def test_parts_of_an_article_named_like_furniture():
    inner = "<h2 id='related-work'>Related work</h2><p>%s</p><section id='discussion'><h2 class='share-prices'>Share prices</h2><p class='social-history'>Social history.</p></section>" % ("Some words here. " * 9).strip()
    assert extract(SITE % f"<article>{inner}</article>") == "\n\n".join(["Related work", ("Some words here. " * 9).strip(), "Share prices", "Social history."])
    links = "<ul><li><a href=/1>One</a><li><a href=/2>Two</a><li><a href=/3>Three</a></ul>"
    assert extract(SITE % f"<article>{BODY}{links}</article>") == WANT + "\n\nOne\n\nTwo\n\nThree"
    assert extract(SITE % f"<article>{BODY}<p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p></article>") == WANT + "\n\nSo x=2 holds."
    assert extract(SITE % f"<article>{BODY}<p class='ad'>Buy this.</p><ol id='thread'><li>me too</ol></article>").startswith(WANT)
    assert "Buy" not in extract(SITE % f"<article>{BODY}<p class='ad'>Buy this.</p></article>")


def test_headline_beside_the_chosen_node():
    long = "".join(f"<p>Paragraph {i} has a good number of words, as an article has, and goes on for a while.</p>" for i in range(9))
    got = extract(SITE % f"<div><h1>The headline</h1><div class=meta><a href=/x>x</a></div><div>{long}</div></div>")
    assert got.startswith("The headline\n\n") and got.count("Paragraph") == 9 and got.count("headline") == 1


def test_ends_of_comments():
    assert extract(SITE % f"<article><!-->{BODY}<!-- a --!><!---></article>") == WANT


def test_stray_end_tags_take_linear_time():
    began = time.perf_counter()
    extract("<div>" * 20_000 + "</section>" * 20_000 + "x")
    assert time.perf_counter() - began < 3


def naive(node):
    """Composite density of a node and the sum of its blocks', each counted anew from its subtree."""
    def count(n, in_link=False):
        chars = links = tags = link_tags = 0
        for c in n.children:
            if isinstance(c, str):
                chars += len(re.sub(r"\s+", "", c))
            elif not c.skip:
                a = count(c)
                chars, links, tags, link_tags = chars + a[0], links + a[1], tags + a[2] + 1, link_tags + a[3] + (c.tag == "a")
        return chars, chars if n.tag == "a" else links, tags, link_tags

    root = node
    while root.parent:
        root = root.parent
    rate = count(root)[1] / max(1, count(root)[0])

    def density(n):
        c, lc, t, lt = count(n)
        if n.skip or not c:
            return 0.0
        t1, lc1, lt1 = max(1, t), max(1, lc), max(1, lt)
        return c / t1 * math.log(max(c / lc1 * t1 / lt1, 1 + 1e-9)) / math.log(c / max(1, c - lc) * lc1 + rate * c + math.e)

    return density(node), sum(density(c) for c in node.children if not isinstance(c, str) and not c.skip and c.tag not in INLINE)


def test_densities_against_brute_force(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()][:12] + [SITE % f"<div>{BODY}<div>{BODY}</div></div>"]
    for page in pages:
        for node in measure(parse(page)):
            density, total = naive(node)
            assert math.isclose(node.density, density, abs_tol=1e-9) and math.isclose(node.total, total, abs_tol=1e-9)


def test_broken_markup():
    assert extract("<article><p><b>one<br><p>two</p>three < four & five</article") == "one\n\ntwo\n\nthree < four & five"
    assert extract("just text") == "just text"
    assert extract('<p title="a > b">x</p><p title=">y</p>') != ""
    assert extract("<article><!-- no --><p>a&nbsp;b&#x41;&#66;</p></article>") == "a bAB"
    for bad in ("", None, "<", "<a", "</", "<!--", "<script>", "<p", "<![CDATA[x"):
        assert isinstance(extract(bad), str)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/pab!-\"'= \n&;dclsi", max_size=120))
def test_any_input_parses(page):
    extract(page)
    parse(page)


def test_long_and_nested_pages():
    assert extract("<div>" * 20_000 + "deep") == "deep"
    assert len(extract("<article>" + "<p>word word</p>" * 20_000 + "</article>")) == 20_000 * 11 - 2
    extract('<a "' * 20_000)


def plain(page):
    """A brute-force reading of the pages that the test tables hold: their one article, cut at block tags."""
    inner = re.search(r"(?s)<article>(.*?)</article>", page)[1]
    parts = re.split(r"</?(?:h1|p)\b[^>]*>", inner)
    return "\n\n".join(t for t in (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0].startswith("<br") else "", x))).strip() for x in parts) if t)


def test_all_pages_against_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: plain(r.html) for r in pages.collect()}
    got = extract_pages(pages).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_odd_rows(spark):
    rows = [(1, None, None), (None, "u", ""), (2, "u", "<p>x"), (2, "u", "<p>x")]
    got = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((repr(r.page_id), r.text) for r in got) == [("1", ""), ("2", "x"), ("2", "x"), ("None", "")]
    assert extract_pages(spark.createDataFrame([], "page_id long, url string, html string, text int")).count() == 0


A, B = "Alpha paragraph of the story with enough words to be a paragraph.", "Beta paragraph of the story that has about as many words as the first."


def test_short_parts_of_an_article_stay():
    for around in ("%s", "<nav><a href=/>x</a></nav><h1>Site</h1>%s<footer>f</footer>"):
        page = "<html><body>" + around % f"<article><div><p>{A}</p><p>{B}</p></div><div><h2>End</h2><p>Short close.</p></div></article>" + "</body></html>"
        assert extract(page).endswith(f"{A}\n\n{B}\n\nEnd\n\nShort close.")
    refs = "<div><h2>References</h2><ol><li><a href=/1>First source</a></li><li><a href=/2>Second source</a></li><li><a href=/3>Third</a></li></ol></div>"
    assert extract(SITE % f"<article><div><p>{A}</p><p>{B}</p></div>{refs}</article>") == f"{A}\n\n{B}\n\nReferences\n\nFirst source\n\nSecond source\n\nThird"


def test_headlines_and_leads_beside_the_text():
    story = f"<div class=story><p>{A}</p><p>{B}</p><p>{A}</p></div>"
    assert extract(SITE % f'<div class="hero"><h1>Headline</h1></div>{story}') == f"Headline\n\n{A}\n\n{B}\n\n{A}"
    assert extract(SITE % f'<div><div class="lead"><p>Lead para of story.</p></div>{story}</div>') == f"Lead para of story.\n\n{A}\n\n{B}\n\n{A}"
    assert extract(SITE % f"<div>{story}<div><p>And it all ended very well indeed.</p></div></div>") == f"{A}\n\n{B}\n\n{A}\n\nAnd it all ended very well indeed."
    assert "2020" not in extract(SITE % f"<div>{story}<div><p>© 2020 by some company, all rights reserved.</p></div></div>")


def test_a_list_of_links_within_a_story():
    links = "<ul><li><a href=/1>One</a><li><a href=/2>Two</a><li><a href=/3>Three</a></ul>"
    assert extract(SITE % f"<div><p>{A}</p>{links}<p>{B}</p><p>{A}</p></div>") == f"{A}\n\nOne\n\nTwo\n\nThree\n\n{B}\n\n{A}"
    assert extract(SITE % f"<div>{links}<p>{A}</p><p>{B}</p><p>{A}</p></div>") == f"{A}\n\n{B}\n\n{A}"


def test_compound_names_are_not_furniture():
    for name in ("related-work", "social-context", "share-prices", "ad-hoc-networks", "comment-ca-va", "widget-theory", "cookie-recipes"):
        for attribute in ("class", "id"):
            assert extract(SITE % f"<article><p>{A}</p><div {attribute}='{name}'><p>{B}</p></div></article>") == f"{A}\n\n{B}"
    for part in ("<section id='discussion'><p>%s</p></section>", "<div class='thread'><p>%s</p></div>", "<div id='notice-of-meeting'><p>%s</p></div>", "<p class='disclaimer'>%s</p>"):
        assert extract(SITE % f"<div><p>{A}</p>{part % B}<p>{A}</p></div>") == f"{A}\n\n{B}\n\n{A}"


def test_names_that_are_furniture():
    names = "related-posts social-share share-buttons cookie-notice comment-list newsletter-signup site-footer user-comments sidebar-left ad-slot ads adBanner reader-opinions readerReactions userComments comments-area notice login-form main-menu promo-box entry-footer article-share"
    for name in names.split():
        assert extract(SITE % f"<article><p>{A}</p><div class='{name}'><p>{B}</p></div><p>{A}</p></article>") == f"{A}\n\n{A}", name
        assert extract(SITE % f"<div><p>{A}</p><p>{A}</p><div class='x {name}'><p>{B}</p></div><p>{A}</p></div>") == f"{A}\n\n{A}\n\n{A}", name
    onward = "<div class='more-stories'><a href=/1>One</a> <a href=/2>Two</a> <a href=/3>Three</a></div>"
    assert extract(SITE % f"<article><p>{A}</p>{onward}<p>{B}</p></article>") == f"{A}\n\n{B}"
    talk = "<div class=thread><div class=msg><p>I was first here.</p></div><div class=msg><p>And I was second, I believe.</p></div></div>"
    assert extract(SITE % f"<div><p>{A}</p><p>{B}</p>{talk}</div>") == f"{A}\n\n{B}"
