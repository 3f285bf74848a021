from pyspark.sql import functions as F

from webloom.functions import predicates as P
from webloom.functions import text as X
from webloom.functions import urls as U
from webloom.operators.finalize import decoded, truncate
from webloom.operators.html_markdown import to_markdown
from webloom.operators.links import linkify

ARTICLE = "This is a sentence of an article with a few words in it. " * 12


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_stub_and_escalation(spark):
    rows = spark.createDataFrame([("",), ("   \n",), ("Home About",), (ARTICLE,), ("Loading…",), ("This domain is for use in illustrative examples in documents. You may use this domain in literature without prior coordination or asking for permission.",)], "t string")
    got = [tuple(r) for r in rows.select(P.looks_like_stub(F.col("t")), P.worth_escalating(F.col("t"))).collect()]
    assert got == [(True, True), (True, True), (True, True), (False, False), (True, True), (True, False)]


def test_rejections(spark):
    rows = spark.createDataFrame([("Your Request could NOT be processed",), ("Just a moment...",), ("Access Denied",), ("Reference #18.2",), ("please verify you are a human " + "x" * 5000,), ("fine",)], "t string")
    assert [r[0] for r in rows.select(P.looks_like_bot_block(F.col("t"))).collect()] == [True] * 4 + [False] * 2


def test_urls(spark):
    lit = F.lit
    r = one(
        spark, U.archive_raw(lit("http://web.archive.org/web/20091026/http://x.y/z")), U.archive_raw(lit("http://x.y/z")), U.archive_probe(lit("https://a.b/c?d=1&e=2#f g+h%")), U.markdown_url(lit("https://a.b")), U.markdown_url(lit("https://a.b/c/?q#f")),
        U.charset_of_header(lit('text/html; CharSet="UTF-8"')), U.charset_of_header(lit("text/html;charset=gbk")), U.charset_of_header(lit("text/html")), U.match_key(lit("https://a.b/c/#x")), U.host(lit("https://u@A.b:80/")),
    )
    assert tuple(r) == (
        "http://web.archive.org/web/20091026id_/http://x.y/z", None, "https://archive.org/wayback/available?url=https://a.b/c?d=1%26e=2%23f%20g%2Bh%25", "https://a.b/index.md", "https://a.b/c.md?q#f", "UTF-8", "gbk", None, "https://a.b/c", "a.b",
    )


def test_pdf(spark):
    r = one(spark, X.pdf_text(F.lit("hyphen-\nated eﬃcient\fnext")), P.looks_like_pdf_url(F.lit("https://a.b/X.PDF?x=1")), P.looks_like_pdf_url(F.lit("https://a.b/?f=x.pdf")))
    assert tuple(r) == ("hyphenated efficient\n\n---\n\nnext", True, False)


def test_postprocess(spark):
    cases = {"": "", "a": "a\n", "a  \n\n\n\nb\t\n": "a\n\nb\n", "\n\n\na": "\na\n", "   ": "\n", "a\r\nb": "a\nb\n", "x\n\n\n": "x\n\n"}
    rows = spark.createDataFrame([(k,) for k in cases], "t string")
    assert [r[0] for r in rows.select(X.postprocess(F.col("t"))).collect()] == list(cases.values())


def test_linkify():
    md = "[a](u) [b](v) [c](u) [d](v) [e](u) [f](w) ![i](u) `[g](u)`\n\n```\n[h](u)\n```\né"
    out = linkify(md)
    assert "[a][L1] [b][L2] [c][L1] [d][L2] [e][L1] [f](w) ![i](u) `[g](u)`" in out and out.endswith("é\n\n## Links\n\n[L1]: u\n[L2]: v\n") and "L3" not in out
    assert "[h](u)" in out
    assert linkify("[x](u) plain") == "[x](u) plain"
    assert linkify('[a [n]](u(1) "t") [b](u(1)) [c\n\nd](u(1)) [](e)').startswith("[a [n]][L1] [b][L1] [c\n\nd](u(1))")


def test_truncate(spark):
    body = "# A\n\n" + "word " * 300 + "\n\n### B\n\n" + "more " * 300
    assert truncate("short", 10) == "short"
    cut = truncate(body, 450)
    assert "### B" not in cut and len(cut.encode()) <= 1800 and "tokens /" in cut
    table = "x" * 100 + "\n## Links\n" + "[L1]: u\n" * 100
    assert truncate(table, 60).startswith("x" * 100 + "\n\n<!-- truncated") and "dropped link table" in truncate(table, 60)
    assert "�" not in truncate("é" * 3000, 200)
    for n in (60, 100, 450):
        for t in (body, table, body + "\n## Links\n[L1]: u\n"):
            assert X.truncated_ascii(spark.createDataFrame([(t,)], "md string"), "md", n).first().md == truncate(t, n)


def test_charsets(spark):
    rows = [
        (1, "text/html", "héllo".encode()), (2, "text/html; charset=shift_jis", "日本".encode("shift_jis")), (3, "text/html;charset=gbk", "中文".encode("gbk")), (4, None, b'<meta charset="euc-kr">' + "한국".encode("euc-kr")),
        (5, "text/html; charset=windows-1252", "“q”".encode("cp1252")), (6, "text/html; charset=gbk", b"\xef\xbb\xbf" + "é".encode()), (7, "text/html; charset=nope", b"ok \xff"), (8, None, None),
    ]
    got = {r.id: r.text for r in decoded(spark.createDataFrame(rows, "id int, content_type string, body binary")).collect()}
    assert got == {1: "héllo", 2: "日本", 3: "中文", 4: '<meta charset="euc-kr">한국', 5: "“q”", 6: "é", 7: "ok �", 8: None}


def test_html_to_markdown():
    page = "<body><nav><a href=x>y</a></nav><article><h1>T &amp; x</h1><p><b>bo</b> a<p>para <a href='/u'>link</a><ul><li>a<li>b</ul><pre>x  y</pre><script>z</script></article><footer>f</footer>"
    assert to_markdown(page) == "# T & x\n\n**bo** a\n\npara [link](/u)\n\n* a\n* b\n\n```\nx  y\n```\n"
    assert "[y](x)" in to_markdown(page, raw=True) and to_markdown(None) == ""


def test_one_rule_for_comments(spark):
    from webloom.functions.text import comment_text, strip_comment

    markup = "<p>a &eacute;&#x27;&#39; &amp;lt; &nope; AT&T<br/>x<br>y <a href='q'>z</a></p>"
    assert strip_comment(markup) == "\n\na é'' &lt; &nope; AT&T\nx\ny z"
    got = spark.createDataFrame([(markup,), (None,)], "t string").select(comment_text(F.col("t")).alias("t")).collect()
    assert [r.t for r in got] == [strip_comment(markup), None]


def test_bytes_are_decoded_in_one_scan(spark, tmp_path):
    spark.createDataFrame([(1, "text/html", b"a")], "id int, content_type string, body binary").write.parquet(str(tmp_path / "c"))
    plan = decoded(spark.read.parquet(str(tmp_path / "c")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Union" not in plan


def test_a_dead_host_is_a_row():
    from webloom.sources.http import _Reader

    reader = _Reader({"urls": "http://127.0.0.1:1/x nonsense http://[broken", "timeout": "2"})
    for part in reader.partitions():
        assert list(reader.read(part)) == [(part.value, "text/html", "plain", part.value, None, None, None)]


def test_probes_skip_failed_hosts(spark):
    from webloom.operators import strategies

    text = "some words that make a real page of markdown, more than eight"
    urls = spark.createDataFrame([("https://a.x/p",), ("https://b.x/p",)], "url string")
    captures = spark.createDataFrame([(f"https://{h}.x/p.md", 200, "text/markdown", text) for h in "ab"], "url string, status int, content_type string, body string")
    memo = spark.createDataFrame([("b.x",), ("b.x",)], "host string")
    assert strategies.markdown_probe(urls, captures).count() == 2
    assert [r.url for r in strategies.markdown_probe(urls, captures, memo).collect()] == ["https://a.x/p"]


def test_word_characters_are_all_but_white_space():
    import re

    from webloom.functions.predicates import NO_SPACE, SPACES

    word = re.compile("[" + re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: re.escape(chr(int(m[1], 16))), NO_SPACE) + "]")
    assert [c for c in map(chr, range(0x110000)) if (word.match(c) is None) != (c in SPACES)] == []


def test_texts_in_parts_of_a_batch(spark):
    from webloom.functions.text import AT_ONCE, by_row

    rows = [(i, None if i % 7 == 3 else f"t{i}") for i in range(2 * AT_ONCE + 1)]
    got = spark.createDataFrame(rows, "i int, t string").coalesce(1).select("i", by_row(str.upper, F.col("t")).alias("t")).collect()
    assert [tuple(r) for r in got] == [(i, t and t.upper()) for i, t in rows]


def test_an_answer_is_parsed_once(spark):
    from webloom.operators.adapters import npm_package

    row = spark.createDataFrame([('{"readme": "r", "version": "2"}', None)], "b string, r string")
    made = row.select(F.when(F.col("b") != "", npm_package(F.lit("p"), F.col("b"), F.col("r"))).alias("m"))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    assert made.first().m == "# p\n\n_npm package · v2_\n\n---\n\nr\n"
