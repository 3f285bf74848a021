"""Queries over predicates, URL functions and text transforms, each with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.functions import predicates as P
from webloom.functions import text as X
from webloom.functions import urls as U
from webloom.plans import fixtures as V
from webloom.plans.registry import Registry

R = Registry()
_S = P.SPACE
_S2 = _S.replace("{", "{{").replace("}", "}}")  # for templates
_TRIM = f"strlen(regexp_replace({{0}}, '^[{_S2}]+|[{_S2}]+$', '', 'g'))"
_WORDS = f"len(regexp_extract_all({{0}}, '[^{_S2}]+'))"
_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_HEAD = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^@/?#]*@)?"
_HOST = f"lower(regexp_extract({{0}}, '{_HEAD}([^:/?#]*)', 1))"
_PATH = f"regexp_extract({{0}}, '{_HEAD}[^/?#]*([^?#]*)', 1)"
_EXT = f"{_LOW.format('list_last(string_split(' + _PATH + ', chr(46)))')}"
_THIN = f"({_TRIM} < {{1}} OR {_WORDS} < {{2}})"
_BLOCK = "(strlen({0}) <= 4096 AND (" + " OR ".join("contains(" + _LOW + ", '" + p.replace("'", "''") + "')" for p in P.BLOCK_PHRASES) + "))"


def stub(c: str) -> str:
    return _THIN.format(c, 200, 40)


def thin(c: str) -> str:
    return _THIN.format(c, 100, 20)


def block(c: str) -> str:
    return _BLOCK.format(c)


def trim_size(c: str) -> str:
    return _TRIM.format(c)


def url_host(c: str) -> str:
    return _HOST.format(c)


def _on(view, column, expr):
    """A query that adds one column to a view's key."""
    key = {"captures": "page_id", "pages_text": "page_id", "page_md": "page_id", "documents": "doc_id", "tabs": "id"}[view]

    def run(spark, d):
        rows = V.read(spark, d, view) if view == "documents" else getattr(V, view)(spark, d)
        return rows.select(key, expr().alias(column))

    return run


def _sql(view, column, expr):
    key = {"captures": "page_id", "pages_text": "page_id", "page_md": "page_id", "documents": "doc_id", "tabs": "id"}[view]
    q = f"SELECT {key}, {expr} AS {column} FROM {view}"
    return q if view == "documents" else V.sql(q, view)


def simple(name, view, expr, sql, column=None):
    R.add(name, _on(view, column or name, expr), _sql(view, column or name, sql))


_ct, _url, _body, _text, _md = (lambda c=c: F.col(c) for c in ("content_type", "url", "body", "text", "md"))

# predicates
simple("is_html_ct", "captures", lambda: P.is_html(_ct()), f"coalesce(contains({_LOW.format('content_type')}, 'html'), false)")
simple("is_text_plain_ct", "captures", lambda: P.is_text_plain(_ct()), f"coalesce(starts_with({_LOW.format('content_type')}, 'text/plain'), false)")
simple(
    "looks_like_markdown_ct", "captures", lambda: P.looks_like_markdown(_ct(), _url()),
    f"coalesce(regexp_matches(lower(content_type), '^text/(x-)?markdown') OR (starts_with(lower(content_type), 'text/plain') AND {_EXT.format('url')} IN ('md', 'markdown')), false)",
)
simple("real_content", "captures", lambda: P.has_real_content(_body()), f"NOT {_THIN.format('body', 32, 8)}")
simple("looks_like_stub", "documents", lambda: P.looks_like_stub(_text()), stub("text"))
simple("worth_escalating", "documents", lambda: P.worth_escalating(_text()), thin("text"))
simple("bot_block", "captures", lambda: P.looks_like_bot_block(_body()), block("body"))
simple("md_probe_eligible", "captures", lambda: P.markdown_probe_eligible(_url()), f"{_EXT.format('url')} NOT IN ('md', 'markdown', 'txt', 'json', 'xml', 'css', 'js')")
R.add(
    "html_masquerade",
    lambda s, d: V.read(s, d, "pages").select("page_id", P.html_masquerade(F.col("html")).alias("html_masquerade"), P.html_masquerade(F.concat(F.lit("x"), "html")).alias("shifted")),
    f"SELECT page_id, regexp_matches(html, '^[{_S}]*(<!DOCTYPE html|<html)') AS html_masquerade, regexp_matches('x' || html, '^[{_S}]*(<!DOCTYPE html|<html)') AS shifted FROM pages",
)
simple("pdf_url", "captures", lambda: P.looks_like_pdf_url(_url()), f"ends_with({_LOW.format('list_last(string_split(' + _PATH.format('url') + ', chr(47)))')}, '.pdf')")
R.add(
    "pdf_body",
    lambda s, d: V.captures(s, d).select("page_id", P.is_pdf_body(F.col("content_type"), F.encode(F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("%PDF-"), "body")).otherwise(F.col("body")), "UTF-8")).alias("pdf_body")),
    V.sql("SELECT page_id, coalesce(contains(lower(content_type), 'pdf') OR starts_with(lower(content_type), 'application/octet-stream'), true) AND page_id % 2 = 0 AS pdf_body FROM captures", "captures"),
)
R.add(
    "archive_guard",
    lambda s, d: V.pages_text(s, d).select("page_id", P.is_archive(F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://Web.archive.org/web/1/"), "url")).otherwise(F.col("url"))).alias("is_archive")),
    "SELECT page_id, page_id % 3 = 0 AS is_archive FROM pages",
)
simple("origin_root", "captures", lambda: P.is_origin_root(F.regexp_replace(_url(), r"(//[^/]*)/[^/]*$", "$1/")), f"{_PATH.format(chr(39).join(['regexp_replace(url, ', '(//[^/]*)/[^/]*$', ', ', chr(92) + '1/', ')']))} IN ('/', '')")
_EVAL_BODY = r"regexp_replace(body, '(?s)^> \[!warning\] \*\*webloom:.*?\n---\n\n?', '')"
_EVAL = (
    "(list_sum(list_transform(string_split(regexp_replace({0}, '\\n$', ''), chr(10)), lambda x: strlen(trim(regexp_replace(x, '[ \\t]+', ' ', 'g'), ' ')) + 1)) >= 200"
    r" AND len(regexp_extract_all({0}, '[^ \t\n\x0B\f\r]+')) >= 40)"
)


def eval_pass(c: str) -> str:
    return _EVAL.format(_EVAL_BODY.replace("body", c, 1))


simple("eval_pass", "documents", lambda: P.eval_passes(_text()), eval_pass("text"))
_NOW = "(SELECT max(fetched_at) FROM tabs)"
R.add(
    "snapshot_usable",
    lambda s, d: (
        V.pages_text(s, d)
        .select("page_id", F.to_json(F.struct((F.col("page_id") % 3 > 0).alias("available"), F.when(F.col("page_id") % 5 > 0, (F.col("page_id") % 5 * 100).cast("string")).alias("status"))).alias("j"))
        .select("page_id", F.from_json("j", "available boolean, status string").alias("j"))
        .select("page_id", P.snapshot_usable(F.col("j.available"), F.col("j.status")).alias("usable"))
    ),
    "SELECT page_id, page_id % 3 > 0 AND page_id % 5 IN (0, 2) AS usable FROM pages",
)

# URLs
simple("url_valid", "captures", lambda: U.valid(F.when(F.col("page_id") % 4 == 0, F.lit("not a url")).otherwise(_url())), "page_id % 4 <> 0", "valid")
R.add("host_key", lambda s, d: V.read(s, d, "pages").groupBy(U.host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("pages")), f"SELECT {_HOST.format('url')} AS host, count(*) AS pages FROM pages GROUP BY 1")
R.add(
    "md_suffix_url",
    lambda s, d: V.read(s, d, "pages").select("page_id", U.markdown_url(F.col("url")).alias("md_url")),
    f"""SELECT page_id, regexp_extract(url, '({_HEAD}[^/?#]*)', 1) || CASE WHEN {_PATH.format('url')} IN ('/', '') THEN '/index.md' ELSE regexp_replace({_PATH.format('url')}, '/$', '') || '.md' END
        || regexp_extract(url, '^[^?#]*(.*)$', 1) AS md_url FROM pages""",
)
R.add("canonical_match_key", lambda s, d: V.read(s, d, "pages").select("page_id", U.match_key(F.col("url")).alias("key")), "SELECT page_id, regexp_replace(regexp_extract(url, '^([^#]*)', 1), '/$', '') AS key FROM pages")
R.add(
    "wayback_probe_url",
    lambda s, d: V.read(s, d, "pages").select("page_id", U.archive_probe(F.concat("url", F.lit("&a b+%"))).alias("probe")),
    "SELECT page_id, 'https://archive.org/wayback/available?url=' || replace(replace(replace(replace(replace(url || '&a b+%', '%', '%25'), '#', '%23'), '&', '%26'), '+', '%2B'), ' ', '%20') AS probe FROM pages",
)
R.add(
    "wayback_id_form",
    lambda s, d: V.read(s, d, "pages").select("page_id", U.archive_raw(F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://web.archive.org/web/2009"), F.col("page_id"), F.lit("/"), "url")).otherwise(F.col("url"))).alias("raw_url")),
    "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://web.archive.org/web/2009' || page_id || 'id_/' || url END AS raw_url FROM pages",
)
simple("charset_header", "captures", lambda: U.charset_of_header(_ct()), "nullif(trim(regexp_extract(content_type, '(?i)(?:^|;)\\s*charset=\\s*[\"'']*([^;\"'']*)', 1)), '')", "charset")
R.add(
    "meta_charset",
    lambda s, d: V.read(s, d, "pages").select("page_id", U.charset_of_meta(F.col("html")).alias("charset")),
    "SELECT page_id, nullif(regexp_extract(substring(html, 1, 4096), '(?i)<meta[^>]*?charset\\s*=\\s*[\"'']?([^\\s>/;\"'']+)', 1), '') AS charset FROM pages",
)
R.add("title_sniff", lambda s, d: V.read(s, d, "pages").select("page_id", U.title(F.col("html")).alias("title")), r"SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title FROM pages")
simple("first_h1", "page_md", lambda: U.first_heading(_md()), "trim(regexp_extract(md, '(?m)^# (.*)$', 1))", "h1")

# text
_POST = (
    r"CASE WHEN {0} = '' THEN '' ELSE regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace({0}, chr(13) || chr(10), chr(10)), '[\t\x0B\f\r \x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+(\n|$)', '\1', 'g'),"
    r" '\n{{3,}}', chr(10) || chr(10), 'g'), '^\n+', chr(10)), '\n$', '') || chr(10) END"
)
R.add(
    "postprocess",
    lambda s, d: V.read(s, d, "documents").select("doc_id", F.md5(X.postprocess(F.regexp_replace("text", r"\. ", ".  \n\n \n"))).alias("md5")),
    f"SELECT doc_id, md5({_POST.format('x')}) AS md5 FROM (SELECT doc_id, regexp_replace(text, '\\. ', '.  ' || chr(10) || chr(10) || ' ' || chr(10), 'g') AS x FROM documents)",
)
# a document's lines are indented for its title, so that none of them ends the first page
R.add(
    "pdf_postprocess",
    lambda s, d: V.read(s, d, "documents").select("doc_id", X.pdf_text(F.replace(F.replace(F.col("text"), F.lit("fi"), F.lit("ﬁ")), F.lit("th"), F.lit("t-\nh"))).alias("text"), X.pdf_title(F.concat(F.lit("\n \n "), F.replace(F.col("text"), F.lit("\n"), F.lit("\n ")), F.lit("\n---\n"))).alias("title")),
    """SELECT doc_id, regexp_replace(replace(replace(text, 'fi', 'ﬁ'), 'th', 't-' || chr(10) || 'h'), '(\\p{L})-\\n([a-z])', '\\1\\2', 'g').replace('ﬁ', 'fi') AS text,
       list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1] AS title FROM documents""",
)
R.add(
    "human_bytes",
    lambda s, d: V.read(s, d, "documents").select("doc_id", X.human_bytes(F.col("n_chars") * F.col("n_chars") * 7).alias("size")),
    """SELECT doc_id, CASE WHEN n >= 1073741824 THEN printf('%.1f GB', n / 1073741824.0) WHEN n >= 1048576 THEN printf('%.1f MB', n / 1048576.0) WHEN n >= 1024 THEN printf('%.1f KB', n / 1024.0) ELSE n || ' B' END AS size
       FROM (SELECT doc_id, n_chars * n_chars * 7 AS n FROM documents)""",
)
_T = lambda s, d: V.tabs(s, d).crossJoin(F.broadcast(V.tabs(s, d).agg(F.max("fetched_at").alias("now"))))
R.add(
    "age_short",
    lambda s, d: _T(s, d).select("id", X.age_short(F.col("now") - F.col("fetched_at")).alias("age")),
    V.sql(
        f"""SELECT id, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN s // 60 || 'm' WHEN s < 86400 THEN s // 3600 || 'h' ELSE s // 86400 || 'd' END AS age
        FROM (SELECT id, ({_NOW} - fetched_at) // 1000 AS s FROM tabs)""",
        "tabs",
    ),
)
R.add(
    "relative_time",
    lambda s, d: _T(s, d).select("id", X.relative_time(F.col("fetched_at"), F.col("now") - 86_400_000).alias("at")),
    V.sql(
        f"""SELECT id, CASE WHEN fetched_at <= n THEN (n - fetched_at) // 1000 || 's ago (' || fetched_at // 1000 || ')' ELSE 'in ' || (fetched_at - n) // 1000 || 's (' || fetched_at // 1000 || ')' END AS at
        FROM (SELECT id, fetched_at, {_NOW} - 86400000 AS n FROM tabs)""",
        "tabs",
    ),
)
R.add("ellipsis_truncate", lambda s, d: V.read(s, d, "documents").select("doc_id", X.ellipsis(F.col("text"), 60).alias("short")), "SELECT doc_id, CASE WHEN length(text) > 60 THEN substring(text, 1, 59) || '…' ELSE text END AS short FROM documents")
R.add(
    "shell_escape",
    lambda s, d: V.read(s, d, "documents").select("doc_id", X.shell_quote(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("it's "), "text")).otherwise(F.col("source"))).alias("arg")),
    """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '''' || replace('it''s ' || text, '''', '''\\''''') || '''' ELSE source END AS arg FROM documents""",
)
R.add("token_estimate", lambda s, d: V.read(s, d, "documents").select("doc_id", X.token_estimate(F.col("text")).alias("tokens")), "SELECT doc_id, strlen(text) // 4 AS tokens FROM documents")
R.add("token_count", lambda s, d: V.read(s, d, "documents").select("doc_id", P.word_count(F.col("text")).alias("words")), f"SELECT doc_id, {_WORDS.format('text')} AS words FROM documents")
R.add("html_strip_visible", lambda s, d: V.pages_text(s, d).select("page_id", F.md5("v").alias("md5"), F.octet_length("v").alias("bytes")), V.sql("SELECT page_id, md5(v) AS md5, strlen(v) AS bytes FROM pages_text", "pages_text"))
R.add(
    "line_range",
    lambda s, d: V.read(s, d, "documents").select("doc_id", X.line_range(F.when(F.col("doc_id") % 3 > 0, F.concat(F.col("doc_id"), F.lit(":"), F.col("n_chars"))).otherwise("x")).alias("r")).select("doc_id", "r.start", "r.end"),
    """SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN doc_id::INT END AS start, CASE WHEN doc_id % 3 > 0 THEN n_chars::INT END AS "end" FROM documents""",
)
R.add(
    "body_cap",
    lambda s, d: V.read(s, d, "documents").select("doc_id", F.md5(X.body_cap(F.col("text"), 1000)).alias("md5")),
    "SELECT doc_id, md5(CASE WHEN strlen(text) > 1000 THEN substring(text, 1, 1000) || '…[truncated; ' || strlen(text) - strlen(substring(text, 1, 1000)) || ' more bytes]' ELSE text END) AS md5 FROM documents",
)
R.add("base64_readme", lambda s, d: V.read(s, d, "documents").select("doc_id", F.md5(X.base64_text(F.base64(F.encode("text", "UTF-8")))).alias("md5")), "SELECT doc_id, md5(text) AS md5 FROM documents")
R.add(
    "hn_strip_html",
    lambda s, d: V.read(s, d, "documents").select("doc_id", X.comment_text(F.concat(F.lit("<p>"), F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("</p>a<br>b<br/><i>&lt;c&gt;</i> &amp;quot;"))).alias("text")),
    "SELECT doc_id, chr(10) || chr(10) || text || 'a' || chr(10) || 'b' || chr(10) || '<c> &quot;' AS text FROM documents",
)
_BANNER = "'> [!warning] **webloom: site rejected our automated request**' || chr(10) || '>' || chr(10) || '> The body below is the rejection page of ' || {h} || ', not real content.' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || {b}"
R.add(
    "bot_banner",
    lambda s, d: V.captures(s, d).select("page_id", F.when(P.looks_like_bot_block(F.col("body")), X.block_banner(U.host(F.col("url")), F.col("body"))).otherwise(F.col("body")).alias("md")),
    V.sql(f"SELECT page_id, CASE WHEN {block('body')} THEN {_BANNER.format(h=url_host('url'), b='body')} ELSE body END AS md FROM captures", "captures"),
)
R.add("banner_strip", lambda s, d: V.captures(s, d).select("page_id", X.strip_banner(X.block_banner(U.host(F.col("url")), F.col("body"))).alias("md")), V.sql("SELECT page_id, body AS md FROM captures", "captures"))
_ASCII = r"regexp_replace(md, '[^\x00-\x7F]', 'x', 'g')"
_LAST = "(length({t}) - instr(reverse({t}), reverse({m})) - length({m}) + 2)"


def _truncate_sql(tokens: int) -> str:
    target = max(0, 4 * tokens - X.RESERVE)
    start = max(0, target - X.WINDOW)
    nl = "chr(10)"
    table = f"{nl} || '## Links' || {nl}"
    marks = [f"({nl} || '# ')", f"({nl} || '## ')", f"({nl} || '### ')", f"({nl} || {nl})", nl]
    at = lambda m: f"CASE WHEN contains(w, {m}) THEN {start} + {_LAST.format(t='w', m=m)} END"
    return f"""SELECT page_id, CASE WHEN length(md) <= {4 * tokens} THEN md
        WHEN length(body) <= {4 * tokens} THEN rtrim(regexp_replace(body, '\\s+$', '')) || chr(10) || chr(10) || printf('<!-- truncated by webloom: dropped link table, ~%d tokens / %d bytes omitted -->', (length(md) - length(body)) // 4, length(md) - length(body)) || chr(10)
        ELSE regexp_replace(substring(body, 1, cut), '\\s+$', '') || chr(10) || chr(10) || printf('<!-- truncated by webloom: ~%d tokens / %d bytes omitted%s -->', (length(md) - cut) // 4, length(md) - cut,
             CASE WHEN length(body) < length(md) THEN ' (link table dropped first)' ELSE '' END) || chr(10) END AS md
        FROM (SELECT *, coalesce({", ".join(at(m) for m in marks)}, {target}) AS cut FROM (
        SELECT *, substring(substring(body, 1, {target}), {start + 1}, {X.WINDOW}) AS w FROM (
        SELECT page_id, md, CASE WHEN contains(md, {table}) THEN substring(md, 1, {_LAST.format(t='md', m=f'({table})')} - 1) ELSE md END AS body FROM (
        SELECT page_id, {_ASCII} || CASE WHEN page_id % 2 = 0 THEN chr(10) || '## Links' || chr(10) || repeat('[L1]: https://x/y' || chr(10), (page_id % 40)::INT) ELSE '' END AS md FROM page_md))))"""


def _linked(s, d):
    md = F.regexp_replace("md", r"[^\x00-\x7F]", "x")
    table = F.concat(F.lit("\n## Links\n"), F.repeat(F.lit("[L1]: https://x/y\n"), (F.col("page_id") % 40).cast("int")))
    return V.page_md(s, d).select("page_id", F.concat(md, F.when(F.col("page_id") % 2 == 0, table).otherwise("")).alias("md"))


R.add("truncate_ascii", lambda s, d: X.truncated_ascii(_linked(s, d), "md", 300), V.sql(_truncate_sql(300), "page_md"))


def extraction_report(spark, d):
    """Per host: pages, stubs, rejections, bytes, words and links of the visible text. Scan to aggregate without a UDF."""
    html = F.col("html")
    v = X.visible_text(html)
    rows = V.read(spark, d, "pages").select(U.host(F.col("url")).alias("host"), U.title(html).alias("title"), v.alias("v"), F.regexp_count(html, F.lit("<a [^>]*href=")).alias("links"))
    return rows.groupBy("host").agg(
        F.count(F.lit(1)).alias("pages"), F.count("title").alias("titled"), F.count_if(P.looks_like_stub(F.col("v"))).alias("stubs"), F.count_if(P.worth_escalating(F.col("v"))).alias("thin"),
        F.count_if(P.looks_like_bot_block(F.col("v"))).alias("rejected"), F.sum(F.octet_length("v")).cast("long").alias("bytes"), F.sum(P.word_count(F.col("v"))).cast("long").alias("words"), F.sum("links").cast("long").alias("links"),
    )


R.add(
    "extraction_report",
    extraction_report,
    V.sql(
        f"""SELECT {url_host('p.url')} AS host, count(*) AS pages, count(nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '')) AS titled, count(*) FILTER (WHERE {stub('v')}) AS stubs,
        count(*) FILTER (WHERE {thin('v')}) AS thin, count(*) FILTER (WHERE {block('v')}) AS rejected, sum(strlen(v))::BIGINT AS bytes, sum({_WORDS.format('v')})::BIGINT AS words,
        sum(len(regexp_extract_all(html, '<a [^>]*href=')))::BIGINT AS links FROM pages p JOIN pages_text USING (page_id) GROUP BY 1""",
        "pages_text",
    ),
)
