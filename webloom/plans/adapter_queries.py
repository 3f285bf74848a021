"""Queries over the adapter tier and comment threads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.operators import adapter_chain as K
from webloom.operators import adapters as A
from webloom.operators import threads as H
from webloom.operators import waterfall as W
from webloom.plans import fixtures as V
from webloom.plans.registry import Registry
from webloom.plans.table_queries import _CLASS
from webloom.plans.text_queries import trim_size

R = Registry()

# An address of each kind for a document N.
_KINDS = [
    "https://github.com/o/r/blob/main/dN.md", "https://github.com/o/rN", "https://github.com/o/r/issues/N", "https://en.wikipedia.org/wiki/Page_N",
    "https://news.ycombinator.com/newest?p=N", "https://pypi.org/project/pN/", "https://www.npmjs.com/package/pN", "https://example.com/N",
]


def _asked(s, d) -> DataFrame:
    """Documents with an address of one of the kinds, and the body that its API would answer with."""
    i, c = F.col("doc_id"), F.col
    url = F.replace(F.element_at(F.array(*[F.lit(u) for u in _KINDS]), (i % 8 + 1).cast("int")), F.lit("N"), i.cast("string"))
    readme = F.to_json(F.struct(F.base64(F.encode("text", "UTF-8")).alias("content"), F.lit("base64").alias("encoding")))
    issue = F.to_json(F.struct(i.alias("number"), c("source").alias("title"), c("text").alias("body"), F.lit("open").alias("state"), F.struct(c("lang").alias("login")).alias("user")))
    pypi = F.to_json(F.struct(F.struct(c("text").alias("description"), F.lit("text/markdown").alias("description_content_type"), F.lit("1").alias("version")).alias("info")))
    npm = F.to_json(F.struct(c("text").alias("readme")))
    wiki = F.concat(F.lit("<section><p>"), "source", F.lit(" <b>"), "n_chars", F.lit("</b></p></section>"))
    bodies = F.array(c("text"), readme, issue, wiki, F.lit("{}"), pypi, npm, F.lit("x"))
    body = F.when((i % 7 == 3) & ~(i % 8).isin(0, 3), F.lit("not json {")).otherwise(F.element_at(bodies, (i % 8 + 1).cast("int")))
    return V.read(s, d, "documents").select("doc_id", url.alias("url"), body.alias("body"))


def _captures(asked: DataFrame) -> DataFrame:
    """What asking the APIs gave: nothing for some, an error for some, broken JSON for some."""
    own = asked.where("doc_id % 11 <> 5").withColumn("api", A.api_url(F.col("url"))).where("api is not null")
    return own.select(F.col("api").alias("url"), F.when(F.col("doc_id") % 5 == 1, 404).otherwise(200).alias("status"), "body")


_URL = f"replace([{', '.join(repr(u) for u in _KINDS)}][doc_id % 8 + 1], 'N', doc_id::VARCHAR)"
_MD = """CASE doc_id % 8 WHEN 0 THEN text WHEN 1 THEN text
    WHEN 2 THEN '# ' || source || chr(10) || chr(10) || '_Issue #' || doc_id || ' · open · @' || lang || '_' || chr(10) || chr(10) || text || chr(10)
    WHEN 3 THEN '# Page ' || doc_id || chr(10) || chr(10) || source || ' **' || n_chars || '**' || chr(10)
    WHEN 5 THEN '# p' || doc_id || chr(10) || chr(10) || '_PyPI · 1_' || chr(10) || chr(10) || CASE WHEN text <> '' THEN '---' || chr(10) || chr(10) || text || chr(10) ELSE '' END
    WHEN 6 THEN '# p' || doc_id || chr(10) || chr(10) || '_npm package · v?_' || chr(10) || chr(10) || CASE WHEN text <> '' THEN '---' || chr(10) || chr(10) || text || chr(10) ELSE '_(no README found in registry or unpkg)_' || chr(10) END END"""
_ATTEMPTS = f"""m AS (SELECT *, {_URL} AS url, {_MD} AS md FROM documents WHERE doc_id % 8 NOT IN (4, 7)),
    o AS (SELECT doc_id, url, CASE doc_id % 8 WHEN 3 THEN 'wikipedia' WHEN 5 THEN 'pypi' WHEN 6 THEN 'npm' ELSE 'github' END AS adapter,
        CASE WHEN doc_id % 11 = 5 THEN 'missing' WHEN doc_id % 5 = 1 THEN 'failed' WHEN doc_id % 7 = 3 AND doc_id % 8 NOT IN (0, 3) THEN 'declined' WHEN doc_id % 8 < 2 AND {trim_size('text')} = 0 THEN 'declined' ELSE 'ok' END AS outcome, md FROM m)"""
R.add(
    "adapter_attempts",
    lambda s, d: (lambda a: K.attempts(a, _captures(a)))(_asked(s, d)).select("url", "adapter", "outcome", F.md5("markdown").alias("md5")),
    f"WITH {_ATTEMPTS} SELECT url, adapter, outcome, CASE WHEN outcome = 'ok' THEN md5(md) END AS md5 FROM o",
)
R.add(
    "adapter_tier",
    lambda s, d: (lambda a: K.adapter_tier(a, _captures(a)))(_asked(s, d)).select("url", "tier", "source", F.md5("markdown").alias("md5")),
    f"WITH {_ATTEMPTS} SELECT url, 4 AS tier, 'adapter' AS source, md5(md) AS md5 FROM o WHERE outcome = 'ok'",
)


def _candidates(s, d) -> DataFrame:
    """The adapter tier beside what the page itself gives, so that a URL whose adapter declines reaches the next tier."""
    asked = _asked(s, d)
    own = K.adapter_tier(asked, _captures(asked)).select("url", "tier", "source", "markdown")
    page = asked.join(V.read(s, d, "documents").select("doc_id", "text"), "doc_id")
    return own.union(page.select("url", F.lit(6), F.lit("parse"), F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("page "), "text"))))


R.add(
    "adapter_fall_through",
    lambda s, d: W.decide(_candidates(s, d), "off").select("url", "tier", "source", F.md5("markdown").alias("md5")),
    f"""WITH {_ATTEMPTS}, candidates AS (SELECT url, 4 AS tier, 'adapter' AS source, md AS markdown FROM o WHERE outcome = 'ok'
        UNION ALL SELECT {_URL}, 6, 'parse', CASE WHEN doc_id % 3 > 0 THEN 'page ' || text END FROM documents), {_CLASS},
        r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY outcome, CASE WHEN outcome = 'ok' THEN tier ELSE -size END, tier) AS rn FROM c WHERE outcome <> 'failed')
        SELECT url, tier, source, md5(markdown) AS md5 FROM r WHERE rn = 1""",
)

# threads: a document's text as a comment, its source as an answer to that, its language as a second comment
_node = lambda author, text, *children: F.struct(author.alias("author"), text.alias("text"), F.col("n_chars").alias("points"), (F.array(*children) if children else F.array().cast("array<string>")).alias("children"))


def _hn_threads(s, d) -> DataFrame:
    c = F.col
    item = F.to_json(F.struct(c("doc_id").alias("id"), c("source").alias("title"), F.array(_node(c("lang"), c("text"), _node(F.lit("b"), c("source"))), _node(F.lit(""), c("lang"), _node(F.lit("x"), F.lit("")))).alias("children")))
    return V.read(s, d, "documents").select("doc_id", F.when(c("doc_id") % 9 == 4, F.lit("{")).otherwise(item).alias("body"))


_SPLIT = "string_split(regexp_replace(t, '\\n$', ''), chr(10))"
_PLAIN = "SELECT *, replace(replace(replace(replace(text, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&') AS t FROM documents WHERE doc_id % 9 <> 4"
R.add(
    "hn_comments",
    lambda s, d: H.comments(_hn_threads(s, d), "doc_id", "body", "hackernews").select(F.col("id").alias("doc_id"), F.array_join("path", ".").alias("path"), "depth", "author", F.md5("text").alias("md5"), "score"),
    f"""WITH p AS ({_PLAIN}) SELECT doc_id, '0' AS path, 0 AS depth, lang AS author, md5(t) AS md5, n_chars AS score FROM p UNION ALL SELECT doc_id, '0.0', 1, 'b', md5(source), n_chars FROM p
        UNION ALL SELECT doc_id, '1', 0, '', md5(lang), n_chars FROM p UNION ALL SELECT doc_id, '1.0', 1, 'x', md5(''), n_chars FROM p""",
)
R.add(
    "hn_comment_markdown",
    lambda s, d: H.thread_markdown(H.comments(_hn_threads(s, d), "doc_id", "body", "hackernews"), "hackernews").select(F.col("id").alias("doc_id"), F.md5("md").alias("md5")),
    f"""WITH p AS ({_PLAIN}) SELECT doc_id, md5(CASE WHEN t <> '' THEN array_to_string(list_transform({_SPLIT}, lambda x: '**' || lang || '**: ' || x || chr(10)), '') || chr(10) ELSE '' END
        || '> **b**: ' || source || chr(10) || '> ' || chr(10) || '**?**: ' || lang || chr(10) || chr(10)) AS md5 FROM p""",
)
