"""Views that connect the test tables to the engine's own: captures, candidates, tabs, cache, agents, markdown, eval runs.

Each view exists twice: as DataFrame code here, and as DuckDB SQL in `SQL` for the queries' oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions.text import visible_text


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages_text(spark, d) -> DataFrame:
    return read(spark, d, "pages").select("page_id", "url", visible_text(F.col("html")).alias("v"))


def page_md(spark, d) -> DataFrame:
    """(page_id, url, md): a title line, the page's links as a list, and its visible text as a section."""
    html = F.col("html")
    anchors = F.transform(F.regexp_extract_all(html, F.lit('(<a href="[^"]*">[^<]*</a>)'), F.lit(1)), lambda a: F.regexp_replace(a, '<a href="([^"]*)">([^<]*)</a>', "* [$2]($1)"))
    title = F.trim(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1))
    md = F.concat(F.lit("# "), title, F.lit("\n\n"), F.array_join(anchors, "\n"), F.lit("\n\n## Body\n\n"), F.replace(visible_text(html), F.lit(". "), F.lit(".\n")))
    return read(spark, d, "pages").select("page_id", "url", md.alias("md"))


def captures(spark, d) -> DataFrame:
    """(page_id, url, content_type, status, fetcher, body): what fetching the pages might have given."""
    n = F.col("page_id")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("text/html; charset=utf-8", "Text/HTML", "text/plain", "text/markdown", None, "application/pdf", "text/plain; charset=gbk")]), (n % 7 + 1).cast("int"))
    status = F.when(n % 11 == 0, 404).when(n % 11 == 1, 503).otherwise(200)
    fetcher = F.element_at(F.array(F.lit("plain"), F.lit("stealth"), F.lit("headless")), (n % 3 + 1).cast("int"))
    ends = F.element_at(F.array(*[F.lit(x) for x in ("", ".md", "/a.pdf", "/doc.MD", "/web/2009/x")]), (n % 5 + 1).cast("int"))
    url = F.concat(F.regexp_replace("url", "[?#].*$", ""), ends)
    body = F.when(n % 13 == 3, "Just a moment... Checking your browser").otherwise(F.when(n % 9 == 0, "").otherwise(F.col("v")))
    return pages_text(spark, d).select("page_id", url.alias("url"), kind.alias("content_type"), status.alias("status"), fetcher.alias("fetcher"), body.alias("body"))


def tabs(spark, d) -> DataFrame:
    events, pages = read(spark, d, "events"), read(spark, d, "pages")
    n = pages.agg(F.count(F.lit(1)).alias("n_pages"))  # one row
    e = events.crossJoin(F.broadcast(n)).withColumn("page_id", F.col("event_id") % F.col("n_pages"))
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    i = F.col("event_id")
    sources = F.array(*[F.lit(x) for x in ("accept_md", "llms_full", "adapter", "parse", "headless", "wayback")])
    return e.join(pages.select("page_id", "url"), "page_id").select(
        i.alias("id"),
        F.col("user_id").alias("agent_id"),
        "url",
        F.when(i % 2 == 0, F.regexp_replace("url", "#.*$", "")).alias("canonical_url"),
        F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "pending").otherwise("ready").alias("status"),
        F.element_at(sources, (i % 6 + 1).cast("int")).alias("source"),
        ms.alias("opened_at"),
        (ms + F.floor("value").cast("long")).alias("fetched_at"),
    )


def agents(spark, d) -> DataFrame:
    """Agents of the tabs, and for every user below 5 one that never opened a tab."""
    t = tabs(spark, d).groupBy("agent_id").agg(F.min("opened_at").alias("created_at"), F.max("opened_at").alias("last_seen_at"))
    note = F.when(F.col("agent_id") % 3 == 0, F.concat(F.lit('{"note":"u'), F.col("agent_id"), F.lit('"}')))
    own = t.select(F.col("agent_id").alias("id"), F.concat(F.lit("agent-"), F.col("agent_id")).alias("name"), "created_at", "last_seen_at", note.alias("metadata"))
    idle = t.where("agent_id < 5").select(
        (-1 - F.col("agent_id")).alias("id"), F.concat(F.lit("idle-"), F.col("agent_id")).alias("name"), "created_at", F.col("created_at").alias("last_seen_at"), F.lit(None).cast("string").alias("metadata")
    )
    return own.union(idle)


def candidates(spark, d) -> DataFrame:
    """(page_id, url, tier, source, markdown, latency_ms): tiers 1 and 6, headless and archive results for each page; null failed."""
    p = read(spark, d, "pages").select("page_id", "url", F.trim(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"), visible_text(F.col("html")).alias("v"))
    n = F.col("page_id")
    cut = F.when(n % 5 == 0, "").when(n % 5 == 1, F.col("title")).otherwise(F.col("v"))
    parse = F.when(n % 10 == 3, "Just a moment...").when(n % 10 == 7, F.lit(None)).otherwise(cut)
    head = F.when(n % 4 == 0, F.col("v")).when(n % 4 == 1, F.concat("title", F.lit(" - "), "title")).when(n % 4 == 2, F.lit("Access Denied"))
    old = F.when(n % 6 == 1, F.concat(F.col("v"), F.lit(" archived")))
    rows = F.array(
        *[
            F.struct(F.lit(t).alias("tier"), F.lit(s).alias("source"), m.alias("markdown"), (n * k % 16000).alias("latency_ms"))
            for t, s, m, k in ((1, "accept_md", F.col("title"), 37), (6, "parse", parse, 611), (7, "headless", head, 997), (8, "wayback", old, 1409))
        ]
    )
    return p.select("page_id", "url", F.inline(rows))


def eval_runs(spark, d) -> DataFrame:
    """Two runs over labelled documents: category, url, rc, body, ms."""
    docs, labels = read(spark, d, "documents"), read(spark, d, "labels")
    both = docs.join(labels, "doc_id").select("doc_id", "source", "text", "quality")
    run = lambda k, body: both.select(
        F.lit(k).cast("long").alias("run_ts"), F.col("source").alias("category"), F.concat(F.lit("https://e/"), F.col("doc_id")).alias("url"),
        F.when(F.col("doc_id") % 17 == k, 3).otherwise(0).alias("rc"), body.alias("body"), (F.col("doc_id") * (7 + k) % 900).alias("ms"),
    )
    return run(1, F.col("text")).union(run(2, F.when(F.col("quality") == 1, F.col("text")).otherwise("stub")))


_V = r"trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<noscript\b.*?</noscript>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"
_TITLE = r"trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))"

SQL = {
    "pages_text": f"SELECT page_id, url, {_V} AS v FROM pages",
    "page_md": f"""SELECT page_id, url, '# ' || {_TITLE} || chr(10) || chr(10) || array_to_string(list_transform(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>'),
        lambda a: regexp_replace(a, '<a href="([^"]*)">([^<]*)</a>', '* [\\2](\\1)')), chr(10)) || chr(10) || chr(10) || '## Body' || chr(10) || chr(10) || replace({_V}, '. ', '.' || chr(10)) AS md FROM pages""",
    "captures": f"""SELECT page_id, regexp_replace(url, '[?#].*$', '') || ['', '.md', '/a.pdf', '/doc.MD', '/web/2009/x'][page_id % 5 + 1] AS url,
        ['text/html; charset=utf-8', 'Text/HTML', 'text/plain', 'text/markdown', NULL, 'application/pdf', 'text/plain; charset=gbk'][page_id % 7 + 1] AS content_type,
        CASE page_id % 11 WHEN 0 THEN 404 WHEN 1 THEN 503 ELSE 200 END AS status, ['plain', 'stealth', 'headless'][page_id % 3 + 1] AS fetcher,
        CASE WHEN page_id % 13 = 3 THEN 'Just a moment... Checking your browser' WHEN page_id % 9 = 0 THEN '' ELSE v END AS body FROM (SELECT page_id, url, {_V} AS v FROM pages)""",
    "tabs": """SELECT e.event_id AS id, e.user_id AS agent_id, p.url, CASE WHEN e.event_id % 2 = 0 THEN regexp_replace(p.url, '#.*$', '') END AS canonical_url,
        CASE e.event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'pending' ELSE 'ready' END AS status,
        ['accept_md', 'llms_full', 'adapter', 'parse', 'headless', 'wayback'][e.event_id % 6 + 1] AS source,
        (epoch_us(e.ts) // 1000) AS opened_at, (epoch_us(e.ts) // 1000) + CAST(floor(e.value) AS BIGINT) AS fetched_at
        FROM events e CROSS JOIN (SELECT count(*) AS n FROM pages) k JOIN pages p ON p.page_id = e.event_id % k.n""",
    "agents": """SELECT agent_id AS id, 'agent-' || agent_id AS name, min(opened_at) AS created_at, max(opened_at) AS last_seen_at,
        CASE WHEN agent_id % 3 = 0 THEN '{"note":"u' || agent_id || '"}' END AS metadata FROM tabs GROUP BY agent_id
        UNION ALL SELECT -1 - agent_id, 'idle-' || agent_id, min(opened_at), min(opened_at), NULL FROM tabs WHERE agent_id < 5 GROUP BY agent_id""",
    "candidates": f"""WITH p AS (SELECT page_id, url, {_TITLE} AS title, {_V} AS v FROM pages)
        SELECT page_id, url, 1 AS tier, 'accept_md' AS source, title AS markdown, page_id * 37 % 16000 AS latency_ms FROM p
        UNION ALL SELECT page_id, url, 6, 'parse', CASE WHEN page_id % 10 = 3 THEN 'Just a moment...' WHEN page_id % 10 = 7 THEN NULL WHEN page_id % 5 = 0 THEN '' WHEN page_id % 5 = 1 THEN title ELSE v END, page_id * 611 % 16000 FROM p
        UNION ALL SELECT page_id, url, 7, 'headless', CASE page_id % 4 WHEN 0 THEN v WHEN 1 THEN title || ' - ' || title WHEN 2 THEN 'Access Denied' END, page_id * 997 % 16000 FROM p
        UNION ALL SELECT page_id, url, 8, 'wayback', CASE WHEN page_id % 6 = 1 THEN v || ' archived' END, page_id * 1409 % 16000 FROM p""",
    "eval_runs": """SELECT k::BIGINT AS run_ts, source AS category, 'https://e/' || doc_id AS url, CASE WHEN doc_id % 17 = k THEN 3 ELSE 0 END AS rc,
        CASE WHEN k = 1 OR quality = 1 THEN text ELSE 'stub' END AS body, doc_id * (7 + k) % 900 AS ms
        FROM documents JOIN labels USING (doc_id), (VALUES (1), (2)) r(k)""",
}
_NEEDS = {"agents": ["tabs"]}


def sql(query: str, *views: str) -> str:
    """`query` below the named views."""
    names: list[str] = []
    for v in views:
        names += [n for n in [*_NEEDS.get(v, []), v] if n not in names]
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in names) + "\n" + query
