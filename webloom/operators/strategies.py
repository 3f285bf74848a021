"""Strategy tiers as DataFrame transforms from captures to candidates; a tier declines by returning no row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import predicates as P
from webloom.functions import text as X
from webloom.functions import urls as U


def accept_md(captures: DataFrame) -> DataFrame:
    """Captures that came as markdown."""
    body = F.col("body")
    ok = (F.col("status") < 400) & P.looks_like_markdown(F.col("content_type"), F.col("url")) & P.has_real_content(body)
    return captures.where(ok).select("url", F.lit(1).alias("tier"), F.lit("accept_md").alias("source"), body.alias("markdown"), U.first_heading(body).alias("title"))


def markdown_probe(urls: DataFrame, captures: DataFrame, memo: DataFrame | None = None) -> DataFrame:
    """URLs whose .md variant was captured as text. Those of hosts in `memo` (host; see failed_hosts) aren't probed."""
    if memo is not None:
        urls = urls.join(memo.select(F.col("host").alias("failed")).distinct(), U.host(F.col("url")) == F.col("failed"), "left_anti")
    body = F.col("c.body")
    good = (F.col("c.status") < 400) & (P.looks_like_markdown(F.col("c.content_type"), F.col("c.url")) | P.is_text_plain(F.col("c.content_type")))
    good = good & ~P.html_masquerade(body) & P.has_real_content(body)
    asked = urls.where(P.markdown_probe_eligible(F.col("url"))).select("url", U.markdown_url(F.col("url")).alias("probe"))
    return asked.join(captures.alias("c"), F.col("probe") == F.col("c.url")).where(good).select(
        asked["url"], F.lit(2).alias("tier"), F.lit("cloudflare").alias("source"), body.alias("markdown"), U.first_heading(body).alias("title")
    )


def failed_hosts(probes: DataFrame) -> DataFrame:
    """(host) of which no probe (url, ok) succeeded: the negative memo."""
    return probes.groupBy(U.host(F.col("url")).alias("host")).agg(F.max("ok").alias("any")).where("not any").select("host")


def llms_entries(indexes: DataFrame) -> DataFrame:
    """(host, pos, title, url) of the list items of llms.txt files (host, text) that link to a page."""
    shape = r"^\s*[-*]\s*\[([^\]]*)\]\((http[^)\s]*)\)"
    rows = indexes.select("host", F.posexplode(F.split("text", "\r?\n")).alias("pos", "line")).where(F.col("line").rlike(shape))
    return rows.select("host", "pos", F.trim(F.regexp_extract("line", shape, 1)).alias("title"), F.regexp_extract("line", shape, 2).alias("url"))


def llms_match(urls: DataFrame, entries: DataFrame) -> DataFrame:
    """For each URL the first entry of its host that names the same page."""
    keyed = entries.select("host", U.match_key(F.col("url")).alias("key"), "pos", F.struct("pos", "title", F.col("url").alias("entry")).alias("e"))
    first = keyed.groupBy("host", "key").agg(F.min("e").alias("e"))
    asked = urls.select("url", U.host(F.col("url")).alias("host"), U.match_key(F.col("url")).alias("key"))
    return asked.join(first, ["host", "key"]).select("url", "e.pos", "e.title", "e.entry")


def llms_root(urls: DataFrame, full: DataFrame, indexes: DataFrame) -> DataFrame:
    """For origin roots the host's llms-full.txt, or else its llms.txt; full and indexes are (host, text)."""
    asked = urls.where(P.is_origin_root(F.col("url"))).select("url", U.host(F.col("url")).alias("host"))
    both = asked.join(full.select("host", F.col("text").alias("f")), "host", "left").join(indexes.select("host", F.col("text").alias("i")), "host", "left")
    use_full = F.col("f").isNotNull()
    return both.where("f is not null or i is not null").select(
        "url", F.when(use_full, "llms_full").otherwise("llms_index").alias("source"), F.concat("host", F.when(use_full, " (llms-full.txt)").otherwise(" (llms.txt)")).alias("title"), F.coalesce("f", "i").alias("markdown")
    )


def pdf(captures: DataFrame, text: Column) -> DataFrame:
    """PDF captures by URL and first bytes, with their extracted text cleaned; `text` is a column of that text."""
    ok = P.looks_like_pdf_url(F.col("url")) & (F.col("status") < 400) & P.is_pdf_body(F.col("content_type"), F.col("body"))
    md = X.postprocess(X.pdf_text(text))
    return captures.where(ok).select("url", F.lit(5).alias("tier"), F.lit("pdf").alias("source"), md.alias("markdown"), X.pdf_title(X.pdf_text(text)).alias("title"))


def parse_html(captures: DataFrame, html_col: str = "html") -> DataFrame:
    """HTML captures (or of no declared type) as markdown with the raw fallback; an error status gives a failed row."""
    from webloom.operators.html_markdown import with_raw_fallback

    ok = captures.where((F.col("status") < 400) & (F.col("content_type").isNull() | P.is_html(F.col("content_type"))))
    done = with_raw_fallback(ok, html_col).withColumn("markdown", X.postprocess(F.col("markdown"))).where(P.trimmed(F.col("markdown")) != "")
    failed = captures.where("status >= 400").select("url", F.lit(6).alias("tier"), F.lit("parse").alias("source"), F.lit(None).cast("string").alias("markdown"), F.lit(None).cast("string").alias("title"))
    return done.select("url", F.lit(6).alias("tier"), F.lit("parse").alias("source"), "markdown", "title").unionByName(failed)


def snapshots(answers: DataFrame) -> DataFrame:
    """(url, snapshot) of usable archive answers (url, body JSON), in the form that serves the page as it was."""
    j = F.from_json("body", "archived_snapshots struct<closest:struct<available:boolean,url:string,status:string>>")["archived_snapshots"]["closest"]
    rows = answers.where(~P.is_archive(F.col("url"))).select("url", j.alias("j"))
    return rows.where(P.snapshot_usable(F.col("j.available"), F.col("j.status"))).select("url", F.coalesce(U.archive_raw(F.col("j.url")), F.col("j.url")).alias("snapshot"))


def wayback(answers: DataFrame, captures: DataFrame, html_col: str = "html") -> DataFrame:
    """Tier 8: usable archive answers (url, body JSON) with the capture of their snapshot, converted; `url` stays the page's own."""
    found = snapshots(answers).join(captures.withColumnRenamed("url", "snapshot").where("status < 400"), "snapshot")
    return _rendered(found, html_col, 8, "wayback")


def headless(captures: DataFrame, html_col: str = "html") -> DataFrame:
    """Tier 7: what a browser rendered, converted like any page; a rendered page has no declared type to go by."""
    return _rendered(captures.where((F.col("fetcher") == "headless") & (F.col("status") < 400)), html_col, 7, "headless")


def _rendered(pages: DataFrame, html_col: str, tier: int, source: str) -> DataFrame:
    from webloom.operators.html_markdown import with_raw_fallback

    done = with_raw_fallback(pages, html_col).withColumn("markdown", X.postprocess(F.col("markdown"))).where(P.trimmed(F.col("markdown")) != "")
    return done.select("url", F.lit(tier).alias("tier"), F.lit(source).alias("source"), "markdown", "title")


def quiet_at(log: DataFrame, gap_ms: int = 1500, cap_ms: int | None = None) -> DataFrame:
    """(page, quiet_ms): when a page was first silent for `gap_ms` after an event; log: (page, at_ms).

    With `cap_ms` a page is taken as it is so long after its first event at the latest (a render: 12 s), and `capped` says so.
    """
    from pyspark.sql import Window

    by_page = Window.partitionBy("page").orderBy("at_ms")
    gaps = log.withColumn("next", F.lead("at_ms").over(by_page))
    silent = (F.col("next") - F.col("at_ms") >= gap_ms) | F.col("next").isNull()
    quiet = F.min(F.when(silent, F.col("at_ms"))) + gap_ms
    if cap_ms is None:
        return gaps.groupBy("page").agg(quiet.alias("quiet_ms"))
    both = gaps.groupBy("page").agg(quiet.alias("quiet"), (F.min("at_ms") + cap_ms).alias("cap"))
    return both.select("page", F.least("quiet", "cap").alias("quiet_ms"), (F.col("quiet") > F.col("cap")).alias("capped"))
