"""The URL cache as relational operators. Times are epoch milliseconds and `now` is always given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions.predicates import fresh_for_lookup, fresh_for_stats


def ttl_seconds(source: Column) -> Column:
    return F.when(source == "parse", 3600).when(source.isin("headless", "wayback"), 1800).otherwise(86400)


def quality_hint(source: Column) -> Column:
    """What a source says about its text."""
    return (
        F.when(source.isin("accept_md", "llms_full", "llms_index"), "authoritative")
        .when(source.isin("cloudflare", "alt_link"), "negotiated")
        .when(source.isin("adapter", "reader", "pdf"), "adapted")
        .when(source == "parse", "parsed")
        .when(source == "headless", "rendered")
        .when(source == "wayback", "archived")
    )


def record(tabs: DataFrame) -> DataFrame:
    """Cache rows of ready tabs: of one URL the freshest, ties by the larger tab id. One shuffle, aggregated before it."""
    freshest = F.max(F.struct("fetched_at", "id", "source"))
    rows = tabs.where("status = 'ready'").groupBy("url").agg(freshest.alias("x"))
    expires = F.col("x.fetched_at") + 1000 * ttl_seconds(F.col("x.source"))
    return rows.select("url", F.col("x.id").alias("tab_id"), F.col("x.source").alias("source"), F.col("x.fetched_at").alias("fetched_at"), expires.cast("long").alias("expires_at"))


def upsert(cache: DataFrame, new: DataFrame) -> DataFrame:
    """`cache` with the rows of `new` put in by URL; what was fetched later wins."""
    w = Window.partitionBy("url").orderBy(F.desc("fetched_at"), F.desc("tab_id"))
    return cache.unionByName(new).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def get(cache: DataFrame, tabs: DataFrame, now: Column) -> DataFrame:
    """Cache rows with their tab: url, tab_id, source, canonical_url, age_s."""
    t = tabs.select(F.col("id").alias("tab_id"), F.coalesce("canonical_url", "url").alias("canonical_url"))
    age = F.floor((now - F.col("fetched_at")) / 1000).cast("long")
    return cache.join(t, "tab_id").select("url", "tab_id", "source", "canonical_url", "expires_at", age.alias("age_s"))


def lookup_fresh(cache: DataFrame, tabs: DataFrame, now: Column) -> DataFrame:
    return get(cache.where(fresh_for_lookup(F.col("expires_at"), now)), tabs, now)


def stats(cache: DataFrame, now: Column, stored: DataFrame | None = None, md_col: str = "markdown") -> DataFrame:
    """entries, fresh, expired, oldest, newest; with the stored tabs also md_bytes, of all of them, cached or not."""
    fresh = F.count_if(fresh_for_stats(F.col("expires_at"), now))
    n = F.count(F.lit(1))
    out = cache.agg(n.alias("entries"), fresh.alias("fresh"), (n - fresh).alias("expired"), F.min("fetched_at").alias("oldest"), F.max("fetched_at").alias("newest"))
    if stored is None:
        return out
    return out.crossJoin(stored.agg(F.coalesce(F.sum(F.octet_length(md_col)), F.lit(0)).cast("long").alias("md_bytes")))  # one row each


def clear(cache: DataFrame, tabs: DataFrame, everything: bool) -> DataFrame:
    """What a clear would remove: cache_rows, tab_rows."""
    n = cache.agg(F.count(F.lit(1)).alias("cache_rows"))
    t = tabs.agg(F.count(F.lit(1)).alias("tab_rows")) if everything else tabs.sparkSession.range(1).select(F.lit(0).cast("long").alias("tab_rows"))
    return n.crossJoin(t)  # one row each


def cleared(cache: DataFrame, tabs: DataFrame, everything: bool) -> tuple[DataFrame, DataFrame]:
    """Cache and tabs after a clear, for the caller to write: no cache rows, and tabs only if not everything goes."""
    return cache.limit(0), tabs.limit(0) if everything else tabs


def gating(requests: DataFrame) -> DataFrame:
    """Adds reads_cache and writes_cache: raw requests do neither, no_cache ones still write."""
    return requests.withColumn("reads_cache", ~(F.col("no_cache") | F.col("raw"))).withColumn("writes_cache", ~F.col("raw"))


def without_memo(requests: DataFrame, memo: DataFrame) -> DataFrame:
    """Requests to hosts that no negative memo holds."""
    return requests.join(memo, "host", "left_anti")


def as_of(cache_log: DataFrame, probes: DataFrame) -> DataFrame:
    """For each probe (url, at) the last cache row of its URL fetched by then: an as-of join in one window, without a range join."""
    log = cache_log.select("url", F.col("fetched_at").alias("at"), F.struct("tab_id", "fetched_at", "expires_at").alias("row"), F.lit(0).alias("probe"))
    asked = probes.select("url", "at", F.lit(None).cast(log.schema["row"].dataType).alias("row"), F.lit(1).alias("probe"))
    w = Window.partitionBy("url").orderBy("at", "probe").rowsBetween(Window.unboundedPreceding, 0)
    seen = log.union(asked).withColumn("last", F.last("row", ignorenulls=True).over(w)).where("probe = 1")
    return seen.select("url", "at", F.col("last.tab_id").alias("tab_id"), (F.coalesce(F.col("last.expires_at") >= F.col("at"), F.lit(False))).alias("fresh"))
