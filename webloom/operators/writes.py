"""Registry and cache as tables that are written to: opening tabs, recording outcomes, upserting and clearing the cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from webloom.operators import cache, registry
from webloom.sources.store import KeyedTable

TAB_ROWS = "id string, agent_id string, url string, canonical_url string, status string, source string, bytes_md long, error string, opened_at long, fetched_at long, markdown string"
CACHE_ROWS = "url string, tab_id string, source string, fetched_at long, expires_at long"


class Registry:
    """Tabs by id and cache rows by URL, under one folder. Every write can be run again without another effect."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        schema = lambda ddl: StructType.fromDDL(ddl)
        self.tabs = KeyedTable(spark, f"{path}/tabs", schema(TAB_ROWS), "id", buckets)
        self.cache = KeyedTable(spark, f"{path}/cache", schema(CACHE_ROWS), "url", buckets)

    def open(self, urls: DataFrame, agent: Column, now: Column) -> list[int]:
        """A pending tab for each of `urls` (url, seq). Tabs that are there already stay as they are."""
        new = registry.opened(urls, agent, now).dropDuplicates(["id"])
        kept = self.tabs.schema.fieldNames()

        def combine(old: DataFrame, new: DataFrame) -> DataFrame:
            return old.unionByName(new.join(old.select("id"), "id", "left_anti"), allowMissingColumns=True).select(*kept)

        return self.tabs.change(new, combine)

    def record(self, outcomes: DataFrame) -> tuple[list[int], list[int]]:
        """Outcomes (id, source, markdown or null, canonical_url, error, fetched_at), one a tab, written to their tabs; the ready ones'
        URLs are cached. Outcomes of unknown tabs are left out."""
        told = registry.recorded(outcomes.withColumn("url", F.col("id"))).withColumnRenamed("url", "id")
        told = outcomes.select("id", "markdown", "canonical_url", "fetched_at").join(told, "id")
        set_ = ["status", "source", "bytes_md", "error", "markdown", "canonical_url", "fetched_at"]

        def combine(old: DataFrame, new: DataFrame) -> DataFrame:
            both = old.alias("o").join(new.select("id", F.struct(*set_).alias("n")), "id", "left")
            return both.select("id", "agent_id", "url", "opened_at", *[F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in set_])

        tabs = self.tabs.change(told, combine)
        ready = self.tabs.read().join(outcomes.select("id"), "id", "left_semi")
        return tabs, self.upsert(cache.record(ready))

    def upsert(self, rows: DataFrame) -> list[int]:
        """Cache rows put in by URL: of a URL's rows the freshest stays."""
        return self.cache.put(rows, ["fetched_at", "tab_id"])

    def clear(self, everything: bool = False) -> tuple[int, int]:
        """Empties the cache, and the tabs if everything goes; (cache rows, tab rows) that went."""
        return self.cache.clear(), self.tabs.clear() if everything else 0
