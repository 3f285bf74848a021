"""A facade over the operators: the calls that an agent makes, for all stored tabs at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions.text import token_estimate
from webloom.operators import cache, registry, search, waterfall
from webloom.operators.finalize import finalize
from webloom.operators.textindex import TextIndex


class EngineError(Exception):
    """An operation that can't be done; `code` says which."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class FetchOptions:
    mode: str = "auto"
    no_cache: bool = False
    raw: bool = False
    link_table: bool = True
    max_tokens: int | None = None
    #: Adds bytes and an estimate of tokens.
    meta: bool = False
    #: 'json' adds the answer as one JSON text.
    format: str = "markdown"

    def __post_init__(self):
        if self.format not in ("markdown", "json"):
            raise EngineError("fetch_failed", f"no such format: {self.format}")
        if self.mode not in ("auto", "on", "off"):
            raise EngineError("fetch_failed", f"no such mode: {self.mode}")


class Engine:
    """Over tables of agents, tabs (with their markdown) and the URL cache; `now` is given, never read from a clock."""

    def __init__(self, tabs: DataFrame, agents: DataFrame, entries: DataFrame, now_ms: int, index: TextIndex | None = None):
        """index: of the tabs' markdown by their id; searches read what it leaves instead of every tab."""
        self.tabs, self.agents, self.entries, self.now, self.index = tabs, agents, entries, F.lit(now_ms), index

    def fetch(self, candidates: DataFrame, options: FetchOptions | None = None) -> DataFrame:
        """(url, tier, source, markdown, banner, cached) for the URLs of `candidates`; those that are fresh in the cache are answered
        from their tab, whose text was finished when it was stored."""
        o = options or FetchOptions()
        found = self._fetched(candidates, o)
        if o.meta:
            found = found.withColumn("bytes", F.octet_length("markdown")).withColumn("tokens", token_estimate(F.col("markdown")))
        if o.format == "json":
            found = found.withColumn("body", F.to_json(F.struct(*[c for c in found.columns if c not in ("banner", "cached")])))
        return found

    def _fetched(self, candidates: DataFrame, o: FetchOptions) -> DataFrame:
        asked = candidates
        if not (o.no_cache or o.raw):
            fresh = cache.lookup_fresh(self.entries, self.tabs, self.now).join(candidates.select("url").distinct(), "url", "left_semi")
            asked = candidates.join(fresh.select("url"), "url", "left_anti")
        chosen = waterfall.with_banner(waterfall.decide(asked, o.mode)).withColumn("cached", F.lit(False))
        if o.raw:
            return chosen
        chosen = chosen.withColumn("markdown", finalize(F.col("markdown"), o.link_table, o.max_tokens))
        if o.no_cache:
            return chosen
        stored = fresh.select("url", "tab_id", "source").join(self.tabs.select(F.col("id").alias("tab_id"), "markdown"), "tab_id")
        text = finalize(F.col("markdown"), False, o.max_tokens)
        stored = stored.select("url", waterfall.tier_of(F.col("source")).alias("tier"), "source", text.alias("markdown"), F.lit(False).alias("banner"), F.lit(True).alias("cached"))
        return chosen.unionByName(stored)

    def search(self, query: str, mode: str = "plain", limit: int = 50, before: int = 0, after: int = 0) -> DataFrame:
        if mode not in ("plain", "regex", "fuzzy"):
            raise EngineError("search_failed", f"no such mode: {mode}")
        tabs = self.index.narrowed(self.tabs, "id", query, mode) if self.index else self.tabs
        return search.search_texts(tabs, "id", "markdown", query, mode, limit, before, after)

    def read_tab(self, tab_id, lines: tuple[int, int] | None = None, section: str | None = None) -> DataFrame:
        own = self.tabs.where(F.col("id") == tab_id)
        if not own.limit(1).count():
            raise EngineError("tab_read_failed", f"no such tab: {tab_id}")
        if lines:
            return search.read_lines(own, "id", "markdown", *lines)
        whole = search.read_whole(own, "id", "markdown")
        if not section:
            return whole
        return search.read_section(own, "id", "markdown", section).unionByName(whole.where("content = ''"))

    def cache_stats(self) -> DataFrame:
        return cache.stats(self.entries, self.now, self.tabs, "markdown")

    def cache_clear(self, everything: bool = False) -> DataFrame:
        """What was removed; the engine's tables are empty afterwards."""
        out = cache.clear(self.entries, self.tabs, everything)
        self.entries = self.entries.limit(0)
        self.tabs = self.tabs.limit(0) if everything else self.tabs
        return out

    def cache_get(self, url: str) -> DataFrame:
        return cache.get(self.entries.where(F.col("url") == url), self.tabs, self.now)

    def session_start(self, name: str, at_ms: int, note: str | None = None) -> DataFrame:
        """The agent of that name, added or seen again; later calls know it."""
        call = self.agents.sparkSession.createDataFrame([(name, at_ms, note)], "name string, at long, note string")
        self.agents = registry.ensure_agents(self.agents, call)
        return self.agents.where(F.col("name") == name)

    def tab_meta(self, tab_id) -> DataFrame:
        """(tab_id, url, canonical_url, status, source) of a tab."""
        own = self.tabs.where(F.col("id") == tab_id)
        if not own.limit(1).count():
            raise EngineError("tab_read_failed", f"no such tab: {tab_id}")
        return own.select(F.col("id").alias("tab_id"), "url", F.coalesce("canonical_url", "url").alias("canonical_url"), "status", "source")

    def sessions(self) -> DataFrame:
        return registry.session_list(self.agents, self.tabs).orderBy(F.desc("last_seen_at"), "id")

    def status(self) -> DataFrame:
        return self.tabs.groupBy("status").count()
