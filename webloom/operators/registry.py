"""Agents, tabs and the lists that a dashboard shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def session_list(agents: DataFrame, tabs: DataFrame) -> DataFrame:
    """Agents with their numbers of tabs; tabs are counted before the join."""
    counted = tabs.groupBy("agent_id").agg(F.count(F.lit(1)).alias("tabs"), F.count_if(F.col("status") == "ready").alias("ready"))
    return session_list_of(agents, counted)


def session_list_of(agents: DataFrame, counted: DataFrame) -> DataFrame:
    """The same from counts (agent_id, tabs, ready) that are there already."""
    both = agents.join(counted, agents["id"] == counted["agent_id"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return both.select("id", "name", "last_seen_at", F.get_json_object("metadata", "$.note").alias("note"), zero("tabs"), zero("ready"))


def recent_agents(agents: DataFrame, tabs: DataFrame, limit: int = 50) -> DataFrame:
    return session_list(agents, tabs).orderBy(F.desc("last_seen_at"), "id").limit(limit)


def recent_tabs(tabs: DataFrame, agent_id=None, limit: int = 200) -> DataFrame:
    own = tabs if agent_id is None else tabs.where(F.col("agent_id") == agent_id)
    return own.orderBy(F.desc("opened_at"), F.desc("id")).limit(limit)


def ensure_agents(agents: DataFrame, calls: DataFrame) -> DataFrame:
    """agents after calls (name, at, note): a new name is added, a known one seen again; a note replaces one only if given."""
    seen = calls.groupBy("name").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.max_by("note", F.when(F.col("note").isNotNull(), F.col("at"))).alias("note"))
    noted = F.when(F.col("note").isNotNull(), F.to_json(F.struct("note")))
    both = agents.join(seen, "name", "full")
    return both.select(
        F.coalesce(F.col("id").cast("string"), F.sha2("name", 256)).alias("id"),
        "name",
        F.coalesce("created_at", "first_at").alias("created_at"),
        F.greatest(F.coalesce("last_seen_at", "last_at"), F.coalesce("last_at", "last_seen_at")).alias("last_seen_at"),
        F.coalesce(noted, F.col("metadata")).alias("metadata"),
    )


def opened(urls: DataFrame, agent: Column, now: Column) -> DataFrame:
    """Pending tabs for `urls` (url, seq); the id is a hash of both, so a rerun gives the same."""
    return urls.select(F.sha2(F.concat_ws("#", "url", "seq"), 256).alias("id"), agent.alias("agent_id"), "url", F.lit("pending").alias("status"), now.alias("opened_at"))


def recorded(chosen: DataFrame) -> DataFrame:
    """Outcomes (url, source, markdown or null, error) as tab columns: status, bytes_md, error as JSON."""
    ok = F.col("markdown").isNotNull()
    return chosen.select(
        "url",
        F.when(ok, "ready").otherwise("failed").alias("status"),
        F.when(ok, F.col("source")).alias("source"),
        F.octet_length("markdown").alias("bytes_md"),
        F.when(~ok, F.to_json(F.struct(F.coalesce("error", F.lit("unknown")).alias("message")))).alias("error"),
    )


def envelope(rows: DataFrame) -> DataFrame:
    return rows.select("tab_id", F.to_json(F.struct("tab_id", "markdown", "source", "canonical_url", "title")).alias("body"))


def default_agent_name(pid: Column) -> Column:
    return F.concat(F.lit("cli-ppid-"), pid.cast("string"))
