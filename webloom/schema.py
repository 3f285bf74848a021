"""Schemas of the engine's tables. Times are epoch milliseconds; no schema is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    kinds = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "binary": T.BinaryType(), "boolean": T.BooleanType()}
    fields = []
    for part in spec.split(","):
        name, kind = part.split()
        fields.append(T.StructField(name, kinds[kind.rstrip("!")], not kind.endswith("!")))
    return T.StructType(fields)


AGENTS = _struct("id string!, name string, created_at long!, last_seen_at long!, metadata string")
TABS = _struct(
    "id string!, agent_id string, url string!, canonical_url string, title string, status string!, source string, quality_hint string,"
    "error string, token_count long, bytes_html long, bytes_md long, opened_at long!, fetched_at long, closed_at long"
)
TAB_CONTENT = _struct("tab_id string!, markdown string, raw_html binary, screenshot binary, headers string")
TAB_HISTORY = _struct("tab_id string!, seq long!, event string, at long")
FETCH_CACHE = _struct("url string!, tab_id string!, fetched_at long!, expires_at long, etag string, last_modified string")
CAPTURES = _struct("url string!, accept string, fetcher string, canonical_url string, status int, content_type string, body binary")
CANDIDATES = _struct("url string!, tier int!, source string, markdown string, canonical_url string, title string, bytes_html long")
EVAL_RUNS = _struct("run_ts long!, category string, url string, result string, source string, bytes long, ms long")

TABLES = {"agents": AGENTS, "tabs": TABS, "tab_content": TAB_CONTENT, "tab_history": TAB_HISTORY, "fetch_cache": FETCH_CACHE, "captures": CAPTURES, "candidates": CANDIDATES, "eval_runs": EVAL_RUNS}

# The names that a stored source, a quality hint and a tab's status may have.
SOURCES = ["accept_md", "cloudflare", "llms_index", "llms_full", "adapter", "pdf", "parse", "headless", "wayback", "alt_link", "reader"]
STATUSES = ["pending", "ready", "failed"]
