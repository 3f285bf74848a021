"""Queries that call the engine's SQL table functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom import sql
from webloom.engine import Engine
from webloom.operators import cache as C
from webloom.plans import fixtures as V
from webloom.plans import index_queries
from webloom.plans import table_queries as Q
from webloom.plans.registry import Registry

R = Registry()


def _over_documents(s, d) -> None:
    """The functions over tabs that are the documents."""
    tabs = V.read(s, d, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("agent_id"), F.concat(F.lit("https://d/"), "doc_id").alias("url"), F.lit(None).cast("string").alias("canonical_url"),
        F.lit("ready").alias("status"), F.lit("parse").alias("source"), F.col("doc_id").alias("opened_at"), F.col("n_chars").cast("long").alias("fetched_at"), F.col("text").alias("markdown"),
    )
    agents = V.read(s, d, "documents").groupBy(F.col("source").alias("id")).agg(F.max("doc_id").alias("last_seen_at")).select("id", F.upper("id").alias("name"), "last_seen_at", F.lit(None).cast("string").alias("metadata"))
    sql.register(s, Engine(tabs, agents, C.record(tabs), 1_000_000))


def _called(statement: str):
    def run(s, d):
        _over_documents(s, d)
        return s.sql(statement)

    return run


R.add("sql_search", _called("SELECT * FROM web_search('license')"), Q.R.sql["search_plain"])
R.add("sql_search_fuzzy", _called("SELECT * FROM web_search('licenze', 'fuzzy')"), Q.R.sql["search_fuzzy"])
R.add("sql_search_phrase", _called("SELECT * FROM web_search('Licenze, undr', 'fuzzy')"), index_queries.R.sql["search_fuzzy_phrase"])
R.add("sql_search_page", _called("SELECT * FROM web_search('the') ORDER BY tab_id, line_number LIMIT 50"), Q.R.sql["search_topk"])
_TABS = "SELECT doc_id, CASE WHEN text = '' THEN [] ELSE string_split(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\\n$', ''), chr(10)) END AS p FROM documents"
R.add(
    "sql_read_tab",
    _called("SELECT t.* FROM web_tabs w, LATERAL web_read_tab(w.id, 2, 4) t"),
    f"SELECT doc_id AS tab_id, greatest(1, least(2, n))::BIGINT AS first, greatest(1, least(4, n))::BIGINT AS last, array_to_string(p[greatest(1, least(2, n)):greatest(1, least(4, n))], chr(10)) AS content FROM (SELECT *, len(p) AS n FROM ({_TABS}))",
)
R.add("sql_cache_get", _called("SELECT c.url, c.tab_id, c.age_s FROM web_tabs w, LATERAL web_cache_get(w.url) c WHERE w.id % 3 = 0"), "SELECT 'https://d/' || doc_id AS url, doc_id AS tab_id, (1000000 - n_chars) // 1000 AS age_s FROM documents WHERE doc_id % 3 = 0")
R.add("sql_sessions", _called("SELECT * FROM web_sessions()"), "SELECT source AS id, upper(source) AS name, max(doc_id) AS last_seen_at, CAST(NULL AS VARCHAR) AS note, count(*) AS tabs, count(*) AS ready FROM documents GROUP BY source")
