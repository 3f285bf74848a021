"""The engine's calls as SQL table functions, over views of its tables: SELECT * FROM web_search('license', 'plain').

They are SQL functions, so a call becomes part of the query that makes it: filters reach the scans, and a call beside a
table of queries (LATERAL) is a join like any other. The rules are those of operators.search and operators.cache.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from webloom.engine import Engine, FetchOptions
from webloom.functions.predicates import LOWER, UPPER
from webloom.operators import cache, search

_LOW = f"translate({{}}, '{UPPER}', '{LOWER}')"
_PARTS = r"CASE WHEN coalesce({0}, '') = '' THEN array() ELSE split(regexp_replace(regexp_replace({0}, '\r\n', '\n'), '\\n\\z', ''), '\n') END"

_FUNCTIONS = {
    # x: words that the fuzzy mode looks at, made once a line and not at all in other modes; bit j of the aggregate's state says that
    # the last words are near to the first j + 1 asked for
    "search": (
        "query STRING, mode STRING DEFAULT 'plain'",
        "tab_id {id}, line_number BIGINT, line STRING",
        r"""SELECT tab_id, line_number, line FROM {p}_lines LATERAL VIEW explode(array(CASE WHEN {p}_search.mode = 'fuzzy' THEN named_struct(
                'held', filter(split({low_line}, '[^\\p{{L}}\\p{{N}}]+'), w -> w <> ''),
                'asked', transform(filter(split({low_query}, '[^\\p{{L}}\\p{{N}}]+'), w -> w <> ''), (w, j) -> named_struct('w', w, 'k', CASE WHEN char_length(w) < 6 THEN 1 ELSE 2 END, 'bit', shiftleft(1L, j)))) END)) t AS x
            WHERE CASE web_mode({p}_search.mode)
            WHEN 'regex' THEN line RLIKE {p}_search.query
            WHEN 'fuzzy' THEN size(x.asked) > 0 AND aggregate(x.held, 0L, (s, w) ->
                (shiftleft(s & (shiftleft(1L, size(x.asked) - 1) - 1L), 1) | 1L)
                & aggregate(x.asked, 0L, (m, a) -> m | CASE WHEN abs(char_length(w) - char_length(a.w)) <= a.k AND levenshtein(w, a.w, a.k) >= 0 THEN a.bit ELSE 0L END)
                | CASE WHEN s & (shiftleft(1L, 62) | shiftleft(1L, size(x.asked) - 1)) <> 0L THEN shiftleft(1L, 62) ELSE 0L END,
                s -> s & (shiftleft(1L, 62) | shiftleft(1L, size(x.asked) - 1)) <> 0L)
            WHEN 'plain' THEN CASE WHEN {p}_search.query RLIKE '[A-Z]' THEN contains(line, {p}_search.query) ELSE contains({low_line}, {p}_search.query) END END""",
    ),
    "read_tab": (
        "tab {id}, first INT DEFAULT NULL, last INT DEFAULT NULL, section STRING DEFAULT NULL",
        "tab_id {id}, first BIGINT, last BIGINT, content STRING",
        r"""SELECT tab_id, first, last, CASE WHEN n > 0 AND first <= last THEN array_join(slice(parts, CAST(first AS INT), CAST(last - first + 1 AS INT)), '\n') ELSE '' END FROM (
            SELECT tab_id, parts, n, CAST(greatest(1, least(CASE WHEN {p}_read_tab.first IS NOT NULL THEN {p}_read_tab.first WHEN at > 0 THEN at ELSE 1 END, n)) AS BIGINT) AS first,
                CAST(greatest(1, least(CASE WHEN {p}_read_tab.first IS NOT NULL THEN coalesce({p}_read_tab.last, n) WHEN next > 0 THEN next - 1 ELSE n END, n)) AS BIGINT) AS last FROM (
            SELECT *, CASE WHEN at > 0 THEN array_position(transform(levels, (v, i) -> i >= at AND v BETWEEN 1 AND levels[at - 1]), true) ELSE 0 END AS next FROM (
            SELECT *, CASE WHEN {p}_read_tab.first IS NULL AND {p}_read_tab.section IS NOT NULL THEN CAST(array_position(transform(parts, (x, i) -> levels[i] BETWEEN 1 AND 6
                AND contains({low_heading}, {low_section})), true) AS INT) ELSE 0 END AS at FROM (
            SELECT id AS tab_id, size(parts) AS n, parts, transform(parts, x -> char_length(regexp_extract(x, '^\\s*(#*)', 1))) AS levels FROM (SELECT id, {parts} AS parts FROM {p}_tabs WHERE id = {p}_read_tab.tab)))))""",
    ),
    "tab_meta": ("tab {id}", "tab_id {id}, url STRING, canonical_url STRING, status STRING, source STRING", "SELECT id, url, coalesce(canonical_url, url), status, source FROM {p}_tabs WHERE id = {p}_tab_meta.tab"),
    "cache_get": ("address STRING", "url STRING, tab_id {id}, source STRING, canonical_url STRING, expires_at BIGINT, age_s BIGINT", "SELECT url, tab_id, source, canonical_url, expires_at, age_s FROM {p}_cached WHERE url = {p}_cache_get.address"),
    "cache_stats": ("", "entries BIGINT, fresh BIGINT, expired BIGINT, oldest BIGINT, newest BIGINT, md_bytes BIGINT", "SELECT entries, fresh, expired, oldest, newest, md_bytes FROM {p}_stats"),
    "sessions": ("", "id {agent}, name STRING, last_seen_at BIGINT, note STRING, tabs BIGINT, ready BIGINT", "SELECT id, name, last_seen_at, note, tabs, ready FROM {p}_sessions"),
    "fetch": ("address STRING", "url STRING, tier INT, source STRING, markdown STRING, banner BOOLEAN, cached BOOLEAN", "SELECT url, tier, source, markdown, banner, cached FROM {p}_fetched WHERE url = {p}_fetch.address"),
}


def register(spark: SparkSession, engine: Engine, candidates: DataFrame | None = None, options: FetchOptions | None = None, prefix: str = "web") -> list[str]:
    """Registers `engine`'s tables as views and its calls as temporary table functions of this session; returns their names.

    search(query, mode), read_tab(tab, first, last, section), tab_meta(tab), cache_get(url), cache_stats(), sessions(), and with
    `candidates` fetch(url). An unknown tab or URL gives no row; an unknown mode of search is an error; a null query or name
    finds nothing. Callers page by ORDER BY and LIMIT. The fuzzy mode takes up to 60 words.
    """
    views = {
        "tabs": engine.tabs,
        "lines": search.lines(engine.tabs, "id", "markdown"),
        "cached": cache.get(engine.entries, engine.tabs, engine.now),
        "stats": engine.cache_stats(),
        "sessions": engine.sessions(),
    }
    if candidates is not None:
        views["fetched"] = engine.fetch(candidates, options)
    for name, rows in views.items():
        rows.createOrReplaceTempView(f"{prefix}_{name}")
    spark.sql(
        """CREATE OR REPLACE TEMPORARY FUNCTION web_mode(mode STRING) RETURNS STRING
        RETURN CASE WHEN mode IN ('plain', 'regex', 'fuzzy') THEN mode ELSE raise_error(concat('no such mode: ', mode)) END"""
    )
    kinds = {
        "p": prefix,
        "id": engine.tabs.schema["id"].dataType.simpleString(),
        "agent": engine.agents.schema["id"].dataType.simpleString(),
        "parts": _PARTS.format("markdown"),
        "low_line": _LOW.format("line"),
        "low_query": _LOW.format(f"{prefix}_search.query"),
        "low_heading": _LOW.format(r"trim(regexp_replace(x, '^\\s*#*', ''))"),
        "low_section": _LOW.format(f"{prefix}_read_tab.section"),
    }
    made = []
    for name, (takes, gives, body) in _FUNCTIONS.items():
        if name == "fetch" and candidates is None:
            continue
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}_{name}({takes.format(**kinds)}) RETURNS TABLE ({gives.format(**kinds)}) RETURN {body.format(**kinds)}")
        made.append(f"{prefix}_{name}")
    return made
