"""Queries over streams and written tables. Each run works in a folder of its own in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.operators import cache as C
from webloom.operators import writes
from webloom.plans import fixtures as V
from webloom.plans import table_queries as Q
from webloom.plans.registry import Registry
from webloom.plans.text_queries import url_host
from webloom.functions import urls as U
from webloom.session import shared_folder
from webloom.streaming import live, polling

R = Registry()
BATCHES = 3


def _place(spark) -> str:
    return f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"


def _streamed(rows: DataFrame, place: str, by: str, last: DataFrame | None = None) -> DataFrame:
    """A stream of `rows` in BATCHES micro-batches of a file for each core, dealt by a hash of `by` and so out of order; `last` comes after all others."""
    files = rows.sparkSession.sparkContext.defaultParallelism
    rows.repartition(BATCHES * files, by).write.parquet(f"{place}/in")
    if last is not None:
        last.coalesce(1).write.mode("append").parquet(f"{place}/in")
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{place}/in")


def _finished(stream: DataFrame, place: str) -> DataFrame:
    """What a stream gives over all that there is."""
    spark = stream.sparkSession
    query = stream.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/out")


def _flush(rows: DataFrame, at: str, **named) -> DataFrame:
    """One row of a time far behind all others, which moves the watermark past them."""
    end = rows.agg((F.max(at) + F.expr("interval 1000 days")).alias(at))
    return end.select(*[F.col(c) if c == at else F.lit(named.get(c)).cast(rows.schema[c].dataType).alias(c) for c in rows.columns])


def _schedule(s, d) -> DataFrame:
    live.prepare(s)
    place = _place(s)
    rows = Q._requests(s, d).select("host", F.timestamp_millis("arrival").alias("arrival"), "id", "status")
    stream = _streamed(rows, place, "id", _flush(rows, "arrival", host=-1, id=-1, status=200))
    return _finished(live.stream_schedule(stream, "400 days", 10**12), place).where("host <> -1")


R.add("stream_schedule", lambda s, d: _schedule(s, d).select("host", "id", "at_ms"), Q.R.sql["host_schedule"])
R.add("stream_gap_fold", lambda s, d: _schedule(s, d).groupBy("host").agg(F.max("requests").alias("requests"), F.max_by("gap_ms", "requests").alias("gap_ms")), Q.R.sql["host_gap_fold"])

# asks answered from what earlier ones fetched: by URL with a source's time to live, by host with an hour's
_ttl = lambda: 1000 * C.ttl_seconds(F.col("source"))
_TTL_SQL = "1000 * CASE WHEN source = 'parse' THEN 3600 WHEN source IN ('headless', 'wayback') THEN 1800 ELSE 86400 END"
_asks = lambda s, d: V.tabs(s, d).select("url", U.host(F.col("url")).alias("host"), F.timestamp_millis("opened_at").alias("at"), "id", "source")


def _replay_sql(key: str, ttl: str) -> str:
    """The chain of fetches of each key: from a fetch to the first ask after its expiry."""
    return f"""WITH RECURSIVE tabs AS ({V.SQL['tabs']}), a AS (SELECT {key} AS key, id, opened_at AS o, opened_at + {ttl} AS e, row_number() OVER (PARTITION BY {key} ORDER BY opened_at, id) AS n FROM tabs),
        t AS (SELECT key, o, min(n) AS n FROM a GROUP BY key, o), x AS (SELECT a.*, t.n AS nxt FROM a ASOF LEFT JOIN t ON a.key = t.key AND t.o > a.e),
        f AS (SELECT key, n, nxt FROM x WHERE n = 1 UNION ALL SELECT x.key, x.n, x.nxt FROM f JOIN x ON x.key = f.key AND x.n = f.nxt)
        SELECT a.key AS {'url' if key == 'url' else 'host'}, a.id, a.o AS "at", f.n IS NULL AS cached FROM a LEFT JOIN f ON f.key = a.key AND f.n = a.n"""


R.add("cache_replay", lambda s, d: live.replayed_asks(_asks(s, d), "url", _ttl()), _replay_sql("url", _TTL_SQL))
R.add("host_memo_replay", lambda s, d: live.replayed_asks(_asks(s, d), "host", F.lit(3_600_000)), _replay_sql(url_host("url"), "3600000"))


def _stream_asks(s, d) -> DataFrame:
    live.prepare(s)
    place, rows = _place(s), _asks(s, d)
    stream = _streamed(rows, place, "id", _flush(rows, "at", url="", host="", id=-1, source="parse"))
    return _finished(live.stream_asks(stream, "url", _ttl(), "400 days"), place).where("url <> ''")


R.add("stream_cache_asks", _stream_asks, _replay_sql("url", _TTL_SQL))


# tables that are written to
def _text_ids(tabs: DataFrame) -> DataFrame:
    return tabs.withColumn("id", F.col("id").cast("string")).withColumn("agent_id", F.col("agent_id").cast("string"))


def _store_upsert(s, d) -> DataFrame:
    store = writes.Registry(s, _place(s), 8)
    for k in (1, 0, 1):  # in any order, and again
        store.upsert(C.record(V.tabs(s, d).where(f"id % 2 = {k}")).withColumn("tab_id", F.col("tab_id").cast("string")))
    return store.cache.read().withColumn("tab_id", F.col("tab_id").cast("long"))


R.add("store_cache_upsert", _store_upsert, Q._cache_sql("SELECT * FROM cache"))


def _store_record(s, d) -> DataFrame:
    """Opens a tab for every page, records how tier 6 did, and shows tabs with what is cached of their URL."""
    store = writes.Registry(s, _place(s), 8)
    pages = V.read(s, d, "pages").select("url", F.col("page_id").alias("seq"))
    store.open(pages, F.lit("a1"), F.lit(5).cast("long"))
    ids = pages.select("seq", F.sha2(F.concat_ws("#", "url", "seq"), 256).alias("id"))
    told = V.candidates(s, d).where("tier = 6").join(ids, F.col("page_id") == F.col("seq"))
    none = F.lit(None).cast("string")
    told = told.select("id", "source", "markdown", none.alias("canonical_url"), F.when(F.col("page_id") % 20 == 7, F.lit("http 500")).alias("error"), (F.col("page_id") + 1000).alias("fetched_at"))
    for _ in range(2):
        store.record(told)
    store.open(pages, F.lit("a2"), F.lit(6).cast("long"))  # known tabs stay
    cached = store.cache.read().select(F.col("tab_id").alias("id"), "expires_at")
    return store.tabs.read().join(cached, "id", "left").select("id", "agent_id", "url", "status", "source", "bytes_md", "error", "opened_at", "fetched_at", "expires_at")


R.add(
    "store_record",
    _store_record,
    V.sql(
        """, c AS (SELECT url, page_id, sha256(url || '#' || page_id) AS id, markdown FROM candidates WHERE tier = 6),
        best AS (SELECT url, max(page_id) FILTER (WHERE markdown IS NOT NULL) AS page_id FROM c GROUP BY url)
        SELECT c.id, 'a1' AS agent_id, c.url, CASE WHEN markdown IS NULL THEN 'failed' ELSE 'ready' END AS status, CASE WHEN markdown IS NOT NULL THEN 'parse' END AS source, strlen(markdown) AS bytes_md,
        CASE WHEN markdown IS NULL THEN '{"message":"' || CASE WHEN c.page_id % 20 = 7 THEN 'http 500' ELSE 'unknown' END || '"}' END AS error, 5::BIGINT AS opened_at, c.page_id + 1000 AS fetched_at,
        CASE WHEN best.page_id = c.page_id THEN c.page_id + 1000 + 3600000 END AS expires_at FROM c LEFT JOIN best USING (url)""",
        "candidates",
    ).replace("\n, c AS", ", c AS", 1),
)


def _store_clear(s, d) -> DataFrame:
    """Rows that a clear of the cache and then of everything removed, and what was left after each."""
    store = writes.Registry(s, _place(s), 8)
    tabs = _text_ids(V.tabs(s, d))
    none = lambda t, n: F.lit(None).cast(t).alias(n)
    store.tabs.put(tabs.select("id", "agent_id", "url", "canonical_url", "status", "source", none("long", "bytes_md"), none("string", "error"), "opened_at", "fetched_at", none("string", "markdown")), ["fetched_at"])
    store.upsert(C.record(tabs))
    rows = []
    for everything in (False, True):
        gone = store.clear(everything)
        rows.append((everything, *gone, store.cache.read().count(), store.tabs.read().count()))
    return s.createDataFrame(rows, "everything boolean, cache_rows long, tab_rows long, cache_left long, tabs_left long")


R.add("store_clear", _store_clear, Q._cache_sql("SELECT false AS everything, (SELECT count(*) FROM cache) AS cache_rows, 0::BIGINT AS tab_rows, 0::BIGINT AS cache_left, (SELECT count(*) FROM tabs) AS tabs_left UNION ALL SELECT true, 0, (SELECT count(*) FROM tabs), 0, 0"))


def _polled(s, d) -> DataFrame:
    place = _place(s)
    rows = V.tabs(s, d).select("id", "agent_id", "status", F.col("opened_at").alias("at"))
    # each tab is pending before it is what it becomes
    rows = rows.union(rows.select("id", "agent_id", F.lit("pending"), F.col("at") - 1))
    board = polling.SessionBoard(s, f"{place}/board", 8, "long", "long")
    polling.follow(board, _streamed(rows, place, "at"), f"{place}/state", None).awaitTermination()
    return board.sessions(V.agents(s, d))


R.add("session_poll", _polled, V.sql(Q._SESSION, "tabs", "agents"))
