import pytest
from pyspark.sql import functions as F

from webloom.engine import Engine, EngineError, FetchOptions
from webloom.operators import adapters, strategies
from webloom.sources import files
from webloom.streaming import politeness


@pytest.fixture(scope="module")
def engine(spark):
    tabs = spark.createDataFrame(
        [("t1", "a", "https://x.y/1", None, "ready", "parse", 1_000, 2_000, "# Intro\nhello World\n## Usage\nrun it\n## End\nbye"), ("t2", "a", "https://x.y/2", "https://c", "ready", "wayback", 2_000, 3_000, "nothing"), ("t3", "b", "https://x.y/3", None, "failed", None, 1, 1, None)],
        "id string, agent_id string, url string, canonical_url string, status string, source string, opened_at long, fetched_at long, markdown string",
    )
    agents = spark.createDataFrame([("a", "one", 1, 9, '{"note":"n"}'), ("b", "two", 1, 5, None), ("c", "three", 1, 7, None)], "id string, name string, created_at long, last_seen_at long, metadata string")
    from webloom.operators import cache

    return Engine(tabs, agents, cache.record(tabs), 2_000_000)


def test_calls(engine):
    assert [tuple(r)[:2] for r in engine.search("world").collect()] == [("t1", 2)]
    assert engine.search("World", before=1, after=1).first().context_after == ["## Usage"]
    assert engine.search("worlt", "fuzzy").count() == 1 and engine.search("(", "regex").count() == 0
    assert engine.read_tab("t1", section="usage").first().content == "## Usage\nrun it"
    assert engine.read_tab("t1", section="none").first().content.endswith("bye")
    assert engine.read_tab("t1", lines=(5, 99)).first().content == "## End\nbye"
    assert engine.read_tab("t1").first().last == 6
    assert [tuple(r) for r in engine.read_tab("t3").collect()] == [("t3", 1, 1, "")] == [tuple(r) for r in engine.read_tab("t3", section="x").collect()]
    assert engine.search(r"\p{L}+ World", "regex").first().regex_fallback_error is None
    assert engine.search("(?P<x>hello)", "regex").count() == 0 and engine.search("#+ (", "regex").count() == 0
    assert tuple(engine.cache_stats().first())[:5] == (2, 1, 1, 2_000, 3_000) and engine.cache_stats().first().md_bytes == 53
    assert engine.cache_get("https://x.y/2").first().canonical_url == "https://c"
    assert [tuple(r) for r in engine.sessions().select("id", "note", "tabs", "ready").collect()] == [("a", "n", 2, 2), ("c", None, 0, 0), ("b", None, 1, 0)]


def test_errors(engine):
    for call in (lambda: engine.read_tab("nope"), lambda: engine.search("x", "odd"), lambda: FetchOptions(mode="never")):
        with pytest.raises(EngineError):
            call()


def test_fetch(engine, spark):
    long = "a good sentence with several words in it. " * 20
    rows = [("https://x.y/1", 6, "parse", long), ("https://n/1", 1, "accept_md", "tiny"), ("https://n/1", 6, "parse", long), ("https://n/2", 6, "parse", "Access Denied"), ("https://n/3", 6, "parse", None)]
    got = {r.url: r for r in engine.fetch(spark.createDataFrame(rows, "url string, tier int, source string, markdown string")).collect()}
    assert set(got) == {"https://x.y/1", "https://n/1", "https://n/2"} and got["https://n/1"].source == "parse"
    assert got["https://n/2"].banner and "rejection page of n," in got["https://n/2"].markdown and not got["https://n/2"].cached
    stored = got["https://x.y/1"]
    assert stored.cached and stored.tier == 6 and stored.markdown.strip() == "# Intro\nhello World\n## Usage\nrun it\n## End\nbye"
    again = engine.fetch(spark.createDataFrame(rows, "url string, tier int, source string, markdown string"), FetchOptions(no_cache=True))
    assert [r.cached for r in again.where("url = 'https://x.y/1'").collect()] == [False]


def test_comment_trees(spark):
    hn = '{"id":1,"title":"T","points":3,"author":"x","children":[{"author":"a","text":"<p>hi<p>yo &amp; c","children":[{"author":"b","text":"re"}]}]}'
    got = spark.createDataFrame([(hn,), ("{",)], "j string").select(adapters.hn_thread(F.col("j")).alias("md")).collect()
    assert "**a**: hi\n" in got[0].md and "**a**: yo & c\n" in got[0].md and "> **b**: re\n" in got[0].md and got[1].md is None
    reddit = '[{"data":{"children":[{"data":{"title":"T","selftext":"s"}}]}},{"data":{"children":[{"kind":"t1","data":{"author":"a","body":"x","score":2,"replies":{"data":{"children":[{"kind":"t1","data":{"body":"y"}},{"kind":"more"}]}}}}]}}]'
    md = spark.createDataFrame([(reddit,)], "j string").select(adapters.reddit_thread(F.col("j")).alias("md")).first().md
    assert "**u/a** (2↑): x\n" in md and "> **u/?** (0↑): y\n" in md


def test_gaps(spark):
    rows = [("h", i, i, s, i * 10) for i, s in enumerate([429, 429, 200, 503])] + [("g", 0, 0, 200, 0)]
    r = spark.createDataFrame(rows, "host string, ts long, id long, status int, arrival long")
    assert {x.host: x.gap_ms for x in politeness.host_gaps(r).collect()} == {"h": 1000, "g": 250}
    assert [x.at_ms for x in politeness.host_schedule(r).where("host = 'h'").orderBy("id").collect()] == [0, 500, 1500, 2000]


def test_streams(spark, tmp_path):
    rows = [("h", 429), ("h", 429), ("g", 200), ("h", 200)]
    spark.createDataFrame(rows, "host string, status int").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("host string, status int").parquet(str(tmp_path / "in"))
    q = politeness.stream_gaps(stream).writeStream.format("memory").queryName("gaps").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.host: (r.requests, r.gap_ms) for r in spark.table("gaps").collect()} == {"h": (3, 500), "g": (1, 250)}
    events = spark.createDataFrame([("u", "2024-01-01 00:00:00"), ("u", "2024-01-01 00:00:05"), ("v", "2024-01-01 01:00:00")], "url string, at string").selectExpr("url", "timestamp(at) as at")
    events.coalesce(1).write.parquet(str(tmp_path / "ev"))
    read = lambda: spark.readStream.schema("url string, at timestamp").parquet(str(tmp_path / "ev"))
    for name, df, want in (("cached", politeness.stream_cache(read()), 2), ("sessions", politeness.idle_sessions(read().withWatermark("at", "1 minute"), "url", "at"), 1)):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        assert spark.table(name).count() == want


def test_files(spark, tmp_path):
    tabs = spark.createDataFrame([("a1", "https://x", "parse", None, 5, "body\nline")], "id string, url string, source string, title string, fetched_at long, markdown string")
    text = tabs.select(files.tab_file().alias("t")).first().t
    (tmp_path / "tabs").mkdir()
    (tmp_path / "tabs" / "a1.md").write_text(text)
    assert [tuple(r) for r in files.read_tab_files(spark, str(tmp_path / "tabs")).collect()] == [("a1", "body\nline")]
    files.write_tabs(tabs, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    with pytest.raises(ValueError, match="no such fetcher"):
        files.fetched_by(tabs, "carrier pigeon")


def test_consent(spark):
    r = spark.range(1).select(adapters.consent_detected(F.lit("<button>I'm a US resident</button>")), adapters.consent_detected(F.lit("<p>accept</p>"))).first()
    assert tuple(r) == (True, False)


def test_llms(spark):
    idx = spark.createDataFrame([("h", "# T\n- [A](https://h/a/): x\n* [B](https://h/a#z)\n- [C](/rel)\ntext")], "host string, text string")
    entries = strategies.llms_entries(idx)
    assert [(r.title, r.url) for r in entries.orderBy("pos").collect()] == [("A", "https://h/a/"), ("B", "https://h/a#z")]
    urls = spark.createDataFrame([("https://h/a#top",), ("https://h/q",)], "url string")
    assert [(r.url, r.title) for r in strategies.llms_match(urls, entries).collect()] == [("https://h/a#top", "A")]
