import pytest

from webloom import sql
from webloom.engine import Engine, EngineError, FetchOptions
from webloom.operators import cache, search

BODY = "# Intro\nhello World\n## Usage\nrun it now\n### Deep\nmore\n## End\nbye"


@pytest.fixture(scope="module")
def engine(spark):
    rows = [("t1", "a", "https://x.y/1", None, "ready", "parse", 1_000, 2_000, BODY), ("t2", "a", "https://x.y/2", "https://c", "ready", "wayback", 2_000, 3_000, "one\r\ntwo wordz\n"), ("t3", "b", "https://x.y/3", None, "failed", None, 1, 1, None)]
    tabs = spark.createDataFrame(rows, "id string, agent_id string, url string, canonical_url string, status string, source string, opened_at long, fetched_at long, markdown string")
    agents = spark.createDataFrame([("a", "one", 1, 9, '{"note":"n"}'), ("b", "two", 1, 5, None)], "id string, name string, created_at long, last_seen_at long, metadata string")
    engine = Engine(tabs, agents, cache.record(tabs), 2_000_000)
    long = "a good sentence with several words in it. " * 20
    candidates = spark.createDataFrame([("https://x.y/1", 6, "parse", long), ("https://n/1", 6, "parse", long)], "url string, tier int, source string, markdown string")
    names = sql.register(spark, engine, candidates, prefix="test")
    assert names == [f"test_{n}" for n in ("search", "read_tab", "tab_meta", "cache_get", "cache_stats", "sessions", "fetch")]
    return engine


def called(spark, statement):
    return sorted((tuple(r) for r in spark.sql(statement).collect()), key=str)


@pytest.mark.parametrize(("query", "mode"), [("world", "plain"), ("World", "plain"), ("WORLD", "plain"), ("^#+ ", "regex"), ("wurld", "fuzzy"), ("run itt", "fuzzy"), ("it run", "fuzzy"), ("!!", "fuzzy"), ("words", "fuzzy"), ("helo worl", "fuzzy")])
def test_search_equals_the_call(spark, engine, query, mode):
    want = sorted((tuple(r)[:3] for r in search.search(search.lines(engine.tabs, "id", "markdown"), query, mode, None).collect()), key=str)
    assert called(spark, f"SELECT * FROM test_search('{query}', '{mode}')") == want


def test_reads_equal_the_calls(spark, engine):
    for tab in ("t1", "t2", "t3"):
        for section in ("usage", "USAGE", "deep", "none", "end"):
            want = [tuple(r) for r in engine.read_tab(tab, section=section).collect()]
            assert called(spark, f"SELECT * FROM test_read_tab('{tab}', section => '{section}')") == want
        assert called(spark, f"SELECT * FROM test_read_tab('{tab}')") == [tuple(r) for r in engine.read_tab(tab).collect()]
        for first, last in ((1, 2), (3, 99), (0, 1), (5, 2)):
            r = engine.read_tab(tab, (first, last)).first()
            assert called(spark, f"SELECT * FROM test_read_tab('{tab}', {first}, {last}, 'usage')") == [(r.tab_id, r.first, r["last"], r.content)]
    assert called(spark, "SELECT * FROM test_read_tab('nope')") == []


def test_other_calls(spark, engine):
    assert called(spark, "SELECT url, canonical_url, age_s FROM test_cache_get('https://x.y/2')") == [("https://x.y/2", "https://c", 1997)]
    assert called(spark, "SELECT * FROM test_cache_get('https://nowhere')") == [] == called(spark, "SELECT * FROM test_tab_meta(NULL)")
    assert called(spark, "SELECT entries, fresh, md_bytes FROM test_cache_stats()") == [(2, 1, len(BODY) + len("one\r\ntwo wordz\n"))]
    assert called(spark, "SELECT id, note, tabs, ready FROM test_sessions()") == [("a", "n", 2, 2), ("b", None, 1, 0)]
    assert called(spark, "SELECT canonical_url, status FROM test_tab_meta('t3')") == [("https://x.y/3", "failed")]
    assert called(spark, "SELECT url, cached FROM test_fetch('https://x.y/1')") == [("https://x.y/1", True)]
    assert called(spark, "SELECT url, cached FROM test_fetch('https://n/1')") == [("https://n/1", False)]
    # beside a table of calls
    got = called(spark, "SELECT q.s, t.first FROM VALUES ('usage'), ('end') AS q(s), LATERAL test_read_tab('t1', section => q.s) t")
    assert got == [("end", 7), ("usage", 3)]
    with pytest.raises(Exception, match="no such mode: odd"):
        called(spark, "SELECT * FROM test_search('x', 'odd')")


def test_search_is_one_scan_without_shuffle(spark, engine):
    plan = spark.sql("SELECT * FROM test_search('world')")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "levenshtein" not in plan


def test_session_start_meta_and_flags(spark, engine):
    e = Engine(engine.tabs, engine.agents, engine.entries, 2_000_000)
    assert e.session_start("new", 77, "hi").first().last_seen_at == 77
    assert {r.name: r.note for r in e.sessions().collect()} == {"one": "n", "two": None, "new": "hi"}
    assert e.session_start("one", 99).first().last_seen_at == 99 and e.sessions().count() == 3
    assert tuple(e.tab_meta("t2").first()) == ("t2", "https://x.y/2", "https://c", "ready", "wayback")
    for call in (lambda: e.tab_meta("nope"), lambda: FetchOptions(format="xml")):
        with pytest.raises(EngineError):
            call()
    one = spark.createDataFrame([("https://n/9", 6, "parse", "word " * 60)], "url string, tier int, source string, markdown string")
    got = e.fetch(one, FetchOptions(meta=True, format="json")).first()
    assert got.bytes == len(got.markdown.encode()) and got.tokens == got.bytes // 4 and '"source":"parse"' in got.body
