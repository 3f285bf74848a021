"""Folds over time, cut into pieces, against the same rules request by request."""

import random

from pyspark.sql import functions as F

from webloom.operators import cache, strategies
from webloom.streaming import politeness


def test_pieces_of_any_length_give_the_fold_of_all(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(60_000), i, rng.choice([200, 200, 404, 429, 503, None])) for i in range(400)]
    requests = spark.createDataFrame(rows, "host string, arrival long, id long, status int").withColumn("ts", F.timestamp_millis("arrival"))
    gaps, at, n = {}, {}, {}
    for host, arrival, i, status in sorted(rows, key=lambda r: (r[1], r[2])):
        gap = gaps.get(host, 250)
        at[i] = last = max(arrival, at["last", host] + gap) if ("last", host) in at else arrival
        at["last", host] = last
        gaps[host] = min(2 * gap, 30_000) if status in (None, 429, 503) else max(gap // 2, 250) if status == 200 else gap
        n[host] = n.get(host, 0) + 1
    for piece, busy in ((700, 0), (10_000, 0), (politeness.PIECE_MS, 0), (5000, 150), (700, politeness.BUSY)):
        got = politeness.host_gaps(requests, piece, busy).collect()
        assert {r.host: (r.requests, r.gap_ms) for r in got} == {h: (n[h], gaps[h]) for h in gaps}
        when = politeness.host_schedule(requests, piece, busy).collect()
        assert {r.id: r.at_ms for r in when} == {r[2]: at[r[2]] for r in rows}


def test_empty_and_untimed(spark):
    rows = spark.createDataFrame([("h", None, 1, 429), ("h", 5, 2, 429)], "host string, arrival long, id long, status int")
    got = politeness.host_gaps(rows.withColumn("ts", F.timestamp_millis("arrival"))).collect()
    assert [tuple(r) for r in got] == [("h", 2, 1000)]
    assert [tuple(r) for r in politeness.host_schedule(rows).collect()] == [("h", 2, 5)]
    assert politeness.host_schedule(rows.limit(0)).count() == 0 == politeness.host_gaps(rows.limit(0).withColumn("ts", F.timestamp_millis("arrival"))).count()


def test_hosts_that_go_on_over_many_batches(spark):
    """Groups longer than an Arrow batch, whole and in pieces."""
    rng = random.Random(9)
    rows = [("long" if i % 3 else f"h{i % 40}", rng.randrange(200_000), i, rng.choice([200, 404, 429])) for i in range(1500)]
    requests = spark.createDataFrame(rows, "host string, arrival long, id long, status int")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {r.id: r.at_ms for r in politeness.host_schedule(requests).collect()}
    gaps = sorted(map(tuple, politeness.host_gaps(requests.withColumn("ts", F.timestamp_millis("arrival"))).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        for busy in (politeness.BUSY, 0):
            assert {r.id: r.at_ms for r in politeness.host_schedule(requests, 50_000, busy).collect()} == want
            assert sorted(map(tuple, politeness.host_gaps(requests.withColumn("ts", F.timestamp_millis("arrival")), 50_000, busy).collect())) == gaps
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_ladder_is_closed():
    steps = set(politeness.ladder())
    assert 250 in steps and all(min(2 * g, 30_000) in steps and max(g // 2, 250) in steps for g in steps)


def test_waits_after_crashes(spark):
    rows = [("w", t, t, t != 9) for t in range(11)] + [("v", 1, 50, True)]
    got = politeness.restart_delays(spark.createDataFrame(rows, "key string, at long, id long, crashed boolean")).collect()
    waits = {r.id: r.wait_ms for r in got}
    assert [waits[i] for i in range(9)] == [500, 1000, 2000, 4000, 8000, 16000, 30000, 30000, 30000]
    assert waits[10] == 500 and waits[50] == 500 and 9 not in waits


def test_a_page_that_never_rests_is_capped(spark):
    log = spark.createDataFrame([("busy", t) for t in range(0, 20_000, 1000)] + [("calm", 0), ("calm", 100)], "page string, at_ms long")
    assert {r.page: (r.quiet_ms, r.capped) for r in strategies.quiet_at(log, 1500, 12_000).collect()} == {"busy": (12_000, True), "calm": (1600, False)}


def test_clear_leaves_tabs_unless_everything_goes(spark):
    c, t = spark.range(3), spark.range(4)
    assert [x.count() for x in cache.cleared(c, t, False)] == [0, 4] and [x.count() for x in cache.cleared(c, t, True)] == [0, 0]
