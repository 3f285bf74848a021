import random

import pytest
from pyspark.sql import functions as F

from webloom.plans import stream_queries
from webloom.streaming import live, politeness


@pytest.fixture
def streamed(spark, tmp_path):
    """A stream of rows in the given micro-batches: files of one folder, taken one by one."""
    live.prepare(spark)

    def run(batches, schema, build, name):
        folder = str(tmp_path / name)
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{i:04d}")
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
        out = str(tmp_path / f"{name}-out")
        query = build(source).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / f"{name}-c")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(150)
        assert query.exception() is None
        return spark.read.parquet(out).collect()

    return run


def shuffled(rows, rng, window):
    """Batches in which rows come up to `window` of time too late."""
    rows = sorted(rows, key=lambda r: r[1] + rng.randrange(window))
    cut = sorted(rng.sample(range(1, len(rows)), 2))
    return [rows[: cut[0]], rows[cut[0] : cut[1]], rows[cut[1] :]]


def test_schedule_equals_the_batch_fold(spark, streamed):
    rng = random.Random(11)
    rows = [(rng.choice(["a", "a", "b"]), rng.randrange(60_000), i, rng.choice([200, 204, 404, 429, 503, None])) for i in range(120)]
    last = [[("flush", 10_000_000, 9999, 200)]]  # moves the watermark past all others
    schema = "host string, ms long, id long, status int"
    got = streamed(shuffled(rows, rng, 8000) + last, schema, lambda s: live.stream_schedule(s.withColumn("arrival", F.timestamp_millis("ms")), "20 seconds"), "s")
    table = spark.createDataFrame(rows, schema).withColumn("arrival", F.col("ms")).withColumn("ts", F.timestamp_millis("ms"))
    want = {r.id: r.at_ms for r in politeness.host_schedule(table).collect()}
    assert {r.id: r.at_ms for r in got if r.host != "flush"} == want
    gaps = {r.host: (r.requests, r.gap_ms) for r in politeness.host_gaps(table).collect()}
    assert {r.host: (r.requests, r.gap_ms) for r in sorted(got, key=lambda r: r.requests) if r.host != "flush"} == gaps


def test_a_host_is_forgotten(streamed):
    rows = [[("a", 1, 1, 429), ("a", 10, 2, 429)], [("a", 20_000, 3, 429), ("b", 30_000, 4, 200)], [("a", 90_000, 5, 200)], [("flush", 10_000_000, 9, 200)]]
    got = streamed(rows, "host string, ms long, id long, status int", lambda s: live.stream_schedule(s.withColumn("arrival", F.timestamp_millis("ms")), "1 second", 15_000), "f")
    assert {r.id: (r.at_ms, r.requests) for r in got if r.host != "flush"} == {1: (1, 1), 2: (501, 2), 3: (20_000, 1), 4: (30_000, 1), 5: (90_000, 1)}


def test_asks_equal_the_replay(spark, streamed):
    rng = random.Random(12)
    rows = [(f"u{rng.randrange(4)}", rng.randrange(40_000), i, rng.choice([500, 3000, 9000])) for i in range(120)]
    schema = "url string, ms long, id long, ttl long"
    ask = lambda s: s.withColumn("at", F.timestamp_millis("ms"))
    got = streamed(shuffled(rows, rng, 5000) + [[("flush", 9_000_000, 9999, 1)]], schema, lambda s: live.stream_asks(ask(s), "url", F.col("ttl"), "20 seconds"), "a")
    want, expires = {}, {}
    for url, at, i, ttl in sorted(rows, key=lambda r: (r[1], r[2])):
        want[i] = url in expires and expires[url] >= at
        if not want[i]:
            expires[url] = at + ttl
    assert {r.id: r.cached for r in got if r.url != "flush"} == want and set(want.values()) == {True, False}
    replay = live.replayed_asks(ask(spark.createDataFrame(rows, schema)), "url", F.col("ttl")).collect()
    assert {r.id: r.cached for r in replay} == want


def test_a_fetch_holds_until_its_expiry_and_no_longer(spark):
    rows = [("u", 0, 1, 1000), ("u", 1000, 2, 50), ("u", 1001, 3, 50), ("u", 1040, 4, 50), ("u", 1052, 5, 50), (None, 1, 6, 1), ("v", None, 7, 1)]
    asks = spark.createDataFrame(rows, "url string, ms long, id long, ttl long").withColumn("at", F.timestamp_millis("ms"))
    got = live.replayed_asks(asks, "url", F.col("ttl")).collect()
    assert {r.id: r.cached for r in got} == {1: False, 2: True, 3: False, 4: True, 5: False}


def test_state_ends(monkeypatch):
    """Without Spark: a key whose state has ended begins anew, and its timer clears what is left."""
    s = live.Schedule(5000)
    state = s.first()
    for at in (0, 10):
        state, (when, gap, n) = s.step(state, at, 429)
    assert (when, gap, n) == (500, 1000, 2) and s.ends(state) == 5500
    e = live.Expiring()
    assert e.step(e.first(), 7, 100) == ((107,), (False,)) and e.step((107,), 107, 5) == ((107,), (True,)) and e.ends((107,)) == 108


def test_many_keys_share_a_state(spark, tmp_path, monkeypatch):
    """Calls and values of the state store are per shard, not per key; every ask is answered as in the replay."""
    monkeypatch.setattr(live, "SHARDS", 16, raising=False)
    live.prepare(spark)
    rng = random.Random(13)
    schema = "url string, ms long, id long, ttl long"
    rows = [(f"u{i % 400}", rng.randrange(50_000), i, rng.choice([500, 9000])) for i in range(1600)]
    for k, batch in enumerate([*shuffled(rows, rng, 5000), [("flush", 9_000_000, 9999, 1)]]):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    ask = lambda s: s.withColumn("at", F.timestamp_millis("ms"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    query = live.stream_asks(ask(source), "url", F.col("ttl"), "20 seconds").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(150)
    assert query.exception() is None
    got = {r.id: r.cached for r in spark.read.parquet(f"{tmp_path}/out").where("url <> 'flush'").collect()}
    assert got == {r.id: r.cached for r in live.replayed_asks(ask(spark.createDataFrame(rows, schema)), "url", F.col("ttl")).collect()} and len(got) == 1600
    states = [o.numRowsTotal for p in query.recentProgress for o in p.stateOperators]
    assert 0 < max(states) <= 3 * 16


def test_a_micro_batch_is_files_for_all_cores(spark, tmp_path):
    place, rows = str(tmp_path), spark.range(5000)
    stream = stream_queries._streamed(rows, place, "id", spark.createDataFrame([(-1,)], "id long"))
    assert len(list((tmp_path / "in").glob("*.parquet"))) == stream_queries.BATCHES * spark.sparkContext.defaultParallelism + 1
    seen = []
    query = stream.writeStream.foreachBatch(lambda batch, _: seen.append([r.id for r in batch.collect()])).option("checkpointLocation", f"{place}/c").trigger(availableNow=True).start()
    query.awaitTermination(150)
    assert query.exception() is None
    assert len(seen) == stream_queries.BATCHES + 1 and seen[-1] == [-1] and sorted(sum(seen[:-1], [])) == list(range(5000))
