import glob
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from webloom.operators import registry, writes
from webloom.sources.store import KeyedTable
from webloom.streaming import polling


def files(path):
    return {f: (os.stat(f).st_mtime_ns, os.stat(f).st_ino) for f in glob.glob(f"{path}/bucket=*/*.parquet")}


@pytest.fixture
def table(spark, tmp_path):
    return KeyedTable(spark, str(tmp_path / "t"), StructType.fromDDL("k string, at long, v string"), "k", 16)


def rows(table):
    return sorted(tuple(r) for r in table.read().collect())


def test_put_touches_only_the_buckets_of_its_keys(spark, table):
    assert rows(table) == [] and table.put(spark.createDataFrame([], table.schema), ["at"]) == []
    table.put(spark.createDataFrame([(f"k{i}", 1, "a") for i in range(200)] + [(None, 1, "x")], table.schema), ["at"])
    assert len(rows(table)) == 200
    before = files(table.path)
    new = spark.createDataFrame([("k3", 2, "b"), ("k4", 0, "old"), ("new", 5, "n")], table.schema)
    touched = table.put(new, ["at"])
    after, own = files(table.path), {f"bucket={b}/" for b in touched}
    assert 0 < len(touched) <= 3
    for f in before:
        assert any(o in f for o in own) or after[f] == before[f]
    want = sorted([(f"k{i}", 1, "a") for i in range(200) if i != 3] + [("k3", 2, "b"), ("new", 5, "n")])
    assert rows(table) == want
    table.put(new, ["at"])  # a job that is run again
    assert rows(table) == want
    assert [tuple(r) for r in table.of(["k3", "nope"]).collect()] == [("k3", 2, "b")]
    plan = table.of(["k3"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_a_failing_change_leaves_the_table_as_it_was(spark, table):
    table.put(spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], table.schema), ["at"])
    before = files(table.path)
    with pytest.raises(Exception, match="stop"):
        table.change(spark.createDataFrame([("a", 2, "z")], table.schema), lambda old, new: new.withColumn("v", F.raise_error(F.lit("stop")).cast("string")))
    assert files(table.path) == before and rows(table) == [("a", 1, "x"), ("b", 1, "y")]


def test_remove_and_clear(spark, table):
    table.put(spark.createDataFrame([(f"k{i}", 1, "a") for i in range(10)], table.schema), ["at"])
    table.remove(spark.createDataFrame([(f"k{i}",) for i in range(7)] + [("none",)], "k string"))
    assert [r[0] for r in rows(table)] == ["k7", "k8", "k9"]
    table.remove(spark.createDataFrame([("k7",), ("k8",), ("k9",)], "k string"))
    assert rows(table) == [] and glob.glob(f"{table.path}/bucket=*") == []
    assert table.clear() == 0 and rows(table) == []


def test_registry_writes(spark, tmp_path):
    store = writes.Registry(spark, str(tmp_path), 4)
    urls = spark.createDataFrame([("https://a/1", 1), ("https://a/2", 2), ("https://a/2", 2), ("https://a/1", 3)], "url string, seq long")
    store.open(urls, F.lit("me"), F.lit(10).cast("long"))
    ids = {(r.url, r.id) for r in store.tabs.read().collect()}
    assert len(ids) == 3
    one, three = sorted(i for u, i in ids if u == "https://a/1")
    told = [(one, "parse", "text", None, None, 50), (three, "wayback", "later", "https://c", None, 60), ("unknown", "parse", "x", None, None, 70)]
    told = spark.createDataFrame(told, "id string, source string, markdown string, canonical_url string, error string, fetched_at long")
    for _ in range(2):
        store.record(told)
    got = {r.id: r for r in store.tabs.read().collect()}
    assert len(got) == 3 and got[one].status == "ready" and got[one].bytes_md == 4 and got[three].canonical_url == "https://c"
    assert [r.status for i, r in got.items() if i not in (one, three)] == ["pending"]
    assert [tuple(r) for r in store.cache.read().collect()] == [("https://a/1", three, "wayback", 60, 60 + 1_800_000)]
    # a later failure is told too; what is cached stays
    store.record(spark.createDataFrame([(three, None, None, None, "boom", 80)], told.schema))
    failed = store.tabs.of([three]).first()
    assert (failed.status, failed.source, failed.error, failed.fetched_at) == ("failed", None, '{"message":"boom"}', 80)
    assert store.clear() == (1, 0) and store.tabs.read().count() == 3 and store.clear(True) == (0, 3) and store.tabs.read().count() == 0


def test_the_board_equals_the_list_after_every_batch(spark, tmp_path):
    agents = spark.createDataFrame([(a, f"n{a}", 1, None) for a in ("x", "y", "z")], "id string, name string, last_seen_at long, metadata string")
    batches = [
        [("1", "x", "pending", 1), ("2", "x", "ready", 2), ("3", "y", "pending", 3)],
        [("1", "x", "ready", 5), ("1", "x", "failed", 4), ("3", "y", "failed", 6), ("4", None, "ready", 1)],
        [("3", "y", "pending", 3), ("5", "y", "ready", 9)],
    ]
    schema, seen, checked = "id string, agent_id string, status string, at long", [], []
    board = polling.SessionBoard(spark, str(tmp_path / "board"), 4)

    def update(batch, number):
        type(board).update(board, batch, number)
        type(board).update(board, batch, number)  # again, as after a failure
        seen.extend(tuple(r) for r in batch.collect())
        latest = {}
        for i, a, status, at in sorted(seen, key=lambda r: r[3]):
            latest[i, a] = status
        tabs = spark.createDataFrame([(i, a, s) for (i, a), s in latest.items()], "id string, agent_id string, status string")
        want = sorted(map(tuple, registry.session_list(agents, tabs).collect()))
        checked.append(sorted(map(tuple, board.sessions(agents).collect())) == want)

    board.update = update
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = polling.follow(board, stream, str(tmp_path / "state"), None)
    query.awaitTermination(120)
    assert query.exception() is None and checked == [True] * 3
