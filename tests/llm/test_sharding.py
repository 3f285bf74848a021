import zlib
from collections import defaultdict

from tests.llm.conftest import ODD
from webloom.llm.sharding import op4_sharding, shard_by_capacity, shard_evenly


def invariants(rows, want):
    assert sorted((repr(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted((repr(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in want)
    slots, places = defaultdict(list), defaultdict(set)
    for r in rows:
        slots[r.shard].append(r.slot)
        places[(r.size, r.text_crc32)].add(r.shard)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert all(len(x) == 1 for x in places.values())


def test_odd_rows(odd, none):
    rows = shard_evenly(odd, 4).collect()
    invariants(rows, [(i, t) for i, t, _ in ODD])
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    assert shard_evenly(none, 4).count() == 0


def test_copies_and_balance(spark):
    want = [(i, f"text {i % 900} " + "x" * (i % 900 % 97)) for i in range(3000)]
    rows = shard_evenly(spark.createDataFrame(want, "doc_id long, text string").repartition(20), 16).collect()
    invariants(rows, want)
    sums = defaultdict(int)
    for r in rows:
        sums[r.shard] += r.size
    assert len(sums) == 16 and max(sums.values()) - min(sums.values()) < 500


def test_fixed_capacity(spark, odd):
    rows = shard_by_capacity(odd, 50).collect()
    invariants(rows, [(i, t) for i, t, _ in ODD])
    sums = defaultdict(int)
    for r in rows:
        sums[r.shard] += r.size
    assert sorted(sums.values())[-1] == max(r.size for r in rows) and all(s <= 50 for s in sorted(sums.values())[:-1])


def naive_fill(sizes, capacity):
    """Bins of item-by-item best-fit decreasing."""
    left = []
    for size in sorted(sizes, reverse=True):
        fits = [b for b in range(len(left)) if left[b] >= size]
        if fits:
            left[min(fits, key=lambda b: (left[b], b))] -= size
        else:
            left.append(capacity - size)
    return [capacity - x for x in left]


def test_balance_of_the_whole_query(spark):
    """The shards' bytes are those of item-by-item best-fit decreasing at the least capacity that needs 16 bins."""
    d = "/root/testdata/sf0.001"
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(d + "/documents.parquet").collect()]
    rows = op4_sharding(spark, d).collect()
    invariants(rows, texts)
    groups, sums = defaultdict(int), defaultdict(int)
    for _, t in texts:
        groups[t or ""] += len((t or "").encode()) + 1
    for r in rows:
        sums[r.shard] += r.size
    sizes = list(groups.values())
    low = max(max(sizes), -(-sum(sizes) // 16))
    assert max(sizes) * 16 <= sum(sizes) or max(sums.values()) == max(sizes)
    if max(sizes) * 16 <= sum(sizes):
        got = max(sums.values())
        assert len(naive_fill(sizes, got)) <= 16 and (got == low or len(naive_fill(sizes, got - 1)) > 16) or sorted(sums.values()) == sorted(naive_fill(sizes, got))
