import random
from bisect import bisect_left, insort
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from webloom.llm.bestfit import balance, fill, pack


def one_by_one(sizes, capacity):
    """Bins that item-by-item best-fit decreasing opens, as the multiset of what they have left."""
    open_bins = []
    for s in sorted(sizes, reverse=True):
        i = bisect_left(open_bins, s)
        left = open_bins.pop(i) if i < len(open_bins) else capacity
        insort(open_bins, left - s)
    return Counter(open_bins)


def places(runs):
    for r in runs:
        for i in range(r.count):
            yield r.size, r.first + i, r.bin + i // r.per_bin, r.offset + i % r.per_bin * r.size


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_runs_equal_item_by_item(sizes):
    used, ranks, at = defaultdict(list), set(), list(places(pack(Counter(sizes), 64)))
    for size, rank, number, offset in at:
        used[number].append((offset, size))
        ranks.add((size, rank))
    assert ranks == {(s, i) for s, n in Counter(sizes).items() for i in range(n)} and len(at) == len(sizes)
    for items in used.values():
        end = 0
        for offset, size in sorted(items):
            assert offset == end
            end += size
        assert end <= 64
    assert Counter(64 - sum(s for _, s in x) for x in used.values()) == one_by_one(sizes, 64)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 500), max_size=100))
def test_treap_finds_the_same_bins(sizes):
    sums = defaultdict(int)
    for r in fill(sorted(Counter(sizes).items(), reverse=True), 500):
        sums[r.bin] += r.size * r.count
    assert Counter(500 - s for s in sums.values()) == one_by_one(sizes, 500)


def test_plans_stay_small_whatever_the_number_of_items():
    runs = pack({s: 10**9 + s for s in range(1, 1025)}, 1024)
    assert len(runs) < 40_000


def test_balance_is_near_equal():
    rng = random.Random(3)
    sizes = [rng.randint(1, 5000) for _ in range(4000)]
    sums = defaultdict(int)
    seen = set()
    for size, rank, number, _ in places(balance(Counter(sizes), 16)):
        sums[number] += size
        seen.add((size, rank))
    assert len(seen) == len(sizes) and max(sums.values()) - min(sums.values()) < 0.02 * sum(sizes) / 16


def test_a_giant_group_has_a_shard_of_its_own():
    sums = defaultdict(int)
    for size, _, number, _ in places(balance({10_000: 1, 10: 1000}, 4)):
        sums[number] += size
    *rest, giant = sorted(sums.values())
    assert giant == 10_000 and sum(rest) == 10_000 and max(rest) - min(rest) <= 20
