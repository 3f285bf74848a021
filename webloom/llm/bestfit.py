"""Best-fit decreasing over runs of equal sizes, with trees that find the tightest open bin in logarithmic time.

Items of one size are interchangeable, so the state that decides is a histogram of sizes, not the items: a run of n
equal items visits the tree once for every bin it fills, and the outcome is the one that item-by-item best-fit
decreasing gives. The driver sees the histogram only; items find their place from their rank within their size.
"""

from __future__ import annotations

import random
from dataclasses import dataclass


class CapacityTree:
    """Segment tree over remaining capacities 0..capacity; a leaf counts the open bins that have just so much left."""

    def __init__(self, capacity: int):
        self.capacity, self.width = capacity, 1 << capacity.bit_length()
        self.counts = [0] * (2 * self.width)

    def add(self, remaining: int, bins: int) -> None:
        i = remaining + self.width
        while i:
            self.counts[i] += bins
            i >>= 1

    def tightest(self, size: int) -> int | None:
        """The smallest remaining capacity of at least `size` that some open bin has."""
        i = size + self.width
        if self.counts[i]:
            return size
        while i > 1:
            if not i & 1 and self.counts[i + 1]:  # a right sibling that holds bins: go to its leftmost leaf
                i += 1
                while i < self.width:
                    i = 2 * i if self.counts[2 * i] else 2 * i + 1
                return i - self.width
            i >>= 1
        return None


class BinTree:
    """Balanced search tree (a treap) of open bins by (remaining capacity, bin); for capacities of any size."""

    def __init__(self, seed: int = 1):
        self.root, self.rng = None, random.Random(seed)

    def add(self, remaining: int, number: int) -> None:
        below, above = self._split(self.root, (remaining, number))
        node = [(remaining, number), self.rng.random(), None, None]
        self.root = self._join(self._join(below, node), above)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the bin with the smallest remaining capacity of at least `size`."""
        below, above = self._split(self.root, (size, -1))
        if above is None:
            self.root = below
            return None
        least = above
        while least[2]:
            least = least[2]
        rest = self._split(above, (least[0][0], least[0][1] + 1))[1]
        self.root = self._join(below, rest)
        return least[0]

    def _split(self, node, key):
        if node is None:
            return None, None
        if node[0] < key:
            low, high = self._split(node[3], key)
            return [node[0], node[1], node[2], low], high
        low, high = self._split(node[2], key)
        return low, [node[0], node[1], high, node[3]]

    def _join(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            return [a[0], a[1], a[2], self._join(a[3], b)]
        return [b[0], b[1], self._join(a, b[2]), b[3]]


@dataclass(frozen=True)
class Run:
    """Items of `size` with ranks first..first+count-1: item i goes to bin + i // per_bin at offset + (i % per_bin) * size."""

    size: int
    first: int
    count: int
    bin: int
    per_bin: int
    offset: int


def pack(histogram: dict[int, int], capacity: int) -> list[Run]:
    """Best-fit decreasing of histogram[size] items of each size (1..capacity) into as few bins of `capacity` as it can.

    Open bins are held as ranges of consecutive numbers with the same capacity left. A range that takes items of size s
    goes on with (what was left) mod s, less than half, so it is visited at most log2(capacity) + 1 times, and each size
    adds at most two ranges: the runs returned number O(capacity * log(capacity)), whatever the number of items.
    """
    tree, ranges, opened, runs = CapacityTree(capacity), [[] for _ in range(capacity + 1)], 0, []
    for size in sorted(histogram, reverse=True):
        placed, n = 0, histogram[size]
        while placed < n:
            left = tree.tightest(size)
            if left is None:
                per_bin = min(capacity // size, n - placed)
                start, bins, left = opened, max(1, (n - placed) // per_bin), capacity
                opened += bins
            else:
                start, bins = ranges[left].pop()
                tree.add(left, -bins)
                per_bin = min(left // size, n - placed)
                use = min(bins, max(1, (n - placed) // per_bin))
                if use < bins:
                    ranges[left].append((start + use, bins - use))
                    tree.add(left, bins - use)
                bins = use
            runs.append(Run(size, placed, bins * per_bin, start, per_bin, capacity - left))
            placed += bins * per_bin
            ranges[left - per_bin * size].append((start, bins))
            tree.add(left - per_bin * size, bins)
    return runs


def fill(histogram: list[tuple[int, int]], capacity: int, most_bins: int | None = None) -> list[Run] | None:
    """Best-fit decreasing of (size, count) pairs, sizes falling, into bins of a large `capacity`; offsets are not kept.

    None if it needs more than `most_bins`. A size above the capacity is an error of the caller.
    """
    tree, opened, runs = BinTree(), 0, []
    for size, n in histogram:
        placed = 0
        while placed < n:
            found = tree.take_tightest(size)
            if found is None:
                if most_bins is not None and opened >= most_bins:
                    return None
                found, opened = (capacity, opened), opened + 1
            left, number = found
            k = min(n - placed, left // size)
            runs.append(Run(size, placed, k, number, k, 0))
            placed += k
            tree.add(left - k * size, number)
    return runs


def balance(histogram: dict[int, int], bins: int) -> list[Run]:
    """Puts all items into `bins` bins of near-equal sums: best-fit decreasing at the smallest capacity that suffices.

    An item larger than an equal share of what is left gets a bin of its own (it is indivisible), and the others share
    the rest; the capacity for those is found by bisection between that share and the share plus the largest item.
    """
    items = sorted(((s, n) for s, n in histogram.items() if n), reverse=True)
    runs, total, alone = [], sum(s * n for s, n in items), 0
    while items and bins - alone > 1 and items[0][0] * (bins - alone) > total:
        size, n = items[0]
        done = sum(r.count for r in runs if r.size == size)
        runs.append(Run(size, done, 1, alone, 1, 0))
        total, alone = total - size, alone + 1
        items = ([(size, n - 1)] if n > 1 else []) + items[1:]
    rest = bins - alone
    if items:
        low = max(items[0][0], -(-total // rest))
        high = max(items[0][0], -(-total // rest) + items[0][0])
        best = None
        while best is None:
            best = fill(items, high, rest)
            if best is None:
                high *= 2
        while low < high:
            middle = (low + high) // 2
            tried = fill(items, middle, rest)
            if tried is None:
                low = middle + 1
            else:
                best, high = tried, middle
        placed = {r.size: 0 for r in runs}
        for r in runs:
            placed[r.size] += 1
        runs += [Run(r.size, r.first + placed.get(r.size, 0), r.count, r.bin + alone, r.per_bin, 0) for r in best]
    return runs
