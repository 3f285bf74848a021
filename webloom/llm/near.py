"""N-gram Jaccard self-join by signature trees.

A set of n shingles that links to another shares one of its first n - ceil(t n) + 1 shingles in any common order, so
every set goes to the blocks of those shingles only and each link has a block of its own. Frequent shingles come last in
the order, which keeps blocks small. Within a block the sets form a signature tree: nodes hold the OR of their members'
bitmaps and their range of sizes, and a dual traversal skips node pairs whose largest possible overlap is too small.
What is left connects sets into clusters; the whole sets of a cluster are compared, again through a tree, and links are
joined into components.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm import graph, vec
from webloom.llm.common import checkpointed, shuffle_width, table

#: A shingle in at least this share of all documents (and in MANY at least), or in CROWDED, is frequent and comes late in the order.
FREQUENT = 1e-4
MANY = 8
CROWDED = 256
#: At most so many frequent shingles (17 bytes each) are broadcast, the most frequent ones; this changes the order of shingles only.
FREQUENT_ROWS = 1_000_000
LEAF = 8
#: Blocks of more sets give a forest that connects the sets instead of the pairs that their tree leaves, if these are more than
#: half as many for each set.
LISTED = 64
#: A shingle in so many documents has no block: its sets are connected to the smallest id that has it. No task holds more of a block.
HOT = 4096
#: Texts are turned into sets in parts of about so many bytes.
PART_BYTES = 4_000_000
#: Shingles are counted over so many at a time, so that one that a few of a thousand documents share is seen twice.
COUNTED = 3_000_000
#: Members of a piece of a cluster, and shingles of all of them; about so many, as members are dealt by a hash.
PIECE = 1024
PIECE_SHINGLES = 2_000_000
#: Members of a component that stand for it when pieces first meet.
DELEGATES = 8
#: At most so many ids are broadcast as an array (8 bytes each) or as rows of a join (about 100 bytes each on the driver); more are
#: joined by shuffle.
BROADCAST_IDS = 1_000_000
BROADCAST_ROWS = 100_000
#: Edges that one task turns into a forest.
FOREST_ROWS = 1_000_000
_SAMPLE = 48
U = np.uint64


def first_shingles(n: int, percent: int) -> int:
    """How many of the first of n shingles two linked sets share one of."""
    return n - (percent * n + 99) // 100 + 1


def least_overlap(a, b, percent: int):
    """The overlap from which sets of a and b shingles link: 100 i >= percent (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def signature(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a sample of the set; the rate falls with the set's size and samples of lower rates are parts of others."""
    rate = min(1.0, _SAMPLE / (1 << (len(s).bit_length() - 1)))
    chosen = s if rate == 1 else s[vec.mix(s) < U(int(rate * 2**64))]
    bits = np.unique(chosen & U(127)).astype("i8")
    low, high = sum(1 << int(b) for b in bits if b < 64), sum(1 << int(b - 64) for b in bits if b >= 64)
    return low, high


def _bits(low: int, high: int) -> int:
    return (low & 0xFFFFFFFFFFFFFFFF) | (high & 0xFFFFFFFFFFFFFFFF) << 64


class Node:
    __slots__ = ("low", "high", "bits", "spare", "scale", "members", "children", "one")


def tree(size, bits) -> Node:
    """A signature tree over members sorted by size. bits: ints of 128 bits."""

    def leaf(members) -> Node:
        node = Node()
        node.members, node.children, node.one = members, (), len(members) == 1
        node.low, node.high = size[members[0]], size[members[-1]]
        node.bits = 0
        for m in members:
            node.bits |= bits[m]
        node.spare = max(size[m] - bits[m].bit_count() for m in members)
        node.scale = {int(size[m]).bit_length() for m in members}
        return node

    level = [leaf(range(i, min(i + LEAF, len(size)))) for i in range(0, len(size), LEAF)]
    while len(level) > 1:
        above = []
        for i in range(0, len(level), LEAF):
            part, node = level[i : i + LEAF], Node()
            node.children, node.one = part, False
            node.members = range(part[0].members.start, part[-1].members.stop)
            node.low, node.high, node.bits = part[0].low, part[-1].high, 0
            for p in part:
                node.bits |= p.bits
            node.spare = max(p.spare for p in part)
            node.scale = set().union(*(p.scale for p in part))
            above.append(node)
        level = above
    return level[0]


def can_link(x: Node, y: Node, percent: int) -> bool:
    """Whether some member of x may link with one of y, by their sizes and bitmaps."""
    if 100 * x.high < percent * y.low or 100 * y.high < percent * x.low:
        return False
    # common shingles with bits of their own, and those that share a bit or weren't sampled
    spare = min(x.spare, y.spare) if len(x.scale | y.scale) == 1 else max(x.spare, y.spare)
    return (x.bits & y.bits).bit_count() + spare >= least_overlap(x.low, y.low, percent)


def may_link(size, bits, i: int, j: int, percent: int) -> bool:
    """The same of two members, i the smaller one."""
    if 100 * size[i] < percent * size[j]:
        return False
    a, b = size[i] - bits[i].bit_count(), size[j] - bits[j].bit_count()
    spare = min(a, b) if int(size[i]).bit_length() == int(size[j]).bit_length() else b
    return (bits[i] & bits[j]).bit_count() + spare >= least_overlap(size[i], size[j], percent)


def tree_pairs(size, bits, percent: int, most: int | None = None) -> list[tuple[int, int]] | None:
    """Pairs (i < j) of members of one block that may link, by dual traversal of its tree; None if there are more than `most`."""
    root = tree(size, bits)
    stack, out = [(root, root)], []
    while stack:
        x, y = stack.pop()
        if not can_link(x, y, percent):
            continue
        if x.children or y.children:
            xs, ys = x.children or (x,), y.children or (y,)
            stack += [(xs[i], ys[j]) for i in range(len(xs)) for j in range(i if x is y else 0, len(ys))]
            continue
        for i in x.members:
            for j in y.members:
                if i < j and may_link(size, bits, i, j, percent):
                    out.append((i, j))
        if most is not None and len(out) > most:
            return None
    return out


class Sets:
    """Disjoint sets of numbers, named by their smallest."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j

    def same(self, node: Node) -> bool:
        """Whether a node's members are known to be one set."""
        if not node.one:
            if node.children:
                roots = {self.root(c.members.start) for c in node.children} if all(map(self.same, node.children)) else ()
            else:
                roots = {self.root(m) for m in node.members}
            node.one = len(roots) == 1
        return node.one


def leaf_pairs(root: Node, known: Sets, percent: int):
    """Pairs of leaves of which some members may link, by dual traversal; not those whose members are one set by then."""
    stack = [(root, root)]
    while stack:
        x, y = stack.pop()
        if known.same(x) and known.same(y) and known.root(x.members.start) == known.root(y.members.start) or not can_link(x, y, percent):
            continue
        if x.children or y.children:
            xs, ys = x.children or (x,), y.children or (y,)
            pairs = [(xs[i], ys[j]) for i in range(len(xs)) for j in range(i if x is y else 0, len(ys))]
            stack += sorted(pairs, key=lambda p: p[0] is p[1])  # what is close meets first
        else:
            yield x, y


def tree_forest(size, bits, percent: int) -> list[tuple[int, int]]:
    """Pairs (i < j) that connect the same members as tree_pairs, fewer than there are members."""
    known, out = Sets(len(size)), []
    for x, y in leaf_pairs(tree(size, bits), known, percent):
        for i in x.members:
            for j in y.members:
                if i < j and known.root(i) != known.root(j) and may_link(size, bits, i, j, percent):
                    known.join(i, j)
                    out.append((i, j))
    return out


def _fingerprint(s: np.ndarray) -> int:
    return int(vec.mix(np.array([np.sum(vec.mix(s ^ U(0x5DEECE66D)))], U) + U(len(s)))[0].astype("i8")) if len(s) else 0


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _measure(docs: DataFrame, k: int) -> DataFrame:
    """kind 0: (id, n, fingerprint, signature) of each row; kind 1: (shingle as print, documents of a part that have it as n, the
    smallest id of those) where several do."""

    def counted(shingles: list, ids: list):
        values, owner = np.concatenate(shingles), np.concatenate(ids)
        order = np.lexsort((owner, values))
        values, owner = values[order], owner[order]
        at = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        count = np.diff(np.append(at, len(values)))
        at, count = at[count >= 2], count[count >= 2]
        zero = pa.array(np.zeros(len(at), "i8"))
        columns = [pa.array(owner[at]), pa.array(count), pa.array(values[at].view("i8")), zero, zero]
        return pa.RecordBatch.from_arrays([pa.array(np.ones(len(at), "i4")), *columns], names=["kind", "id", "n", "print", "low", "high"])

    def run(batches):
        held, owners, size = [], [], 0
        for batch in vec.parts(batches, 1, PART_BYTES):
            sets = list(vec.sets(batch.column(1), k))
            bits = [signature(s) if len(s) else (0, 0) for s in sets]
            n, prints = np.array([len(s) for s in sets], "i8"), np.array([_fingerprint(s) for s in sets], "i8")
            columns = [batch.column(0), pa.array(n), pa.array(prints), *(pa.array([_signed(b[c]) for b in bits], pa.int64()) for c in (0, 1))]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), "i4")), *columns], names=["kind", "id", "n", "print", "low", "high"])
            for i, s in zip(batch.column(0).to_pylist(), sets, strict=True):
                if i is not None and len(s):
                    held.append(s)
                    owners.append(np.full(len(s), i))
                    size += len(s)
            if size >= COUNTED:
                yield counted(held, owners)
                held, owners, size = [], [], 0
        if size:
            yield counted(held, owners)

    return docs.mapInArrow(run, "kind int, id long, n long, print long, low long, high long")


def _frequent(measured: DataFrame, total: int):
    """A broadcast of the frequent shingles, sorted, with the binary logarithm of how many documents have them and a hub for hot ones.

    The list is cut at a count that leaves at most FREQUENT_ROWS: shingles below it are ordered like any others.
    """
    often = measured.where("kind = 1").groupBy(F.col("print").alias("shingle")).agg(F.sum("n").alias("n"), F.min("id").alias("hub"))
    often = checkpointed(often.where(F.col("n") >= max(MANY, min(CROWDED, math.ceil(FREQUENT * total)))).withColumn("tier", F.log2("n").cast("int")))
    rows = 0
    for r in sorted(often.groupBy("tier").agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        rows += r["n"]
        if rows > FREQUENT_ROWS:
            often = often.where(F.col("tier") > r["tier"])
            break
    listed = often.toArrow()
    shingle = listed["shingle"].to_numpy().view(U)
    order = np.argsort(shingle)
    tier, hub = listed["tier"].to_numpy().astype(np.uint8)[order], listed["hub"].to_numpy()[order]
    hot = listed["n"].to_numpy()[order] >= HOT
    return measured.sparkSession.sparkContext.broadcast((shingle[order], tier + np.uint8(1), np.flatnonzero(hot), hub[hot]))


_BLOCKS = ["token", "print", "id", "n", "low", "high"]


def _blocks(docs: DataFrame, k: int, percent: int, frequent) -> DataFrame:
    """A row per set and block that it goes to; sets that a part holds more than once go once, as the smallest id. Instead
    of a hot shingle's block: (its hub as print, id) with n = 0."""

    def run(batches):
        shingle, tier, hot, hub = frequent.value
        for batch in vec.parts(batches, 1, PART_BYTES):
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            first: dict[tuple, int] = {}
            sets = list(vec.sets(batch.column(1), k))
            for i, s in enumerate(sets):
                if known[i] and len(s):
                    key = (len(s), _fingerprint(s), *signature(s))
                    if key not in first or ids[i] < ids[first[key]]:
                        first[key] = i
            out: list = [[] for _ in _BLOCKS]
            for (n, value, low, high), i in first.items():
                s, take = sets[i], first_shingles(n, percent)
                at = np.searchsorted(shingle, s)
                at[at == len(shingle)] = 0
                at = np.where(shingle[at] == s, at, -1) if len(shingle) else np.full(n, -1)
                level = np.where(at >= 0, tier[at], 0).astype(U) if len(shingle) else np.zeros(n, U)
                chosen = np.argpartition((level << U(58)) | (s >> U(6)), take - 1)[:take] if take < n else np.arange(n)
                place = np.searchsorted(hot, at[chosen])
                place[place == len(hot)] = 0
                is_hot = (hot[place] == at[chosen]) & (at[chosen] >= 0) if len(hot) else np.zeros(take, bool)
                hubs, uses = np.unique(hub[place[is_hot]], return_counts=True) if is_hot.any() else (np.zeros(0, "i8"),) * 2
                own, m = s[chosen[~is_hot]].view("i8"), take - int(is_hot.sum())
                out[0] += [own, np.full(len(hubs), value)]
                out[1] += [np.full(m, value), hubs]
                out[2].append(np.full(m + len(hubs), ids[i]))
                out[3] += [np.full(m, n), -uses]
                for c, b in ((4, low), (5, high)):
                    out[c].append(np.full(m + len(hubs), _signed(b)))
            if first:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype("i8", copy=False)) for x in out], names=_BLOCKS)

    return docs.mapInArrow(run, ", ".join(f"{c} long" for c in _BLOCKS))


_FOUND = ["kind", "a", "b", "na", "nb"]


def _found(kind: int, a, b, na=None, nb=None) -> pa.RecordBatch:
    zero = np.zeros(len(a), "i8")
    columns = [pa.array(np.asarray(zero if c is None else c, "i8")) for c in (a, b, na, nb)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, "i4")), *columns], names=_FOUND)


def _runs(batches):
    """Rows of successive blocks (runs of one token) from batches that are sorted by token: (whole, arrays of one or more blocks).

    A block of more than HOT rows comes in parts that aren't whole; the last of them holds what is left of it.
    """
    held, cut_token = None, None
    for batch in batches:
        own = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in _BLOCKS}
        if held is not None:
            own = {c: np.concatenate([held[c], own[c]]) for c in _BLOCKS}
        token = own["token"]
        if cut_token is not None and len(token):
            rest = int(np.searchsorted(token, cut_token, "right"))
            if rest:
                yield False, {c: v[:rest] for c, v in own.items()}
                own = {c: v[rest:] for c, v in own.items()}
                token = own["token"]
        if not len(token):
            held = None
            continue
        cut = int(np.searchsorted(token, token[-1], "left"))
        if cut:
            yield True, {c: v[:cut] for c, v in own.items()}
        held = {c: v[cut:] for c, v in own.items()}
        if len(token) - cut > HOT:
            yield False, held
            held, cut_token = None, token[-1]
        else:
            cut_token = None if cut_token != token[-1] else cut_token
    if held is not None and len(held["token"]):
        yield True, held


def _candidates(blocks: DataFrame, percent: int) -> DataFrame:
    """kind 0: pairs (a, b, their sizes) that may link, once for each block; of larger blocks with many such pairs kind 1: the
    members (a) with how many such blocks (na), and kind 2: pairs that connect what may link."""

    def run(batches):
        stars: list[pa.RecordBatch] = []
        hub = None  # of the block that comes in parts

        def in_blocks():
            for batch in batches:
                star = batch.column("n").to_numpy() < 0
                if star.any():
                    own = [batch.column(c).to_numpy()[star] for c in ("id", "print", "n")]
                    stars.extend((_found(1, own[0], own[0], -own[2]), _found(2, own[1], own[0])))
                yield batch.filter(pa.array(~star))

        for whole, rows in _runs(in_blocks()):
            yield from stars
            stars.clear()
            if not whole:
                if hub is None or hub[0] != rows["token"][0]:
                    hub = (rows["token"][0], rows["id"][0])
                yield _found(1, rows["id"], rows["id"], np.ones(len(rows["id"])))
                yield _found(2, np.full(len(rows["id"]), hub[1]), rows["id"], None, rows["n"])
                continue
            # equal sets of one block: the first, which has the smallest id, stays
            keep = np.ones(len(rows["token"]), bool)
            keep[1:] = np.logical_or.reduce([rows[c][1:] != rows[c][:-1] for c in ("token", "n", "print", "low", "high")])
            token, ids, n, low, high = (rows[c][keep] for c in ("token", "id", "n", "low", "high"))
            edges = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]]))
            length = np.diff(edges)
            block = np.repeat(np.arange(len(length)), length)
            # trees of one leaf, all at once
            at = np.flatnonzero((length[block] > 1) & (length[block] <= LEAF))
            ones = [np.bitwise_count(x.view(U)).astype("i8") for x in (low, high)]
            loose = n - ones[0] - ones[1]
            scale = np.frexp(n.astype("f8"))[1]
            for d in range(1, LEAF):
                i, j = at[:-d], at[d:]
                pair = (block[i] == block[j]) & (100 * n[i] >= percent * n[j])
                i, j = i[pair], j[pair]
                common = np.bitwise_count((low[i] & low[j]).view(U)).astype("i8") + np.bitwise_count((high[i] & high[j]).view(U))
                spare = np.where(scale[i] == scale[j], np.minimum(loose[i], loose[j]), loose[j])
                pair = common + spare >= least_overlap(n[i], n[j], percent)
                i, j = i[pair], j[pair]
                if len(i):
                    yield _found(0, ids[i], ids[j], n[i], n[j])
            listed, members, forest = [], [], []
            for x in np.flatnonzero(length > LEAF):
                s, e = int(edges[x]), int(edges[x + 1])
                bits = [_bits(int(a), int(b)) for a, b in zip(low[s:e], high[s:e], strict=True)]
                pairs = tree_pairs(n[s:e].tolist(), bits, percent, LISTED * (e - s) // 2)
                if pairs is not None:
                    listed += [(s + i, s + j) for i, j in pairs]
                else:
                    members.append(np.arange(s, e))
                    forest += [(s + i, s + j) for i, j in tree_forest(n[s:e].tolist(), bits, percent)]
            if listed:
                i, j = np.array(listed).T
                yield _found(0, ids[i], ids[j], n[i], n[j])
            if members:
                members = np.concatenate(members)
                yield _found(1, ids[members], ids[members], np.ones(len(members)))
            if forest:
                i, j = np.array(forest).T
                yield _found(2, ids[i], ids[j], n[i], n[j])
        yield from stars

    dealt = blocks.repartition("token").sortWithinPartitions("token", "n", "print", "low", "high", "id")
    return dealt.mapInArrow(run, "kind int, a long, b long, na long, nb long")


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) of every id in `edges` (a, b; checkpointed, a <> b): comp is the smallest id reachable."""
    return graph.components(edges, FOREST_ROWS)


def _maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _those(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs (id, text) whose id is in `ids` (id, distinct): a sorted array of ids goes to the tasks, so that no text is shuffled."""
    rows = ids.count()
    if rows > BROADCAST_IDS:
        return docs.join(ids, "id", "left_semi")
    wanted = docs.sparkSession.sparkContext.broadcast(np.sort(ids.toArrow()["id"].to_numpy()))

    def run(batches):
        known = wanted.value
        for batch in batches:
            own = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            at = np.searchsorted(known, own)
            at[at == len(known)] = 0
            hit = known[at] == own if len(known) else np.zeros(len(own), bool)
            yield batch.filter(pa.array(hit & batch.column(0).is_valid().to_numpy(zero_copy_only=False)))

    return docs.mapInArrow(run, "id long, text string")


def overlaps(sets: list[np.ndarray], cells: int = 2_000_000) -> np.ndarray:
    """The overlaps of all pairs of sets: shingles of a few sets count for each pair, the others are columns of an incidence
    matrix whose product is taken in strips of about `cells` entries."""
    m = len(sets)
    flat, row = np.concatenate(sets), np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    at = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    uses = np.diff(np.append(at, len(flat)))
    number = np.repeat(np.arange(len(at)), uses)
    few, out = 8, np.zeros((m, m), np.float32)
    keep = (uses[number] > 1) & (uses[number] <= few)
    r, v = row[keep], number[keep]
    for d in range(1, few):
        same = v[d:] == v[:-d]
        pairs = np.bincount(r[:-d][same] * m + r[d:][same], minlength=m * m) if same.any() else 0
        out += np.reshape(pairs, (m, m)) if same.any() else 0
    out += out.T
    keep = uses[number] > few
    r, v = row[keep], number[keep]
    v = np.cumsum(np.concatenate([[0], v[1:] != v[:-1]])) if len(v) else v
    wide = max(1, cells // m)
    for start in range(0, int(v[-1]) + 1 if len(v) else 0, wide):
        a, b = np.searchsorted(v, [start, start + wide])
        strip = np.zeros((m, wide), np.float32)
        strip[r[a:b], v[a:b] - start] = 1
        out += strip @ strip.T
    return out


#: Members that all others of a piece are compared with before trees are used.
LEADERS = 6


def joined(ids: list[int], comp: list[int], sets: list[np.ndarray], percent: int) -> list[int]:
    """For each member of a piece the smallest component (a number) that links within the piece connect it to.

    Some members are compared with all others first, which joins most of a group of near copies. Members outside the largest
    component then meet the leaves that the signature tree leaves for them.
    """
    order = sorted(range(len(ids)), key=lambda i: (len(sets[i]), ids[i]))
    sets, names = [sets[i] for i in order], [comp[i] for i in order]
    n = np.array([len(s) for s in sets])
    known, first = Sets(len(ids)), {}
    for i, c in enumerate(names):
        known.join(first.setdefault(c, i), i)
    for i, c in enumerate(ids[x] for x in order):  # an id with several texts
        known.join(first.setdefault(("id", c), i), i)
    flat, ends = np.concatenate(sets), np.cumsum(n)

    def root_of() -> np.ndarray:
        return np.array([known.root(i) for i in range(len(ids))])

    pending = np.arange(len(ids))
    for _ in range(LEADERS):
        leader = int(pending[len(pending) // 2])
        at = np.searchsorted(sets[leader], flat)
        at[at == n[leader]] = 0
        hit = sets[leader][at] == flat
        both = np.diff(np.concatenate([[0], np.cumsum(hit)])[np.concatenate([[0], ends])])
        for i in np.flatnonzero(100 * both >= percent * (n + n[leader] - both)).tolist():
            known.join(leader, i)
        root = root_of()
        pending = pending[root[pending] != root[leader]]
        if not len(pending):
            break
    label, count = np.unique(root_of(), return_counts=True)
    if len(label) > 1:
        main = label[np.argmax(count)]
        other = root_of() != main
        near = np.zeros((len(ids), len(ids)), bool)
        for x, y in leaf_pairs(tree(n.tolist(), [_bits(*signature(s)) for s in sets]), known, percent):
            near[x.members.start : x.members.stop, y.members.start : y.members.stop] = True
        near &= other[:, None] | other
        if near.any():
            both = overlaps(sets)
            root = root_of()
            near &= (100 * both >= percent * (n[:, None] + n - both)) & (root[:, None] != root)
            i, j = np.nonzero(near)
            for a, b in np.unique(np.stack([root[i], root[j]]), axis=1).T.tolist():
                known.join(a, b)
    least: dict[int, int] = {}
    for i, c in enumerate(names):
        r = known.root(i)
        least[r] = min(c, least.get(r, c))
    out = [0] * len(ids)
    for place, i in enumerate(order):
        out[i] = least[known.root(place)]
    return out


def _compared(dealt: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """dealt: (group, id, comp, pieces) to (comp, to, pieces, id): the component that links within the group connect `comp` to.

    Each text is read once, and each set goes once to every group that it is in.
    """
    needed = checkpointed(dealt.select("id").distinct())

    def sets_of(batches):
        for batch in vec.parts(batches, 1, PART_BYTES):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in vec.sets(batch.column(1), k)], pa.binary())], names=["id", "s"])

    def grouped(batches):
        group, rows = None, []
        for batch in batches:
            for g, *row in zip(*(batch.column(c).to_pylist() for c in ("group", "id", "comp", "pieces", "s")), strict=True):
                if g != group:
                    yield rows
                    group, rows = g, []
                rows.append(row)
        yield rows

    def links(batches):
        for rows in grouped(batches):
            if rows:
                ids, comp, pieces, sets = zip(*rows, strict=True)
                to = joined(list(ids), list(comp), [np.frombuffer(x, U) for x in sets], percent) if len(rows) > 1 else comp
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (comp, to, pieces, ids)], names=["comp", "to", "pieces", "id"])

    sets = _those(docs, needed).mapInArrow(sets_of, "id long, s binary").where("octet_length(s) > 0")
    rows = sets.join(dealt, "id").select("group", "id", "comp", "pieces", "s")
    return checkpointed(rows.repartition("group").sortWithinPartitions("group").mapInArrow(links, "comp long, to long, pieces long, id long"))


def _linked(candidates: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(id, comp): components of the links among the candidate pairs (a, b), and within what they connect.

    Candidates connect ids into clusters. A cluster is cut into pieces of PIECE members by a hash, and the members of a piece
    are compared; a cluster of one piece is done. Of larger ones, some members of every component so far meet in pieces again,
    which joins the parts of a group of near copies. At last, members outside the largest component of a cluster meet
    every piece: that component is never compared to itself, and no task holds more than two pieces or so.
    """
    clusters = components(candidates.select("a", "b")).withColumnRenamed("comp", "cluster")
    size = candidates.select(F.col("a").alias("id"), F.col("na").alias("n")).union(candidates.select("b", "nb")).groupBy("id").agg(F.max("n").alias("n"))
    clusters = checkpointed(clusters.join(size, "id"))
    needed = lambda rows, n: F.ceil(F.greatest(rows / PIECE, n / PIECE_SHINGLES)).cast("long")
    sizes = clusters.groupBy("cluster").agg(needed(F.count(F.lit(1)), F.sum("n")).alias("pieces"))
    several = checkpointed(sizes.where("pieces > 1"))
    large = several.count()
    pieces = F.coalesce("pieces", F.lit(1).cast("long")) if large else F.lit(1).cast("long")
    clusters = clusters.join(_maybe_broadcast(several, large), "cluster", "left") if large else clusters
    dealt = clusters.select("cluster", "id", "n", pieces.alias("pieces"))
    dealt = checkpointed(dealt.withColumn("group", F.xxhash64("cluster", F.pmod(F.xxhash64("id", F.lit(7)), F.col("pieces")))).withColumn("comp", F.col("id")))
    local = _compared(dealt.select("group", "id", "comp", "pieces"), docs, k, percent)
    done = local.where("pieces = 1").select("id", F.col("to").alias("comp")).groupBy("id").agg(F.min("comp").alias("comp"))
    if not large:
        return done
    known = local.where("pieces > 1").groupBy("id").agg(F.min("to").alias("comp"))
    known = checkpointed(dealt.where("pieces > 1").select("cluster", "id", "n").join(known, "id").withColumn("sort", F.xxhash64("id", F.lit(5))))
    shares = known.groupBy("comp").agg(F.count(F.lit(1)).alias("members"))
    chosen = known.join(shares, "comp").where((F.col("id") == F.col("comp")) | (F.pmod("sort", F.ceil(F.col("members") / DELEGATES)) == 0))
    counts = chosen.groupBy("cluster").agg(needed(F.count(F.lit(1)), F.sum("n")).alias("parts"))
    chosen = chosen.join(counts, "cluster").withColumn("group", F.xxhash64("cluster", F.pmod(F.xxhash64("comp", F.lit(9)), F.col("parts"))))
    met = _compared(checkpointed(chosen.select("group", "id", "comp", F.lit(2).cast("long").alias("pieces"))), docs, k, percent)
    met = checkpointed(known.select(F.col("comp").alias("a"), F.col("id").alias("b")).union(met.select("to", "comp")).where("a <> b").distinct())
    ids = checkpointed(known.select("cluster", "id", "n").join(components(met), "id", "left").withColumn("comp", F.coalesce("comp", "id")))
    counts = ids.groupBy("cluster", "comp").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"))
    counts = counts.groupBy("cluster").agg(F.max_by(F.struct("comp", "rows", "n"), F.struct("rows", "comp")).alias("main"), F.sum("rows").alias("rows"), F.sum("n").alias("n"))
    counts = counts.where("rows > main.rows").select(
        "cluster", F.col("main.comp").alias("main"), needed(F.col("main.rows"), F.col("main.n")).alias("mains"), needed(F.col("rows") - F.col("main.rows"), F.col("n") - F.col("main.n")).alias("others")
    )
    open_ = checkpointed(counts)
    links = met
    if rows := open_.count():
        dealt = ids.join(_maybe_broadcast(open_, rows), "cluster").withColumn("is_main", F.col("comp") == F.col("main"))
        dealt = dealt.withColumn("piece", F.pmod(F.xxhash64("id", F.lit(3)), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("others"))))
        upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
        key = lambda x, y, kind: F.xxhash64("cluster", x, y, F.lit(kind))
        own = F.transform(upto("others"), lambda x: key(F.least(x, F.col("piece")), F.greatest(x, F.col("piece")), "other"))
        groups = F.when(F.col("is_main"), F.transform(upto("others"), lambda x: key(x, F.col("piece"), "main"))).otherwise(F.concat(own, F.transform(upto("mains"), lambda y: key(F.col("piece"), y, "main"))))
        dealt = checkpointed(dealt.select(F.explode(groups).alias("group"), "id", "comp", F.lit(2).cast("long").alias("pieces")))
        more = _compared(dealt, docs, k, percent).select(F.col("to").alias("a"), F.col("comp").alias("b"))
        links = checkpointed(links.union(more).where("a <> b").distinct())
    return done.union(known.select("id").distinct().join(components(links), "id", "left").select("id", F.coalesce("comp", "id").alias("comp")))


def near_copies(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, n_shingles, component_id.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased; a set holds the distinct k-word shingles of
    the whole text, or the whole sequence if it has fewer words. Sets link when 100 x overlap >= percent x union; a
    component's id is the smallest id reachable by links. Null and empty texts have empty sets and link with nothing;
    ids are integers; rows of one id are one node; rows without an id link with nothing and have no component; an empty
    table gives an empty result; other columns are not read. Equal sets (same size, 64-bit sum and 128-bit signature)
    are one node from the start; links between different sets are all found, though pairs within one component need
    not be.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    run = F.pmod(F.spark_partition_id(), F.lit(shuffle_width(spark)))
    measured = checkpointed(_measure(texts, k).withColumn("run", run.cast("int")))
    rows = measured.where("kind = 0").drop("kind")
    found = checkpointed(_candidates(_blocks(texts, k, percent, _frequent(measured, rows.count())), percent))

    # A pair that links shares more than so many first shingles; blocks that don't list all pairs may hide as many as either set has there
    hidden = found.where("kind = 1").groupBy(F.col("a").alias("id")).agg(F.sum("na").alias("hidden"))
    hidden = checkpointed(hidden)
    few = hidden.count()
    pairs = found.where("kind = 0").groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("shared"))
    for c in ("a", "b"):
        pairs = pairs.join(_maybe_broadcast(hidden.select(F.col("id").alias(c), F.col("hidden").alias(f"h{c}")), few), c, "left")
    overlap = F.expr(f"({percent} * (na + nb) + {99 + percent}) div {100 + percent}")
    least = 1 + overlap - F.greatest(*(F.expr(f"({percent} * {n} + 99) div 100") for n in ("na", "nb")))
    most = F.col("shared") + F.least(F.coalesce("ha", F.lit(0)), F.coalesce("hb", F.lit(0)))
    connected = found.where("kind = 2 and a <> b").select("a", "b", "na", "nb").distinct()
    comp = _linked(checkpointed(pairs.where(most >= least).select("a", "b", "na", "nb").union(connected)), texts, k, percent)

    # Equal sets: the copies of a text in one run meet first, so no task gathers all copies
    same = ["print", "low", "high", "n"]
    by_run = checkpointed(rows.where("id is not null and n > 0").groupBy(*same, "run").agg(F.min("id").alias("keep"), F.count(F.lit(1)).alias("rows")))
    classes = by_run.groupBy(*same).agg(F.min("keep").alias("keep"), F.sum("rows").alias("rows"))
    several = rows.where("id is not null and n > 0").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if several.limit(1).count():
        # rows of one id are one node: what they are equal to is connected
        held = rows.join(several.select("id"), "id").select("id", *same).distinct().join(classes, same).select(F.col("keep").alias("a"), F.col("id").alias("b"))
        comp = components(checkpointed(comp.select(F.col("comp").alias("a"), F.col("id").alias("b")).union(held).where("a <> b").distinct()))
    classes = classes.join(comp.withColumnRenamed("id", "keep"), "keep", "left").where("rows > 1 or comp <> keep")
    down = by_run.select(*same, "run").join(classes.select(*same, F.coalesce("comp", "keep").alias("component")), same)
    out = rows.join(down, [*same, "run"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), component.cast(kind).alias("component_id"))


def drop_near_copies(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one document of each component, the one with the smallest id; all columns. Rows without an id stay, and so
    do all rows that repeat an id that stays (they are one document)."""
    gone = checkpointed(near_copies(docs, k, percent, id_col, text_col).where(f"`{id_col}` <> component_id").select(id_col).distinct())
    return docs.join(_maybe_broadcast(gone, gone.count()), id_col, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"), k=3, percent=90)


SQL: dict[str, str] = {}
