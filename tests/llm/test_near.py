import random
import re
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from webloom.llm import graph, near
from webloom.llm.near import components, drop_near_copies, near_copies, tree_pairs


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k, percent):
    """{id: component} of rows (id, text), and {(id, text): set size}."""
    sets = [(i, shingles(t, k)) for i, t in rows]
    up = {i: i for i, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    holders = defaultdict(set)
    for x, (i, s) in enumerate(sets):
        if i is not None:
            for g in s:
                holders[g].add(x)
    for x, (i, s) in enumerate(sets):
        for y in {y for g in s for y in holders[g] if y < x} if i is not None else ():
            j, o = sets[y]
            if 100 * len(s & o) >= percent * len(s | o):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: root(i) for i in up if i is not None}


def corpus(seed, groups=25, copies=8):
    rng = random.Random(seed)
    common = [f"p{i}" for i in range(60)]
    out = []
    for _ in range(groups):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randint(0, 150))]
        if rng.random() < 0.5:
            words += common
        for _ in range(rng.randint(1, copies)):
            v = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 6])):
                if v:
                    v[rng.randrange(len(v))] = f"n{rng.randrange(10**6)}"
            out.append((len(out), " ".join(v)))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("k", "percent", "listed", "hot", "forest"), [(3, 90, 64, 4096, 10**6), (5, 80, 9, 12, 20), (2, 50, 9, 20, 10**6), (2, 50, 9, 10, 30)])
def test_components_against_brute_force(spark, monkeypatch, k, percent, listed, hot, forest):
    monkeypatch.setattr(near, "LISTED", listed)
    monkeypatch.setattr(near, "HOT", hot)
    monkeypatch.setattr(near, "FOREST_ROWS", forest)
    monkeypatch.setattr(near, "PIECE", 7)
    rows = corpus(k) + [(10_000, None), (10_001, ""), (10_002, "One two"), (10_003, "one  TWO"), (10_004, "one")]
    rows += [(20_000, rows[0][1]), (20_000, "a b c d e f"), (20_001, "a b c d e f")]
    got = near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), k, percent).collect()
    want = brute(rows, k, percent)
    assert len(got) == len(rows) and {r.doc_id: r.component_id for r in got} == want
    assert sorted(r.n_shingles for r in got) == sorted(len(shingles(t, k)) for _, t in rows)
    assert len(set(want.values())) < len(want) - 20


@settings(max_examples=100, deadline=None)
@given(st.lists(st.frozensets(st.integers(0, 60), min_size=1, max_size=40), min_size=1, max_size=40), st.sampled_from([50, 80, 90]))
def test_trees_lose_no_link(sets, percent):
    import numpy as np

    from webloom.llm import vec

    sets = sorted(sets, key=len)
    hashed = [np.sort(vec.mix(np.array(sorted(s), np.uint64))) for s in sets]
    bits = [low | high << 64 for low, high in map(near.signature, hashed)]
    size = [len(s) for s in sets]
    pairs, forest = set(tree_pairs(size, bits, percent)), near.tree_forest(size, bits, percent)
    one, other = near.Sets(len(sets)), near.Sets(len(sets))
    for i, j in forest:
        assert one.join(i, j) and (i, j) in pairs
    for i, j in pairs:
        other.join(i, j)
    for j in range(len(sets)):
        assert one.root(j) == other.root(j)
        for i in range(j):
            if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                assert (i, j) in pairs


@settings(max_examples=100, deadline=None)
@given(st.lists(st.frozensets(st.integers(0, 30), min_size=1, max_size=25), min_size=1, max_size=40), st.sampled_from([50, 80, 90]), st.integers(1, 50))
def test_pieces_against_brute_force(sets, percent, names):
    import numpy as np

    from webloom.llm import vec

    hashed = [np.sort(vec.mix(np.array(sorted(s), np.uint64))) for s in sets]
    comp = [i % names for i in range(len(sets))]
    up = near.Sets(len(sets) + 1)
    for i in range(len(sets)):
        up.join(i, comp[i])
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up.join(i, j)
    want = [up.root(i) for i in range(len(sets))]
    assert near.joined(list(range(len(sets))), comp, hashed, percent) == want


@settings(deadline=None)
@given(st.lists(st.tuples(st.integers(-20, 20), st.integers(-20, 20)), max_size=60))
def test_roots(edges):
    import numpy as np

    a, b = (np.array([e[c] for e in edges], "i8") for c in (0, 1))
    up = near.Sets(41)
    for x, y in edges:
        up.join(x + 20, y + 20)
    node, root = graph.roots(a, b)
    assert node.tolist() == sorted({x for e in edges for x in e}) and root.tolist() == [up.root(x + 20) - 20 for x in node]


@settings(deadline=None)
@given(st.lists(st.lists(st.integers(0, 12), max_size=12), max_size=6), st.integers(1, 6))
def test_runs(batches, hot):
    """Every row of a block comes once; blocks are whole unless they have more than HOT rows."""
    import pyarrow as pa

    flat = sorted(x for b in batches for x in b)
    cut, parts = 0, []
    for b in batches:
        own, cut = flat[cut : cut + len(b)], cut + len(b)
        parts.append(pa.RecordBatch.from_arrays([pa.array(own, pa.int64())] * 6, names=near._BLOCKS))
    before, near.HOT = near.HOT, hot
    try:
        got = [(w, r["token"].tolist()) for w, r in near._runs(iter(parts))]
    finally:
        near.HOT = before
    assert [x for _, r in got for x in r] == flat
    for t in set(flat):
        own = [(w, r) for w, r in got if t in r]
        assert len(own) == 1 or all(not w for w, _ in own) and flat.count(t) > hot


def test_overlaps():
    import numpy as np

    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 50, rng.integers(1, 40)).astype(np.uint64)) for _ in range(30)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    for cells in (30, 100, 10**6):
        got = near.overlaps(sets, cells)
        assert all(got[i, j] == want[i][j] for i in range(30) for j in range(30) if i != j)


def test_a_large_group_that_mostly_just_misses(spark, monkeypatch):
    monkeypatch.setattr(near, "PIECE", 20)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(300):
        v = list(base)
        for j in rng.sample(range(100), rng.choice([0, 1, 2, 3])):
            v[j] = f"x{i}_{j}"
        rows.append((i, " ".join(v)))
    got = near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 3, 90).collect()
    want = brute(rows, 3, 90)
    assert {r.doc_id: r.component_id for r in got} == want and 10 < len(set(want.values())) < 290


def test_one_large_group_of_near_copies(spark):
    rng = random.Random(1)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(400):
        v = list(base)
        v[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(v)))
    rows += [(1000 + i, " ".join(base[:60] + [f"y{i}_{j}" for j in range(60)])) for i in range(200)]
    got = near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(9), 3, 90).collect()
    assert {r.doc_id: r.component_id for r in got} == brute(rows, 3, 90)


@pytest.mark.parametrize("forest", [10**6, 40])
def test_chain(spark, monkeypatch, forest):
    monkeypatch.setattr(near, "FOREST_ROWS", forest)
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    assert {r.id: r.comp for r in components(edges).collect()} == {i: 0 for i in range(201)} | {500: 500, 501: 500}


def test_odd_rows(spark, odd, none):
    rows = near_copies(odd, 3, 90).collect()
    assert len(rows) == odd.count() and {r.component_id for r in rows if r.doc_id is None} == {None}
    kept = drop_near_copies(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {1, 3, 4, 5, 6, 7, None}
    assert near_copies(none).count() == 0 and drop_near_copies(none).count() == 0


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], 3, 90)
    assert {r.doc_id: r.component_id for r in near_copies(docs, 3, 90).collect()} == want


def _block(spark, sets):
    """One block of sets, as _blocks gives it."""
    rows = []
    for i, s in enumerate(sets):
        low, high = (near._signed(x) for x in near.signature(s))
        rows.append((7, near._fingerprint(s), i, len(s), low, high))
    return spark.createDataFrame(rows, ", ".join(f"{c} long" for c in near._BLOCKS))


def test_a_large_block_of_different_sets_lists_its_pairs(spark):
    """One common shingle doesn't connect sets into a cluster, also where many have it (F2)."""
    import numpy as np

    from webloom.llm import vec

    sets = [np.sort(vec.mix(np.arange(1000 * i, 1000 * i + 200).astype(np.uint64))) for i in range(300)]
    sets += [np.sort(np.append(s[:-1], np.uint64(i))) for i, s in enumerate(sets[:5])]
    found = near._candidates(_block(spark, sets), 90).collect()
    assert {r.kind for r in found} == {0}
    assert {(i, 300 + i) for i in range(5)} <= {tuple(sorted((r.a, r.b))) for r in found}
    copies = [np.sort(np.append(sets[0][:-1], np.uint64(i))) for i in range(300)]
    found = near._candidates(_block(spark, copies), 90).collect()
    assert {r.kind for r in found} == {1, 2} and len(found) < 600


@pytest.mark.parametrize("most", [0, 10**6])
def test_rows_of_some_ids(spark, monkeypatch, most):
    """Texts are chosen by an array of ids, by a join where there are too many (F1)."""
    monkeypatch.setattr(near, "BROADCAST_IDS", most)
    docs = spark.createDataFrame([(i if i != 3 else None, f"t{i}") for i in range(-4, 9)] + [(5, "again")], "id long, text string")
    ids = spark.createDataFrame([(-4,), (0,), (5,), (8,), (99,)], "id long")
    assert sorted(r.text for r in near._those(docs, ids).collect()) == ["again", "t-4", "t0", "t5", "t8"]
    assert near._those(docs, ids.limit(0)).collect() == []


def test_many_ids_are_not_broadcast_as_rows(spark):
    plan = lambda n: near._maybe_broadcast(spark.range(3), n)._jdf.queryExecution().toString()
    assert "broadcast" in plan(1000) and "broadcast" not in plan(300_000)
