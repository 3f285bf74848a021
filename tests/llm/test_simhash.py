import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from webloom.llm import graph, simhash
from webloom.llm.common import table


def brute_print(text, k=4):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, pairs):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def brute(rows, radius=4):
    """(id, fingerprint, component) of (id, fingerprint) rows."""
    by_id = {}
    for i, f in rows:
        if i is not None:
            by_id.setdefault(i, set()).add(f)
    ids = sorted(by_id)
    pairs = [(a, b) for a, b in itertools.combinations(ids, 2) if any((x ^ y).bit_count() <= radius for x in by_id[a] for y in by_id[b])]
    comp = brute_components(ids, pairs)
    return sorted(((i, f"{f:016x}", comp.get(i)) for i, f in rows), key=str)


def held(docs, radius=4):
    rows = [(r.doc_id, brute_print(r.text)) for r in docs.select("doc_id", "text").collect()]
    got = simhash.near_copies(docs, radius=radius).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, radius)
    return got


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, brute_print(r.text)) for r in table(spark, d, "documents").collect()]
    got = simhash.op12_simhash(spark, d).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)
    assert any(r.component_id != r.doc_id for r in got)


def test_odd_rows(odd):
    held(odd.withColumn("fp", F.lit(1)).withColumn("component_id", F.lit("x")).withColumn("node", F.lit(2)))


def test_empty(none):
    assert simhash.near_copies(none).collect() == []


def test_ids_with_several_texts_and_copies(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(50)]
    base = [" ".join(rng.choices(words, k=60)) for _ in range(6)]
    rows = [(i, base[i % 3]) for i in range(40)] + [(5, base[4]), (60, base[4]), (61, base[5]), (61, base[4]), (2, None), (70, ""), (None, base[0])]
    rows += [(100 + i, base[i % 6] + f" tail{i}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(5)
    got = held(docs)
    assert got and simhash.near_copies(docs).schema["component_id"].dataType.simpleString() == "int"


def close(rng, n, centres, flips):
    out = set()
    while len(out) < n:
        x = rng.choice(centres)
        for b in rng.sample(range(64), rng.randint(0, flips)):
            x ^= 1 << b
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize(("radius", "variants"), [(4, 1 << 20), (4, 2000), (3, 3000), (2, 50)])
def test_links_equal_all_pairs(spark, radius, variants):
    """Close groups, chains and single ones, with ranges so small that many are cut again."""
    rng = random.Random(radius * 1000 + variants)
    centres = [rng.getrandbits(64) for _ in range(8)] + [0, 2**64 - 1, 0xFFFF]
    prints = close(rng, 250, centres, radius + 2)
    node = list(range(len(prints)))
    rng.shuffle(node)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    classes = spark.createDataFrame(list(zip(signed, node, strict=True)), "fp long, node long").cache()
    edges = [tuple(r) for r in simhash.links(classes, radius, variants).collect()]
    value = dict(zip(node, prints, strict=True))
    pairs = [(a, b) for a, b in itertools.combinations(node, 2) if (value[a] ^ value[b]).bit_count() <= radius]
    assert brute_components(node, edges) == brute_components(node, pairs)


def test_crowded_ranges_are_cut(spark):
    """Thousands within a few low bits of each other share leading bits: no range may hold them all."""
    rng = random.Random(1)
    prints = close(rng, 3000, [0x0123456789ABCDEF], 3)
    classes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, i) for i, x in enumerate(prints)], "fp long, node long").cache()
    limit = 200_000
    ranges = simhash._ranges(classes, 2, limit)
    sizes = {}
    for r in ranges.collect():
        sizes[r.depth, r.range] = sizes.get((r.depth, r.range), 0) + simhash.ball(64 - r.depth, r.left)
    assert len({d for d, _ in sizes}) > 1 and max(sizes.values()) <= simhash.WIDE * limit
    assert sum(sizes.values()) == 3000 * simhash.ball(64, 2)
    edges = [tuple(r) for r in simhash.links(classes, 4, limit).collect()]
    assert len(set(brute_components(range(3000), edges).values())) == 1


def test_hash_meetings_are_verified(monkeypatch):
    """If hashes of different variants met, links would neither arise nor be lost."""
    monkeypatch.setattr(simhash.vec, "mix", lambda x: (x % np.uint64(97)) << np.uint64(24))
    rng = random.Random(5)
    prints = close(rng, 40, [rng.getrandbits(64) for _ in range(5)], 4)
    fp = np.array(prints, np.uint64)
    n = len(fp)
    i, j = simhash.meetings(fp, fp >> np.uint64(60) << np.uint64(60), np.full(n, 60), np.full(n, 1), 2)
    assert all((prints[a] ^ prints[b]).bit_count() <= 2 for a, b in zip(i.tolist(), j.tolist(), strict=True))
    # whoever shares a range and is near is connected; other ranges may meet by chance, and only who is near is linked
    comp = brute_components(range(n), zip(i.tolist(), j.tolist(), strict=True))
    pairs = [(a, b) for a, b in itertools.combinations(range(n), 2) if (prints[a] ^ prints[b]).bit_count() <= 2]
    assert all(comp[a] == comp[b] for a, b in pairs if prints[a] >> 60 == prints[b] >> 60)
    whole = brute_components(range(n), pairs)
    assert all(whole[a] == whole[c] for a, c in comp.items())


@pytest.mark.parametrize("forest_rows", [10**6, 300])
def test_components_of_hubs_and_chains(spark, forest_rows):
    rng = random.Random(forest_rows)
    edges = [(0, i) for i in range(1, 400)] + [(i, i + 1) for i in range(1000, 1060)] + [(rng.randrange(2000, 2500), rng.randrange(2000, 2500)) for _ in range(300)]
    edges = [(a, b) if rng.random() < 0.5 else (b, a) for a, b in edges if a != b]
    nodes = sorted({x for e in edges for x in e})
    got = graph.components(spark.createDataFrame(edges, "a long, b long").cache(), forest_rows, 20).collect()
    assert len(got) == len(nodes) and {r.id: r.comp for r in got} == brute_components(nodes, edges)


def test_components_of_nothing(spark):
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_drop_keeps_one_of_each(spark):
    docs = spark.createDataFrame([(3, "a b c d e", 1), (1, "a b c d e", 2), (9, "another thing entirely here", 3), (None, "a b c d e", 4)], "doc_id long, text string, id int")
    got = sorted(simhash.drop_near_copies(docs).collect(), key=str)
    assert simhash.drop_near_copies(docs).columns == docs.columns
    assert [r.doc_id for r in got] == [1, 9, None]
