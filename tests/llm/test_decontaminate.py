import random
import re

import numpy as np
import pyarrow as pa
import pytest

from webloom.llm import decontaminate
from webloom.llm.decontaminate import drop_contaminated, find_contamination, split_item


def words(t):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def grams(w, k):
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]


def brute(docs, items):
    out = set()
    for item, text in items:
        w = words(text)
        if not w:
            continue
        k = min(5, len(w))
        q, a = split_item(text)
        cut = max(0, len(w) - len(words(a)))
        g = grams(w, k)
        question = set(g if q == a or not cut else g[:cut])
        answer = {x for i, x in enumerate(g) if i + k > cut}
        for doc, t in docs:
            have = set(grams(words(t), k))
            if len(question & have) >= 0.8 * len(question) and len(answer & have) >= 0.8 * len(answer):
                out.add((doc, item))
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", "", ".", ","]) for _ in range(n))
    items = [(i, text(rng.randint(1, 60))) for i in range(60)] + [(60, None), (61, ""), (62, "Only. Two")]
    docs = []
    for i in range(250):
        t = text(rng.randint(0, 400))
        if i % 3 == 0:
            leak = words(items[rng.randrange(60)][1])
            for _ in range(rng.choice([0, 0, 1, 3])):
                leak[rng.randrange(len(leak))] = "changed"
            t = f"{t} {'  '.join(leak).upper()} {text(rng.randint(0, 200))}"
        docs.append((i, t))
    return docs + [(900, None), (901, ""), (None, items[0][1]), (902, items[1][1]), (902, items[1][1])], items


def test_against_brute_force(spark, corpus):
    docs, items = corpus
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = find_contamination(d, spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute(docs, items)
    assert {(r.doc_id, r.item_id) for r in got} == want and len(want) > 60
    kept = drop_contaminated(d, spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {i for i, _ in want}


def test_slices_of_items(spark, corpus, monkeypatch):
    docs, items = corpus
    monkeypatch.setattr(decontaminate, "SLICE_BYTES", 4000)
    got = find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == brute(docs, items)


def test_empty_tables(spark, odd, none):
    items = spark.createDataFrame([], "item_id long, text string")
    assert find_contamination(odd, items).count() == 0 and drop_contaminated(odd, items).count() == odd.count()
    assert find_contamination(none, items.union(spark.createDataFrame([(1, "a b")], items.schema))).count() == 0


def test_planted_items_of_the_table(spark):
    d = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(d + "/documents.parquet"), spark.read.parquet(d + "/benchmark.parquet")
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.collect()])
    assert {(r.doc_id, r.item_id) for r in find_contamination(docs, items).collect()} == want and want


def test_short_items_at_every_offset(spark):
    items = [(0, "What is the capital of Peru? Lima."), (1, "What is the capital of Chile? Santiago.")]
    items += [(i, f"What is the capital of land{i}? Town{i}.") for i in range(2, 300)]
    docs = [(1000 * i + n, f"{'filler ' * n}{text} {'rest ' * (n % 50)}") for i, (_, text) in enumerate(items[:2]) for n in range(100)]
    got = find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = brute(docs, items)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and {(d, d // 1000) for d, _ in docs} <= want


def test_a_fifth_of_five_shingles_may_be_missing():
    assert [decontaminate._lost(n) for n in range(12)] == [0, 0, 0, 0, 0, 1, 1, 1, 1, 1, 2, 2]
    item = (0, "Q0 q1 q2 q3 q4. R0 r1 r2 r3")
    index = decontaminate.Index.build([item, *((i, f"Other{i} words{i}. Of{i} it{i}") for i in range(1, 40))])
    for n in range(80):
        text = f"{'filler ' * n}x {item[1].split(' ', 1)[1]}"
        assert [m[1] for m in index.matches(pa.array([text]))] == [i for _, i in brute([(0, text)], [item])] == [0]


def test_index_of_many_items_is_small():
    rng = random.Random(3)
    items = [(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(25)) + ". Yes it is.") for i in range(6000)]
    index = decontaminate.Index.build(items)
    size = sum(x.nbytes for x in vars(index).values() if hasattr(x, "nbytes"))
    assert size < 3 * 8 * 6000 * 30 * 3
    terms = np.unique(np.searchsorted(index.vocabulary, decontaminate._words([items[17][1]])[0]))
    found, score = index.search(terms)
    assert 17 in [index.items[n].id for n in found] and (score >= 1 - 1e-9).all()
