import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from webloom.llm import spelling
from webloom.llm.common import table


def brute_counts(rows, every=199):
    n = Counter()
    for i, text in rows:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", text):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def edits(a, b):
    """Whether b is a with one edit, by trying every edit's shape."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(n, ratio=5):
    by_length = {}
    for w in n:
        by_length.setdefault(len(w), []).append(w)
    near = {w: [x for size in (-1, 0, 1) for x in by_length.get(len(w) + size, ()) if edits(w, x)] for w in n}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root(w)) for w in n)


def held(words, n, **options):
    got = sorted(tuple(r) for r in spelling.spelling_variants(words, **options).collect())
    want = brute(n)
    assert got == want
    return got


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.001"
    want = brute(brute_counts([(r.doc_id, r.text) for r in table(spark, d, "documents").collect()]))
    got = spelling.op11_spelling_variants(spark, d)
    assert got.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    got = sorted(tuple(r) for r in got.collect())
    assert got == want and any(r[3] for r in got) and len(got) > 500


def test_counts_of_odd_rows(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    rows += [(200 + i, "Straße STRASSE ÀÉÎ×÷ÿabc naïveté snake_case 12abcdef34 Ārmāns ἀλήθεια") for i in range(300)]
    rows += [(None, "lonely lonely lonely lonely LONELY"), (900, "x" * 300_000 + " " + "repeated " * 50_000)]
    docs = spark.createDataFrame([(i, t, 1, "w") for i, t in rows], "doc_id long, text string, n int, word string").repartition(3)
    for every in (199, 3, 1):
        got = {r.word: r.n for r in spelling.word_counts(docs, every=every).collect()}
        assert got == brute_counts(rows, every)
    assert spelling.word_counts(docs).where("word = 'lonely'").first().n == 5


def test_empty(spark, none):
    assert spelling.spelling_variants(spelling.word_counts(none)).collect() == []
    odd = spark.createDataFrame([(None, 5, "r"), ("abcdef", None, "r"), ("abc", 9, "r"), ("abcdef", 0, "r")], "word string, n long, root string")
    assert spelling.spelling_variants(odd).collect() == []


def crowd(seed, size):
    """Words that share starts and ends, with chains of forms, ties, and non-ASCII letters."""
    rng = random.Random(seed)
    letters = "abcé"
    n = {}
    while len(n) < size:
        w = rng.choice(("inter", "aaaa", "ción", "")) + "".join(rng.choices(letters, k=rng.randint(3, 5))) + rng.choice(("ation", "aaa", "", "nción"))
        if len(w) >= 6:
            n[w] = rng.choice((5, 6, 25, 130, 700, 4000, 30_000))
    n |= {"boundary": 5, "bounddary": 30, "bounary": 200, "boundxary": 30}
    return n


@pytest.mark.parametrize(("shard_segments", "hot"), [(50_000, 20_000), (60, 20_000), (200, 30), (100, 2)])
def test_crowds_equal_brute_force(spark, shard_segments, hot, monkeypatch):
    """Many small shards, and segments so hot that their words are dealt by deletions."""
    n = crowd(shard_segments + hot, 700)
    words = spark.createDataFrame(list(n.items()), "word string, n long").withColumn("form", F.lit("z"))
    got = held(words, n, shard_segments=shard_segments, hot=hot)
    assert max(r[2] for r in got) > 3 and any(r[3] and r[5] != r[3] for r in got)


def test_halves_of_every_length(spark):
    """Each edit at each place of words from the least length on, and words whose halves repeat."""
    n = {}
    for w in ("abcdef", "abcdefg", "zzzzzz", "zzzzzzz", "abcabcabc", "ÿéàèùç"):
        for i in range(len(w) + 1):
            for v in {w[:i] + w[i + 1 :], w[:i] + "q" + w[i:], w[:i] + "q" + w[i + 1 :], w}:
                if len(v) >= 6:
                    n[v] = 5 + 7 * len(n) % 400
    held(spark.createDataFrame(list(n.items()), "word string, n long"), n)


def test_long_ways_to_a_root(spark):
    """A chain as long as the largest n allows; many words with one root."""
    word, n = "aaaaaaaa", {}
    for step in range(12):
        n[word] = 5**step
        word = "abcdefghijklmn"[step] + word
    n |= {f"{chr(98 + i)}aaaaaaaa": 1 for i in range(20)}
    got = held(spark.createDataFrame(list(n.items()), "word string, n long"), n)
    assert len({r[5] for r in got}) < 4


def test_one_edit():
    rng = random.Random(2)
    for _ in range(3000):
        a, b = ("".join(rng.choices("ab", k=rng.randint(0, 5))) for _ in range(2))
        assert spelling.one_edit(a, b) == edits(a, b)


def test_bad_bounds(spark):
    words = spark.createDataFrame([], "word string, n long")
    for options in ({"ratio": 1}, {"least": 1}):
        with pytest.raises(ValueError):
            spelling.spelling_variants(words, **options)
