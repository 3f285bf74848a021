import random
import re

import pytest
from pyspark.sql import functions as F

from webloom.operators import search as S
from webloom.operators.textindex import LONG, TextIndex

TEXTS = [
    "# Intro\nThe MIT License applies.\r\nlicensed under the terms of v2\n",
    "licence and Licenses; licenze under nothing",
    "an apache LICENSE\nunder the\n license",
    "Straße ÉCOLE école K\n\n\nfoo_bar foo-bar foo bar",
    "", None, "x", "ab", "a\tb  c\n" * 50, "w" * 300 + " " + "w" * 299 + "v", "under licenze undr", "licenze\nundr",
    "permisson granted hereby", "permission granted herby to anyone", "a.b*c (d|e) [f] {g}",
]
QUERIES = [
    ("license", "plain"), ("MIT License", "plain"), ("École", "plain"), ("li", "plain"), ("", "plain"), ("nowhere to be found", "plain"), ("under\nthe", "plain"),
    (r"(?i)licensed? under .* v", "regex"), (r"\p{Lu}\p{Ll}+ ", "regex"), (r"^licen|under$", "regex"), ("](", "regex"), (r"a\.b\*c \(d", "regex"),
    (r"(?:under)+ the", "regex"), (r"[]f]", "regex"), ("lic*ense", "regex"), ("fo+", "regex"), (r"\Qa.b\E", "regex"), (r"(?i)ÉCOLE", "regex"),
    ("licenze", "fuzzy"), ("licenze undr", "fuzzy"), ("permission granted herebi", "fuzzy"), ("x", "fuzzy"), ("--", "fuzzy"), ("w" * 300, "fuzzy"), ("zzzzzz", "fuzzy"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    words = "the quick licence Licensee undr underr thy permit".split()
    more = ["\n".join(" ".join(rng.choices(words, k=6)) for _ in range(4)) for _ in range(15)]
    rows = [(i, t, "t", "x") for i, t in enumerate(TEXTS + more)]
    return spark.createDataFrame(rows, "id long, body string, tab_id string, line string").cache()


@pytest.fixture(scope="module")
def index(docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    index = TextIndex(docs.sparkSession, path).add(docs.where("id < 9"), "id", "body", "a")
    for _ in range(2):  # again, as a retried job does
        index.add(docs.where("id >= 9"), "id", "body", "b")
    return index


@pytest.mark.parametrize(("query", "mode"), QUERIES)
def test_equals_the_scan(docs, index, query, mode):
    want = sorted(map(repr, S.search(S.lines(docs, "id", "body"), query, mode, None).collect()))
    assert sorted(map(repr, S.search_texts(docs, "id", "body", query, mode, None).collect())) == want
    assert sorted(map(repr, index.search(docs, "id", "body", query, mode, None).collect())) == want
    if (found := index.candidates(query, mode)) is not None:
        ids = [r.tab_id for r in found.collect()]
        assert len(ids) == len(set(ids)) and set(ids) >= {int(re.search(r"tab_id=(\d+)", r)[1]) for r in want}


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_near_words_equal_brute_force(docs, index):
    held = {r.word for r in docs.select(F.explode(S.words(F.col("body"))).alias("word")).distinct().collect()} - {""}
    assert max(map(len, held)) > LONG
    for word in ("licenze", "undr", "ab", "a", "thee", "permision", "w" * 299, "qqqqqqqqq"):
        want = {w for w in held if levenshtein(w, word) <= S.edits(word)}
        assert {r.word for r in index.near_words(word).collect()} == want


def test_lookups_prune(docs, index):
    plan = index.candidates("mit license")._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and re.search(r"PushedFilters: \[[^\]]*gram", plan)
    assert index.narrowed(docs, "id", "license applies").count() == 1
    narrow = index.narrowed(docs.sparkSession.read.parquet("/root/testdata/sf0.001/documents.parquet"), "doc_id", "mit license")
    assert "PushedFilters: [" in narrow._jdf.queryExecution().toString() and "Join" not in narrow._jdf.queryExecution().toString()


def test_many_candidates_are_joined(docs, index, monkeypatch):
    monkeypatch.setattr("webloom.operators.textindex.NAMED", 1)
    for query, mode in (("license", "plain"), ("licenze", "fuzzy"), ("licenze undr", "fuzzy")):
        want = sorted(map(repr, S.search(S.lines(docs, "id", "body"), query, mode, None).collect()))
        assert sorted(map(repr, index.search(docs, "id", "body", query, mode, None).collect())) == want and want


def test_a_common_trigram_is_spread(docs, tmp_path):
    spark = docs.sparkSession
    many = spark.range(3000).select("id", F.concat(F.lit("same words in all of them "), "id").alias("body"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 128)
    try:
        index = TextIndex(spark, str(tmp_path)).add(many, "id", "body")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    files = index._read("grams").where("gram = 'sam'").groupBy(F.input_file_name()).count().collect()
    assert len(files) > 1 and max(r["count"] for r in files) < 2000
    assert index.search(many, "id", "body", "them 77", limit=None).count() == 11


def test_context_through_the_index(docs, index):
    got = index.search(docs, "id", "body", "license applies", before=1, after=1).collect()
    assert [(r.tab_id, r.line_number, r.context_before, r.context_after) for r in got] == [(0, 2, ["# Intro"], ["licensed under the terms of v2"])]


def test_only_what_a_mode_looks_up_is_written(docs, tmp_path):
    index = TextIndex(docs.sparkSession, str(tmp_path)).add(docs, "id", "body", tables=("grams",))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["gram_counts", "grams"]
    assert index.search(docs, "id", "body", "license applies", limit=None).count() == 1
    index.add(docs, "id", "body", tables=("words",))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["gram_counts", "grams", "vocabulary", "words"]
    assert index.search(docs, "id", "body", "licenze", "fuzzy", limit=None).count() > 0


def test_texts_and_postings_are_not_shuffled_for_many_candidates(docs, index, monkeypatch):
    monkeypatch.setattr("webloom.operators.textindex.NAMED", 1)
    for query, mode in (("license", "plain"), ("licenze", "fuzzy")):
        plan = index.narrowed(docs, "id", query, mode)._jdf.queryExecution().toString()
        assert "leftsemi" in plan.lower().replace(" ", "") and "strategy=broadcast" in plan
