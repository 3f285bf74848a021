import re

import corpus_pipeline
from tests.llm.test_decontaminate import brute as held_items
from tests.llm.test_near import brute as near_groups
from webloom.llm import toxicity


def test_stages_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(d + "/documents.parquet")
    left = {r.doc_id: r.text for r in docs.collect()}
    model = toxicity.train(docs, spark.read.parquet(d + "/labels.parquet"))
    toxic = {r.doc_id for r in toxicity.score_toxicity(docs, model).collect() if r.predicted}
    left = {i: t for i, t in left.items() if i not in toxic}
    first = {}
    for i in sorted(left):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", left[i] or ""), i)
    left = {i: left[i] for i in first.values()}
    comp = near_groups(list(left.items()), 5, 80)
    left = {i: t for i, t in left.items() if comp[i] == i}
    items = [tuple(r) for r in spark.read.parquet(d + "/benchmark.parquet").collect()]
    bad = {i for i, _ in held_items(list(left.items()), items)}
    want = {i for i in left if i not in bad}
    got = corpus_pipeline.run(spark, d).collect()
    assert {r.doc_id for r in got} == want and 0 < len(want) < docs.count() and bad
    ends = {}
    for r in got:
        ends.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in ends.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and sum(parts[-1]) <= 1024


def test_stages_keep_the_columns_of_documents(spark, odd):
    d = "/root/testdata/sf0.001"
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, d)
        assert out.columns == odd.columns and out.count() <= odd.count()
