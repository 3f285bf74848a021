import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from webloom.llm import toxicity
from webloom.llm.toxicity import BLOCK, Index, build, drop_toxic, score_toxicity, terms, train, vectors

ENTRY = st.tuples(st.integers(0, 400), st.integers(0, 12), st.floats(0.05, 1))


@settings(max_examples=80, deadline=None)
@given(st.lists(ENTRY, max_size=300, unique_by=lambda x: x[:2]), st.dictionaries(st.integers(0, 12), st.floats(0.05, 1), min_size=1, max_size=6), st.integers(1, 20))
def test_nearest_equals_brute_force(entries, query, k):
    dense = np.zeros((401, 13))
    for d, t, w in entries:
        dense[d, t] = w
    doc, term, weight = (np.array([e[i] for e in entries]) for i in range(3))
    index = Index.build(13, np.arange(401), np.zeros(401), doc.astype("i8"), term.astype("i8"), weight.astype("f8"))
    q = np.zeros(13)
    for t, w in query.items():
        q[t] = w
    found, score = index.nearest(np.array(sorted(query)), np.array([query[t] for t in sorted(query)]), k)
    want = np.sort(dense @ q)[::-1][:k]
    assert np.allclose(score, want[want > 0][: len(score)]) and len(score) == (want > 0).sum()
    assert np.allclose((dense @ q)[found], score) and BLOCK < 401


def test_terms_are_words_and_their_first_bytes():
    texts = pa.array(["Idiot, idiot!", None, "idiots"])
    found = [(row + d, t) for row, doc, term in terms(texts) for d, t in zip(doc.tolist(), term.tolist(), strict=True)]
    first, third = {t for d, t in found if d == 0}, {t for d, t in found if d == 2}
    assert len(first) == 2 and len(third) == 3 and len(first & third) == 1
    vocabulary = np.sort(np.array(sorted(first), np.uint64))
    doc, term, count = vectors(texts, vocabulary)
    assert doc.tolist() == [0] * 2 + [2] and count.tolist() == [2] * 2 + [1]


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(d + "/documents.parquet"), spark.read.parquet(d + "/labels.parquet")
    model = train(docs, labels)
    scored = score_toxicity(docs, model)
    fold = [r for r in scored.join(labels, "doc_id").collect() if r.held_out]
    assert np.mean([r.predicted == r.toxic for r in fold]) > 0.96
    assert np.mean([r.predicted for r in fold if r.toxic]) > 0.9
    assert any(r.evidence and r.evidence[0].label == 1 for r in fold if r.toxic)
    kept = drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == scored.where("predicted = 0").count()


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (6, 0), (3, 1), (None, 0), (4, None), (1, 1)], "doc_id long, toxic int")
    model = train(odd, labels)
    rows = score_toxicity(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert score_toxicity(none, model).count() == 0 and drop_toxic(none, model).count() == 0
    assert score_toxicity(odd, train(none, labels)).count() == odd.count()


def test_a_model_without_terms():
    model = build(np.array([1, 2]), [1, 0], np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0), np.zeros(0, np.uint64), np.zeros(0))
    assert 0 <= model.score(np.zeros(0, "i8"), np.zeros(0))[0] <= 1


def test_calibration_reads_all_examples():
    n = 4400
    labels = [0] * 4100 + [1] * (n - 4100)
    term = np.array([0] * 4100 + [1] * (n - 4100))
    model = build(np.arange(n), labels, np.arange(n), term, np.ones(n), np.arange(2, dtype=np.uint64), np.ones(2))
    assert model.calibration.tolist() != [0.0, 1.0]
    assert model.score(np.array([1]), np.ones(1))[0] > 0.5 > model.score(np.array([0]), np.ones(1))[0]


def test_scores_against_brute_force(spark):
    """Every score of the table from cosines with all examples, the nearest of which vote."""
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(d + "/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = train(docs, labels)
    index = model.index
    dense = np.zeros((len(index.ids), len(model.vocabulary)))
    for t in range(len(model.vocabulary)):
        for b in range(index.term_at[t], index.term_at[t + 1]):
            for at in range(index.block_at[b], index.block_at[b + 1]):
                dense[index.examples[at], t] = index.weights[at]
    got = {r.doc_id: r for r in score_toxicity(docs, model).collect()}
    for r in docs.collect():
        doc, term, count = vectors(pa.array([r.text], pa.string()), model.vocabulary)
        if not len(term):
            assert got[r.doc_id].score == model.none
            continue
        v = np.zeros(len(model.vocabulary))
        v[term] = (1 + np.log(count)) * model.idf[term]
        cosine = dense @ (v / np.sqrt((v * v).sum()))
        near = sorted((-c, i) for i, c in enumerate(cosine) if c > 0)[: toxicity.NEIGHBOURS]
        total = sum(-c for c, _ in near)
        vote = (sum(-c * index.labels[i] for c, i in near) + 0.05 * model.prior) / (total + 0.05)
        assert abs(got[r.doc_id].score - model.calibrated(vote)) < 1e-6


def test_ids_that_are_strings(spark):
    rows = [(f"d{i}", ("vile scum words " if i % 3 == 0 else "kind gentle words ") * (1 + i % 4) + f"w{i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{i}", int(i % 3 == 0)) for i in range(300)], "doc_id string, toxic int")
    got = score_toxicity(docs, train(docs, labels)).collect()
    assert len(got) == 300 and all(e.id.startswith("d") for r in got for e in r.evidence) and any(r.evidence for r in got)
