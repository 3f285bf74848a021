import zlib

import numpy as np
import pyarrow as pa

from webloom.llm import quality
from webloom.llm.quality import CUT, features, fit, score_quality, train


def test_features_do_not_depend_on_neighbours():
    texts = ["Some plain words here.", None, "", "SHOUT!! SHOUT!!", "a b c a b c\na b c", "|" * 500, "x " * 3000]
    together = features(pa.array(texts))
    for i, t in enumerate(texts):
        assert np.allclose(together[i], features(pa.array([t], pa.string()))[0])
    assert np.isfinite(together).all()


def test_preferences_are_learned_and_cut():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5))
    label = (x[:, 0] - 2 * x[:, 1] + 0.3 * rng.normal(size=400) > 0.5).astype(int)
    model = fit(x, label)
    assert ((model.score(x) >= CUT) == label).mean() > 0.9
    assert model.weight[0] > 0 > model.weight[1] and abs(model.weight[2]) < 0.3 * model.weight[0]


def test_one_label_or_none():
    x = np.ones((3, 2))
    assert (fit(x, np.array([1, 1, 1])).score(x) >= CUT).all() and (fit(x, np.array([0, 0, 0])).score(x) < CUT).all()
    assert (fit(x[:0], np.array([])).score(x) >= CUT).all()


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(d + "/documents.parquet"), spark.read.parquet(d + "/labels.parquet")
    rows = score_quality(docs, train(docs, labels)).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    fold = [r for r in rows if r.held_out]
    assert len(fold) > 500 and np.mean([r.predicted == r.quality for r in fold]) > 0.98
    for label in (0, 1):
        assert np.mean([r.predicted == label for r in fold if r.quality == label]) > 0.95


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (6, 0), (3, 1), (None, 0), (4, None), (1, 1)], "doc_id long, quality int")
    model = train(odd, labels)
    rows = score_quality(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.held_out for r in rows if r.doc_id is None} == {False}
    assert score_quality(none, model).count() == 0
    assert score_quality(odd, train(none, labels)).count() == odd.count()


def test_sample_of_labels_is_bounded(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "concat('t ', id) as text")
    labels = spark.range(4000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    assert 350 < quality.labelled(docs, labels, "quality", "doc_id", "text", 500).count() < 650


def test_scores_of_the_table_one_by_one(spark):
    """Every row of the query against its own text scored alone, and the fit against plain gradient descent on all pairs."""
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(d + "/documents.parquet"), spark.read.parquet(d + "/labels.parquet")
    model = train(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = quality.op10_quality(spark, d).collect()
    assert len(rows) == len(texts)
    for r in rows:
        (want,) = model.score(quality.features(pa.array([texts[r.doc_id]], pa.string())))
        assert abs(r.score - want) < 1e-9 and r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_strips_change_nothing(monkeypatch):
    rng = np.random.default_rng(3)
    x, label = rng.normal(size=(60, 4)), rng.integers(0, 2, 60)
    whole = fit(x, label).weight
    monkeypatch.setattr(quality, "CELLS", 7)
    assert np.allclose(whole, fit(x, label).weight, atol=1e-9)


def test_fit_against_plain_descent():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(12, 3))
    label = (x @ [1.0, -2.0, 0.5] + rng.normal(size=12) > 0).astype(int)
    model = fit(x, label)
    z = np.clip((x - x.mean(axis=0)) / x.std(axis=0), -8, 8)
    pairs = [z[g] - z[b] for g in range(12) for b in range(12) if label[g] == 1 and label[b] == 0]
    w = np.zeros(3)
    for _ in range(20_000):
        w -= 0.01 * (sum(-p / (1 + np.exp(p @ w)) for p in pairs) + 1e-3 * len(pairs) * w) / 4
        if _ > 300 and np.abs(w - model.weight).max() < 1e-4:
            break
    assert np.abs(w - model.weight).max() < 1e-3
    s = model.strength(x)
    right = lambda cut: (label == (s >= cut)).sum()
    assert right(model.cut) == max(right(c) for c in [*s, s.max() + 1])
