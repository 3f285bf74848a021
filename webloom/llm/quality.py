"""Quality classifier: Bradley-Terry scores learned from preference pairs, cut at a quantile of the scores."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm import vec
from webloom.llm.common import table

#: At most so many labelled rows are fitted, the ones with the smallest hash of their id; a score reads whole texts of all rows.
FIT_ROWS = 12_000
#: Pairs that are looked at at a time while all are fitted.
CELLS = 1_000_000
#: Score at the quantile that divides the documents.
CUT = 0.7

_CLASSES = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "bang": b"!",
    "bar": b"|",
    "symbol": b"#%$&*@^~=+<>\\_{}[]",
    "stop": b".?",
    "pause": b",;:-'\"()/",
    "line": b"\n",
    "space": b" \t\r",
    "high": range(128, 256),
}
_CLASS = np.full(256, len(_CLASSES), np.uint8)
for _i, _bytes in enumerate(_CLASSES.values()):
    _CLASS[list(_bytes)] = _i
_NOT_LINE = np.ones(256, bool)
_NOT_LINE[10] = False


def _distinct_share(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text: distinct values over values, and the share of its most frequent value."""
    distinct, top = np.ones(len(first) - 1), np.zeros(len(first) - 1)
    for i, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
        if b - a > 1:
            part = np.sort(values[a:b])
            edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
            distinct[i], top[i] = (len(edges) - 1) / (b - a), np.diff(edges).max() / (b - a)
    return distinct, top


def features(texts: pa.Array) -> np.ndarray:
    """A row of features for each text: shares of kinds of characters, lengths, and how much words and lines repeat."""
    out = []
    for _, data, at in vec.slices(texts):
        n = len(at) - 1
        size = np.diff(at)
        row = np.repeat(np.arange(n), size)
        counts = np.bincount(row * 16 + _CLASS[data], minlength=16 * n).reshape(n, 16)[:, : len(_CLASSES) + 1]
        share = counts / np.maximum(size, 1)[:, None]
        starts, ends, first = vec.spans(data, at)
        words = np.diff(first)
        word = vec.hashes(data, starts, ends)
        distinct, top = _distinct_share(word, first)
        tri, tri_at = vec.shingles(word, first, 3)
        distinct3, _ = _distinct_share(tri, tri_at)
        ls, le, lf = vec.spans(data, at, _NOT_LINE)
        lines, _ = _distinct_share(vec.hashes(data, ls, le), lf)
        mean_word = (ends - starts).sum() and np.add.reduceat(np.append(ends - starts, 0), np.minimum(first[:-1], len(starts))) * (words > 0) / np.maximum(words, 1)
        mean_word = np.broadcast_to(np.asarray(mean_word, float), (n,))
        letters = np.maximum(counts[:, 0] + counts[:, 1] + counts[:, 10], 1)
        x = [share, np.sqrt(share), np.log1p(size)[:, None], np.log1p(words)[:, None], (words < 5)[:, None], (words == 0)[:, None]]
        x += [np.stack([distinct, top, distinct3, lines, mean_word, counts[:, 0] / letters, np.log1p(np.diff(lf))], axis=1)]
        expected = np.log1p(words) * (1 - distinct)  # a long text repeats more words than a short one
        x += [np.stack([expected, (1 - lines) * np.log1p(np.diff(lf)), (1 - distinct3) * np.log1p(words)], axis=1)]
        out.append(np.concatenate(x, axis=1).astype("f8"))
    return np.concatenate(out) if out else np.zeros((0, 0))


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    cut: float
    slope: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weight if len(self.weight) else np.zeros(len(x))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Strengths on 0..1, rising; the cut lands on CUT."""
        z = self.slope * (self.strength(x) - self.cut) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def _newton(d: np.ndarray, y: np.ndarray, l2: float, rounds: int = 25) -> np.ndarray:
    """Weights w that minimise sum(log(1 + exp(-y * (d @ w)))) + l2/2 |w|^2."""
    w = np.zeros(d.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(y * (d @ w), -500, 500)))
        gradient = -(d.T @ (y * p)) + l2 * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d + l2 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _prefer(good: np.ndarray, bad: np.ndarray, l2: float, rounds: int = 25) -> np.ndarray:
    """Weights w that minimise the sum over all pairs of a row g of good and b of bad of log(1 + exp(-(g - b) @ w)), plus l2/2 |w|^2.

    Differences are never formed: with p the matrix of the pairs' probabilities to be the wrong way round, taken in strips,
    the gradient follows from its sums by row and column, the Hessian from those of p(1 - p) and one product.
    """
    w, strip = np.zeros(good.shape[1]), max(1, CELLS // len(bad))
    for _ in range(rounds):
        below = bad @ w
        gradient, hessian = l2 * w, l2 * np.eye(len(w))
        p_bad, q_bad = np.zeros(len(bad)), np.zeros(len(bad))
        for at in range(0, len(good), strip):
            z = good[at : at + strip]
            p = 1 / (1 + np.exp(np.clip((z @ w)[:, None] - below, -500, 500)))
            gradient = gradient - z.T @ p.sum(axis=1)
            p_bad += p.sum(axis=0)
            p *= 1 - p
            q_bad += p.sum(axis=0)
            both = z.T @ (p @ bad)
            hessian = hessian + (z * p.sum(axis=1)[:, None]).T @ z - both - both.T
        step = np.linalg.solve(hessian + (bad * q_bad[:, None]).T @ bad, gradient + bad.T @ p_bad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(x: np.ndarray, label: np.ndarray) -> Model:
    """Bradley-Terry: P(a is preferred to b) = sigmoid(s(a) - s(b)) with s linear in the features.

    Every preference sets a text of label 1 above one of label 0, and all such pairs are fitted. Scores are cut at the quantile
    that agrees with most labels. Without both labels there are no pairs: all strengths are 0 and the score is CUT or just
    below it by majority.
    """
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(x):
        return Model(np.zeros(0), np.ones(0), np.zeros(0), 0.0, 1.0)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    if not len(good) or not len(bad):
        return Model(mean, scale, np.zeros(x.shape[1]), 0.0 if len(good) else 1.0, 1.0)
    z = np.clip((x - mean) / scale, -8, 8)
    weight = _prefer(z[good], z[bad], l2=1e-3 * len(good) * len(bad))
    s = z @ weight
    order = np.argsort(s)
    right = np.concatenate([[0], np.cumsum(np.where(label[order] == 0, 1, -1))])  # agreement if all up to here fall below
    at = int(np.argmax(right))
    ends = np.concatenate([[s[order[0]] - 1], s[order], [s[order[-1]] + 1]])
    cut = (ends[at] + ends[at + 1]) / 2
    slope = _newton((s - cut)[:, None], np.where(label == 1, 1.0, -1.0), l2=1.0)[0]
    return Model(mean, scale, weight, float(cut), float(max(slope, 1e-3)))


def _features_of(docs: DataFrame, text_col: str, extra: list[str]) -> DataFrame:
    def run(batches):
        for batch in batches:
            x = features(batch.column(0))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64())) if len(x) else pa.array([], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([flat, *batch.columns[1:]], names=["x", *extra])

    chosen = docs.select(F.col(text_col).cast("string").alias("text"), *extra)
    return chosen.mapInArrow(run, "x array<double>, " + ", ".join(f"{c} {chosen.schema[c].dataType.simpleString()}" for c in extra))


def labelled(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, rows: int) -> DataFrame:
    """(text, label) of at most about `rows` labelled documents outside the held-out fold, chosen by a hash of the id.

    The labels chosen are few enough to broadcast (`rows` bounds them), so the documents aren't shuffled.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).where(~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    total = max(1, known.count())
    known = known.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1_000_000)) < int(1_000_000 * rows / total)) if rows < total else known
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(known), "id").select("id", "text", "label")


def held_out(id_col) -> F.Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", rows: int = FIT_ROWS) -> Model:
    found = _features_of(labelled(docs, labels, label_col, id_col, text_col, rows), "text", ["id", "label"]).orderBy("id", "x").toArrow()
    x = np.array(found["x"].to_pylist(), "f8").reshape(found.num_rows, -1) if found.num_rows else np.zeros((0, 0))
    return fit(x, found["label"].to_numpy())


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, held_out, score, strength, predicted (1 from the cut on).

    Null text counts as empty and is scored as such; a null id is never held out; repeated rows are scored each; an
    empty table gives an empty result. Only the text decides a score.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            x = features(batch.column(2))
            score = model.score(x) if len(x) else np.zeros(0)
            strength = model.strength(x) if len(x) else np.zeros(0)
            columns = [batch.column(0), batch.column(1), pa.array(score), pa.array(strength), pa.array((score >= CUT).astype("i4"))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "held_out", "score", "strength", "predicted"])

    chosen = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, f"id {kind}, held_out boolean, score double, strength double, predicted int").withColumnRenamed("id", id_col)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, train(docs, table(spark, sf_dir, "labels"))).drop("strength")


SQL: dict[str, str] = {}
