"""Toxicity by the nearest labelled examples: exact TF-IDF cosine through a block-max inverted index, with calibrated votes."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm import vec
from webloom.llm.common import checkpointed, table
from webloom.llm.quality import held_out, labelled

#: At most about so many labelled rows are examples, chosen by a hash of the id; scores read whole texts of all rows.
FIT_ROWS = 12_000
#: At most so many terms, the ones that tell the labels apart best.
TERMS = 4_000
#: Likelihood ratio that a term must reach.
EVIDENCE = 30.0
NEIGHBOURS = 15
BLOCK = 64
THRESHOLD = 0.3

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Besides whole words, their first bytes are terms, so that inflected and compounded forms meet.
PREFIXES = (4, 5, 6, 7, 8)


def terms(texts: pa.Array):
    """For each slice: the first row, then text number, term and count of each distinct term of a text, in that order."""
    for row, data, at in vec.slices(texts):
        starts, ends, first = vec.spans(data, at, _LETTER)
        doc = np.repeat(np.arange(len(at) - 1), np.diff(first))
        parts, docs = [vec.hashes(data, starts, ends)], [doc]
        for n in PREFIXES:
            long = ends - starts > n
            parts.append(vec.hashes(data, starts[long], starts[long] + n) ^ np.uint64(n * 0x1F3D5B79))
            docs.append(doc[long])
        yield row, np.concatenate(docs), np.concatenate(parts)


def _counted(doc: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((term, doc))
    doc, term = doc[order], term[order]
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])])) if len(doc) else np.zeros(0, "i8")
    return doc[new], term[new], np.diff(np.append(new, len(doc)))


def _lookup(vocabulary: np.ndarray, term: np.ndarray) -> np.ndarray:
    """The place of each term in the sorted vocabulary, or -1."""
    if not len(vocabulary) or not len(term):
        return np.full(len(term), -1)
    at = np.searchsorted(vocabulary, term)
    at[at == len(vocabulary)] = 0
    return np.where(vocabulary[at] == term, at, -1)


def vectors(texts: pa.Array, vocabulary: np.ndarray):
    """(text number, place in the vocabulary, count) of the vocabulary's terms in each text, for the whole batch."""
    out = [(np.zeros(0, "i8"),) * 3]
    for row, doc, term in terms(texts):
        at = _lookup(vocabulary, term)
        hit = at >= 0
        d, t, n = _counted(doc[hit], at[hit])
        out.append((d + row, t, n))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


@dataclass
class Index:
    """Postings by term, cut into blocks of BLOCK examples with the largest weight of each block."""

    ids: np.ndarray
    labels: np.ndarray
    weights: np.ndarray  # of the postings, by term and example
    examples: np.ndarray
    block_of: np.ndarray  # by (term, block): the block, its largest weight, where its postings begin
    block_max: np.ndarray
    block_at: np.ndarray
    term_at: np.ndarray  # by term: where its blocks begin

    @staticmethod
    def build(terms_: int, ids, labels, doc, term, weight) -> Index:
        order = np.lexsort((doc, term))
        doc, term, weight = doc[order], term[order], weight[order]
        block = doc // BLOCK
        new = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])])) if len(doc) else np.zeros(0, "i8")
        most = np.maximum.reduceat(weight, new) if len(new) else np.zeros(0)
        return Index(ids, labels, weight, doc, block[new], most, np.append(new, len(doc)), np.searchsorted(term[new], np.arange(terms_ + 1)))

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k examples with the largest dot product, exactly: (examples, products), best first, ties by example.

        Every block has a bound, the sum of its largest weights. The blocks with the largest bounds are scored first; of
        the others only those whose bound reaches the k-th product so far can hold a better example.
        """
        spans = [np.arange(self.term_at[t], self.term_at[t + 1]) for t in term]
        lists = np.concatenate(spans) if spans else np.zeros(0, "i8")
        if not len(lists):
            return np.zeros(0, "i8"), np.zeros(0)
        w = np.repeat(weight, [len(s) for s in spans])
        blocks = 1 + int(self.block_of[lists].max())
        bound = np.bincount(self.block_of[lists], w * self.block_max[lists], blocks)
        first = np.zeros(blocks, bool)
        first[np.argsort(-bound, kind="stable")[: max(1, k // 4)]] = True
        score = self._score(lists, w, first)
        if len(score) >= k:
            floor = np.partition(score, len(score) - k)[len(score) - k]
            rest = ~first & (bound >= floor * (1 - 1e-12))
        else:
            rest = ~first & (bound > 0)
        if rest.any():
            score = np.maximum(np.pad(score, (0, max(0, BLOCK * blocks - len(score)))), self._score(lists, w, rest, BLOCK * blocks))
        found = np.flatnonzero(score > 0)
        best = found[np.lexsort((found, -score[found]))[:k]]
        return best, score[best]

    def _score(self, lists, w, chosen, size: int = 0) -> np.ndarray:
        keep = chosen[self.block_of[lists]]
        lists, w = lists[keep], w[keep]
        lengths = self.block_at[lists + 1] - self.block_at[lists]
        at = np.repeat(self.block_at[lists] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        return np.bincount(self.examples[at], np.repeat(w, lengths) * self.weights[at], max(size, 1))


@dataclass
class Model:
    vocabulary: np.ndarray
    idf: np.ndarray
    prior: float
    none: float  # of a text without a term of the vocabulary
    index: Index
    calibration: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))

    def unit(self, term: np.ndarray, count: np.ndarray) -> np.ndarray:
        w = (1 + np.log(count)) * self.idf[term]
        return w / np.sqrt((w * w).sum()) if len(w) else w

    def vote(self, examples: np.ndarray, similarity: np.ndarray) -> float:
        """The share of label 1 among the neighbours, weighted by similarity, drawn to the prior where they are far."""
        return (similarity @ self.index.labels[examples] + 0.05 * self.prior) / (similarity.sum() + 0.05)

    def calibrated(self, vote: float) -> float:
        z = np.clip(self.calibration[0] + self.calibration[1] * np.log(vote / (1 - vote)), -30, 30)
        return float(1 / (1 + np.exp(-z)))

    def score(self, term: np.ndarray, count: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        if not len(term):
            return self.none, np.zeros(0, "i8"), np.zeros(0)
        examples, similarity = self.index.nearest(term, self.unit(term, count), NEIGHBOURS)
        return self.calibrated(self.vote(examples, similarity)), examples, similarity


def _split(doc: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(doc, np.arange(n + 1))


def build(ids, labels, doc, term, count, vocabulary, idf) -> Model:
    """A model of labelled examples given as (example, place, count) triples ordered by example."""
    labels = np.asarray(labels, "f8")
    n = len(labels)
    prior = (labels.sum() + 0.5) / (n + 1)
    at = _split(doc, n)
    size = np.diff(at)
    empty = size == 0
    none = float(min((labels[empty].sum() + 0.5 * prior) / (empty.sum() + 0.5), 1.0))
    model = Model(vocabulary, idf, float(prior), none, Index.build(len(vocabulary), ids, labels, doc[:0], term[:0], np.zeros(0)))
    weight = np.concatenate([model.unit(term[a:b], count[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)] or [np.zeros(0)])
    model.index = Index.build(len(vocabulary), ids, labels, doc, term, weight)
    votes, truth = [], []
    for i in np.flatnonzero(~empty):
        examples, similarity = model.index.nearest(term[at[i] : at[i + 1]], weight[at[i] : at[i + 1]], NEIGHBOURS + 1)
        other = examples != i
        votes.append(model.vote(examples[other], similarity[other]))
        truth.append(labels[i])
    if len(set(truth)) == 2:
        model.calibration = _platt(np.array(votes), np.array(truth))
    return model


def _platt(votes: np.ndarray, truth: np.ndarray) -> np.ndarray:
    """Logistic calibration of the votes' log-odds with targets drawn in by one row each."""
    x = np.stack([np.ones(len(votes)), np.log(votes / (1 - votes))], axis=1)
    up, down = truth.sum(), (1 - truth).sum()
    y = np.where(truth == 1, (up + 1) / (up + 2), 1 / (down + 2))
    w = np.array([0.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 0.1 * np.eye(2), x.T @ (p - y) + 0.1 * (w - [0, 1]))
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return np.array([w[0], max(w[1], 0.05)])


def _examples(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, rows: int) -> DataFrame:
    """Labelled rows, one for each group of near copies: of rows with the same least or greatest 5-word shingle the first stays."""

    def sketch(batches):
        for batch in vec.parts(batches, 1, vec.PART_BYTES):
            low, high = [], []
            for s in vec.sets(batch.column(1), 5):
                low.append(int(s[0].astype("i8")) if len(s) else 0)
                high.append(int(s[-1].astype("i8")) if len(s) else 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(low, pa.int64()), pa.array(high, pa.int64())], names=["id", "text", "label", "low", "high"])

    found = labelled(docs, labels, label_col, id_col, text_col, rows)
    found = found.mapInArrow(sketch, f"id {found.schema['id'].dataType.simpleString()}, text string, label int, low long, high long")
    for c in ("low", "high"):
        found = found.withColumn("n", F.row_number().over(Window.partitionBy(c, "label").orderBy("id"))).where("n = 1")
    return checkpointed(found.select("id", "text", "label"))


def _select_terms(examples: DataFrame, limit: int) -> np.ndarray:
    def count(batches):
        for batch in vec.parts(batches, 0, vec.PART_BYTES):
            label = batch.column(1).to_numpy()
            out = []
            for row, doc, term in terms(batch.column(0)):
                d, t, _ = _counted(doc, term)
                out.append((t, label[d + row]))
            if out:
                t, y = (np.concatenate(x) for x in zip(*out, strict=True))
                distinct, at = np.unique(t, return_inverse=True)
                toxic = np.bincount(at, y == 1, len(distinct))
                yield pa.RecordBatch.from_arrays([pa.array(distinct.view("i8")), pa.array(toxic.astype("i8")), pa.array((np.bincount(at, minlength=len(distinct)) - toxic).astype("i8"))], names=["term", "a", "b"])

    totals = {r["label"]: r["n"] for r in examples.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    na, nb = totals.get(1, 0), totals.get(0, 0)
    if not na or not nb:
        return np.zeros(0, np.uint64)
    counted = examples.select("text", "label").mapInArrow(count, "term long, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    a, b = F.col("a"), F.col("b")
    share = F.lit(na / (na + nb))
    gain = 2 * (F.when(a > 0, a * F.log(a / ((a + b) * share))).otherwise(0.0) + F.when(b > 0, b * F.log(b / ((a + b) * (1 - share)))).otherwise(0.0))
    telling = counted.withColumn("gain", gain).where((F.col("gain") >= EVIDENCE) & (a / na >= 4 * b / nb))
    best = telling.orderBy(F.desc("gain"), "term").limit(limit).select("term").toArrow()
    return np.sort(best["term"].to_numpy().view(np.uint64))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", rows: int = FIT_ROWS) -> Model:
    """Terms that tell the labels apart and their examples from labelled rows; document frequencies from all of `docs`."""
    examples = _examples(docs, labels, label_col, id_col, text_col, rows)
    vocabulary = _select_terms(examples, TERMS)

    def frequency(batches):
        for batch in vec.parts(batches, 0, vec.PART_BYTES):
            _, t, _ = vectors(batch.column(0), vocabulary)
            n = np.bincount(t, minlength=len(vocabulary))
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(n[at], batch.num_rows))], names=["at", "n"])

    everything = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(frequency, "at long, n long")
    df = {r["at"]: r["n"] for r in everything.groupBy("at").agg(F.sum("n").alias("n")).collect()}
    total = df.pop(-1, 0)
    idf = np.array([np.log((total + 1) / (df.get(i, 0) + 1)) + 1 for i in range(len(vocabulary))])

    def vector(batches):
        for batch in vec.parts(batches, 1, vec.PART_BYTES):
            d, t, n = vectors(batch.column(1), vocabulary)
            at = pa.array(_split(d, batch.num_rows).astype("i4"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.ListArray.from_arrays(at, pa.array(t)), pa.ListArray.from_arrays(at, pa.array(n))], names=["id", "label", "t", "n"]
            )

    kind = examples.schema["id"].dataType.simpleString()
    found = examples.mapInArrow(vector, f"id {kind}, label int, t array<long>, n array<long>").orderBy("id").collect()
    # examples with the same leading terms stand together: their blocks' bounds are tighter
    found.sort(key=lambda r: (list(r["t"])[:3], r["id"]))
    sizes = [len(r["t"]) for r in found]
    doc = np.repeat(np.arange(len(found)), sizes)
    term = np.array([t for r in found for t in r["t"]], "i8")
    count = np.array([n for r in found for n in r["n"]], "f8")
    return build(np.array([r["id"] for r in found]), [r["label"] for r in found], doc, term, count, vocabulary, idf)


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", evidence: int = 3) -> DataFrame:
    """One row per row of `docs`: id, held_out, score, predicted, evidence (ids and similarities of the nearest examples).

    Null and empty texts, and texts without a telling term, get the calibrated rate of such examples and no evidence. A
    null id is never held out; repeated rows are scored each; an empty table gives an empty result. Only the text decides.
    The evidence's ids are long if the examples' ids are whole numbers, else strings.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    # examples come from a table whose ids may be of another kind than those of `docs`
    numbers = model.index.ids.dtype.kind in "iu"
    index_kind, arrow_id, plain = ("long", pa.int64(), int) if numbers else ("string", pa.string(), str)
    schema = f"id {kind}, held_out boolean, score double, predicted int, evidence array<struct<id:{index_kind},similarity:double,label:int>>"
    index = model.index

    def run(batches):
        for batch in vec.parts(batches, 2, vec.PART_BYTES):
            doc, t, n = vectors(batch.column(2), model.vocabulary)
            at = _split(doc, batch.num_rows)
            score = np.full(batch.num_rows, model.none)
            why: list = [[]] * batch.num_rows
            for i in np.flatnonzero(np.diff(at)):
                score[i], examples, similarity = model.score(t[at[i] : at[i + 1]], n[at[i] : at[i + 1]].astype("f8"))
                why[i] = [{"id": plain(index.ids[e]), "similarity": float(s), "label": int(index.labels[e])} for e, s in zip(examples[:evidence], similarity, strict=False)]
            why = pa.array(why, pa.list_(pa.struct([("id", arrow_id), ("similarity", pa.float64()), ("label", pa.int32())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= THRESHOLD).astype("i4")), why], names=["id", "held_out", "score", "predicted", "evidence"])

    chosen = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """`docs` without the rows that the model predicts to be toxic; a narrow filter that keeps all columns."""
    column = docs.columns.index(text_col)

    def keep(batches):
        for batch in vec.parts(batches, column, vec.PART_BYTES):
            doc, t, n = vectors(batch.column(column), model.vocabulary)
            at = _split(doc, batch.num_rows)
            score = [model.score(t[a:b], n[a:b].astype("f8"))[0] for a, b in zip(at[:-1], at[1:], strict=True)]
            yield batch.filter(pa.array([s < THRESHOLD for s in score], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.withColumn("evidence", F.col("evidence.id"))


SQL: dict[str, str] = {}
