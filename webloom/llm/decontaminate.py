"""Benchmark decontamination: a BM25 inverted index of test items, queried with every passage by block-max WAND, then verified."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm import vec
from webloom.llm.common import table

SHINGLE = 5
OVERLAP = 0.8
K1, B = 1.2, 0.75
BLOCK = 16
#: Items are indexed in slices of at most about so many bytes; a larger benchmark takes more passes over the passages.
SLICE_BYTES = 16_000_000

_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
SENTENCE_END = re.compile(r"(?<=[.!?])\s+|\n+")


def _words(texts: list[str]) -> list[np.ndarray]:
    out = []
    for _, data, at in vec.slices(pa.array(texts, pa.string())):
        starts, ends, first = vec.spans(data, at, _ALNUM)
        word = vec.hashes(data, starts, ends)
        out += [word[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
    return out


def _grams(word: np.ndarray, k: int) -> np.ndarray:
    return vec.shingles(word, np.array([0, len(word)]), k)[0]


def split_item(text: str) -> tuple[str, str]:
    """Question and answer of an item: all sentences but the last, and the last; of one sentence both are the whole."""
    parts = [p for p in SENTENCE_END.split(text.strip()) if p.strip()]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, text)


def _lost(n: int) -> int:
    """How many of n shingles a copy may lack; exact, since 0.2 times 5 is below 1 in floats."""
    return math.floor((1 - Fraction(str(OVERLAP))) * n)


def _spans(at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The places at[r]..at[r + 1] - 1 of all rows r, one after the other."""
    first = at[rows]
    count = at[rows + 1] - first
    ends = count.cumsum()
    return np.repeat(first - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted and without repeats; for short arrays faster than np.unique."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def _held(x: np.ndarray, among: np.ndarray) -> float:
    """The share of `x` that sorted `among` holds."""
    if not len(among):
        return 0.0
    at = among.searchsorted(x)
    at[at == len(among)] = 0
    return float((among[at] == x).mean())


@dataclass
class Item:
    id: object
    k: int
    question: np.ndarray  # shingles that hold a word of the question, sorted
    answer: np.ndarray


@dataclass
class Index:
    """Postings by term with weights divided by what a copy of the item must score at least, so that every item's threshold is 1."""

    items: list[Item]
    vocabulary: np.ndarray
    essential_at: np.ndarray  # by term: where its essential postings begin; an item's other postings sum to less than half its threshold
    essential_item: np.ndarray
    essential: np.ndarray
    need: np.ndarray  # by item: what its essential postings must score
    term_at: np.ndarray
    posting_item: np.ndarray
    posting: np.ndarray
    bound_at: np.ndarray  # by term: where its blocks' bounds begin
    bound_block: np.ndarray
    bound: np.ndarray  # largest weight of the term in the block
    window: int
    floors: np.ndarray

    @staticmethod
    def build(rows: list[tuple]) -> Index | None:
        """rows: (id, text). Items without words are left out; null texts too."""
        rows = [(i, t) for i, t in rows if t]
        texts = [t for _, t in rows]
        words = _words(texts)
        halves = [split_item(t) for t in texts]
        answers = _words([a for _, a in halves])
        keep = [n for n, w in enumerate(words) if len(w)]
        if not keep:
            return None
        items, vectors = [], []
        df: dict[int, int] = {}
        for n in keep:
            for t in set(words[n].tolist()):
                df[t] = df.get(t, 0) + 1
        mean = sum(len(words[n]) for n in keep) / len(keep)
        for n in keep:
            word, k = words[n], min(SHINGLE, len(words[n]))
            grams = _grams(word, k)
            cut = max(0, len(word) - len(answers[n]))  # words from here on are the answer's
            starts = np.arange(len(grams))
            whole = halves[n][0] == halves[n][1]
            items.append(Item(rows[n][0], k, np.unique(grams[starts < cut] if not whole and cut else grams), np.unique(grams[starts + k > cut])))
            tf: dict[int, int] = {}
            for t in word.tolist():
                tf[t] = tf.get(t, 0) + 1
            idf = {t: math.log(1 + (len(keep) - df[t] + 0.5) / (df[t] + 0.5)) for t in tf}
            weight = {t: idf[t] * c * (K1 + 1) / (c + K1 * (1 - B + B * len(word) / mean)) for t, c in tf.items()}
            # at most `lost` shingles of a copy are missing, so at most lost + k - 1 words; were they the heaviest, this is left
            lost = _lost(len(items[-1].question)) + _lost(len(items[-1].answer))
            spare = lost + k - 1 if lost else 0
            floor = sum(sorted(weight.values())[: max(1, len(weight) - spare)])
            vectors.append((weight, max(floor, 1e-9)))
        vocabulary = np.array(sorted(df), np.uint64)
        item = np.repeat(np.arange(len(vectors)), [len(w) for w, _ in vectors])
        term = np.searchsorted(vocabulary, np.fromiter((t for w, _ in vectors for t in w), np.uint64, len(item)))
        floors = np.array([f for _, f in vectors])
        value = np.fromiter((x for w, _ in vectors for x in w.values()), "f8", len(item)) / floors[item]
        # of an item, its most frequent terms are spared as long as less than half its threshold depends on them
        often = np.array([df[int(t)] for t in vocabulary])
        spared, need = np.zeros(len(item), bool), np.ones(len(items))
        order = np.lexsort((vocabulary[term], -often[term], item))
        for i, n in zip(order.tolist(), item[order].tolist(), strict=True):
            if need[n] - value[i] > 0.5:
                need[n] -= value[i]
                spared[i] = True
        order = np.lexsort((item, term))
        term, item, value, spared = term[order], item[order], value[order], spared[order]
        starts = lambda t: np.searchsorted(t, np.arange(len(vocabulary) + 1))
        block = item // BLOCK
        new = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])]))
        longest = max(len(words[n]) for n in keep)
        return Index(
            items, vocabulary, starts(term[~spared]), item[~spared], value[~spared], need, starts(term), item, value,
            starts(term[new]), block[new], np.maximum.reduceat(value, new), max(longest, 32), floors,
        )

    def search(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items whose score for the distinct `terms` of a passage reaches their threshold, and the scores over it.

        The blocks' bounds come first; postings are read in those blocks only whose bound reaches 1.
        """
        blocks = -(-len(self.items) // BLOCK)
        at = _spans(self.bound_at, terms)
        open_blocks = np.flatnonzero(np.bincount(self.bound_block[at], self.bound[at], blocks) >= 1 - 1e-9)
        if not len(open_blocks):
            return np.zeros(0, "i8"), np.zeros(0)
        rank = np.full(blocks, -1)
        rank[open_blocks] = np.arange(len(open_blocks))
        at = _spans(self.term_at, terms)
        item = self.posting_item[at]
        place = rank[item // BLOCK]
        at, item, place = (x[place >= 0] for x in (at, item, place))
        score = np.bincount(place * BLOCK + item % BLOCK, self.posting[at], len(open_blocks) * BLOCK)
        found = np.flatnonzero(score >= 1 - 1e-9)
        return open_blocks[found // BLOCK] * BLOCK + found % BLOCK, score[found]

    def _passages(self, first: np.ndarray, known: np.ndarray, place: np.ndarray):
        """(text, begin, end) of the passages that may reach some item's threshold.

        Texts are cut into cells of one window; a passage is two cells, so that whatever is no longer than a window is
        whole in one. Only essential postings are read, for all cells at once: an item is in reach of a passage if they
        score, repeats counted, what they must. A passage may begin one cell before them, with the item's other words.
        """
        length = np.diff(first)
        cells = -(-length // self.window)
        cell_at = np.concatenate([[0], np.cumsum(cells)])
        at = np.flatnonzero(known)
        at = at[self.essential_at[place[at] + 1] > self.essential_at[place[at]]]
        text = np.searchsorted(first, at, "right") - 1
        cell = cell_at[text] + (at - first[text]) // self.window
        count = self.essential_at[place[at] + 1] - self.essential_at[place[at]]
        flat = _spans(self.essential_at, place[at])
        n = len(self.items)
        key, inverse = np.unique(np.repeat(cell, count) * n + self.essential_item[flat], return_inverse=True)
        score = np.bincount(inverse, self.essential[flat], len(key))
        cell = key // n
        before = key[cell > cell_at[np.searchsorted(cell_at, cell, "right") - 1]] - n
        own, key = key, np.union1d(key, before)
        score = np.bincount(np.searchsorted(key, own), score, len(key))
        cell, item = key // n, key % n
        following = np.searchsorted(key, key + n)
        following[following == len(key)] = 0
        doc = np.searchsorted(cell_at, cell, "right") - 1
        joined = (key[following] == key + n) & (cell + 1 < cell_at[doc + 1]) if len(key) else np.zeros(0, bool)
        total = score + np.where(joined, score[following], 0.0)
        for c in np.unique(cell[total >= self.need[item] - 1e-9]):
            d = int(np.searchsorted(cell_at, c, "right")) - 1
            begin = int(first[d] + (c - cell_at[d]) * self.window)
            yield d, begin, min(begin + 2 * self.window, int(first[d + 1]))

    def matches(self, texts: pa.Array):
        """(row, item, BM25 score, question overlap, answer overlap) of every verified match in the texts, whole texts read."""
        for row, data, at in vec.slices(texts):
            starts, ends, first = vec.spans(data, at, _ALNUM)
            word = vec.hashes(data, starts, ends)
            place = np.searchsorted(self.vocabulary, word)
            place[place == len(self.vocabulary)] = 0
            known = self.vocabulary[place] == word
            best_of: dict[int, dict[int, float]] = {}
            for d, begin, end in self._passages(first, known, place):
                best = best_of.setdefault(d, {})
                terms = _distinct(place[begin:end][known[begin:end]])
                for n, score in zip(*self.search(terms), strict=True):
                    best[n] = max(best.get(n, 0.0), score)
            for d, best in best_of.items():
                a, b = int(first[d]), int(first[d + 1])
                grams: dict[int, np.ndarray] = {}
                for n in sorted(best):
                    item = self.items[n]
                    if item.k not in grams:
                        grams[item.k] = np.sort(_grams(word[a:b], item.k)) if b - a >= item.k else np.zeros(0, np.uint64)
                    q, r = (_held(x, grams[item.k]) for x in (item.question, item.answer))
                    if q >= OVERLAP and r >= OVERLAP:
                        yield row + int(d), item.id, best[n] * self.floors[n], float(q), float(r)


def _indexes(items: DataFrame, id_col: str, text_col: str):
    """A broadcast index for each slice of the items; a slice's bytes bound what the driver holds and what is broadcast."""
    size = items.agg(F.coalesce(F.sum(F.octet_length(text_col) + 16), F.lit(0))).first()[0]
    parts = 1 + size // SLICE_BYTES
    rows = items.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    for part in range(parts):
        own = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == part) if parts > 1 else rows
        index = Index.build(sorted(((r["id"], r["text"]) for r in own.distinct().collect()), key=repr))
        if index is not None:
            yield items.sparkSession.sparkContext.broadcast(index)


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and test item that it holds: id, item id, score (BM25), question_overlap, answer_overlap.

    An item is held when at least OVERLAP of the five-word shingles of its question and of its answer occur in the
    document (words: letters and digits, case-insensitive). The index finds every item of which one passage holds so
    much: its threshold is the least that such a passage can score. Null and empty texts hold nothing and are held by
    nothing; repeated rows give repeated results; without items the result is empty; other columns are not read.
    """
    kinds = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, {item_col} {items.schema[item_col].dataType.simpleString()}"
    schema = kinds + ", score double, question_overlap double, answer_overlap double"
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for index in _indexes(items, item_col, item_text):

        def run(batches, index=index):
            for batch in vec.parts(batches, 1, vec.PART_BYTES):
                found = list(index.value.matches(batch.column(1)))
                ids = batch.column(0).take(pa.array([f[0] for f in found], pa.int64()))
                rest = [pa.array([f[i] for f in found]) for i in (1, 2, 3, 4)] if found else [pa.nulls(0)] * 4
                if found:
                    yield pa.RecordBatch.from_arrays([ids, *rest], names=[id_col, item_col, "score", "question_overlap", "answer_overlap"])

        part = chosen.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """`docs` without the rows that hold a test item, all columns kept; narrow, no shuffle. See find_contamination."""
    at = docs.columns.index(text_col)
    for index in _indexes(items, item_col, item_text):

        def keep(batches, index=index):
            for batch in vec.parts(batches, at, vec.PART_BYTES):
                bad = {m[0] for m in index.value.matches(batch.column(at))}
                yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL: dict[str, str] = {}
