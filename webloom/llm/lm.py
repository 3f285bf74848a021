"""Stupid-backoff scores: count tables of n-grams partitioned by hash, joined to the n-grams of blocks of documents.

Documents are read in blocks (parts of Arrow batches). A block asks for each of its distinct n-grams once, with its own count, so
that a phrase that a third of all documents share costs one entry a block and not one a document. The asking goes to
partitions by hash; each sums what all blocks have and answers every block with totals in the order that it asked. Back
at the block the totals meet the texts, and scores are summed per document. Keys travel as packed sorted differences.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm import vec
from webloom.llm.common import checkpointed, shuffle_width, table

ORDER = 3
BACKOFF = 0.4
#: A batch is cut into blocks of about so many bytes of text, which bounds a worker's memory.
BLOCK_BYTES = 8_000_000
U = np.uint64


def _grams(texts: pa.Array, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For k = 1..order the hash of the k-gram that ends at each word (0 where the text has fewer words before), and text offsets."""
    parts = list(vec.words(texts))
    word = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, U)
    length = np.concatenate([np.diff(p[2]) for p in parts]) if parts else np.zeros(0, "i8")
    first = np.concatenate([[0], np.cumsum(length)])
    before = np.arange(len(word)) - np.repeat(first[:-1], length)  # words of the text before this one
    out = [word]
    for k in range(2, order + 1):
        g = np.zeros(len(word), U)
        g[1:] = vec.mix(out[-1][:-1] * U(0x9E3779B97F4A7C15) + vec.mix(word[1:] + U(k)))
        g[before < k - 1] = 0
        out.append(g)
    return out, first


def _pack(keys: np.ndarray, base: int) -> bytes:
    """Sorted keys as differences of as many bytes as the largest needs. The highest bytes, small numbers mostly, are compressed;
    the others are as good as random and stay as they are."""
    d = np.diff(keys, prepend=U(base))
    size = max(1, (int(d.max()).bit_length() + 7) // 8) if len(d) else 1
    raw = d.astype("<u8").view(np.uint8).reshape(-1, 8)
    return bytes([size]) + len(d).to_bytes(8, "little") + raw[:, : size - 1].tobytes() + pa.compress(raw[:, size - 1].tobytes(), "zstd", asbytes=True)


def _unpack(data: bytes, base: int) -> np.ndarray:
    size, n = data[0], int.from_bytes(data[1:9], "little")
    low = n * (size - 1)
    d = np.zeros((n, 8), np.uint8)
    d[:, : size - 1] = np.frombuffer(data, np.uint8, low, 9).reshape(n, size - 1)
    d[:, size - 1] = np.frombuffer(pa.decompress(data[9 + low :], n, "zstd", asbytes=True), np.uint8, n)
    return np.cumsum(d.reshape(-1).view("<u8"), dtype=U) + U(base)


def _narrow(n: np.ndarray) -> bytes:
    """Counts as compressed bytes; the few above 254 follow in eight bytes each."""
    large = n[n >= 255].astype("<u8")
    data = np.minimum(n, 255).astype(np.uint8).tobytes() + large.tobytes()
    return len(large).to_bytes(4, "little") + pa.compress(data, "zstd", asbytes=True)


def _wide(data: bytes, n: int) -> np.ndarray:
    large = int.from_bytes(data[:4], "little")
    raw = pa.decompress(data[4:], n + 8 * large, "zstd", asbytes=True)
    out = np.frombuffer(raw, np.uint8, n).astype("i8")
    out[out == 255] = np.frombuffer(raw, "<u8", large, n)
    return out


def _blocks(docs: DataFrame, order: int, bits: int, asking: bool) -> DataFrame:
    """asking: rows (block, place, keys, counts) to ask; else (block, place -1, ids and texts). A block's number is a hash of what it holds."""

    def run(batches):
        for batch in vec.parts(batches, 1, BLOCK_BYTES):
            grams, first = _grams(batch.column(1), order)
            whole = np.concatenate([np.array([batch.num_rows], U), vec.mix(grams[0]), first.astype(U) * U(0xD6E8FEB86659FD93)])
            ids = np.frombuffer(repr((batch.column(0)[0].as_py(), batch.column(0)[-1].as_py())).encode(), np.uint8).astype(U)
            block = int(vec.mix(np.array([np.sum(vec.mix(whole + np.arange(len(whole)).astype(U)))], U) + np.sum(vec.mix(ids + np.arange(len(ids)).astype(U) * U(257))))[0].astype("i8"))
            if not asking:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=9))) as writer:
                    writer.write_batch(batch)
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([-1], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([b""], pa.binary())], names=["block", "place", "keys", "counts"])
                continue
            places, keys, counts = [], [], []
            for k, g in enumerate(grams):
                seen, n = np.unique(g[g != 0], return_counts=True)
                cuts = np.searchsorted(seen, np.arange(1 << bits).astype(U) << U(64 - bits))
                cuts = np.append(cuts, len(seen))
                for b in np.flatnonzero(np.diff(cuts)):
                    s = slice(cuts[b], cuts[b + 1])
                    places.append(k << 32 | int(b))
                    keys.append(_pack(seen[s], int(b) << (64 - bits)))
                    counts.append(_narrow(n[s]))
            if places:
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(places)), pa.array(places, pa.int64()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], names=["block", "place", "keys", "counts"])

    return docs.mapInArrow(run, "block long, place long, keys binary, counts binary")


def _answers(asked: DataFrame, bits: int) -> DataFrame:
    """(block, place, keys: totals) for each asking: the part of a count table that a place holds, joined back to every asker."""

    def answer(place: int, rows: list[tuple]) -> pa.RecordBatch:
        base = (place & 0xFFFFFFFF) << (64 - bits)
        keys = [_unpack(r[1], base) for r in rows]
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, np.concatenate([_wide(r[2], len(k)) for r, k in zip(rows, keys, strict=True)]).astype("f8")).astype("i8")[at]
        ends = np.cumsum([len(k) for k in keys])
        parts = [_narrow(total[e - len(k) : e]) for e, k in zip(ends, keys, strict=True)]
        n = len(rows)
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([place] * n), pa.array(parts, pa.binary()), pa.array([b""] * n, pa.binary())], names=["block", "place", "keys", "counts"])

    def run(batches):
        place, rows = None, []
        for batch in batches:
            for p, *row in zip(*(batch.column(c).to_pylist() for c in ("place", "block", "keys", "counts")), strict=True):
                if p != place:
                    if rows:
                        yield answer(place, rows)
                    place, rows = p, []
                rows.append(tuple(row))
        if rows:
            yield answer(place, rows)

    return asked.repartition("place").sortWithinPartitions("place", "block").mapInArrow(run, "block long, place long, keys binary, counts binary")


def _score_block(texts: pa.Array, order: int, bits: int, answers: dict[int, bytes]):
    """Per text: words, sum of log scores without the corpus size, and how many words fell back to it."""
    grams, first = _grams(texts, order)
    n, length = len(grams[0]), np.diff(first)
    text = np.repeat(np.arange(len(length)).astype(U), length)
    before = np.arange(n) - np.repeat(first[:-1], length)
    others = []  # by order: how often other texts of the corpus hold the n-gram that ends here
    for k, g in enumerate(grams):
        seen, at = np.unique(g, return_inverse=True)
        real = seen != 0
        counts = np.zeros(len(seen), "i8")
        parts = []
        cuts = np.append(np.searchsorted(seen[real], np.arange(1 << bits).astype(U) << U(64 - bits)), real.sum())
        for b in np.flatnonzero(np.diff(cuts)):
            parts.append(_wide(answers[k << 32 | int(b)], cuts[b + 1] - cuts[b]))
        if parts:
            counts[real] = np.concatenate(parts)
        # the place of a text's n-gram among the block's, and which text: no two pairs are equal
        pair = at.astype(U) * U(max(1, len(length))) + text
        _, where, own = np.unique(pair, return_inverse=True, return_counts=True)
        others.append(np.where(g != 0, counts[at] - own[where], 0) if n else counts)
    steps = np.minimum(order - 1, before)
    score = np.log(np.maximum(others[0], 1)) + steps * math.log(BACKOFF)
    to_size = np.ones(n, bool)
    for k in range(1, order):
        seen = others[k] > 0
        context = np.concatenate([[1], others[k - 1][:-1]]) if n else others[k - 1]
        score = np.where(seen, np.log(np.maximum(others[k], 1)) - np.log(np.maximum(context, 1)) + (steps - k) * math.log(BACKOFF), score)
        to_size &= ~seen
    sums = np.concatenate([[0.0], np.cumsum(score)])
    falls = np.concatenate([[0], np.cumsum(to_size)])
    return length, sums[first[1:]] - sums[first[:-1]], falls[first[1:]] - falls[first[:-1]]


def score_documents(docs: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, n_words, log_score (natural logarithm, summed over words), mean_log_score.

    A text is scored by the n-grams of all others: every count is the whole corpus's less the text's own (with its own, no
    n-gram would ever be missing). A word scores count(n-gram) / count(its context) for the longest n-gram up to `order`
    that is left, times BACKOFF for each shorter step; failing all, its count (1 at least) over the corpus's words. Words:
    runs of bytes other than ASCII white space, A-Z lower-cased. Null and empty texts have no words, score 0 and a null mean; a
    null id stays; repeated rows count and are scored each; an empty table gives an empty result; other columns are not
    read. Counts cover all rows.
    """
    spark = docs.sparkSession
    bits = max(4, (4 * shuffle_width(spark) - 1).bit_length())
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def finish(block, rows):
        answers, texts = {}, []
        for place, keys in rows:
            if place < 0:
                texts.append(keys)
            else:
                answers[place] = keys
        for data in texts:  # more than one only for blocks that hold the same
            batch = pa.ipc.open_stream(data).read_next_batch()
            words, score, falls = _score_block(batch.column(1), order, bits, answers)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(score), pa.array(falls)], names=["id", "words", "score", "falls"])

    def run(batches):
        block, rows = None, []
        for batch in batches:
            for b, *row in zip(*(batch.column(c).to_pylist() for c in ("block", "place", "keys")), strict=True):
                if b != block:
                    if rows:
                        yield from finish(block, rows)
                    block, rows = b, []
                rows.append(tuple(row))
        if rows:
            yield from finish(block, rows)

    answered = _answers(_blocks(chosen, order, bits, True), bits)
    met = answered.union(_blocks(chosen, order, bits, False)).repartition("block").sortWithinPartitions("block")
    scored = checkpointed(met.mapInArrow(run, f"id {kind}, words long, score double, falls long"))
    size = scored.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    total = F.col("score") - F.col("falls") * F.lit(math.log(max(size, 1)))
    return scored.select(F.col("id").alias(id_col), F.col("words").alias("n_words"), total.alias("log_score"), F.when(F.col("words") > 0, total / F.col("words")).alias("mean_log_score"))


def op5_lm_score(spark, sf_dir: str) -> DataFrame:
    scored = score_documents(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", F.round("log_score", 3).alias("log_score"), F.round("mean_log_score", 5).alias("mean_log_score"))


SQL = {
    "op5_lm_score": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, i, w[i + 1] AS w, CASE WHEN i > 0 THEN w[i] END AS v, CASE WHEN i > 1 THEN w[i - 1] END AS u FROM (SELECT doc_id, w, unnest(range(len(w))) AS i FROM w)),
o1 AS (SELECT doc_id, w, count(*) AS n FROM t GROUP BY ALL),
o2 AS (SELECT doc_id, v, w, count(*) AS n FROM t WHERE v IS NOT NULL GROUP BY ALL),
o3 AS (SELECT doc_id, u, v, w, count(*) AS n FROM t WHERE u IS NOT NULL GROUP BY ALL),
x1 AS (SELECT doc_id, w, sum(n) OVER (PARTITION BY w) - n AS n FROM o1),
x2 AS (SELECT doc_id, v, w, sum(n) OVER (PARTITION BY v, w) - n AS n FROM o2),
x3 AS (SELECT doc_id, u, v, w, sum(n) OVER (PARTITION BY u, v, w) - n AS n FROM o3),
s AS (SELECT t.doc_id, CASE WHEN x3.n > 0 THEN ln(x3.n / cuv.n)
                            WHEN x2.n > 0 THEN ln(x2.n / cv.n) + CASE WHEN t.u IS NULL THEN 0 ELSE ln(0.4) END
                            ELSE ln(greatest(x1.n, 1) / (SELECT count(*) FROM t)) + least(t.i, 2) * ln(0.4) END AS s
      FROM t JOIN x1 ON x1.doc_id = t.doc_id AND x1.w = t.w
      LEFT JOIN x1 cv ON cv.doc_id = t.doc_id AND cv.w = t.v
      LEFT JOIN x2 ON x2.doc_id = t.doc_id AND x2.v = t.v AND x2.w = t.w
      LEFT JOIN x2 cuv ON cuv.doc_id = t.doc_id AND cuv.v = t.u AND cuv.w = t.v
      LEFT JOIN x3 ON x3.doc_id = t.doc_id AND x3.u = t.u AND x3.v = t.v AND x3.w = t.w)
SELECT w.doc_id, len(w.w) AS n_words, round(coalesce(sum(s.s), 0), 3) AS log_score, round(avg(s.s), 5) AS mean_log_score
FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id, len(w.w)"""
}
