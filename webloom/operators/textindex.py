"""Postings of line trigrams and words, so that a search reads the tabs that can have a hit instead of all of them.

Tables in one folder, each a directory for every bucket of a key and sorted by key within its files, so a lookup prunes to
buckets by partition and to row groups by their ranges:

* grams (gram, tab_id): the trigrams of a tab's lines, A-Z lower-cased;
* words (word, tab_id): its words, split as the fuzzy mode splits them;
* gram_counts (gram, tabs) and vocabulary (word): how many tabs have a trigram, and each distinct word once, in buckets by its
  length; other buckets are of a key's crc32.

Postings are never wrong by being old: what they lead to is matched against the text itself. Tabs that were written
again must be added again. At 2 to 3 bytes a posting, trigrams take about as much room as the compressed texts.
"""

from __future__ import annotations

import zlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions.predicates import ascii_lower
from webloom.operators import search as S

BUCKETS = 32
#: Of the trigrams that a hit must hold, so many of the rarest are looked up.
RAREST = 12
#: Words of so many code points and longer ones share a bucket of the vocabulary.
LONG = 32
#: Up to so many words or tabs found are named in a filter that prunes the next read; more are joined, by broadcast up to BROADCAST.
NAMED = 2000
BROADCAST = 100_000


def grams_of(text: str) -> list[str]:
    low = S.lowered(text)
    return sorted({low[i : i + 3] for i in range(len(low) - 2)})


def line_grams(text: Column) -> Column:
    """The distinct trigrams of the lines of `text`, in one pass."""
    return F.array_distinct(F.regexp_extract_all(ascii_lower(text), F.lit("(?=([^\n]{3}))"), F.lit(1)))


def line_words(text: Column) -> Column:
    return F.array_distinct(F.filter(S.words(text), lambda w: w != ""))


def _bucket(key: Column) -> Column:
    return F.pmod(F.crc32(key), F.lit(BUCKETS)).cast("int")


def _buckets(keys) -> list[int]:
    return sorted({zlib.crc32(k.encode()) % BUCKETS for k in keys})


class TextIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def add(self, docs: DataFrame, id_col: str, text_col: str, batch: str = "0", tables: tuple[str, ...] = ("grams", "words")) -> TextIndex:
        """Indexes (id, text) rows as one batch; null texts have no postings. Fuzzy searches need words (and the vocabulary), others
        grams (and their counts); `tables` names what is written.

        A batch is written as a whole: written again (a retried job) it replaces itself, and others are not touched.
        A rewritten tab's old postings stay in their batch; they cost a look at the tab. Postings are dealt evenly: a
        trigram that every tab has is spread over as many files as the session's shuffles are wide.
        """
        width = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        lanes = max(1, width // BUCKETS)
        text = docs.where(F.col(text_col) != "").select(F.col(id_col).alias("tab_id"), F.col(text_col).alias("text"))
        for name, key, keys in (("grams", "gram", line_grams(F.col("text"))), ("words", "word", line_words(F.col("text")))):
            if name not in tables:
                continue
            rows = text.select("tab_id", F.explode(keys).alias(key)).withColumn("bucket", _bucket(F.col(key)))
            rows = rows.repartition(width, "bucket", F.pmod(F.xxhash64("tab_id"), F.lit(lanes)))
            self._write(rows.sortWithinPartitions("bucket", key, "tab_id").select(key, "tab_id", "bucket"), name, batch)
        if "grams" in tables:
            counts = self._read("grams", batch).groupBy("bucket", "gram").agg(F.count(F.lit(1)).alias("tabs"))
            self._write(counts.repartition("bucket").sortWithinPartitions("bucket", "gram"), "gram_counts", batch)
        if "words" in tables:
            words = self._read("words", batch).select("word").distinct().withColumn("bucket", F.least(F.char_length("word"), F.lit(LONG)))
            words = words.repartition(width, "bucket", F.pmod(F.xxhash64("word"), F.lit(lanes)))
            self._write(words.sortWithinPartitions("bucket", "word"), "vocabulary", batch)
        return self

    def _write(self, rows: DataFrame, name: str, batch: str) -> None:
        rows.write.partitionBy("bucket").mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")

    def _read(self, name: str, batch: str | None = None) -> DataFrame:
        """A table, of all batches or one. Equal rows may be there once a batch."""
        return self.spark.read.parquet(f"{self.path}/{name}" + (f"/batch={batch}" if batch is not None else ""))

    def _of(self, name: str, key: str, keys) -> DataFrame:
        """The rows of some keys, by partition and pushed filter."""
        keys = sorted(keys)
        return self._read(name).where(F.col("bucket").isin(_buckets(keys)) & F.col(key).isin(keys))

    def near_words(self, word: str) -> DataFrame:
        """(word): the distinct words that the fuzzy mode takes for `word`."""
        most = S.edits(word)
        lengths = [min(n, LONG) for n in range(max(1, len(word) - most), len(word) + most + 1)]
        return self._read("vocabulary").where(F.col("bucket").isin(sorted(set(lengths))) & S.near(F.col("word"), word)).select("word").distinct()

    def _kept(self, rows: DataFrame, found: DataFrame, on) -> DataFrame:
        """The rows that `found` has: few keys go to the rows, so that no text or posting is shuffled."""
        few = found.limit(BROADCAST + 1).count() <= BROADCAST
        return rows.join(F.broadcast(found) if few else found, on, "left_semi")

    def candidates(self, query: str, mode: str = "plain") -> DataFrame | None:
        """(tab_id): the tabs that can have a hit, each once; None where the query says too little to leave any out."""
        if mode == "fuzzy":
            return self._fuzzy(S.query_words(query))
        held = [g for literal in (S.literals(query, mode) or ()) for g in grams_of(literal)]
        if not held:
            return None
        counts = self._of("gram_counts", "gram", set(held)).groupBy("gram").agg(F.sum("tabs").alias("tabs"))
        rarest = counts.orderBy("tabs", "gram").collect()  # a row for each trigram of the query
        if len(rarest) < len(set(held)):
            return self._read("grams").select("tab_id").limit(0)
        chosen = [r["gram"] for r in rarest[:RAREST]]
        return self._all_of(self._of("grams", "gram", chosen).withColumn("which", F.col("gram")), len(chosen))

    def _all_of(self, postings: DataFrame, n: int) -> DataFrame:
        return postings.groupBy("tab_id").agg(F.count_distinct("which").alias("n")).where(F.col("n") == n).select("tab_id")

    def _fuzzy(self, words: list[str]) -> DataFrame:
        postings = []
        for i, word in enumerate(words):
            near = self.near_words(word)
            listed = [r["word"] for r in near.limit(NAMED + 1).collect()]
            own = self._of("words", "word", listed) if len(listed) <= NAMED else self._kept(self._read("words"), near, "word")
            postings.append(own.select("tab_id", F.lit(i).alias("which")))
        if not postings:
            return self._read("words").select("tab_id").limit(0)
        return self._all_of(reduce(DataFrame.union, postings), len(words))

    def narrowed(self, docs: DataFrame, id_col: str, query: str, mode: str = "plain") -> DataFrame:
        """The rows of `docs` that can have a hit. A few tabs are named in a filter that reaches the scan, more are joined."""
        found = self.candidates(query, mode)
        if found is None:
            return docs
        few = [r["tab_id"] for r in found.limit(NAMED + 1).collect()]
        if len(few) <= NAMED:
            return docs.where(F.col(id_col).isin(few))
        key = "tab_id"
        while key in docs.columns:
            key = "_" + key
        return self._kept(docs, found.withColumnRenamed("tab_id", key), F.col(id_col) == F.col(key))

    def search(self, docs: DataFrame, id_col: str, text_col: str, query: str, mode: str = "plain", limit: int | None = 50, before: int = 0, after: int = 0) -> DataFrame:
        """The rows that search.search_texts gives over all of `docs`, read from the tabs that can have a hit."""
        return S.search_texts(self.narrowed(docs, id_col, query, mode), id_col, text_col, query, mode, limit, before, after)
