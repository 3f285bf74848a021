"""Exact deduplication by tree-merge of sorted digest runs, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import checkpointed, free_name, merge_copies, run_of, table

#: At most so many rows to drop (100 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 200_000
SPACES = r"[\x20\x09-\x0D]+"


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of ASCII white space became one space. Every input partition is a
    run of (digest, smallest id), sorted by digest; runs meet and are merged in rounds (see merge_copies). A
    match is verified by more than its SHA-256: the byte length and an independent 64-bit hash belong to the key.

    Null text counts as empty. Among rows of one text, the smallest id stays; rows without an id come last; of
    repeated rows (same id and text) exactly one is kept. Other columns are neither read nor returned; an empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    text = F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), SPACES, " ")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("norm")).select(
        "id",
        F.unhex(F.sha2("norm", 256)).alias("digest"),
        F.octet_length("norm").alias("bytes"),
        F.xxhash64("norm").alias("check"),
        run_of(spark).alias("run"),
        F.monotonically_increasing_id().alias("uid"),
    )
    rows = checkpointed(rows.withColumn("first", F.struct(F.isnull("id").alias("no_id"), "id", "uid")))
    merged = merge_copies(rows, ["digest", "bytes", "check"], "first")
    return merged.select(
        F.col("id").alias(id_col),
        F.col("keep.id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("keep.uid") == F.col("uid")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each text, all its columns; which one: see exact_copies. Rows without an id are kept if
    no row with an id has their text; repeated rows (same id and text) stay once. Texts are not shuffled while the
    rows to drop are few enough to broadcast.
    """
    found = exact_copies(docs, id_col, text_col).groupBy(F.col(id_col).alias("__id"), F.col("text_sha256").alias("__sha"))
    found = checkpointed(found.agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("rows")))
    text = F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), SPACES, " ")
    own, key, sha = (free_name(docs, c) for c in ("text_sha", "id", "sha"))
    found = found.withColumnsRenamed({"__id": key, "__sha": sha})
    marked = docs.withColumn(own, F.sha2(text, 256))
    same = F.col(id_col).eqNullSafe(F.col(key)) & (F.col(own) == F.col(sha))

    def listed(rows: DataFrame) -> DataFrame:
        rows = rows.select(key, sha)
        return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows

    left = marked.join(listed(found.where("not kept")), same, "left_anti")
    repeated = found.where("kept and rows > 1")
    if repeated.limit(1).count():
        again = listed(repeated)
        left = left.join(again, same, "left_anti").unionByName(left.join(again, same, "left_semi").dropDuplicates([id_col, own]))
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_copies(table(spark, sf_dir, "documents"))


SQL = {
    "op6_exact_dedup": r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS s FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS keep_id, count(*) OVER (PARTITION BY s) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY s) AS kept, s AS text_sha256
FROM n""",
}
