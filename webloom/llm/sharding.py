"""Sharding by best-fit-decreasing bin packing of indivisible groups, in DataFrame operations; the driver sees a size histogram."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.bestfit import Run, balance, fill
from webloom.llm.common import checkpointed, merge_copies, ranked, run_of, table

#: A plan of at most so many sizes is broadcast (16 MB or so); a larger one is joined by shuffle.
BROADCAST_SIZES = 100_000


def _sized(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t")).select(
        "id",
        F.unhex(F.sha2("t", 256)).alias("digest"),
        (F.octet_length("t") + 1).cast("long").alias("bytes"),
        F.crc32("t").alias("crc"),
        run_of(docs.sparkSession).alias("run"),
        F.monotonically_increasing_id().alias("uid"),
    )
    return checkpointed(rows)


def _place(docs: DataFrame, id_col: str, text_col: str, plan) -> DataFrame:
    """plan: from {group bytes: groups} to runs. Equal texts are one group, never divided."""
    spark = docs.sparkSession
    rows = merge_copies(_sized(docs, id_col, text_col), ["digest", "bytes", "crc"], "uid")
    rows = checkpointed(rows.select("id", "bytes", "crc", "uid", "run", "keep", (F.col("group_size") * F.col("bytes")).alias("weight")))
    # one row a group: the copy with the smallest uid
    groups = rows.where("uid = keep").select("weight", "uid")
    # Distinct sizes: their sum is at most the corpus's bytes B, so there are fewer than sqrt(2 B) of them
    counts = {r["weight"]: r["n"] for r in groups.groupBy("weight").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}
    runs: list[Run] = plan(counts)
    by_size: dict[int, list[Run]] = {}
    for run in runs:
        by_size.setdefault(run.size, []).append(run)
    whole = [(s, [r.first for r in rs], [r.bin for r in rs]) for s, rs in by_size.items()]
    plans = spark.createDataFrame(whole, "weight long, firsts array<long>, bins array<int>")
    numbered = ranked(checkpointed(groups), "weight", "uid", ["uid"], "rank")
    placed = numbered.join(F.broadcast(plans) if len(whole) <= BROADCAST_SIZES else plans, "weight")
    shard = F.element_at("bins", F.size(F.filter("firsts", lambda x: x <= F.col("rank"))))
    placed = placed.select(F.col("uid").alias("keep"), shard.alias("shard"))
    # back to the copies: dealt by run as well, so that the copies of one text are not one task's
    keys = rows.select("keep", "run").distinct().join(placed, "keep")
    return checkpointed(rows.join(keys, ["keep", "run"]).select("id", "bytes", "crc", "uid", "shard"))


def _result(placed: DataFrame, id_col: str, law: str) -> DataFrame:
    numbered = ranked(placed, "shard", "uid", ["id"], "slot")
    return numbered.select(
        F.col("id").alias(id_col),
        F.col("bytes").alias("size"),
        F.col("crc").alias("text_crc32"),
        F.lit(law).alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def shard_evenly(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deals all rows into shards 0..shards-1 of near-equal bytes; equal texts stay together.

    Returns id, size (UTF-8 bytes of the text plus 1), text_crc32, law ('bytes'), shard, slot (gapless from 0 in each
    shard), grown_shard (null: under this law a new shard moves groups everywhere). Null text counts as empty; a null
    id is kept as it is; repeated rows are copies; fewer groups than shards leave shards empty; an empty table gives
    an empty result. A group larger than an equal share has a shard of its own. Other columns are not read.
    """
    return _result(_place(docs, id_col, text_col, lambda counts: balance(counts, shards)), id_col, "bytes")


def shard_by_capacity(docs: DataFrame, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As shard_evenly, but with as few shards of at most `capacity` bytes as best-fit decreasing finds.

    A group larger than the capacity has a shard of its own, numbered after the others.
    """

    def plan(counts: dict[int, int]) -> list[Run]:
        runs = fill(sorted(((s, n) for s, n in counts.items() if s <= capacity), reverse=True), capacity)
        bins = 1 + max((r.bin for r in runs), default=-1)
        for size, n in sorted(counts.items()):
            if size > capacity:
                runs += [Run(size, i, 1, bins + i, 1, 0) for i in range(n)]
                bins += n
        return runs

    return _result(_place(docs, id_col, text_col, plan), id_col, "capacity")


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_evenly(table(spark, sf_dir, "documents"), 16)


SQL: dict[str, str] = {}
