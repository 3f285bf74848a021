"""Pieces that the training-data operators share: checkpoints, copy groups and ranks that no single task computes."""

from __future__ import annotations

import math
import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark's own reader so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a local session gets a temporary one; on a cluster that is
    an error, since executors don't share the driver's folders."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[[^-]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="webloom-ckpt-"))
    return sc.getCheckpointDir()


def free_name(df: DataFrame, name: str) -> str:
    """`name` with as many underscores before it as make it differ from every column's, letter case aside."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_width(spark: SparkSession) -> int:
    """Partitions of a shuffle in this session; widths below are derived from it so that they grow with the cluster."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def merge_copies(rows: DataFrame, keys: list[str], first: str, fan_in: int = 8) -> DataFrame:
    """Adds `keep` (smallest `first` of the rows equal in `keys`) and `group_size` to every row of `rows`.

    `rows` must be checkpointed and carry an int column `run`; the first of `keys` is a binary digest. Each input
    partition combines its rows into a run, sorted by digest. In every round `fan_in` neighbouring runs (three binomial
    steps at once) are sent to where they meet and merged in order of their digests; only what is equal in all of `keys`
    merges, and the smallest `first` is retained. A run lies in lanes, ranges of the digest, so a merge has as many tasks
    as lanes even where one run is left, and its pieces in order of lane are the sorted run.
    The result then goes back down the same tree, so a key that holds a third of all rows never meets in one task:
    at most `fan_in` rows a key in each merge, and the rows of one run in the last join.
    """
    runs = 1 + (rows.agg(F.max("run")).first()[0] or 0)
    at, lane = free_name(rows, "lane"), _lane(F.col(keys[0]), shuffle_width(rows.sparkSession))
    order = ["run", at, *keys]
    level = rows.withColumn(at, lane).groupBy(*order).agg(F.min(first).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    levels = []
    while True:
        levels.append(level.drop(at))
        if runs <= 1:
            break
        runs = math.ceil(runs / fan_in)
        met = level.withColumn("run", F.expr(f"cast(run div {fan_in} as int)")).repartition("run", at).sortWithinPartitions(*order)
        level = met.groupBy(*order).agg(F.min("keep").alias("keep"), F.sum("group_size").alias("group_size"))
    down = levels.pop()
    while levels:
        up = levels.pop().select(*keys, F.col("run").alias("own"), F.expr(f"cast(run div {fan_in} as int)").alias("run"))
        down = up.join(down, [*keys, "run"]).select(*keys, F.col("own").alias("run"), "keep", "group_size")
    return rows.join(down, [*keys, "run"])


def _lane(digest: Column, lanes: int) -> Column:
    """Which of `lanes` equal ranges a digest falls into, by its first four bytes."""
    head = F.conv(F.hex(F.substring(digest, 1, 4)), 16, 10).cast("long")
    return F.floor(head * lanes / 2**32).cast("int")


def run_of(spark: SparkSession, fan_in: int = 8) -> Column:
    """The run that an input partition feeds; as many as the shuffle is wide, rounded up to a power of the fan-in."""
    width = fan_in ** max(1, math.ceil(math.log(shuffle_width(spark), fan_in)))
    return F.pmod(F.spark_partition_id(), F.lit(width)).cast("int")


def ranked(rows: DataFrame, group: str, uid: str, order: list[str], out: str) -> DataFrame:
    """Adds `out`: a gapless number from 0 within each `group`, without one task for a group.

    `rows` must be checkpointed. Each group is cut into lanes by a hash of `uid`; rows are numbered within a lane and
    lanes are offset by the counts of the lanes before. A lane holds 1/lanes of a group, however large that is.
    """
    lanes = 2 * shuffle_width(rows.sparkSession)
    dealt = rows.withColumn("lane", F.pmod(F.xxhash64(uid), F.lit(lanes)).cast("int"))
    before = Window.partitionBy(group).orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy(group, "lane")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(group, "lane", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("lane_start"))
    )
    within = Window.partitionBy(group, "lane").orderBy(*order, uid)
    numbered = dealt.withColumn("in_lane", F.row_number().over(within) - 1)
    return numbered.join(starts, [group, "lane"]).withColumn(out, F.col("lane_start") + F.col("in_lane")).drop("lane", "lane_start", "in_lane")
