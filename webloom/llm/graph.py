"""Connected components whose hubs no single task holds."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import checkpointed

#: Edges that one task turns into a forest.
FOREST_ROWS = 1_000_000
#: A key that more rows look up is looked up by broadcast, unless that made a list of more than so many keys.
HOT_ROWS = 100_000
HOT_KEYS = 200_000


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges a[i] - b[i], sorted, and for each the smallest node that it is connected to."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(i):
        x, y = label[i], label[j]
        open_ = x != y
        if not open_.any():
            break
        i, j, x, y = i[open_], j[open_], x[open_], y[open_]
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (label[label] != label).any():
            label = label[label]
    return nodes, nodes[label]


def forest(edges: DataFrame) -> DataFrame:
    """Edges (a: smallest node, b) that connect in each partition what its edges do, one for each other node."""

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            node, root = roots(*(np.concatenate([b.column(c).to_numpy() for b in held]) for c in (0, 1)))
            out = node != root
            yield pa.RecordBatch.from_arrays([pa.array(root[out]), pa.array(node[out])], names=["a", "b"])

    return edges.mapInArrow(run, "a long, b long")


def looked_up(rows: DataFrame, n: int, key: str, values: DataFrame, how: str = "inner", hot_rows: int | None = None) -> DataFrame:
    """rows (checkpointed, n of them) joined ("inner" or "left") to values, which has each `key` at most once. Keys of many rows
    take their value from a broadcast, so that they don't meet in one task; there are at most n / hot_rows of them, and never
    more than HOT_KEYS."""
    least = max(hot_rows or HOT_ROWS, math.ceil(n / HOT_KEYS))
    if n <= least:
        return rows.join(values, key, how)
    hot = checkpointed(rows.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > least).select(key))
    if not hot.limit(1).count():
        return rows.join(values, key, how)
    few = hot.join(values, key, how)
    rest = rows.join(F.broadcast(hot), key, "left_anti").join(values, key, how)
    return rest.unionByName(rows.join(F.broadcast(few), key).select(*rest.columns))


def components(edges: DataFrame, forest_rows: int = FOREST_ROWS, hot_rows: int | None = None) -> DataFrame:
    """(id, comp) of every id in `edges` (a, b; checkpointed, a <> b): comp is the smallest id reachable.

    Any split of the edges may be reduced to forests, so they are dealt evenly to tasks of forest_rows edges, again while
    that halves them. If more than one task's worth is left, labels spread along it and jump to their label's label:
    rounds grow with the logarithm of a chain's length, and lineage is cut after each. No edges give no rows.
    """
    n = edges.count()
    while n > forest_rows:
        edges = checkpointed(forest(edges.repartition(-(-n // forest_rows))))
        before, n = n, edges.count()
        if n > before / 2:
            break
    if n <= forest_rows:
        star = checkpointed(forest(edges.repartition(1)))
        return star.select(F.col("b").alias("id"), F.col("a").alias("comp")).union(star.select("a", F.col("a").alias("comp")).distinct())
    both = checkpointed(edges.union(edges.select("b", "a")).distinct())
    m = both.count()
    labels = checkpointed(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("comp")))
    nodes = labels.count()
    while True:
        near = looked_up(both, m, "b", labels.select(F.col("id").alias("b"), "comp"), hot_rows=hot_rows).groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near"))
        step = checkpointed(labels.join(near, "id").select("id", F.least("comp", "near").alias("next"), F.col("comp").alias("old")))
        step = looked_up(step, nodes, "next", labels.select(F.col("id").alias("next"), F.col("comp").alias("further")), hot_rows=hot_rows)
        step = checkpointed(step.select("id", F.least("next", "further").alias("comp"), "old"))
        labels = step.select("id", "comp")
        if not step.where("comp <> old").limit(1).count():
            return labels
