"""A dashboard's session list, kept up to date from a stream of tab rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from webloom.operators import registry
from webloom.sources.store import KeyedTable

TABS, COUNTS = "agent_id {0}, id {1}, status string, at long", "agent_id {0}, tabs long, ready long"


class SessionBoard:
    """Counts of tabs by agent that follow a stream of tab rows (id, agent_id, status, at), the latest of each tab counting.

    Tabs lie in buckets of their agent. A batch rewrites the buckets of its agents and counts these anew, so that a batch
    that is run again after a failure gives the same, and one that touches few agents reads and writes little. A tab's
    rows must all have one agent.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, agent_type: str = "string", tab_type: str = "string"):
        schema = lambda ddl: StructType.fromDDL(ddl.format(agent_type, tab_type))
        self.tabs = KeyedTable(spark, f"{path}/tabs", schema(TABS), "agent_id", buckets)
        self.counts = KeyedTable(spark, f"{path}/counts", schema(COUNTS), "agent_id", buckets)

    def update(self, batch: DataFrame, batch_id: int | None = None) -> None:
        """One micro-batch, for foreachBatch."""
        latest = lambda old, new: old.unionByName(new.select(*old.columns)).groupBy("agent_id", "id").agg(F.max(F.struct("at", "status")).alias("x")).select("agent_id", "id", "x.status", "x.at")
        touched = self.tabs.change(batch, latest)
        if touched:
            own = self.tabs._all().where(F.col("bucket").isin(touched)).groupBy("agent_id").agg(F.count(F.lit(1)).alias("tabs"), F.count_if(F.col("status") == "ready").alias("ready"))
            self.counts.change(own, lambda old, new: new)

    def sessions(self, agents: DataFrame) -> DataFrame:
        """registry.session_list as of the last batch."""
        return registry.session_list_of(agents, self.counts.read())


def follow(board: SessionBoard, tabs: DataFrame, checkpoint: str, every: str | None = "1 second"):
    """Starts the query that keeps `board` up to date: every so often, or once over what there is if `every` is None."""
    writer = tabs.writeStream.foreachBatch(board.update).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=every).start() if every else writer.trigger(availableNow=True).start()
