"""Streams whose rows come out of order: schedules, cache expiry and host memos with state that ends.

Rows wait in state until the watermark has passed them, and are then folded in order of (time, id) as the batch functions
do. What is older than the watermark when it arrives is left out, as in every stream with a watermark. State ends by
event-time timers: a host that no one asks is forgotten, a cache entry goes at its expiry. Sessions need the RocksDB state
store (`prepare`).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from webloom.streaming.politeness import LEAST_MS, MOST_MS

#: A host without requests for so long is forgotten: its next request is the first one again.
FORGET_MS = 7 * 86_400_000
#: Timers are set on a grid of so many milliseconds, so that a shard has few of them; those that only let states end on a coarser one.
GRID_MS, SWEEP_MS = 1000, 3_600_000
#: Keys are dealt into so many shards by a hash. A stream keeps their number for as long as it goes on.
SHARDS = 1024
#: Rows of a block of the state, and of what comes out at a time.
BLOCK_ROWS = 10_000


def prepare(spark: SparkSession) -> None:
    """The state store that keyed state with timers needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _packed(columns: dict) -> bytes:
    """Columns as the bytes that a state holds: one value for thousands of rows, where a state of rows pickles each."""
    batch, out = pa.record_batch(columns), pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as stream:
        stream.write_batch(batch)
    return out.getvalue().to_pybytes()


def _unpacked(block: bytes) -> pa.Table:
    return pa.ipc.open_stream(bytes(block)).read_all()


class Ordered(StatefulProcessor):
    """Folds each key's rows (at, id, value) in order once the watermark has passed them. A subclass says what a key's state is, how
    a row changes it, what comes out, and when it ends.

    Spark's key is a shard, which holds many keys: each call and each value of the state store then serves thousands of rows.
    """

    #: Names of a key's state, and of the columns that come out besides the key, the id and the time.
    fields: list[str] = []
    out: list[str] = []

    def first(self) -> tuple:
        """The state of a key that nothing is known of."""
        raise NotImplementedError

    def step(self, state: tuple, at: int, value) -> tuple[tuple, tuple]:
        """(state after, values that come out) of a row."""
        raise NotImplementedError

    def ends(self, state: tuple) -> int:
        """The time from which a state without further rows is as good as none."""
        raise NotImplementedError

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "block binary")
        self.states = handle.getValueState("states", "block binary")
        #: Time of the earliest row that waits, which a timer is set for, and the earliest end of a state.
        self.next = handle.getValueState("next", "due long, ends long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        due, ends = self.next.get() or (None, None)
        least = due
        for frame in rows:
            at = pa.array(frame["at"], pa.int64(), from_pandas=True)
            value = pa.array(frame["value"], pa.int64(), from_pandas=True)
            self.waiting.appendValue((_packed({"key": pa.array(frame["key"]), "at": at, "id": pa.array(frame["id"], pa.int64(), from_pandas=True), "value": value}),))
            first = pc.min(at).as_py()
            least = first if least is None else min(least, first)
        if least != due:
            self.next.update((least, ends))
            self.handle.registerTimer(self._grid(least))
        return iter(())

    @staticmethod
    def _grid(at: int, step: int = GRID_MS) -> int:
        return -(-(at + 1) // step) * step

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        due, ends = self.next.get() or (None, None)
        if (due is None or due >= now) and (ends is None or ends > now):
            return
        held = self.states.get()
        states = {k: tuple(state) for k, *state in zip(*_unpacked(held[0]).to_pydict().values(), strict=True)} if held else {}
        if due is not None and due < now:
            waiting = pa.concat_tables([_unpacked(block) for (block,) in self.waiting.get()])
            early = pc.less(waiting["at"], now)
            ready, left = waiting.filter(early).sort_by([(c, "ascending") for c in ("key", "at", "id")]), waiting.filter(pc.invert(early))
            del waiting
            self.waiting.clear()
            for batch in left.combine_chunks().to_batches(BLOCK_ROWS):
                self.waiting.appendValue((_packed(dict(zip(batch.schema.names, batch.columns, strict=True))),))
            due = pc.min(left["at"]).as_py()
            for batch in ready.combine_chunks().to_batches(BLOCK_ROWS):
                yield self._fold(states, batch.to_pydict())
        states = {k: state for k, state in states.items() if self.ends(state) > now}
        ends = min(map(self.ends, states.values()), default=None)
        if states:
            self.states.update((_packed({"key": list(states), **dict(zip(self.fields, zip(*states.values(), strict=True), strict=True))}),))
            self.handle.registerTimer(self._grid(ends, SWEEP_MS))
        else:
            self.states.clear()
        if due is not None:
            self.handle.registerTimer(self._grid(due))
        self.next.update((due, ends))

    def _fold(self, states: dict, rows: dict) -> pd.DataFrame:
        """What comes out of rows in order of (key, at, id); `states` has each key's state afterwards."""
        found = []
        for k, at, value in zip(rows["key"], rows["at"], rows["value"], strict=True):
            state = states.get(k)
            if state is None or self.ends(state) <= at:
                state = self.first()
            states[k], values = self.step(state, at, value)
            found.append(values)
        return pd.DataFrame({"key": rows["key"], "id": rows["id"], "at": rows["at"], **dict(zip(self.out, zip(*found, strict=True), strict=True))})

    def close(self) -> None:
        pass


class Schedule(Ordered):
    """When each request may go, and the gap after it; see politeness.host_schedule."""

    fields, out = ["gap", "last", "known", "n"], ["at_ms", "gap_ms", "requests"]

    def __init__(self, forget_ms: int):
        self.forget_ms = forget_ms

    def first(self):
        return LEAST_MS, 0, False, 0

    def step(self, state, at, value):
        gap, last, known, n = state
        last = max(at, last + gap) if known else at
        gap = min(2 * gap, MOST_MS) if value is None or value in (403, 429, 503) else max(gap // 2, LEAST_MS) if 200 <= value < 300 else gap
        return (gap, last, True, n + 1), (last, gap, n + 1)

    def ends(self, state):
        return state[1] + self.forget_ms


class Expiring(Ordered):
    """Whether each ask is answered by what an earlier one fetched: a fetch holds for its own time to live, and the first ask after
    that fetches again."""

    fields, out = ["expires"], ["cached"]

    def first(self):
        return (None,)

    def step(self, state, at, value):
        if state[0] is not None and state[0] >= at:
            return state, (True,)
        return (at + value,), (False,)

    def ends(self, state):
        return -1 if state[0] is None else state[0] + 1


def _folded(rows: DataFrame, key: str, at: str, late: str, processor: Ordered, out: str) -> DataFrame:
    """rows: (key, at timestamp, id, value) with a watermark of `late`. A shard's waiting rows and states are in memory of a task at a time."""
    kind = rows.schema[key].dataType.simpleString()
    asked = rows.withWatermark(at, late).select(F.col(key).alias("key"), F.col(at).alias("event"), F.unix_millis(at).alias("at"), "id", "value").where("at is not null and key is not null")
    asked = asked.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(SHARDS)))
    made = asked.groupBy("shard").transformWithStateInPandas(processor, f"key {kind}, id long, at long, {out}", "Append", "eventTime")
    return made.withColumnRenamed("key", key)


def stream_schedule(requests: DataFrame, late: str = "10 minutes", forget_ms: int = FORGET_MS) -> DataFrame:
    """(host, id, at, at_ms, gap_ms, requests) of a stream of requests (host, arrival timestamp, id, status): when each may go, the
    host's gap after it and its number; the same as politeness.host_schedule and host_gaps over all of them.

    Requests that come more than `late` after younger ones may be left out; so are those without host or arrival. A host's
    requests wait for as long as `late` says, and its state ends `forget_ms` after its last request.
    """
    rows = requests.select("host", "arrival", F.col("id").cast("long").alias("id"), F.col("status").cast("int").alias("value"))
    return _folded(rows, "host", "arrival", late, Schedule(forget_ms), "at_ms long, gap_ms long, requests long")


def stream_asks(asks: DataFrame, key: str, ttl_ms, late: str = "10 minutes") -> DataFrame:
    """(key, id, at, cached) of a stream of asks (key, at timestamp, id): whether each is answered by an earlier fetch that still
    holds. ttl_ms (a Column) is how long what an ask fetches would hold. For the URL cache the key is the URL; for memos of hosts
    and their indexes it is the host."""
    rows = asks.select(key, F.col("at").alias("event_at"), F.col("id").cast("long").alias("id"), ttl_ms.cast("long").alias("value"))
    return _folded(rows, key, "event_at", late, Expiring(), "cached boolean")


def replayed_asks(asks: DataFrame, key: str, ttl_ms) -> DataFrame:
    """The same over a table, (key, at timestamp, id): each key's asks in order of (at, id), one pass over sorted rows."""
    kind = asks.schema[key].dataType.simpleString()
    rows = asks.select(F.col(key).alias("key"), F.unix_millis("at").alias("at"), F.col("id").cast("long").alias("id"), ttl_ms.cast("long").alias("ttl")).where("at is not null and key is not null")

    def run(batches):
        own, expires = None, None
        for batch in batches:
            cached = []
            for k, at, ttl in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3)), strict=True):
                if k != own:
                    own, expires = k, None
                cached.append(expires is not None and expires >= at)
                if not cached[-1]:
                    expires = at + ttl
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(1), pa.array(cached, pa.bool_())], names=["key", "id", "at", "cached"])

    found = rows.repartition("key").sortWithinPartitions("key", "at", "id").mapInArrow(run, f"key {kind}, id long, at long, cached boolean")
    return found.withColumnRenamed("key", key)
