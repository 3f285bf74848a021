"""Per-host politeness: gaps between requests as a fold over their outcomes, for tables and for streams."""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.state import GroupStateTimeout

LEAST_MS, MOST_MS = 250, 30_000


#: Hosts of more requests than this are folded in pieces of time, so that a busy host is many tasks' work; there is one for
#: each so many rows at most, and their list is broadcast.
BUSY = 100_000
PIECE_MS = 3_600_000
#: No request yet: earlier than any time, and far enough from the least long to add gaps to.
NEVER = -(2**62)


def ladder() -> list[int]:
    """Every gap that can follow from the first one: a few dozen."""
    found = [LEAST_MS]
    for gap in found:
        found += [g for g in dict.fromkeys((min(2 * gap, MOST_MS), max(gap // 2, LEAST_MS))) if g not in found]
    return found


def _moves(requests: DataFrame, at: Column) -> DataFrame:
    """(host, at, id, move): move is 1 where the gap doubles, -1 where it halves, 0 where it stays."""
    s = F.col("status")
    move = F.when(s.isNull() | s.isin(403, 429, 503), 1).when(s.between(200, 299), -1).otherwise(0)
    return requests.select("host", at.alias("at"), F.col("id").cast("long").alias("id"), move.alias("move"))


def _by_load(rows: DataFrame, busy: int) -> tuple[DataFrame, DataFrame]:
    """Rows of hosts with at most `busy` rows, and of the others."""
    crowded = F.broadcast(rows.groupBy("host").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > busy).select(F.col("host").alias("crowded")))
    same = rows["host"].eqNullSafe(crowded["crowded"])
    return rows.join(crowded, same, "left_anti"), rows.join(crowded, same, "left_semi")


def _groups(batches, keys: list[str]):
    """(batch, columns, first row of each group, whether the first group goes on from the batch before) of sorted batches. A null
    time is NEVER."""
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = {n: batch.column(n) for n in batch.schema.names}
        new = np.zeros(batch.num_rows, bool)
        for key in keys:
            code = columns[key].dictionary_encode().indices.fill_null(-1).to_numpy()
            new[1:] |= code[1:] != code[:-1]
        first = tuple(columns[k][0].as_py() for k in keys)
        starts = np.flatnonzero(np.concatenate([[True], new[1:]]))
        numbers = {"at": columns["at"].fill_null(NEVER).to_numpy(), "move": columns["move"].to_numpy()}
        yield batch, numbers, starts, first == before
        before = tuple(columns[k][-1].as_py() for k in keys)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The gaps of the ladder, and for each move (halve, stay, double) the place that each gap goes to."""
    gaps = np.array(ladder(), dtype=np.int64)
    place = {g: i for i, g in enumerate(gaps.tolist())}
    to = [np.maximum(gaps // 2, LEAST_MS), gaps, np.minimum(2 * gaps, MOST_MS)]
    return gaps, np.array([[place[g] for g in x.tolist()] for x in to])


def _steps(starts: np.ndarray, n: int):
    """(groups, their rows) of the first, second, ... row of every group that has so many: groups go on side by side."""
    length = np.diff(np.append(starts, n))
    order = np.argsort(-length, kind="stable")
    left = length[order]
    for k in range(int(left[0])):
        own = order[: int(np.searchsorted(-left, -k, "left"))]
        yield own, starts[own] + k


def _folded(rows: DataFrame, schema: T.StructType, scheduled: bool) -> DataFrame:
    """Whole hosts, from the first gap on: (host, requests, gap_ms) of each, or (host, id, at_ms) of each request."""
    arrow = to_arrow_schema(schema)

    def run(batches):
        gaps, to = _tables()
        held = None  # host, place on the ladder, last time and number of requests of the host that may go on
        for batch, column, starts, goes_on in _groups(batches, ["host"]):
            at, move, n = column["at"], column["move"] + 1, batch.num_rows
            place, last, count = np.zeros(len(starts), "i8"), np.full(len(starts), NEVER), np.diff(np.append(starts, n))
            if goes_on:
                place[0], last[0], count[0] = held[1], held[2], count[0] + held[3]
            elif held and not scheduled:
                yield pa.RecordBatch.from_arrays([held[0], pa.array([held[3]]), pa.array(gaps[[held[1]]])], schema=arrow)
            when = np.empty(n, "i8")
            for own, rows in _steps(starts, n):
                last[own] = when[rows] = np.maximum(at[rows], last[own] + gaps[place[own]])
                place[own] = to[move[rows], place[own]]
            if scheduled:
                yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("id"), pa.array(when)], schema=arrow)
            elif len(starts) > 1:
                hosts = batch.column("host").take(pa.array(starts[:-1]))
                yield pa.RecordBatch.from_arrays([hosts, pa.array(count[:-1]), pa.array(gaps[place[:-1]])], schema=arrow)
            held = (batch.column("host").take(pa.array([n - 1])), int(place[-1]), int(last[-1]), int(count[-1]))
        if held and not scheduled:
            yield pa.RecordBatch.from_arrays([held[0], pa.array([held[3]]), pa.array(gaps[[held[1]]])], schema=arrow)

    return rows.repartition("host").sortWithinPartitions("host", "at", "id").mapInArrow(run, schema)


def _effects(pieces: DataFrame) -> DataFrame:
    """What a piece does to its host's state, whatever that is: for each gap on the ladder that it may begin with, the place of the
    gap after it, and the time of its last request as max(floor, time of the request before the piece + shift)."""
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([pieces.schema["host"], *[T.StructField(n, T.LongType()) for n in ("piece", "requests")], *[T.StructField(n, longs) for n in ("ends", "floors", "shifts")]])
    arrow = to_arrow_schema(schema)

    def run(batches):
        gaps, to = _tables()
        held = None

        def out(keys, count, ends, floors, shifts):
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel())) for x in (ends, floors, shifts)]
            return pa.RecordBatch.from_arrays([*keys, pa.array(count), *lists], schema=arrow)

        for batch, column, starts, goes_on in _groups(batches, ["host", "piece"]):
            at, move, n, many = column["at"], column["move"] + 1, batch.num_rows, len(starts)
            ends, floors, shifts = np.tile(np.arange(len(gaps)), (many, 1)), np.full((many, len(gaps)), NEVER), np.zeros((many, len(gaps)), "i8")
            count = np.diff(np.append(starts, n))
            if goes_on:
                ends[0], floors[0], shifts[0], count[0] = held[2][0], held[3][0], held[4][0], count[0] + held[1][0]
            elif held:
                yield out(*held)
            for own, rows in _steps(starts, n):
                gap = gaps[ends[own]]
                floors[own] = np.maximum(floors[own] + gap, at[rows][:, None])
                shifts[own] += gap
                ends[own] = to[move[rows][:, None], ends[own]]
            keys = [batch.column(k).take(pa.array(starts)) for k in ("host", "piece")]
            if many > 1:
                yield out([k.slice(0, many - 1) for k in keys], count[:-1], ends[:-1], floors[:-1], shifts[:-1])
            held = ([k.slice(many - 1) for k in keys], count[-1:], ends[-1:], floors[-1:], shifts[-1:])
        if held:
            yield out(*held)

    return pieces.repartition("host", "piece").sortWithinPartitions("host", "piece", "at", "id").mapInArrow(run, schema)


def _starts(rows):
    """Each piece's state before it and the gap after it, from the effects of its host's pieces in order."""
    gaps = ladder()
    for host, group in groupby(rows, key=lambda r: r["host"]):
        place, last, n = 0, NEVER, 0
        for r in group:
            n += r["requests"]
            yield {"host": host, "piece": r["piece"], "at": last, "place": place, "after": gaps[r["ends"][place]], "requests": n}
            place, last = r["ends"][place], max(r["floors"][place], last + r["shifts"][place])


def _states(pieces: DataFrame) -> DataFrame:
    """(host, piece, at, place, after, requests): one short row for each piece of a busy host."""
    schema = T.StructType([pieces.schema["host"], *[T.StructField(n, T.LongType()) for n in ("piece", "at", "place", "after", "requests")]])
    arrow = to_arrow_schema(schema)

    def run(batches):
        out = []
        for row in _starts(r for b in batches for r in b.to_pylist()):
            out.append(row)
            if len(out) == 10_000:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    return _effects(pieces).repartition("host").sortWithinPartitions("host", "piece").mapInArrow(run, schema)


def _in_pieces(rows: DataFrame, length: int) -> DataFrame:
    return rows.withColumn("piece", F.floor(F.col("at") / length).cast("long"))


def host_gaps(requests: DataFrame, piece_ms: int = PIECE_MS, busy: int = BUSY) -> DataFrame:
    """(host, requests, gap_ms) after all requests (host, ts, id, status) of a host in order of (ts, id).

    Hosts go on side by side, a request of each at a time, in arrays. A host of more than `busy` requests is cut into pieces of
    `piece_ms`: a piece's effect on any gap is known without the pieces before it, so only one short row a piece,
    never the requests of a busy host, meets in one task. Requests without a time come first.
    """
    calm, crowded = _by_load(_moves(requests, F.unix_micros(F.col("ts").cast("timestamp"))), busy)
    schema = T.StructType([calm.schema["host"], T.StructField("requests", T.LongType()), T.StructField("gap_ms", T.LongType())])
    last = F.max_by(F.struct("requests", "after"), F.coalesce("piece", F.lit(NEVER)))
    cut = _states(_in_pieces(crowded, 1000 * piece_ms)).groupBy("host").agg(last.alias("x")).select("host", "x.requests", F.col("x.after").alias("gap_ms"))
    return _folded(calm, schema, False).union(cut)


def _placed(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Times of the requests of pieces, whose first row is the state before the piece (a place on the ladder, the last time)."""
    arrow = to_arrow_schema(schema)

    def run(batches):
        gaps, to = _tables()
        held = (0, NEVER)
        for batch, column, starts, goes_on in _groups(batches, ["host", "piece"]):
            at, move, n = column["at"], column["move"] + 1, batch.num_rows
            mark = batch.column("place").is_valid().to_numpy(zero_copy_only=False)
            begins = batch.column("place").fill_null(0).to_numpy()
            place, last, when = np.zeros(len(starts), "i8"), np.full(len(starts), NEVER), np.empty(n, "i8")
            if goes_on:
                place[0], last[0] = held
            for own, rows in _steps(starts, n):
                first = mark[rows]
                last[own] = when[rows] = np.where(first, at[rows], np.maximum(at[rows], last[own] + gaps[place[own]]))
                place[own] = np.where(first, begins[rows], to[move[rows], place[own]])
            held = (int(place[-1]), int(last[-1]))
            asked = pa.array(~mark)
            yield pa.RecordBatch.from_arrays([batch.column("host").filter(asked), batch.column("id").filter(asked), pa.array(when[~mark])], schema=arrow)

    return rows.repartition("host", "piece").sortWithinPartitions("host", "piece", "asked", "at", "id").mapInArrow(run, schema)


def host_schedule(requests: DataFrame, piece_ms: int = PIECE_MS, busy: int = BUSY) -> DataFrame:
    """(host, id, at_ms): when each request (host, id, arrival ms, status) may go: the first at once, others a gap after the last.

    As host_gaps; for busy hosts a second sweep gives each piece its times from the state before it. Requests without an
    arrival are never scheduled.
    """
    calm, crowded = _by_load(_moves(requests.where("arrival is not null"), F.col("arrival").cast("long")), busy)
    schema = T.StructType([calm.schema["host"], T.StructField("id", T.LongType()), T.StructField("at_ms", T.LongType())])
    pieces, none = _in_pieces(crowded, piece_ms), F.lit(None).cast("long")
    # a piece's state sorts before its requests
    marks = _states(pieces).select("host", "at", none.alias("id"), F.lit(0).alias("move"), "piece", "place", F.lit(0).alias("asked"))
    rows = pieces.withColumn("place", none).withColumn("asked", F.lit(1)).unionByName(marks)
    return _folded(calm, schema, True).union(_placed(rows, schema))


def stream_gaps(requests: DataFrame) -> DataFrame:
    """The same on a stream (host, status): (host, requests, gap_ms) after every batch, state kept per host."""

    def update(key, frames, state):
        gap, n = state.get if state.exists else (LEAST_MS, 0)
        for frame in frames:
            for s in frame["status"]:
                slow = pd.isna(s) or int(s) in (403, 429, 503)
                gap = min(2 * gap, MOST_MS) if slow else max(gap // 2, LEAST_MS) if 200 <= int(s) < 300 else gap
                n += 1
        state.update((gap, n))
        yield pd.DataFrame({"host": [key[0]], "requests": [n], "gap_ms": [gap]})

    return requests.groupBy("host").applyInPandasWithState(update, "host string, requests long, gap_ms long", "gap long, n long", "update", GroupStateTimeout.NoTimeout)


def idle_sessions(events: DataFrame, key: str, at: str, gap: str = "10 minutes") -> DataFrame:
    """Sessions of `key` that end after `gap` without an event; works on tables and, with a watermark on `at`, on streams."""
    return events.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count(F.lit(1)).alias("events")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def recycled(renders: DataFrame, every: int = 200) -> DataFrame:
    """Adds `worker`: the number of the worker that renders (key, at, id) in turn, each good for `every` renders."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("key").orderBy("at", "id"))
    return renders.withColumn("worker", F.ceil(n / every).cast("long"))


def restart_delays(exits: DataFrame, first_ms: int = 500, most_ms: int = 30_000) -> DataFrame:
    """Crashes of workers (key, at, id, crashed) with the wait before the restart: doubled from crash to crash, anew after a clean exit."""
    from pyspark.sql import Window

    by_key = Window.partitionBy("key").orderBy("at", "id")
    spells = exits.withColumn("spell", F.count_if(~F.col("crashed")).over(by_key)).where("crashed")
    n = F.row_number().over(Window.partitionBy("key", "spell").orderBy("at", "id"))
    most = (most_ms // first_ms).bit_length()  # doublings that reach the cap
    wait = F.least(F.lit(first_ms) * F.pow(F.lit(2), F.least(n - 1, F.lit(most))).cast("long"), F.lit(most_ms))
    return spells.select("key", "id", wait.cast("long").alias("wait_ms"))


def stream_cache(fetches: DataFrame, watermark: str = "1 day") -> DataFrame:
    """One cache entry per URL of a stream (url, at, ...) within the watermark; later ones are dropped as already cached."""
    return fetches.withWatermark("at", watermark).dropDuplicatesWithinWatermark(["url"])


def hourly_indexes(probes: DataFrame) -> DataFrame:
    """One index probe per host and hour (host, at): the first; tumbling windows, for tables and streams."""
    return probes.groupBy("host", F.window("at", "1 hour").alias("w")).agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("asked")).select("host", "at", "asked")
