"""Request quotas as stateful streams, and their batch counterparts.

An hourly limit per client slides: a request that was let in counts for 3600 seconds, the last of them included. A daily
budget is charged only by requests that finish.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR, PER_HOUR, DAY_CAP = 3600, 3, 150


def admit(times: list[float], now: float, limit: int = PER_HOUR, span: float = HOUR) -> tuple[bool, list[float]]:
    """Whether a request is let in, and the times that still count. Refused requests don't count."""
    kept = [t for t in times if now - t <= span]
    return (True, [*kept, now]) if len(kept) < limit else (False, kept)


def admitted_batch(requests: DataFrame, client: str = "client", at: str = "ts", key: str = "request_id", limit: int = PER_HOUR, span: int = HOUR) -> DataFrame:
    """Requests with `allowed`, client by client in time order: the stateful semantics on a finished table.

    A client's requests are a sequence, so they pass through one task, but as a stream: batches of sorted rows go by, and
    only the at most `limit` times that still count are carried on.
    """
    kinds = {c: requests.schema[c].dataType.simpleString() for c in (client, key)}
    rows = requests.select(F.col(client).alias("client"), F.col(at).cast("timestamp").cast("double").alias("t"), F.col(key).alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, times = object(), []
        for b in batches:
            allowed = []
            for c, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if c != who:
                    who, times = c, []
                ok, times = admit(times, t, limit, span)
                allowed.append(ok)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(allowed, pa.bool_())], names=[client, key, "allowed"])

    return rows.repartition("client").sortWithinPartitions("client", "t", "key").mapInArrow(run, f"`{client}` {kinds[client]}, `{key}` {kinds[key]}, allowed boolean")


def arrivals_in_hour(requests: DataFrame, client: str = "client", at: str = "ts", span: int = HOUR) -> DataFrame:
    """Requests with n_before: arrivals of the client in the hour before, whether let in or not, in whole seconds."""
    w = Window.partitionBy(client).orderBy(F.col(at).cast("timestamp").cast("long")).rangeBetween(-span, -1)
    return requests.withColumn("n_before", F.count(F.lit(1)).over(w))


def daily_usage(requests: DataFrame, calls: Column, done: Column, at: str = "ts", cap: int = DAY_CAP) -> DataFrame:
    """day (UTC), n_requests, used, over_cap: only finished requests are charged."""
    day = F.date_format(F.col(at), "yyyy-MM-dd").alias("day")
    return requests.groupBy(day).agg(F.count(F.lit(1)).alias("n_requests"), F.coalesce(F.sum(F.when(done, calls)), F.lit(0)).cast("long").alias("used")).withColumn("over_cap", F.col("used") > cap)


def reserve(used: int, estimate: int, cap: int = DAY_CAP) -> bool:
    """Whether a request that may need `estimate` calls fits into what is left of the day."""
    return used + estimate <= cap


class Slots:
    """At most `limit` requests at a time in this process; one more is refused, not queued."""

    def __init__(self, limit: int = 2):
        self.free = threading.BoundedSemaphore(limit)

    @contextmanager
    def take(self) -> Iterator[bool]:
        """Whether a slot was free; it is given back in any case."""
        got = self.free.acquire(blocking=False)
        try:
            yield got
        finally:
            if got:
                self.free.release()


def limit_stream(requests: DataFrame, client: str = "client", at: str = "ts", key: str = "request_id", limit: int = PER_HOUR, span: int = HOUR, watermark: str = "1 hour") -> DataFrame:
    """A stream of requests with `allowed`. State per client is the times that still count; it is dropped once event time has
    passed the last of them, so clients that went away cost nothing."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kinds = {c: requests.schema[c].dataType.simpleString() for c in (client, key)}

    def step(who: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values([at, key])
        out = []
        for t, k in zip(rows[at], rows[key], strict=True):
            ok, times = admit(times, t.timestamp(), limit, span)
            out.append((who[0], k, ok))
        state.update((times,))
        last = max([*times, rows[at].max().timestamp()])
        state.setTimeoutTimestamp(int(max((last + span) * 1000, state.getCurrentWatermarkMs() + 1)))
        yield pd.DataFrame(out, columns=[client, key, "allowed"])

    watched = requests.withWatermark(at, watermark)
    return watched.groupBy(client).applyInPandasWithState(step, f"`{client}` {kinds[client]}, `{key}` {kinds[key]}, allowed boolean", "times array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def reserve_stream(events: DataFrame, at: str = "ts", key: str = "request_id", cap: int = DAY_CAP, watermark: str = "1 hour") -> DataFrame:
    """Reservations and their ends with `granted` and `used`, by UTC day, as a stateful stream that survives restarts.

    events has kind (`reserve`, `commit` or `release`), a key and calls. A reservation is granted if used and reserved calls and its
    own fit into the day's cap; a commit charges what was really called and ends the reservation, a release ends it
    without a charge. What follows no granted reservation changes nothing. A day's state is its used calls and its open
    reservations; it is dropped once event time has passed the day.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kind = events.schema[key].dataType.simpleString()

    def step(day: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        used, open_ = (state.get[0], json.loads(state.get[1])) if state.exists else (0, {})
        rows, out = pd.concat(list(frames)), []
        for _, r in rows.sort_values([at, key, "kind"]).iterrows():
            used, open_, granted = settle(used, open_, r["kind"], str(r[key]), int(r["calls"]), cap)
            out.append((day[0], r[key], r["kind"], granted, used))
        state.update((used, json.dumps(open_)))
        end = int((pd.Timestamp(day[0]) + pd.Timedelta(days=1)).timestamp() * 1000)
        state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["day", key, "kind", "granted", "used"])

    watched = events.withWatermark(at, watermark).withColumn("day", F.date_format(at, "yyyy-MM-dd"))
    return watched.groupBy("day").applyInPandasWithState(step, f"day string, `{key}` {kind}, kind string, granted boolean, used long", "used long, open string", "append", GroupStateTimeout.EventTimeTimeout)


def settle(used: int, open_: dict[str, int], kind: str, key: str, calls: int, cap: int = DAY_CAP) -> tuple[int, dict[str, int], bool | None]:
    """Used calls and open reservations after an event, and whether a reservation was granted (null for its end)."""
    if kind == "reserve":
        ok = key not in open_ and reserve(used + sum(open_.values()), calls, cap)
        return used, {**open_, key: calls} if ok else open_, ok
    if key in open_:
        open_ = {k: n for k, n in open_.items() if k != key}
        used += calls if kind == "commit" else 0
    return used, open_, None


def daily_stream(requests: DataFrame, at: str = "ts", watermark: str = "1 hour") -> DataFrame:
    """A stream of (day, used): calls of finished requests by UTC day. requests has calls and done."""
    day = F.window(at, "1 day")
    return requests.withWatermark(at, watermark).where("done").groupBy(day).agg(F.sum("calls").alias("used")).select(F.col("window.start").alias("day"), "used")
