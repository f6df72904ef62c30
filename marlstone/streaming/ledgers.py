"""Structured Streaming forms: daily counters, latest versions, reservations under a daily cap."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def daily_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", late: str | None = "2 days") -> DataFrame:
    """day, kind, runs, units: tumbling UTC days; a day is emitted in append mode once the
    watermark has passed it; ``late`` is None for a stream that has one already."""
    day = F.window(time, "1 day").alias("w")
    timed = events if late is None else events.withWatermark(time, late)
    counted = timed.groupBy(day, kind).agg(F.count(F.lit(1)).alias("runs"), F.sum("value").alias("units"))
    return counted.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), kind, "runs", "units")


def deduplicated(events: DataFrame, key: str = "event_id", time: str = "ts", late: str = "2 days") -> DataFrame:
    """The first event of each key; keys are forgotten behind the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


RESERVED = "day string, run string, asked bigint, granted boolean, left bigint"


def reservations(requests: DataFrame, run_cap: int, day_cap: int, late: str | None = None) -> DataFrame:
    """day, run, asked, granted, left of requests (day, seq, run, asked, actual).

    A request reserves its upper bound if it is within the cap of a run and of
    what the day has left; one with ``actual`` settles the run instead, giving
    back (or taking) the difference, never below zero. The state of a day is its
    sum and the open runs' bounds, which settling removes.

    With ``late`` days are dates (yyyy-MM-dd, UTC), and requests that long behind the newest day are dropped: a
    day's state ends once the stream has passed it, so only so many days are held as ``late`` spans. Days that are no dates have
    no end, and are dropped. Without ``late`` every day is kept.
    """
    forget = late is not None

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        used, names, bounds = state.get if state.exists else (0, [], [])
        open_ = dict(zip(names, bounds))
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        out = []
        for run, asked, actual in zip(rows["run"], rows["asked"], rows["actual"]):
            if not pd.isna(actual):
                if run in open_:
                    used = max(0, used + int(actual) - open_.pop(run))
                continue
            asked = int(asked)
            granted = asked <= run_cap and used + asked <= day_cap
            if granted:
                used += asked
                open_[run] = open_.get(run, 0) + asked
            out.append((key[0], run, asked, granted, day_cap - used))
        state.update((used, list(open_), list(open_.values())))
        if forget:  # when no request of the day can come any more
            state.setTimeoutTimestamp(max(int(rows["_at"].iloc[0].timestamp() * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["day", "run", "asked", "granted", "left"])

    if forget:
        requests = requests.withColumn("_at", F.try_to_timestamp("day", F.lit("yyyy-MM-dd"))).filter("_at IS NOT NULL").withWatermark("_at", late)
    timeout = GroupStateTimeout.EventTimeTimeout if forget else GroupStateTimeout.NoTimeout
    return requests.groupBy("day").applyInPandasWithState(step, RESERVED, "used bigint, runs array<string>, bounds array<bigint>", "append", timeout)
