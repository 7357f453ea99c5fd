"""Sessions of activity that end after a silence, and what is too old to go on with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: how long a session lives without activity.
IDLE = "24 hours"


def sessions(events: DataFrame, by: str, ts: str = "ts", idle: str = IDLE, late: str = "1 hour") -> DataFrame:
    """by, first_ts, last_ts and n of each session: activity of one key with no silence of `idle` or more.

    On a stream the state of a session is its window and count. It is kept until the watermark, the latest time
    less `late`, has passed the end of the silence; then the session expires, is emitted once, and its state is dropped.
    """
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    found = rows.where(F.col(ts).isNotNull()).groupBy(by, F.session_window(ts, idle).alias("w")).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("n"))
    return found.select(by, "first_ts", "last_ts", "n")


def stale(last: Column, now: Column, idle: str = IDLE) -> Column:
    """Whether a session last active then is over: more than `idle` ago. One that was never active is."""
    return F.coalesce(last < now - F.expr(f"interval {idle}"), F.lit(True))
