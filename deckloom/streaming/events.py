"""Event-time operators that run on static and streaming tables alike, and keyed state machines."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: (cap, seconds) of the limiter.
CAP, WINDOW_S = 5, 3600
#: A breaker opens after so many failures in a row, for so many seconds.
TRIP_AFTER, RETRY_AFTER_S = 4, 900
SESSION_GAP = "30 minutes"


def _timed(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str, late: str | None = None) -> DataFrame:
    """Count and sum by window and kind. ``late``: how long a stream waits for late events."""
    events = _timed(events)
    if late:
        events = events.withWatermark("ts", late)
    grouped = events.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.bround(F.sum("value"), 2).alias("total"))
    return grouped.select(F.col("w.start").alias("started"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = SESSION_GAP, late: str | None = None) -> DataFrame:
    """A user's events without a pause of ``gap``: start and count."""
    events = _timed(events)
    if late:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("started"), "n")


def view_counts(events: DataFrame) -> DataFrame:
    """Views by token (here: user): a running count that a stream updates."""
    return events.where("event_type = 'view'").groupBy("user_id").agg(F.count(F.lit(1)).alias("views"))


def limited(times: list[float], log: deque, cap: int = CAP, window: float = WINDOW_S) -> list[bool]:
    """Which hits a sliding log lets through, in order. Refused hits are not logged; ``log`` is the state."""
    passed = []
    for now in times:
        while log and log[0] < now - window:
            log.popleft()
        passed.append(len(log) < cap)
        if passed[-1]:
            log.append(now)
    return passed


def rate_limited(events: DataFrame, cap: int = CAP, window: float = WINDOW_S) -> DataFrame:
    """(event_id, user_id, accepted): the limiter over each user's events in order.

    Whether a hit passes depends on which passed before, so a user's events are folded in turn; a group is one user's log.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["t", "event_id"])
        return pd.DataFrame({"event_id": rows["event_id"], "user_id": rows["user_id"], "accepted": limited(rows["t"].tolist(), deque(), cap, window)})

    timed = _timed(events).select("event_id", "user_id", (F.unix_micros("ts") / 1e6).alias("t"))
    return timed.groupBy("user_id").applyInPandas(fold, "event_id long, user_id long, accepted boolean")


def rate_limited_stream(events: DataFrame, cap: int = CAP, window: float = WINDOW_S) -> DataFrame:
    """The same on a stream: the state of a user is the times of the hits that passed within the window."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        log = deque(state.get[0] if state.exists else ())
        rows = pd.concat(list(batches)).sort_values(["t", "event_id"])
        accepted = limited(rows["t"].tolist(), log, cap, window)
        state.update((list(log),))
        yield pd.DataFrame({"event_id": rows["event_id"], "user_id": rows["user_id"], "accepted": accepted})

    timed = _timed(events).select("event_id", "user_id", (F.unix_micros("ts") / 1e6).alias("t"))
    return timed.groupBy("user_id").applyInPandasWithState(fold, "event_id long, user_id long, accepted boolean", "times array<double>", "append", "NoTimeout")


def breaker(events: DataFrame, trip: int = TRIP_AFTER, retry: float = RETRY_AFTER_S) -> DataFrame:
    """(event_id, user_id, is_open): a circuit breaker by user over its events; ``error`` is a failure, anything else a success.

    It opens after ``trip`` failures in a row; while it is open calls are not made and change nothing; after ``retry`` seconds the next
    one is made again.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["t", "event_id"])
        streak, tripped, out = 0, 0.0, []
        for t, kind in zip(rows["t"], rows["event_type"], strict=True):
            if streak >= trip and t - tripped > retry:
                streak = 0
            out.append(streak >= trip)
            if not out[-1]:
                streak = streak + 1 if kind == "error" else 0
                tripped = t if streak >= trip else tripped
        return pd.DataFrame({"event_id": rows["event_id"], "user_id": rows["user_id"], "is_open": out})

    timed = _timed(events).select("event_id", "user_id", "event_type", (F.unix_micros("ts") / 1e6).alias("t"))
    return timed.groupBy("user_id").applyInPandas(fold, "event_id long, user_id long, is_open boolean")


def paced(events: DataFrame, pause: float = 4.2) -> DataFrame:
    """(user_id, n, delay): by how much a user's last call is late if each waits ``pause`` seconds after the start of the one before. The last of n starts at the largest of t_k + (n - 1 - k) * pause, so the
    calls are numbered by a window and the rest is a maximum."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = _timed(events).select("user_id", (F.unix_micros("ts") / 1e6).alias("t"), (F.row_number().over(order) - 1).alias("k"))
    found = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("t").alias("last"), F.max(F.col("t") - F.col("k") * pause).alias("lead"))
    return found.select("user_id", "n", F.bround(F.col("lead") + (F.col("n") - 1) * pause - F.col("last"), 3).alias("delay"))
