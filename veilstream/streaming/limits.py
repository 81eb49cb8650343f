"""Request limits: a window anchored at the request that opens it, and nonces that count once.

A key's windows follow from its times alone: the next one opens at the first request that is a whole window later
than the last opening.  A pause as long as a window always ends it, so a key's history falls apart at such pauses,
and only the times between two of them meet in one row; requests themselves are only numbered.
"""

from __future__ import annotations

import hmac
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from veilstream.functions.small import hmac_sha256
from veilstream.streaming.state import keep_state

LATE = "10 minutes"
MOST_REQUESTS, WINDOW_SECONDS, NONCE_SECONDS, SKEW_SECONDS = 300, 60, 60, 60


def _openings(times: Column, window: int) -> Column:
    """Of ascending times those that open a window."""
    start = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast("array<bigint>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        opens = acc["last"].isNull() | (t - acc["last"] >= window)
        return F.when(opens, F.struct(t.alias("last"), F.concat(acc["out"], F.array(t)).alias("out"))).otherwise(acc)

    return F.aggregate(times, start, step)["out"]


def numbered(requests: DataFrame, key: str, at: str, order: str, seconds: float) -> DataFrame:
    """requests with _nth: the number of each within its key's window, from 1; null without a time."""
    window = round(seconds * 1_000_000)
    by_time = Window.partitionBy(key).orderBy("_at")
    rows = requests.withColumn("_at", F.unix_micros(F.col(at)))
    pause = F.coalesce(F.col("_at") - F.lag("_at").over(by_time) >= window, F.lit(True))
    rows = rows.withColumn("_run", F.sum(pause.cast("long")).over(by_time))
    times = rows.groupBy(F.col(key).alias("_key"), F.col("_run").alias("_in")).agg(F.array_sort(F.collect_set("_at")).alias("t"))
    opened = times.select("_key", "_in", F.explode(_openings(F.col("t"), window)).alias("_open"))
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("_run") == F.col("_in")) & (F.col("_at") == F.col("_open"))
    run = Window.partitionBy(key, "_run").orderBy("_at")
    placed = rows.join(opened, same, "left").withColumn("_opened", F.last("_open", ignorenulls=True).over(run))
    nth = F.row_number().over(Window.partitionBy(key, "_run", "_opened").orderBy("_at", order))
    return placed.withColumn("_nth", F.when(F.col("_at").isNotNull(), nth)).drop("_at", "_run", "_key", "_in", "_open", "_opened")


def limited(requests: DataFrame, key: str, at: str = "ts", order: str = "event_id", most: int = MOST_REQUESTS, seconds: float = WINDOW_SECONDS) -> DataFrame:
    """requests with allowed: whether it is among the first of its key's window.  A null key is a key, rows that repeat
    are requests of their own, and a request without a time has no verdict."""
    return numbered(requests, key, at, order, seconds).withColumn("allowed", F.col("_nth") <= most).drop("_nth")


def budget(state: tuple[float, int] | None, at: float, most: int, seconds: float) -> tuple[bool, tuple[float, int]]:
    """(allowed, new state); the state is the window's opening and the requests in it.  For streams."""
    opened, n = state if state is not None else (at, 0)
    if at - opened >= seconds:
        opened, n = at, 0
    return (n < most), (opened, n + (n < most))


class _Budget(StatefulProcessor):
    """The state of a key is its open window; a timer in event time ends it with the window."""

    def __init__(self, key: str, most: int, seconds: float):
        self.key, self.most, self.window = key, most, round(seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("window", "opened long, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["at", "event_id"])
        at = pdf["at"].to_numpy()
        allowed = np.zeros(len(at), bool)
        opened, n = self.held.get() if self.held.exists() else (None, 0)
        i = 0
        while i < len(at):  # window by window
            if opened is None or at[i] - opened >= self.window:
                opened, n = int(at[i]), 0
            end = int(np.searchsorted(at, opened + self.window))
            taken = min(self.most - n, end - i)
            allowed[i : i + taken] = True
            n, i = n + taken, end
        self.held.update((opened, n))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(-(-(opened + self.window) // 1000))
        yield pd.DataFrame({self.key: pd.Series([key[0]] * len(at), dtype=object), "event_id": pdf["event_id"].to_numpy(), "allowed": allowed})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        yield from ()

    def close(self) -> None:
        pass


def limited_stream(requests: DataFrame, key: str, most: int = MOST_REQUESTS, seconds: float = WINDOW_SECONDS, at: str = "ts", order: str = "event_id", late: str = LATE) -> DataFrame:
    """Streaming: key, event_id, allowed.  Requests of a key are taken in the order of their times within a micro-batch,
    and as they come from one to the next.  A key's state ends when the watermark passes its window: what comes
    afterwards opens a new one in any case, so verdicts are those of the batch form.  Requests that come later than
    ``late`` behind the newest have no verdict."""
    keep_state(requests.sparkSession)
    kind = dict(requests.dtypes)[key]
    timed = requests.withColumn("_ts", F.col(at)).withWatermark("_ts", late)
    slim = timed.select(key, F.col(order).cast("long").alias("event_id"), F.unix_micros("_ts").alias("at"), "_ts")
    return slim.groupBy(key).transformWithStateInPandas(_Budget(key, most, seconds), f"{key} {kind}, event_id long, allowed boolean", "append", "EventTime")


def first_uses_stream(requests: DataFrame, nonce: str = "nonce", at: str = "ts", order: str = "event_id", seconds: int = NONCE_SECONDS, late: str = LATE) -> DataFrame:
    """Streaming: nonce, event_id, fresh: as ``first_uses``; a nonce is forgotten when its time is over."""
    return limited_stream(requests, nonce, 1, seconds, at, order, late).withColumnRenamed("allowed", "fresh")


def first_uses(requests: DataFrame, nonce: str = "nonce", at: str = "ts", seconds: int = NONCE_SECONDS) -> DataFrame:
    """Per use of a nonce: its time, and fresh (no accepted use less than so many seconds before)."""
    return numbered(requests.select(nonce, at), nonce, at, at, seconds).select(nonce, at, (F.col("_nth") == 1).alias("fresh"))


def signature(ts: Column, nonce: Column, secret: bytes) -> Column:
    return hmac_sha256(F.concat(ts.cast("string"), F.lit("."), nonce), secret)


def _signed(secret: bytes, skew: int) -> Column:
    return F.coalesce((F.abs(F.col("now") - F.col("ts")) <= skew) & (signature(F.col("ts"), F.col("nonce"), secret) == F.col("signature")), F.lit(False))


def authorised_stream(requests: DataFrame, secret: bytes, skew: int = SKEW_SECONDS, seconds: int = NONCE_SECONDS, late: str = LATE) -> DataFrame:
    """Streaming: requests (id, ts, nonce, signature, now; seconds) to id, allowed, by the same three tests."""
    rows = requests.withColumn("_ok", _signed(secret, skew))
    good = rows.where("_ok").select("id", "nonce", F.timestamp_seconds("now").alias("at"))
    used = first_uses_stream(good, "nonce", "at", "id", seconds, late).select(F.col("event_id").alias("id"), F.col("fresh").alias("allowed"))
    return used.unionByName(rows.where("NOT _ok").select(F.col("id").cast("long").alias("id"), F.lit(False).alias("allowed")))


def authorised(requests: DataFrame, secret: bytes, skew: int = SKEW_SECONDS, seconds: int = NONCE_SECONDS) -> DataFrame:
    """requests (id, ts, nonce, signature, now; seconds) with allowed: not too old or early, rightly signed, and the
    nonce not used before.  Only requests that pass the first two tests use up their nonce."""
    rows = requests.withColumn("_ok", _signed(secret, skew))
    good = numbered(rows.where("_ok").withColumn("_now", F.timestamp_seconds("now")), "nonce", "_now", "id", seconds).withColumn("allowed", F.col("_nth") == 1).drop("_nth", "_now", "_ok")
    return good.unionByName(rows.where("NOT _ok").withColumn("allowed", F.lit(False)).drop("_ok"))


def is_signed(ts: int, nonce: str, given: str, secret: bytes, now: int) -> bool:
    """The same two tests for one request, in constant time."""
    right = hmac.new(secret, f"{ts}.{nonce}".encode(), "sha256").hexdigest()
    return abs(now - ts) <= SKEW_SECONDS and hmac.compare_digest(right, given)
