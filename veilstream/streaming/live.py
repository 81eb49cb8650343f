"""Running counters and event-time rollups over a stream (or a table) of audit events, and sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstream.operators.asof import as_of

LATE = "10 minutes"


def live_requests(events: DataFrame) -> DataFrame:
    """Counts by event type and action; use output mode complete or update."""
    return events.groupBy("event_type", "action_taken").agg(F.count("*").alias("requests"))


def hourly(events: DataFrame, at: str = "timestamp", late: str = LATE) -> DataFrame:
    """Events and findings by tenant and hour of event time; late ones are dropped beyond the watermark."""
    base = events.withWatermark(at, late) if events.isStreaming else events
    by = base.groupBy("tenant_id", F.window(at, "1 hour").alias("w")).agg(F.count("*").alias("events"), F.sum("finding_count").cast("long").alias("findings"))
    return by.select("tenant_id", F.col("w.start").alias("hour"), "events", "findings")


def sessions(events: DataFrame, user: str = "user_identity", at: str = "timestamp", gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    """Events by user and session: runs without a pause as long as the gap."""
    base = events.withWatermark(at, late) if events.isStreaming else events
    by = base.groupBy(user, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("events"))
    return by.select(user, F.col("w.start").alias("opened"), "events")


def tool_calls(calls: DataFrame, session: str = "session", at: str = "ts", seconds: int = 60, most: int = 20) -> DataFrame:
    """Calls by session and window, and whether they are more than allowed."""
    by = calls.groupBy(session, F.window(at, f"{seconds} seconds").alias("w")).agg(F.count("*").alias("calls"))
    return by.select(session, F.col("w.start").alias("opened"), "calls", (F.col("calls") > most).alias("over"))


def with_policy(events: DataFrame, versions: DataFrame) -> DataFrame:
    """Events with the latest version of a policy table (version, ...): one row, so it is broadcast."""
    latest = versions.orderBy(F.col("version").desc()).limit(1)
    return events.crossJoin(F.broadcast(latest.select(F.struct("*").alias("policy"))))


def with_policy_in_force(stream: DataFrame, versions: Callable[[], DataFrame], send: Callable[[DataFrame, int], None], checkpoint: str, at: str, since: str, order: str, keys: list[str]):
    """A stream's events beside the policy version in force at their own time (see ``as_of``); send gets each micro-batch.

    versions is called for each micro-batch, so that versions that were added meanwhile count from then on, and an event
    keeps to the version of its time however late it comes.
    """
    return stream.writeStream.foreachBatch(lambda batch, n: send(as_of(batch, versions(), at, since, order, keys), n)).option("checkpointLocation", checkpoint)


def forward(stream: DataFrame, send: Callable[[DataFrame, int], None], checkpoint: str):
    """A sink hook: send gets each micro-batch and its number."""
    return stream.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint)
