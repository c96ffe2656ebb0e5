"""Queries that run streams to their end over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.plans.tables import table
from ledgerloom.streaming import events


def _stream(s, d):
    return events.event_stream(s, d, table(s, d, "events").schema, "events.parquet")


def str_event_windows(s, d):
    """Events per day and type; complete mode gives every window."""
    out = events.drained(s, events.tumbling(_stream(s, d)), "complete")
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.col("value").cast("double").alias("value"))


def str_user_sessions(s, d):
    out = events.drained(s, events.user_sessions(_stream(s, d)), "complete")
    return out.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("began"), "n")


def str_first_deliveries(s, d):
    out = events.drained(s, events.first_deliveries(_stream(s, d).select("event_id", "ts", "event_type")))
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (str_event_windows, str_user_sessions, str_first_deliveries)}
SQL = {
    "str_event_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, sum(value::DECIMAL(18,2))::DOUBLE AS value FROM events GROUP BY 1, 2",
    "str_user_sessions": "WITH g AS (SELECT *, coalesce(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE, true) AS new FROM events), n AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, min(ts) AS began, count(*) AS n FROM n GROUP BY user_id, k",
    "str_first_deliveries": "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1",
}
