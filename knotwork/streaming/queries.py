"""Batch forms of the stream aggregates, for comparison with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from knotwork.session import table
from knotwork.streaming.ingest import deduplicated, sessions, windowed


def queries() -> dict:
    events = lambda s, d: table(s, d, "events")
    return {
        "events_hourly": lambda s, d: windowed(events(s, d)),
        "events_sliding": lambda s, d: windowed(events(s, d), "2 hours", "1 hour"),
        "event_sessions": lambda s, d: sessions(events(s, d)),
        "events_once": lambda s, d: deduplicated(events(s, d).union(events(s, d))).select("event_id", "event_type"),
        "event_properties": lambda s, d: events(s, d).select("event_id", F.from_json("props", "k int")["k"].alias("k")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "events_hourly": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
        "events_sliding": "SELECT start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT event_type, value, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS start FROM events) GROUP BY 1, 2",
        "event_sessions": "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, g",
        "events_once": "SELECT DISTINCT event_id, event_type FROM events",
        "event_properties": "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events",
    }
