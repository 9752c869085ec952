"""Queries over events, as batches and as a stream run to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.plans.registry import ORACLE, QUERIES, query
from corvane.streaming import events as E

_TUMBLING = "SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS window_start, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') + INTERVAL '6 hours' AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3"


@query("events_tumbling", _TUMBLING)
def events_tumbling(t):
    return E.windowed(E.with_event_time(t("events")), "6 hours")


@query("events_sliding", "SELECT s AS window_start, s + INTERVAL '2 hours' AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') - k * INTERVAL '1 hour' AS s FROM events, (VALUES (0), (1)) AS o(k)) GROUP BY 1, 2, 3")
def events_sliding(t):
    return E.windowed(E.with_event_time(t("events")), "2 hours", "1 hour")


@query("events_session", "WITH x AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events), y AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x) SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL '30 minutes' AS window_end, count(*) AS n FROM y GROUP BY user_id, s")
def events_session(t):
    return E.sessions(E.with_event_time(t("events")), "30 minutes")


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tumbling windows computed by a stream with a watermark."""
    return E.run_to_table(E.windowed(E.with_event_time(E.read_stream(spark, f"{sf_dir}/events*.parquet"), late="1 day"), "6 hours"))


def events_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event once within the watermark, as appended by a stream."""
    s = E.with_event_time(E.read_stream(spark, f"{sf_dir}/events*.parquet"), late="1 day")
    return E.run_to_table(E.without_repeats(s, "event_id").select("event_id", "user_id", "event_type"), "append").select("event_id", "user_id", "event_type")


QUERIES["events_stream"] = events_stream
ORACLE["events_stream"] = _TUMBLING
QUERIES["events_late"] = events_late
ORACLE["events_late"] = "SELECT DISTINCT event_id, user_id, event_type FROM events"
