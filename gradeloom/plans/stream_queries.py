"""Queries over the event table: windowed aggregation, an extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gradeloom.plans import roles
from gradeloom.plans.registry import query
from gradeloom.streaming import events


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY ALL")
def tumbling_counts(spark: SparkSession, d: str) -> DataFrame:
    return events.tumbling(roles.table(spark, d, "events"))


@query(
    """SELECT start, event_type, count(*) AS n FROM (
  SELECT event_type, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS start FROM events) GROUP BY ALL"""
)
def sliding_counts(spark: SparkSession, d: str) -> DataFrame:
    return events.sliding(roles.table(spark, d, "events"))


@query(
    """WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS n FROM n GROUP BY user_id, k"""
)
def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    return events.sessions(roles.table(spark, d, "events"))
