"""Queries of event-time streams over the driver's events, and SQL of what they must give."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .queries import table
from .streaming import windows

#: Days of event time that arrive together, and the days by which every tenth event is late.
DAYS, DELAYED = 8, 5


def _arrivals(spark: SparkSession, sf_dir: str, delayed: int) -> list[DataFrame]:
    """The events in the order of their arrival, some days at a time."""
    events = table(spark, sf_dir, "events")
    first = events.agg(F.to_date(F.min("ts"))).first()[0]
    day = F.date_diff(F.to_date("ts"), F.lit(first)) + F.when(F.col("event_id") % 10 == 0, delayed).otherwise(0)
    dealt = events.withColumn("arrival", F.floor(day / DAYS))
    last = dealt.agg(F.max("arrival")).first()[0]
    return [dealt.where(F.col("arrival") == k).drop("arrival") for k in range((last if last is not None else -1) + 1)]


def _told(counted: DataFrame, key: str) -> DataFrame:
    return counted.select(key, F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


def late_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type in windows of twelve hours, as a stream counts them when every tenth event is five days late."""
    return _told(windows.replayed(spark, _arrivals(spark, sf_dir, DELAYED), lambda s: windows.window_counts(s, "event_type")), "event_type")


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' sessions that have ended, as a stream finds them over several restarts."""
    return _told(windows.replayed(spark, _arrivals(spark, sf_dir, 0), lambda s: windows.user_sessions(s, "user_id")), "user_id")


LATE_WINDOWS_SQL = f"""
WITH f AS (SELECT CAST(min(ts) AS DATE) AS first FROM events),
a AS (SELECT ts, event_type, CAST(floor((CAST(ts AS DATE) - first + CASE WHEN event_id % 10 = 0 THEN {DELAYED} ELSE 0 END) / {DAYS}) AS BIGINT) AS arrival, time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '2000-01-01') AS start FROM events, f),
m AS (SELECT arrival, max(max(ts)) OVER (ORDER BY arrival) - INTERVAL 1 DAY AS mark FROM a GROUP BY arrival),
k AS (SELECT a.*, (SELECT max(mark) FROM m WHERE m.arrival < a.arrival) AS mark FROM a)
SELECT epoch_us(start) AS start_us, epoch_us(start + INTERVAL 12 HOUR) AS end_us, event_type, count(*) AS n FROM k WHERE mark IS NULL OR start + INTERVAL 12 HOUR > mark GROUP BY start, event_type HAVING start + INTERVAL 12 HOUR <= (SELECT max(mark) FROM m)
"""
USER_SESSIONS_SQL = """
WITH o AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 6 HOUR, true) AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM o)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 6 HOUR) AS end_us, count(*) AS n FROM s GROUP BY user_id, session HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"late_windows": late_windows, "user_sessions": user_sessions}
ORACLES: dict[str, str] = {"late_windows": LATE_WINDOWS_SQL, "user_sessions": USER_SESSIONS_SQL}
