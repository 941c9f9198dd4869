"""Request limits on the event table, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrylens.operators.rates import aligned_windows, anchored_windows
from quarrylens.session import load
from quarrylens.streaming import rates as stream_rates


def rate_windows(spark: SparkSession, d: str) -> DataFrame:
    """One request a day for each user and kind of event."""
    return aligned_windows(load(spark, d, "events"), ["user_id", "event_type"], 86_400, 1)


def rate_rejects(spark: SparkSession, d: str) -> DataFrame:
    return rate_windows(spark, d).groupBy("event_type", "window_start").agg(
        F.count("*").alias("n_requests"), F.count_if("rejected").alias("n_rejected"))


def anchored_rates(spark: SparkSession, d: str) -> DataFrame:
    """At most two events in 12 hours from a user's first."""
    return anchored_windows(load(spark, d, "events"), "user_id", 43_200, 2)


def stream_window_counts(spark: SparkSession, d: str) -> DataFrame:
    counts = stream_rates.window_counts(stream_rates.event_stream(spark, d), ["event_type"], "1 day", "1 hour")
    return stream_rates.drain(counts).select("event_type", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n_requests")


def stream_anchored_rates(spark: SparkSession, d: str) -> DataFrame:
    return stream_rates.drain(stream_rates.anchored_limits(stream_rates.event_stream(spark, d), "user_id", 43_200, 2))


QUERIES = {f.__name__: f for f in (rate_windows, rate_rejects, anchored_rates, stream_window_counts, stream_anchored_rates)}

_W = """WITH w AS (SELECT event_id, user_id, event_type, ts, time_bucket(INTERVAL 1 DAY, ts) AS window_start,
row_number() OVER (PARTITION BY user_id, event_type, time_bucket(INTERVAL 1 DAY, ts) ORDER BY ts, event_id) AS request_no FROM events WHERE ts IS NOT NULL)
"""

_ANCHORED = """WITH RECURSIVE e AS (SELECT event_id, CAST(user_id AS VARCHAR) AS key, epoch_us(ts) AS us,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM events WHERE ts IS NOT NULL),
f(key, no, event_id, ends, used, rejected) AS (
  SELECT key, no, event_id, us + 43200000000, 1, false FROM e WHERE no = 1
  UNION ALL SELECT e.key, e.no, e.event_id, CASE WHEN f.ends <= e.us THEN e.us + 43200000000 ELSE f.ends END,
    CASE WHEN f.ends <= e.us THEN 1 WHEN f.used >= 2 THEN f.used ELSE f.used + 1 END, f.ends > e.us AND f.used >= 2
  FROM f JOIN e ON e.key IS NOT DISTINCT FROM f.key AND e.no = f.no + 1)
SELECT event_id, key, rejected FROM f"""

ORACLE = {
    "anchored_rates": _ANCHORED,
    "stream_anchored_rates": _ANCHORED,
    "rate_windows": _W + """SELECT event_id, user_id, event_type, ts, window_start, request_no, request_no > 1 AS rejected,
CAST(greatest(ceil((epoch_us(window_start) + 86400000000 - epoch_us(ts)) / 1000000.0), 1) AS BIGINT) AS retry_after FROM w""",
    "rate_rejects": _W + """SELECT event_type, window_start, count(*) AS n_requests, count(*) FILTER (WHERE request_no > 1) AS n_rejected FROM w GROUP BY 1, 2""",
    "stream_window_counts": """SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(*) AS n_requests FROM events WHERE ts IS NOT NULL
GROUP BY 1, 2 HAVING time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
}
