"""Queries that read the events as a stream, up to its end. Only what lies behind the watermark is final, so the last rows' windows are open still."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import views
from ..streaming import streams

LATE_MS = 6 * 3_600_000
LATE = f"{LATE_MS} milliseconds"


def _events(spark, sf_dir) -> DataFrame:
    schema = views.read(spark, sf_dir, "events").schema
    # As a pattern: a stream takes a plain path for a folder, and the table may be one file.
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def stream_event_rate(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("source", F.col("event_type"))
    out = streams.gathered(streams.event_rate(e, "1 hour", LATE), "rates")
    return out.select("source", F.unix_micros("start").alias("start_us"), "n", F.round("per_second", 9).alias("per_second"))


def stream_sessions(spark, sf_dir):
    """Runs of a user's events less than six hours apart."""
    e = _events(spark, sf_dir).select(F.col("user_id").alias("check_id"), "ts", F.col("value").alias("magnitude"), (F.col("value") >= 100).alias("tradeable"))
    out = streams.gathered(streams.violation_sessions(e, LATE), "sessions")
    return out.select(F.col("check_id").alias("user_id"), F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"), "seen", "peak", "tradeable")


QUERIES = {f.__name__: f for f in (stream_event_rate, stream_sessions)}

_MARK = f"wm AS (SELECT (max(epoch_us(ts)) // 1000 - {LATE_MS}) * 1000 AS mark FROM events)"
ORACLE_SQL = {
    "stream_event_rate": f"WITH {_MARK}, h AS (SELECT event_type AS source, epoch_us(ts) // 3600000000 * 3600000000 AS start_us, count(*) AS n FROM events GROUP BY ALL) SELECT source, start_us, n, round(n / 3600, 9) AS per_second FROM h CROSS JOIN wm WHERE start_us + 3600000000 <= mark",
    "stream_sessions": f"""WITH {_MARK}, a AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < {LATE_MS * 1000} THEN 0 ELSE 1 END AS fresh FROM events), b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM a),
      s AS (SELECT user_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS seen, max(value) AS peak, bool_or(value >= 100) AS tradeable FROM b GROUP BY user_id, k) SELECT user_id, first_us, last_us, seen, peak, tradeable FROM s CROSS JOIN wm WHERE last_us + {LATE_MS * 1000} <= mark""",
}
