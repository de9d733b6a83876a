"""Streaming queries over the events and the inbox; each has the batch result as its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotmill.runtime import new_path
from plotmill.streaming import ingest


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.file_stream(spark, f"{sf}/events.parquet").withColumn("at", F.col("ts").cast("timestamp"))


def _bounds(df: DataFrame, column: str) -> DataFrame:
    w = F.col(column)
    return df.select(w.start.cast("timestamp_ntz").alias("from"), w.end.cast("timestamp_ntz").alias("to"), *[c for c in df.columns if c != column])


def stream_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    """Events and their value per day and type."""
    s = ingest.tumbling(_events(spark, sf), "at", "1 day", ["event_type"], [F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value")])
    return _bounds(ingest.run_available(s, "complete"), "window")


TUMBLING_SQL = "SELECT time_bucket(INTERVAL 1 DAY, ts) AS \"from\", time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS \"to\", event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL"


def stream_sliding(spark: SparkSession, sf: str) -> DataFrame:
    """Events per window of a day, every twelve hours."""
    s = ingest.sliding(_events(spark, sf), "at", "1 day", "12 hours", [], [F.count(F.lit(1)).alias("n")])
    return _bounds(ingest.run_available(s, "complete"), "window")


SLIDING_SQL = "SELECT w AS \"from\", w + INTERVAL 1 DAY AS \"to\", count(*) AS n FROM (SELECT unnest([date_trunc('day', ts) + CASE WHEN hour(ts) >= 12 THEN INTERVAL 12 HOUR ELSE INTERVAL 0 HOUR END, date_trunc('day', ts) + CASE WHEN hour(ts) >= 12 THEN INTERVAL 0 HOUR ELSE INTERVAL (-12) HOUR END]) AS w FROM events) GROUP BY 1"


def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of users: events less than six hours apart."""
    s = ingest.sessions(_events(spark, sf), "at", "6 hours", ["user_id"], [F.count(F.lit(1)).alias("n")])
    return _bounds(ingest.run_available(s, "complete"), "session_window")


SESSIONS_SQL = "SELECT min(ts) AS \"from\", max(ts) + INTERVAL 6 HOUR AS \"to\", user_id, count(*) AS n FROM (SELECT *, sum(CASE WHEN ts < before + INTERVAL 6 HOUR THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)) GROUP BY user_id, s"


def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Canonical addresses of the inbox, each once, by a stream that appends what its table hasn't got."""
    path = new_path(spark, "stream-table")
    inbox = ingest.file_stream(spark, f"{sf}/scan_inbox.parquet").select("entry_id", "batch_no", "url")
    ingest.run_available(inbox, handler=ingest.ingest_into(path, ["batch_no", "entry_id"]))
    return spark.read.schema("entry_id bigint, batch_no int, url string").parquet(path).select("entry_id", "url")


DEDUP_SQL = "SELECT entry_id, url FROM scan_inbox QUALIFY row_number() OVER (PARTITION BY split_part(split_part(url, '#', 1), '?', 1) ORDER BY batch_no, entry_id) = 1"


def stream_static_join(spark: SparkSession, sf: str) -> DataFrame:
    """A stream of inbox rows joined to the reports that exist for their address."""
    inbox = ingest.file_stream(spark, f"{sf}/scan_inbox.parquet").select("entry_id", "url")
    reports = spark.read.parquet(f"{sf}/reports.parquet").where("url <> '' and deleted_on is null").groupBy("url").agg(F.count(F.lit(1)).alias("n_reports"))
    return ingest.run_available(inbox.join(reports, "url").select("entry_id", "n_reports"))


STATIC_SQL = "SELECT entry_id, n_reports FROM scan_inbox JOIN (SELECT url, count(*) AS n_reports FROM reports WHERE url <> '' AND deleted_on IS NULL GROUP BY 1) USING (url)"


def stream_alarm(spark: SparkSession, sf: str) -> DataFrame:
    """Days with fewer than 25 history rows: the outcome alarm."""
    h = ingest.file_stream(spark, f"{sf}/scan_history.parquet").select(F.col("first_seen").cast("timestamp").alias("at"))
    days = ingest.run_available(ingest.tumbling(h, "at", "1 day", [], [F.count(F.lit(1)).alias("n")]), "complete")
    return _bounds(days, "window").where("n < 25").select(F.col("from").cast("date").alias("day"), "n")


ALARM_SQL = "SELECT first_seen AS day, count(*) AS n FROM scan_history WHERE first_seen IS NOT NULL GROUP BY 1 HAVING count(*) < 25"

QUERIES = {f.__name__: f for f in (stream_tumbling, stream_sliding, stream_sessions, stream_dedup, stream_static_join, stream_alarm)}
ORACLES = dict(zip(QUERIES, (TUMBLING_SQL, SLIDING_SQL, SESSIONS_SQL, DEDUP_SQL, STATIC_SQL, ALARM_SQL), strict=True))
