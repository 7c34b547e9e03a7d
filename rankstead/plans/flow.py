"""Queries of the windowed summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankstead.streaming.rollup import windowed_summary


def events_by_day(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    out = windowed_summary(e, "ts", "1 day", ["event_type"], "value", late="1 hour", where=F.col("value") > 10)
    return out.withColumn("day", F.date_format("window_start", "yyyy-MM-dd")).withColumns({c: F.round(c, 4) for c in ("total", "least", "most")}).drop("window_start")


QUERIES = {"events_by_day": events_by_day}
SQL = {
    "events_by_day": """SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(min(value), 4) AS least, round(max(value), 4) AS most,
        count(*) FILTER (WHERE value > 10) AS n_true, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day FROM events GROUP BY event_type, date_trunc('day', ts)""",
}
