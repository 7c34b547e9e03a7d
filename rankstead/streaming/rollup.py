"""Windowed summaries that run on a stream (with a watermark) as on a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def windowed_summary(df: DataFrame, time: str, window: str, group: list[str], value: str, late: str | None = None, slide: str | None = None, where: Column | None = None) -> DataFrame:
    """Per time window and group: ``window_start``, ``n``, ``total``, ``least``, ``most`` and ``n_true`` rows where ``where`` holds.

    On a stream, ``late`` bounds how long a window waits for late rows, and with it the state that is kept. On a table it
    has no effect. Null times fall in no window.
    """
    timed = df.withColumn("_time", F.col(time).cast("timestamp"))
    timed = timed.withWatermark("_time", late) if late and df.isStreaming else timed
    flag = F.coalesce(where, F.lit(False)) if where is not None else F.lit(False)
    w = F.window("_time", window, slide) if slide else F.window("_time", window)
    out = timed.groupBy(w.alias("w"), *group).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"), F.sum(flag.cast("bigint")).alias("n_true")
    )
    return out.select(F.col("w.start").alias("window_start"), *group, "n", "total", "least", "most", "n_true")


def write_increments(summary: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append finished windows to a parquet folder, exactly once, and stop when all present input is read."""
    return summary.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
