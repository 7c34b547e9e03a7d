from pyspark.sql import functions as F

from rankstead.streaming.rollup import windowed_summary, write_increments


def test_stream_equals_batch_for_finished_windows(spark, tmp_path, data):
    src = spark.read.parquet(f"{data}/events.parquet")
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    args = ("ts", "1 day", ["event_type"], "value", "1 hour")
    batch = windowed_summary(src, *args, where=F.col("value") > 10)
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = write_increments(windowed_summary(stream, *args, where=F.col("value") > 10), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    done = spark.read.parquet(str(tmp_path / "out"))
    key = lambda r: (str(r["window_start"]), r["event_type"])
    got, want = {key(r): (r["n"], r["n_true"]) for r in done.collect()}, {key(r): (r["n"], r["n_true"]) for r in batch.collect()}
    assert got and all(want[k] == v for k, v in got.items())
