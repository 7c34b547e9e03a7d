"""Per-key results under extreme key skew, by value-frequency compression.

Rows are first grouped by (key, value), which combines map-side and turns a hot key into its distinct values, each with
a weight. Everything per key is then derived from these weighted values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankstead.operators.skew import running_totals


def compress_values(df: DataFrame, key: str, value: str | Column, flags: dict[str, Column] | None = None) -> DataFrame:
    """One row per (key, value): ``key``, ``value``, ``weight`` (rows) and, for each flag, the rows where it is true.

    Nulls in key or value form values of their own; a null flag counts as false. Empty input gives an empty result.
    Columns of ``df`` other than those named are not read.
    """
    v = F.col(value) if isinstance(value, str) else value
    flags = flags or {}
    marks = [F.coalesce(c.cast("boolean"), F.lit(False)).cast("bigint").alias(f"_f{i}") for i, c in enumerate(flags.values())]
    slim = df.select(F.col(key).alias("_key"), v.alias("_value"), *marks)
    sums = [F.sum(f"_f{i}").alias(n) for i, n in enumerate(flags)]
    return slim.groupBy("_key", "_value").agg(F.count(F.lit(1)).alias("weight"), *sums).withColumnsRenamed({"_key": "key", "_value": "value"})


def per_key_summary(compressed: DataFrame, flags: list[str] = ()) -> DataFrame:
    """Per key: rows, the flag sums, exact distinct non-null values, and the mode (most rows; ties: least value).

    All four are algebraic over the compressed rows, so Spark combines them map-side: a key with any number of distinct
    values reaches the reducer as one partial row per map task. The null key is a group like any other.
    """
    mode = F.min_by("value", F.struct(F.col("value").isNull(), -F.col("weight"), F.col("value")))
    return compressed.groupBy("key").agg(
        F.sum("weight").alias("n_rows"),
        *[F.sum(f).alias(f) for f in flags],
        F.count("value").alias("n_distinct"),
        mode.alias("mode_value"),
    )


def per_key_percentiles(compressed: DataFrame, shares: list[float]) -> DataFrame:
    """Exact percentiles per key (linear interpolation) of a numeric value: ``key``, ``p0``, ``p1`` ... in order of ``shares``.

    The weighted values are range-sorted over the cluster and numbered by running weight. Each of them sees from its own
    interval of ranks, and its key's total, whether it stands at a wanted rank, so nothing is joined and a key's values
    are gathered nowhere. Null values are left out; keys with no value
    have no row.
    """
    known = compressed.filter(F.col("value").isNotNull()).select("key", "value", "weight")
    ran = running_totals(known, ["key"], ["value"], {"upto": F.col("weight")}, {"n": F.col("weight")})
    first = F.col("upto") - F.col("weight")
    aggs, parts = [], []
    for i, share in enumerate(shares):
        at = F.lit(float(share)) * (F.col("n") - 1)
        stands = lambda r, first=first: (r >= first) & (r < F.col("upto"))
        aggs += [F.max(F.when(stands(F.floor(at)), F.col("value"))).alias(f"_a{i}"), F.max(F.when(stands(F.ceil(at)), F.col("value"))).alias(f"_b{i}")]
        parts.append((F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * (at - F.floor(at))).alias(f"p{i}"))
    return ran.groupBy("key").agg(F.first("n").alias("n"), *aggs).select("key", *parts)


def heavy_keys(compressed: DataFrame, share: float) -> DataFrame:
    """Keys (non-null) that hold at least ``share`` of the rows with a key: ``key``, ``n_rows``, ``n_all``.

    At most ``1 / share`` rows. The total is taken from the per-key sums, one row per key.
    """
    sums = compressed.filter(F.col("key").isNotNull()).groupBy("key").agg(F.sum("weight").alias("n_rows"))
    total = sums.agg(F.sum("n_rows").alias("n_all")).scalar()
    return sums.withColumn("n_all", total).filter(F.col("n_rows") >= F.lit(share) * F.col("n_all"))
