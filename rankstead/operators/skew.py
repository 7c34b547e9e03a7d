"""Building blocks that keep one hot key from landing in one task.

* :func:`cut_lineage` materialises a frame in the cluster's shared checkpoint folder.
* :func:`lookup_skew_safe` joins rows to a table with unique keys although a key may hold a third of the rows.
* :func:`running_totals` and :func:`positions_within` sum and number rows inside groups of any size, by a range sort and
  per-partition offsets.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A key with at least this share of the rows is hot, so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 1e-3
#: Bytes of hot rows that are broadcast at most.
HOT_BYTES = 64 << 20
#: Bytes of input for each task of a range sort, and the most tasks.
BYTES_PER_TASK, MOST_TASKS = 256 << 20, 50_000


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``.

    Where none is named, a temporary one will do on a single machine (tests); on a cluster this raises ``ValueError``,
    because executors must all see the folder.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="rankstead-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table to the shared checkpoint folder and return a frame that reads it from there.

    A columnar table takes a fraction of what checkpointed rows take and its size is known to the optimiser. Lost
    executors cost only the tasks they ran. Tables are deleted when the driver ends.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def tasks_for(df: DataFrame) -> int:
    """Tasks for a range sort of ``df``: the session's shuffle partitions, or more if its inputs are large."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leaves, size = df._jdf.queryExecution().optimizedPlan().collectLeaves(), 0
    for i in range(leaves.size()):
        own = int(str(leaves.apply(i).stats().sizeInBytes()))
        size += own if own < 1 << 60 else 0  # what has no size says the largest number there is
    return max(least, min(size // BYTES_PER_TASK, MOST_TASKS))


def _row_bytes(df: DataFrame) -> Column:
    def one(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType | T.BinaryType):
            return F.coalesce(F.octet_length(c), F.lit(0)) + 8
        if isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType):
            return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 8
        return F.lit(8)

    return sum((one(f) for f in df.schema.fields), F.lit(0)).cast("bigint")


def lookup_skew_safe(
    rows: DataFrame, table: DataFrame, keys: list[str], weight: str, how: str = "inner", hot_share: float = HOT_SHARE
) -> DataFrame:
    """Join ``rows`` with ``table``, which has one row per key and says in ``weight`` how many rows bear the key.

    Keys whose weight reaches ``hot_share`` of the total are at most ``1 / hot_share`` in number whatever the size of
    the data; only these are broadcast, and only if the widest rows of the table could not exceed ``HOT_BYTES``, else they
    are joined by a shuffle whose skewed partitions are split at run time. All other keys go through an ordinary shuffled
    join, in which none can hold more than ``hot_share`` of the weight. ``weight`` is not part of the result. ``how`` is
    ``inner`` or ``left``. Rows with a null key match nothing and take no part in a shuffle. Keys missing from ``table``
    are taken to be rare: tables made from the rows themselves lack only keys that stand alone. ``rows`` and ``table`` are
    read several times: pass scans or frames from :func:`cut_lineage`.
    """
    first = table.agg(F.sum(weight).alias("t"), F.max(_row_bytes(table)).alias("b")).first()
    hot_rows = max(float(first["t"] or 0) * hot_share, 2.0)
    hot = table.filter(F.col(weight) >= hot_rows).drop(weight)
    if (first["b"] or 0) / hot_share <= HOT_BYTES:
        hot = F.broadcast(hot)
    cold = table.filter(F.col(weight) < hot_rows).drop(weight)
    whole = rows.dropna(subset=keys)
    out = whole.join(hot, keys, "inner").unionByName(whole.join(hot.select(*keys), keys, "left_anti").join(cold, keys, how))
    if how == "left":
        lone = rows.filter(" OR ".join(f"`{k}` IS NULL" for k in keys))
        added = [f for f in table.schema.fields if f.name not in (*keys, weight)]
        out = out.unionByName(lone.withColumns({f.name: F.lit(None).cast(f.dataType) for f in added}))
    return out


def running_totals(df: DataFrame, group: list[str], order: list[str | Column], totals: dict[str, Column], final: dict[str, Column] | None = None) -> DataFrame:
    """Add running sums of ``totals`` over each group in ``order``, the row itself included, and sums ``final`` of the group.

    Rows are range-partitioned by group and order, so a huge group spans many partitions. Sums per (partition, group) are
    one row each; their running sum gives the offset of every piece, and no window ever spans a whole group. ``order``
    (names, or columns with a direction) must be unique within a group. The placed rows are written out before the offsets are taken, because a range
    partitioning that is computed twice may place rows differently.
    """
    parts = tasks_for(df)
    names = list(totals)
    own = df.withColumns({f"_w{i}": c for i, c in enumerate(totals.values())} | {f"_f{i}": c for i, c in enumerate((final or {}).values())})
    placed = cut_lineage(own.repartitionByRange(parts, *group, *order).withColumn("_pid", F.spark_partition_id()))
    pieces = placed.groupBy(*group, "_pid").agg(*[F.sum(f"_w{i}").alias(f"_s{i}") for i in range(len(names))], *[F.sum(f"_f{i}").alias(f"_g{i}") for i in range(len(final or {}))])
    before = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.withColumns(
        {f"_o{i}": F.coalesce(F.sum(f"_s{i}").over(before), F.lit(0)) for i in range(len(names))} | {n: F.sum(f"_g{i}").over(Window.partitionBy(*group)) for i, n in enumerate(final or {})}
    )
    inside = Window.partitionBy("_pid", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    running = placed.withColumns({f"_r{i}": F.sum(f"_w{i}").over(inside) for i in range(len(names))})
    right = offsets.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate([*group, "_pid"])], *[f"_o{i}" for i in range(len(names))], *(final or {}))
    joined = running.join(right, _all([F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate([*group, "_pid"])]))
    return joined.select(*df.columns, *[(F.col(f"_r{i}") + F.col(f"_o{i}")).alias(n) for i, n in enumerate(names)], *(final or {}))


def positions_within(df: DataFrame, group: list[str], order: list[str | Column], weight: str | None = None, name: str = "position") -> DataFrame:
    """Add the 1-based position of each row in its group by ``order`` (with ``weight``: the running weight)."""
    w = F.lit(1) if weight is None else F.col(weight)
    return running_totals(df, group, order, {name: w.cast("bigint")})


def _all(conditions: list):
    first, *rest = conditions
    for c in rest:
        first = first & c
    return first
