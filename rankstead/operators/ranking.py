"""Ranks, standard scores, gates and top-k within groups.

All functions here take and return DataFrames or Columns, name their group, entity and score columns as parameters, and
treat the empty list of groups as one group of all rows. A null score has no rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankstead.operators.skew import cut_lineage, positions_within, running_totals
from rankstead.operators.weighted import compress_values, per_key_percentiles


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def has_value(df: DataFrame, name: str) -> Column:
    """Whether a column is neither null nor NaN."""
    c = F.col(name)
    return c.isNotNull() & ~F.isnan(c) if df.select(name).schema[0].dataType.typeName() in ("double", "float") else c.isNotNull()


def average_rank(score: Column | str, group: list[str] = (), also: list[str] = ()) -> Column:
    """Average rank (ties share the mean of their ranks) of ``score`` within groups that fit a task; else :func:`ranked`."""
    keys = [*group, *also]
    by = Window.partitionBy(*keys).orderBy(col(score))
    ties = Window.partitionBy(*keys, col(score))
    return F.when(col(score).isNotNull(), F.rank().over(by) + (F.count(F.lit(1)).over(ties) - 1) / F.lit(2.0))


def ranked(df: DataFrame, score: str, group: list[str] = (), name: str = "rank", share: str | None = None) -> DataFrame:
    """Add the average rank among the rows with a score (and, as ``share``, that rank over their number).

    Null and NaN scores get null and don't shift the others. Works on (group, score) counts that are summed over the cluster, so a
    group, or the table, may have any size.
    """
    keys = list(group)
    levels = df.filter(has_value(df, score)).groupBy(*keys, score).agg(F.count(F.lit(1)).alias("_n"))
    upto = running_totals(levels, keys, [score], {"_upto": F.col("_n")}, {"_all": F.col("_n")})
    table = upto.withColumn(name, F.col("_upto") - (F.col("_n") - 1) / F.lit(2.0))
    if share:
        table = table.withColumn(share, F.col(name) / F.col("_all"))
    right = table.drop("_n", "_upto", "_all").withColumnsRenamed({k: f"_r_{k}" for k in [*keys, score]})
    same = F.col(score) == F.col(f"_r_{score}")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return df.join(right, same, "left").drop(*[f"_r_{k}" for k in [*keys, score]])


def ranked_together(df: DataFrame, scores: list[str], group: list[str] = (), ranks: list[str] | None = None, shares: list[str] | None = None) -> DataFrame:
    """:func:`ranked` for several numeric scores: the counts of all their distinct values are sorted and summed in one pass.

    ``ranks`` and ``shares`` name the added columns, one for each score; either may be left out.
    """
    keys, levels = list(group), None
    for i, s in enumerate(scores):
        one = df.filter(has_value(df, s)).groupBy(*keys, F.col(s).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_i", F.lit(i))
        levels = one if levels is None else levels.unionByName(one)
    upto = cut_lineage(running_totals(levels, [*keys, "_i"], ["_v"], {"_upto": F.col("_n")}, {"_all": F.col("_n")}))
    rank = F.col("_upto") - (F.col("_n") - 1) / F.lit(2.0)
    for i, s in enumerate(scores):
        added = ([rank.alias(ranks[i])] if ranks else []) + ([(rank / F.col("_all")).alias(shares[i])] if shares else [])
        right = upto.filter(F.col("_i") == i).select(*[F.col(k).alias(f"_r_{k}") for k in keys], F.col("_v").alias("_rv"), *added)
        same = F.col(s).cast("double") == F.col("_rv")
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        df = df.join(right, same, "left").drop("_rv", *[f"_r_{k}" for k in keys])
    return df


def with_group_stats(df: DataFrame, group: list[str], stats: dict[str, Column]) -> DataFrame:
    """Add aggregates of each group (of all rows, without one) to its rows. One row per group is joined back."""
    keys = list(group)
    if not keys:
        one = df.agg(F.struct(*[c.alias(n) for n, c in stats.items()]).alias("s")).scalar()
        return df.withColumn("_s", one).withColumns({n: F.col(f"_s.{n}") for n in stats}).drop("_s")
    table = df.groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()]).withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return df.join(table, same).drop(*[f"_r_{k}" for k in keys])


def with_zscore(df: DataFrame, score: str, group: list[str] = (), name: str = "z", population: bool = False) -> DataFrame:
    """Add the standard score within the group, by the sample (or population) deviation; null where that is 0 or undefined."""
    sd = (F.stddev_pop if population else F.stddev_samp)(score)
    t = with_group_stats(df, list(group), {"_mean": F.avg(score), "_sd": sd})
    return t.withColumn(name, (F.col(score) - F.col("_mean")) / F.nullif(F.col("_sd"), F.lit(0.0))).drop("_mean", "_sd")


def with_rank_average(df: DataFrame, scores: list[str], group: list[str] = (), name: str = "mean_rank") -> DataFrame:
    """Add the mean over several scores of their average rank divided by the number of scores."""
    out = ranked_together(df, scores, group, shares=[f"_p{i}" for i in range(len(scores))])
    total = sum((F.col(f"_p{i}") for i in range(len(scores))), F.lit(0.0))
    return out.withColumn(name, total / F.lit(float(len(scores)))).drop(*[f"_p{i}" for i in range(len(scores))])


def with_percentile_of_score(df: DataFrame, score: str, group: list[str] = (), name: str = "pct") -> DataFrame:
    """Add the share of the group's scores that are strictly lower, in percent."""
    keys = list(group)
    levels = df.filter(has_value(df, score)).groupBy(*keys, score).agg(F.count(F.lit(1)).alias("_n"))
    upto = running_totals(levels, keys, [score], {"_upto": F.col("_n")}, {"_all": F.col("_n")})
    table = upto.withColumn(name, (F.col("_upto") - F.col("_n")) / F.col("_all") * F.lit(100.0)).drop("_n", "_upto", "_all")
    right = table.withColumnsRenamed({k: f"_r_{k}" for k in [*keys, score]})
    same = F.col(score) == F.col(f"_r_{score}")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return df.join(right, same, "left").drop(*[f"_r_{k}" for k in [*keys, score]])


def mad_gate(df: DataFrame, score: str, group: str, name: str = "gate") -> DataFrame:
    """Add ``1 / (1 + |x - median| / MAD)`` within the group; 0.5 where the MAD is 0 or the score null.

    Both medians come from weighted values (:mod:`rankstead.operators.weighted`), so no group is gathered anywhere.
    """

    def medians(t: DataFrame, value: str, out: str) -> DataFrame:
        m = per_key_percentiles(compress_values(t, group, value), [0.5]).select(F.col("key").alias("_k"), F.col("p0").alias(out))
        return t.join(m, F.col(group).eqNullSafe(F.col("_k")), "left").drop("_k")

    off = medians(df.withColumn("_x", F.col(score).cast("double")), "_x", "_med").withColumn("_off", F.abs(F.col("_x") - F.col("_med")))
    both = medians(off, "_off", "_mad")
    gate = F.lit(1.0) / (F.lit(1.0) + F.col("_off") / F.nullif(F.col("_mad"), F.lit(0.0)))
    return both.withColumn(name, F.coalesce(gate, F.lit(0.5))).drop("_x", "_med", "_off", "_mad")


def entropy_gate(x: Column | str) -> Column:
    """One minus the binary entropy of the logistic of ``x``, with the probability clipped to [1e-6, 1 - 1e-6]."""
    p = F.least(F.greatest(F.lit(1.0) / (F.lit(1.0) + F.exp(-col(x))), F.lit(1e-6)), F.lit(1 - 1e-6))
    q = F.lit(1.0) - p
    return F.lit(1.0) + p * F.log2(p) + q * F.log2(q)


def with_minmax_gate(df: DataFrame, x: str, group: list[str] = (), name: str = "gate") -> DataFrame:
    """Add ``1 - (x - min) / (max - min)``; 0.5 where all values are equal."""
    t = with_group_stats(df, list(group), {"_lo": F.min(x), "_hi": F.max(x)})
    lo, hi = F.col("_lo"), F.col("_hi")
    return t.withColumn(name, F.when(hi == lo, F.lit(0.5)).otherwise(F.lit(1.0) - (F.col(x) - lo) / F.nullif(hi - lo, F.lit(0.0)))).drop("_lo", "_hi")


def top_k(df: DataFrame, k: int | Column, group: list[str], order: list[Column]) -> DataFrame:
    """The first ``k`` rows of each group in ``order``, which must be total.

    With a number, each task passes on at most so many rows of a group; with a column, rows are numbered over the cluster.
    """
    if isinstance(k, Column):
        return positions_within(df, list(group), list(order), name="_rn").filter(F.col("_rn") <= k).drop("_rn")
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def top_fraction(df: DataFrame, share: float, least: int, group: list[str], order: list[Column]) -> DataFrame:
    """The first ``max(least, floor(n * share))`` rows of each group, of any size, in ``order``, which must be total."""
    one = F.lit(1).cast("bigint")
    ran = running_totals(df, list(group), list(order), {"_rn": one}, {"_n": one})
    return ran.filter(F.col("_rn") <= F.greatest(F.lit(least), F.floor(F.col("_n") * F.lit(share)))).drop("_rn", "_n")


def hash_order(seed: int | str, *parts: Column | str) -> Column:
    """A reproducible shuffle key: the md5 of seed and parts, joined by bars."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[col(p).cast("string") for p in parts]))


def quota_pick(df: DataFrame, stratum: str, entity: str, order: list[Column], quotas: dict, name: str = "picked") -> DataFrame:
    """Top rows of each stratum by ``order``, a stratum's unmet quota going on to the next one named.

    The strata are few and named by ``quotas``, whose order is kept. One count per stratum reaches the driver.
    """
    counts = {r[0]: r[1] for r in df.filter(F.col(stratum).isin(list(quotas))).groupBy(stratum).count().collect()}
    carried, limits = 0, []
    for s, q in quotas.items():
        got = min(q + carried, counts.get(s, 0))
        carried = q + carried - got
        limits.append((s, got))
    limit = F.coalesce(*[F.when(F.col(stratum) == s, F.lit(n)) for s, n in limits], F.lit(0))
    return positions_within(df, [stratum], list(order), name=name).filter(F.col(name) <= limit)
