"""Exact, tie-aware ranking metrics, per group.

Every metric starts from the *level table*: one row per (group, distinct score) with its rows and positives. It is a
combinable aggregation, so ties and repeated scores shrink before the shuffle; what follows runs over levels instead of rows
and is spread over the cluster even for one huge group. Rows with a null score or label don't count. A metric that needs both classes is null where one is absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankstead.operators.skew import running_totals


def level_table(df: DataFrame, label: Column | str, score: Column | str, group: list[str] = ()) -> DataFrame:
    """``group``, ``s`` (score), ``nn`` (rows), ``pp`` (positives) per distinct score of a group."""
    lab = F.col(label) if isinstance(label, str) else label
    sco = F.col(score) if isinstance(score, str) else score
    rows = df.select(*group, lab.cast("int").alias("_y"), sco.cast("double").alias("s")).filter("_y IS NOT NULL AND s IS NOT NULL AND NOT isnan(s)")
    return rows.groupBy(*group, "s").agg(F.count(F.lit(1)).alias("nn"), F.sum("_y").alias("pp"))


def _cumulated(levels: DataFrame, group: list[str]) -> DataFrame:
    """Levels from the highest score down, with running rows ``cn`` and positives ``cp`` and totals ``n``, ``p``.

    A group, or the whole table, may have any number of distinct scores: see :func:`rankstead.operators.skew.running_totals`.
    """
    down = levels.withColumn("_down", -F.col("s"))
    return running_totals(down, list(group), ["_down"], {"cn": F.col("nn"), "cp": F.col("pp")}, {"n": F.col("nn"), "p": F.col("pp")}).drop("_down")


def _grouped(df: DataFrame, group: list[str], *aggs: Column) -> DataFrame:
    return df.groupBy(*group).agg(*aggs)


def summary(df: DataFrame, label: Column | str, score: Column | str, group: list[str] = (), names: tuple[str, ...] = ("n", "n_pos", "auroc", "ap")) -> DataFrame:
    """Rows, positives, AUROC (Mann-Whitney, ties one half) and average precision of each group, in one pass.

    AUROC: a level's positives beat all negatives below it and draw with its own. AP: recall gained at each level times the
    precision there, levels taken from the highest score down.
    """
    lev = _cumulated(level_table(df, label, score, group), list(group))
    neg_below = (F.col("n") - F.col("p")) - (F.col("cn") - F.col("cp"))
    own = F.col("nn") - F.col("pp")
    wins = F.sum(F.col("pp") * (neg_below + own / F.lit(2.0)))
    p, n = F.first("p"), F.first("n")
    out = _grouped(
        lev,
        list(group),
        F.first("n").alias("n"),
        F.first("p").alias("n_pos"),
        (wins / F.nullif((p * (n - p)).cast("double"), F.lit(0.0))).alias("auroc"),
        F.when(n > p, F.sum(F.col("pp") / F.nullif(F.col("p").cast("double"), F.lit(0.0)) * (F.col("cp") / F.col("cn")))).alias("ap"),
    )
    return out.select(*group, *names)


def auroc(df: DataFrame, label: Column | str, score: Column | str, group: list[str] = ()) -> DataFrame:
    return summary(df, label, score, group, ("n", "n_pos", "auroc"))


def average_precision(df: DataFrame, label: Column | str, score: Column | str, group: list[str] = ()) -> DataFrame:
    return summary(df, label, score, group, ("n", "n_pos", "ap"))


def ppv_at_k(df: DataFrame, label: Column | str, score: str, key: str, k: int, group: list[str] = ()) -> DataFrame:
    """Mean label of the ``k`` rows with the highest score (ties: least key); of all rows if there are fewer.

    Rows with a null or NaN score don't count. Each task passes on at most ``k`` rows of a group, whatever its size.
    """
    lab = F.col(label) if isinstance(label, str) else label
    w = Window.partitionBy(*group).orderBy(F.desc(score), F.asc(key))
    rows = df.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))).select(*group, lab.cast("double").alias("_y"), F.row_number().over(w).alias("_rn"))
    return rows.filter(F.col("_rn") <= k).groupBy(*group).agg(F.avg("_y").alias("ppv"))


def bundle(df: DataFrame, label: Column | str, score: str, key: str, group: list[str] = (), k: int = 100) -> DataFrame:
    """:func:`summary` and PPV at ``k`` (``ppv``) of each group side by side; the empty list of groups is all rows."""
    s, p = summary(df, label, score, group), ppv_at_k(df, label, score, key, k, group)
    if not group:
        return s.withColumn("ppv", p.scalar())
    right = p.withColumnsRenamed({g: f"_r_{g}" for g in group})
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_r_{g}"))
    return s.join(right, same, "left").drop(*[f"_r_{g}" for g in group])


def evaluate(df: DataFrame, label: Column | str, score: str, key: str, group: str, stratum: str) -> dict[str, DataFrame]:
    """The whole evaluation of one scored table: ``pooled``, ``per_group`` (bundles) and ``strata`` with the equity gap."""
    return {"pooled": bundle(df, label, score, key), "per_group": bundle(df, label, score, key, [group]), "strata": stratified(df, label, score, stratum)}


def with_overall(per_scope: DataFrame, overall: DataFrame, group: str, everything: str = "ALL") -> DataFrame:
    """Per-group rows and the pooled row in one long table with ``scope``; ranks differ between scopes, so both are given."""
    a = per_scope.withColumn("scope", F.lit("per_group")).withColumn(group, F.col(group).cast("string"))
    b = overall.withColumn("scope", F.lit("pooled")).withColumn(group, F.lit(everything))
    return a.unionByName(b)


def youden_point(df: DataFrame, label: Column | str, score: Column | str, group: list[str] = ()) -> DataFrame:
    """``sensitivity``, ``specificity``, ``asymmetry`` and ``threshold`` where TPR - FPR is largest (ties: highest score)."""
    lev = _cumulated(level_table(df, label, score, group), list(group)).filter("p > 0 AND n > p")
    tpr = F.col("cp") / F.col("p")
    fpr = (F.col("cn") - F.col("cp")) / (F.col("n") - F.col("p"))
    pts = lev.withColumns({"tpr": tpr, "fpr": fpr}).withColumn("j", F.round(F.col("tpr") - F.col("fpr"), 9))
    best = pts.groupBy(*group).agg(F.max_by(F.struct("tpr", "fpr", "s"), F.struct("j", "s")).alias("b"))
    sens, spec = F.col("b.tpr"), F.lit(1.0) - F.col("b.fpr")
    return best.select(*group, sens.alias("sensitivity"), spec.alias("specificity"), (sens - spec).alias("asymmetry"), F.col("b.s").alias("threshold"))


def margins(df: DataFrame, label: Column | str, score: Column | str, group: list[str], keep: list[str]) -> DataFrame:
    """Per row: the share of the group's opposite class that it is ordered correctly against, ties one half.

    The levels carry the counts; rows get theirs by a join on (group, score). The mean over a class is the group's AUROC.
    """
    lab = F.col(label) if isinstance(label, str) else label
    sco = F.col(score) if isinstance(score, str) else score
    rows = df.select(*dict.fromkeys([*group, *keep]), lab.cast("int").alias("_y"), sco.cast("double").alias("_s")).filter("_y IS NOT NULL AND _s IS NOT NULL")
    lev = _cumulated(level_table(df, label, score, group), list(group))
    own_neg = F.col("nn") - F.col("pp")
    neg_below = (F.col("n") - F.col("p")) - (F.col("cn") - F.col("cp"))
    pos_above = F.col("cp") - F.col("pp")
    table = lev.select(
        *[F.col(g).alias(f"_g_{g}") for g in group],
        F.col("s").alias("_ls"),
        ((neg_below + own_neg / F.lit(2.0)) / F.nullif((F.col("n") - F.col("p")).cast("double"), F.lit(0.0))).alias("_mp"),
        ((pos_above + F.col("pp") / F.lit(2.0)) / F.nullif(F.col("p").cast("double"), F.lit(0.0))).alias("_mn"),
    )
    same = F.col("_s") == F.col("_ls")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    out = rows.join(table, same)
    return out.select(*dict.fromkeys([*group, *keep]), F.when(F.col("_y") == 1, F.col("_mp")).otherwise(F.col("_mn")).alias("margin"))


def assign_bins(value: Column | str, edges: list[float], labels: list[str]) -> Column:
    """Label of the half-open bin [low, high) of a value; values beyond the outer edges go to the end labels."""
    v = F.col(value) if isinstance(value, str) else value
    out = F.lit(labels[-1])
    for edge, name in reversed(list(zip(edges[1:-1], labels[:-1], strict=True))):
        out = F.when(v < edge, F.lit(name)).otherwise(out)
    return F.when(v.isNotNull(), out)


def stratified(df: DataFrame, label: Column | str, score: Column | str, stratum: str, also: list[str] = ()) -> DataFrame:
    """AUROC per stratum and, beside each, the equity gap: best minus worst scored stratum, their names; null below two.

    Strata without both classes have no AUROC and take no part. Ties go to the first name in sorted order.
    """
    per = auroc(df, label, score, [*also, stratum])
    w = Window.partitionBy(*also)
    scored = F.col("auroc").isNotNull()
    name = F.col(stratum).cast("string")
    best = F.min(F.when(scored, F.struct(-F.col("auroc"), name.alias("n")))).over(w)
    worst = F.min(F.when(scored, F.struct(F.col("auroc"), name.alias("n")))).over(w)
    enough = F.count("auroc").over(w) >= 2
    return per.withColumns(
        {
            "gap": F.when(enough, F.max("auroc").over(w) - F.min("auroc").over(w)),
            "best": F.when(enough, best["n"]),
            "worst": F.when(enough, worst["n"]),
        }
    )


def unpivot(df: DataFrame, keys: list[str], features: list[str], name: str = "feature", value: str = "value") -> DataFrame:
    """Long form of feature columns, without null values."""
    return df.select(*keys, *[F.col(f).cast("double").alias(f) for f in features]).unpivot(keys, features, name, value).filter(F.col(value).isNotNull())


def feature_auroc(df: DataFrame, label: str, features: list[str], lower_is_positive: list[str], group: list[str] = ()) -> DataFrame:
    """AUROC of every feature; features whose low values speak for the positive class are negated first."""
    long = unpivot(df, [*group, label], features)
    sign = F.when(F.col("feature").isin(list(lower_is_positive)), -1.0).otherwise(1.0) if lower_is_positive else F.lit(1.0)
    return auroc(long.withColumn("value", F.col("value") * sign), label, "value", [*group, "feature"])


def auto_oriented(per: DataFrame) -> DataFrame:
    """Add ``auroc_oriented`` = max(a, 1 - a) and ``direction`` (1 or -1)."""
    a = F.col("auroc")
    return per.withColumns({"auroc_oriented": F.greatest(a, F.lit(1.0) - a), "direction": F.when(a >= 0.5, 1).when(a < 0.5, -1)})


def standardised_orientation(df: DataFrame, label: str, features: list[str], group: str) -> DataFrame:
    """Per feature: ``auroc`` in its better orientation, ``direction`` (1 or -1), and ``auroc_z`` of the values standardised
    within groups (sample deviation; 0 where undefined), turned by the direction that the raw values gave.

    Missing values get the feature's mean. Standard scores are rounded to 9 digits, so that equal ones of different groups
    are ties. Turning a score turns its AUROC a into 1 - a, so nothing is ranked twice.
    """
    means = df.agg(*[F.avg(f).alias(f) for f in features]).first()  # one number per feature
    filled = df.select(group, label, *[F.coalesce(F.col(f).cast("double"), F.lit(means[f])).alias(f) for f in features])
    long = unpivot(filled, [group, label], features)
    stats = long.groupBy(group, "feature").agg(F.avg("value").alias("_m"), F.stddev_samp("value").alias("_sd")).withColumnRenamed(group, "_g")
    z = long.join(stats.withColumnRenamed("feature", "_f"), F.col(group).eqNullSafe(F.col("_g")) & (F.col("feature") == F.col("_f")))
    z = z.select(label, "feature", F.round(F.coalesce((F.col("value") - F.col("_m")) / F.nullif("_sd", F.lit(0.0)), F.lit(0.0)), 9).alias("value"))
    raw = auto_oriented(auroc(long, label, "value", ["feature"])).select("feature", F.col("auroc_oriented").alias("auroc"), "direction")
    scaled = auroc(z, label, "value", ["feature"]).select("feature", F.col("auroc").alias("_z"))
    return raw.join(scaled, "feature").select("feature", "auroc", "direction", F.when(F.col("direction") > 0, F.col("_z")).otherwise(F.lit(1.0) - F.col("_z")).alias("auroc_z"))


def worst_sets(df: DataFrame, key: str, models: list[str], share: float) -> DataFrame:
    """Long table of each model's worst rows: ``model``, ``key``; the ``max(1, floor(n * share))`` lowest values, ties by key."""
    long = unpivot(df, [key], models, "model", "value")
    ran = running_totals(long, ["model"], ["value", key], {"_rn": F.lit(1).cast("bigint")}, {"_n": F.lit(1).cast("bigint")})
    return ran.filter(F.col("_rn") <= F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(share)))).select("model", key)


def worst_set_jaccard(df: DataFrame, key: str, models: list[str], share: float) -> DataFrame:
    """``a``, ``b``, ``jaccard`` of the worst sets of every pair of models, and the value expected by chance."""
    sets = worst_sets(df, key, models, share)
    sizes = sets.groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    both = sets.alias("x").join(sets.alias("y"), (F.col(f"x.{key}") == F.col(f"y.{key}")) & (F.col("x.model") < F.col("y.model")))
    shared = both.groupBy(F.col("x.model").alias("a"), F.col("y.model").alias("b")).agg(F.count(F.lit(1)).alias("k"))
    pairs = sizes.alias("p").join(sizes.alias("q"), F.col("p.model") < F.col("q.model")).select(F.col("p.model").alias("a"), F.col("q.model").alias("b"), F.col("p.n").alias("na"), F.col("q.n").alias("nb"))
    out = pairs.join(shared, ["a", "b"], "left").withColumn("k", F.coalesce("k", F.lit(0)))
    return out.select("a", "b", (F.col("k") / (F.col("na") + F.col("nb") - F.col("k"))).alias("jaccard"), F.lit(share / (2 - share)).alias("chance"))
