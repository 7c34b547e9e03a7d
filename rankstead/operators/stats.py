"""Correlations, regressions, tests and intervals."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankstead.operators.ranking import has_value, ranked_together
from rankstead.operators.skew import cut_lineage, positions_within, running_totals


def spearman(df: DataFrame, x: str, y: str, group: list[str] = (), name: str = "rho") -> DataFrame:
    """Spearman's rho per group: Pearson's r of average ranks. Rows with a null in x or y don't count."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranks = ranked_together(both.select(*dict.fromkeys([*group, x, y])), [x, y], list(group), ["_x", "_y"])
    return ranks.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.corr("_x", "_y").alias(name))


def partial_spearman(df: DataFrame, x: str, y: str, z: str, group: list[str] = ()) -> DataFrame:
    """Spearman's rho of x and y with z held fixed, by the closed form on rank correlations.

    Equal to the correlation of the residuals of the ranks of x and y on those of z.
    """
    whole = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(z).isNotNull())
    r = whole.select(*dict.fromkeys([*group, x, y, z]))
    r = ranked_together(r, [x, y, z], list(group), ["_0", "_1", "_2"])
    c = r.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.corr("_0", "_1").alias("raw_rho"), F.corr("_0", "_2").alias("_xz"), F.corr("_1", "_2").alias("_yz"))
    under = F.sqrt((1 - F.col("_xz") * F.col("_xz")) * (1 - F.col("_yz") * F.col("_yz")))
    return c.withColumn("partial_rho", (F.col("raw_rho") - F.col("_xz") * F.col("_yz")) / F.nullif(under, F.lit(0.0))).select(*group, "n", "raw_rho", "partial_rho", F.col("_xz").alias("rho_x_z"))


#: Most distinct keys that models may have to be compared in blocks, models of a block, and pairs of blocks of a task.
MOST_KEYS, BLOCK, PAIRS_OF_TASK = 256, 512, 4


def pairwise_spearman(long: DataFrame, model: str, key: list[str], value: str, least: int = 0) -> DataFrame:
    """Spearman's rho of every pair of models over the keys that both have; pairs with fewer than ``least`` are left out.

    ``long`` has one row for each model and key. With up to ``MOST_KEYS`` keys, more models than keys and no NaN, the models are
    compared block by block, by products of matrices; else the joined values of each pair are ranked over the cluster.
    """
    rows = cut_lineage(long.select(F.col(model).alias("m"), *key, F.col(value).alias("v")).dropna(subset=["m", *key]).filter("v IS NOT NULL"))
    keys = rows.select(*key).distinct().limit(MOST_KEYS + 1).collect()
    many = len(keys) <= MOST_KEYS and rows.select("m").distinct().limit(len(keys) + 1).count() > len(keys)
    if many and rows.filter(~has_value(rows, "v")).isEmpty():
        return _spearman_in_blocks(rows, list(key), [tuple(r) for r in keys], least)
    a = rows.select(*key, F.col("m").alias("a"), F.col("v").alias("va"))
    b = rows.select(*key, F.col("m").alias("b"), F.col("v").alias("vb"))
    return spearman(a.join(b, list(key)).filter("a < b"), "va", "vb", ["a", "b"]).filter(F.col("n") >= least)


def _doubled_ranks(v: np.ndarray) -> np.ndarray:
    """Twice the average ranks within each row, less their mean: whole numbers."""
    n = v.shape[1]
    order = np.argsort(v, axis=1, kind="stable")
    s = np.take_along_axis(v, order, 1)
    new = np.ones((len(v), n + 1), bool)
    new[:, 1:-1] = s[:, 1:] != s[:, :-1]
    at = np.arange(n)
    first = np.maximum.accumulate(np.where(new[:, :-1], at, 0), axis=1)
    last = np.minimum.accumulate(np.where(new[:, 1:], at, n)[:, ::-1], axis=1)[:, ::-1]
    out = np.empty(v.shape)
    np.put_along_axis(out, order, (first + last + 1 - n).astype(float), 1)
    return out


def _rho_of_blocks(left: np.ndarray, right: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``left`` with each of ``right``: their common places (NaN: none) and rho (NaN: undefined).

    Rows that have the same places are ranked together, once for each set of places of the other side; the sums of
    products are of whole numbers, hence exact.
    """
    n, rho = np.zeros((len(left), len(right)), np.int64), np.full((len(left), len(right)), np.nan)
    sides = []
    for x in (left, right):
        has, of = np.unique(~np.isnan(x), axis=0, return_inverse=True)
        sides.append([(h, np.flatnonzero(of.reshape(-1) == i)) for i, h in enumerate(has)])
    for hl, il in sides[0]:
        for hr, ir in sides[1]:
            both = np.flatnonzero(hl & hr)
            at = np.ix_(il, ir)
            n[at] = len(both)
            if len(both) > 1 and len(both) >= least:
                x, y = _doubled_ranks(left[np.ix_(il, both)]), _doubled_ranks(right[np.ix_(ir, both)])
                under = np.sqrt((x * x).sum(1)[:, None] * (y * y).sum(1)[None, :])
                rho[at] = np.divide(x @ y.T, under, out=np.full(under.shape, np.nan), where=under > 0)
    return n, rho


def _spearman_in_blocks(rows: DataFrame, key: list[str], keys: list[tuple], least: int) -> DataFrame:
    """The pairs of models that share a key, as :func:`pairwise_spearman` gives them.

    Models are numbered by the keys that they have, so that those of a block mostly have the same, and each pair of blocks
    is a row of two matrices.
    """
    spark, width = rows.sparkSession, len(keys)
    places = spark.createDataFrame([(*k, i) for i, k in enumerate(sorted(keys))], rows.select(*key, F.lit(0).alias("_p")).schema)
    had = rows.join(F.broadcast(places), key).groupBy("m").agg(F.sort_array(F.collect_list(F.struct("_p", F.col("v").cast("double").alias("v")))).alias("x"))
    models = positions_within(had.withColumn("_has", F.col("x._p")), [], ["_has", "m"], name="_at").withColumn("_b", F.floor((F.col("_at") - 1) / BLOCK))
    blocks = cut_lineage(models.groupBy("_b").agg(F.collect_list(F.struct("m", "x")).alias("x")))
    count = blocks.count()
    pairs = blocks.select(F.col("_b").alias("i"), "x").join(blocks.select(F.col("_b").alias("j"), F.col("x").alias("y")), F.col("i") <= F.col("j"))
    pairs = pairs.repartition(max(1, count * (count + 1) // 2 // PAIRS_OF_TASK), "i", "j")
    kind = rows.schema["m"].dataType

    def matrix(x: pa.ListScalar) -> tuple[pa.Array, np.ndarray]:
        names, had = x.values.field("m"), x.values.field("x")
        out = np.full((len(names), width), np.nan)
        cells = had.flatten()
        row = np.repeat(np.arange(len(names)), pc.list_value_length(had).to_numpy())
        out[row, cells.field("_p").to_numpy()] = cells.field("v").to_numpy()
        return names, out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x, j, y in zip(*batch.columns):
                (ml, left), (mr, right) = matrix(x), matrix(y)
                n, rho = _rho_of_blocks(left, right, least)
                one, other = np.nonzero(n >= max(least, 1))
                names = pa.concat_arrays([ml, mr])
                place = np.empty(len(names), np.int64)
                place[sorted(range(len(names)), key=names.to_pylist().__getitem__)] = np.arange(len(names))
                less = place[one] < place[other + len(ml)]
                if i.as_py() == j.as_py():  # each pair once, no model with itself
                    one, other, less = one[one < other], other[one < other], less[one < other]
                a, b = np.where(less, one, other + len(ml)), np.where(less, other + len(ml), one)
                values = rho[one, other]
                yield pa.RecordBatch.from_arrays([names.take(pa.array(a)), names.take(pa.array(b)), pa.array(n[one, other]), pa.array(values, mask=np.isnan(values))], names=["a", "b", "n", "rho"])

    return pairs.mapInArrow(run, T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("n", T.LongType()), T.StructField("rho", T.DoubleType())]))


def one_predictor_ols(df: DataFrame, y: str, x: str, group: list[str] = ()) -> DataFrame:
    """Slope, intercept and R2 of y on x."""
    return df.groupBy(*group).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


#: Categories that a dummy-coded column may have.
MOST_CATEGORIES = 1000


def dummies(df: DataFrame, column: str) -> dict[str, Column]:
    """Indicator predictors of a column's categories in sorted order, without the first; raises beyond ``MOST_CATEGORIES``."""
    names = sorted(r[0] for r in df.select(F.col(column).cast("string")).dropna().distinct().limit(MOST_CATEGORIES + 1).collect())
    if len(names) > MOST_CATEGORIES:
        raise ValueError(f"{column} has more than {MOST_CATEGORIES} categories")
    return {f"{column}_{n}": (F.col(column).cast("string") == n).cast("double") for n in names[1:]}


def standardised(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as standard scores over the rows that have them all (population deviation)."""
    whole = df.dropna(subset=columns)
    s = whole.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return whole.withColumns({c: (F.col(c) - F.lit(s[f"m_{c}"])) / F.nullif(F.lit(s[f"s_{c}"]), F.lit(0.0)) for c in columns})


def ols(df: DataFrame, y: str, predictors: dict[str, Column]) -> DataFrame:
    """Ordinary least squares with an intercept: ``term``, ``coef``, ``se``, ``t``, ``p``, and ``r2`` and ``n`` of the model.

    For categories pass :func:`dummies` among the predictors, for comparable coefficients a :func:`standardised` table.

    The sums of products are taken in one distributed aggregation, (k + 2)^2 numbers whatever the size of the data; only
    these reach the driver, where the small system is solved. Rows with a null don't count. With no degree of freedom left,
    ``se``, ``t`` and ``p`` are null.
    """
    names = ["intercept", *predictors]
    cols = {"_c0": F.lit(1.0), **{f"_c{i + 1}": c.cast("double") for i, c in enumerate(predictors.values())}, "_y": F.col(y).cast("double")}
    data = df.select(*[c.alias(n) for n, c in cols.items()]).dropna()
    keys = list(cols)
    sums = data.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}x{b}") for i, a in enumerate(keys) for b in keys[i:]]).first()
    m = np.zeros((len(keys), len(keys)))
    for i, a in enumerate(keys):
        for j, b in enumerate(keys[i:], i):
            m[i, j] = m[j, i] = sums[f"{a}x{b}"] or 0.0
    k = len(names)
    xx, xy, yy, n = m[:k, :k], m[:k, k], m[k, k], m[0, 0]
    inv = np.linalg.pinv(xx)
    beta = inv @ xy
    free = n - np.linalg.matrix_rank(xx)
    spread = yy - xy[0] ** 2 / n if n else 0.0
    r2 = float(1 - (yy - beta @ xy) / spread) if spread > 0 else None
    rows = []
    for i, name in enumerate(names):
        se = math.sqrt(max(0.0, (yy - beta @ xy) / free * inv[i, i])) if free > 0 else None
        t = float(beta[i] / se) if se else None
        rows.append((name, float(beta[i]), se, t, float(t_two_sided(t, float(free))) if t is not None else None, r2, int(n)))
    return df.sparkSession.createDataFrame(rows, "term string, coef double, se double, t double, p double, r2 double, n bigint")


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny, c = 1e-300, 1.0
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_two_sided(t: float, free: float) -> float:
    """Two-sided tail probability of Student's t."""
    return incomplete_beta(free / 2.0, 0.5, free / (free + t * t))


def correlation_p(r: float | None, n: int) -> float | None:
    """Two-sided p of a (rank) correlation by the t distribution with n - 2 degrees of freedom; null if undefined."""
    if r is None or n < 3:
        return None
    if abs(r) >= 1:
        return 0.0
    return t_two_sided(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


def mann_whitney_p(auroc: float, n1: int, n0: int, tie_term: float = 0.0) -> float:
    """Two-sided p of the Mann-Whitney U test, normal approximation with continuity and tie correction.

    ``tie_term`` is the sum of t^3 - t over groups of t tied scores.
    """
    n, u = n1 + n0, auroc * n1 * n0
    var = n1 * n0 / 12.0 * ((n + 1) - tie_term / (n * (n - 1)))
    if var <= 0:
        return 1.0
    z = (abs(u - n1 * n0 / 2.0) - 0.5) / math.sqrt(var)
    return math.erfc(max(z, 0.0) / math.sqrt(2))


def with_correlation_p(df: DataFrame, r: str, n: str, name: str = "p") -> DataFrame:
    """Add the two-sided p of a (rank) correlation in column ``r`` over ``n`` pairs; null where undefined."""

    @F.pandas_udf("double")
    def p(rs: pd.Series, ns: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) or pd.isna(b) else correlation_p(float(a), int(b)) for a, b in zip(rs, ns, strict=True)], dtype="Float64").astype(object)

    return df.withColumn(name, p(F.col(r).cast("double"), F.col(n).cast("bigint")))


def one_sample_t(df: DataFrame, value: str, group: list[str] = (), mean: float = 0.0) -> DataFrame:
    """Per group: ``n``, ``mean``, its 95 % interval (normal), ``t`` and two-sided ``p`` against a given mean; null below two."""
    s = df.groupBy(*group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("_sd"))
    se = F.nullif(F.col("_sd") / F.sqrt(F.col("n")), F.lit(0.0))
    t = (F.col("mean") - F.lit(mean)) / se

    @F.pandas_udf("double")
    def p(ts: pd.Series, ns: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) or b < 2 else t_two_sided(float(a), float(b - 1)) for a, b in zip(ts, ns, strict=True)], dtype="Float64").astype(object)

    return s.withColumns({"ci_lo": F.col("mean") - 1.96 * se, "ci_hi": F.col("mean") + 1.96 * se, "t": t}).withColumn("p", p("t", "n")).drop("_sd")


def mann_whitney(df: DataFrame, label: str, score: str, group: list[str] = ()) -> DataFrame:
    """Per group: ``auroc``, ``n_pos``, ``n_neg`` and the two-sided ``p`` of the Mann-Whitney U test with ties corrected.

    All comes from the level table, so that groups may have any size; null where a class is absent.
    """
    from rankstead.operators.metrics import auroc, level_table

    ties = level_table(df, label, score, group).groupBy(*group).agg(F.sum(F.col("nn").cast("double") * F.col("nn") * F.col("nn") - F.col("nn")).alias("_ties"))
    a = auroc(df, label, score, group)
    if group:
        right = ties.withColumnsRenamed({g: f"_r_{g}" for g in group})
        same = F.lit(True)
        for g in group:
            same = same & F.col(g).eqNullSafe(F.col(f"_r_{g}"))
        both = a.join(right, same).drop(*[f"_r_{g}" for g in group])
    else:
        both = a.withColumn("_ties", ties.scalar())

    @F.pandas_udf("double")
    def p(au: pd.Series, n1: pd.Series, n: pd.Series, tt: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) else mann_whitney_p(float(x), int(k), int(m - k), float(t)) for x, k, m, t in zip(au, n1, n, tt, strict=True)], dtype="Float64").astype(object)

    return both.select(*group, "auroc", "n_pos", (F.col("n") - F.col("n_pos")).alias("n_neg"), p("auroc", "n_pos", "n", "_ties").alias("p"))


def stability(pairs: DataFrame, key: list[str], rho: str = "rho") -> DataFrame:
    """Mean and least correlation over the pairs of each key, and their number."""
    return pairs.groupBy(*key).agg(F.count(rho).alias("n_pairs"), F.avg(rho).alias("mean_rho"), F.min(rho).alias("min_rho"))


def ladder(value: Column, steps: list[tuple[float, str]], otherwise: str) -> Column:
    """The name of the first step whose threshold the value reaches, highest first; below all of them ``otherwise``; null
    stays null."""
    out = F.lit(otherwise)
    for least, name in sorted(steps):
        out = F.when(value >= least, F.lit(name)).otherwise(out)
    return F.when(value.isNotNull(), out)


def auroc_numpy(y: np.ndarray, s: np.ndarray) -> float:
    """AUROC of one small sample, ties one half; NaN if a class is absent."""
    n1 = int(y.sum())
    n0 = len(y) - n1
    if not n1 or not n0:
        return math.nan
    _, where, counts = np.unique(s, return_inverse=True, return_counts=True)
    ends = np.cumsum(counts)
    rank = (ends - (counts - 1) / 2.0)[where]
    return float((rank[y == 1].sum() - n1 * (n1 + 1) / 2.0) / (n1 * n0))


#: Cells of the matrix of resamples by rows that are worked on at once.
RESAMPLED_CELLS = 4_000_000


def resampled_aurocs(y: np.ndarray, scores: list[np.ndarray], times: int, seed: int) -> np.ndarray:
    """AUROCs (a row for each score) of ``times`` resamples with replacement, the same for all scores; NaN where a class is
    absent.

    A resample is how often each row was drawn, so scores are sorted once and many resamples are summed level by level
    together.
    """
    n, rng, out = len(y), np.random.default_rng(seed), []
    y = y.astype(float)
    sorts = []
    for s in scores:
        order = np.argsort(s, kind="stable")
        sorts.append((order, np.concatenate(([0], np.flatnonzero(np.diff(s[order])) + 1)), y[order]))
    step = max(1, RESAMPLED_CELLS // max(n, 1))
    for at in range(0, times, step):
        rows = min(step, times - at)
        picked = rng.integers(0, n, (rows, n)) + np.arange(rows)[:, None] * n
        drawn = np.bincount(picked.ravel(), minlength=rows * n).reshape(rows, n).astype(float)
        part = []
        for order, starts, label in sorts:
            own = drawn[:, order]
            pos, every = np.add.reduceat(own * label, starts, axis=1), np.add.reduceat(own, starts, axis=1)
            neg = every - pos
            wins = (pos * (np.cumsum(neg, axis=1) - neg / 2)).sum(axis=1)
            both = pos.sum(axis=1) * neg.sum(axis=1)
            part.append(np.where(both > 0, wins / np.where(both > 0, both, 1), np.nan))
        out.append(np.stack(part))
    return np.concatenate(out, axis=1)


def bootstrap_ci(df: DataFrame, label: str, score: str, key: list[str], group: list[str] = (), times: int = 2000, seed: int = 0) -> DataFrame:
    """AUROC of each group with its 95 % bootstrap interval: ``auroc``, ``ci_lo``, ``ci_hi``, ``n``.

    Meant for evaluation sets, whose groups fit a task: rows are put in the order of ``key``, resampled with numpy's
    generator, and resamples with one class are left out. For groups of any size use :func:`poisson_bootstrap`.
    """
    keys = list(group)
    cols = [*keys, *key, label, score]
    slim = df.select(*dict.fromkeys(cols)).filter(F.col(label).isNotNull() & F.col(score).isNotNull())
    grouped = slim.withColumn("_all", F.lit(1))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(list(key), kind="stable")
        y, s = part[label].to_numpy().astype(int), part[score].to_numpy(dtype=float)
        got = resampled_aurocs(y, [s], times, seed)[0]
        got = got[~np.isnan(got)]
        lo, hi = np.percentile(got, [2.5, 97.5]) if len(got) else (None, None)
        a = auroc_numpy(y, s)
        return pd.DataFrame([[*part[keys].iloc[0].tolist(), None if math.isnan(a) else a, lo, hi, len(y)]], columns=[*keys, "auroc", "ci_lo", "ci_hi", "n"])

    kinds = ", ".join([*(f"`{k}` {slim.schema[k].dataType.simpleString()}" for k in keys), "auroc double, ci_lo double, ci_hi double, n bigint"])
    return grouped.groupBy(*(keys or ["_all"])).applyInPandas(run, kinds)


def paired_bootstrap(df: DataFrame, label: str, a: str, b: str, key: list[str], group: list[str] = (), times: int = 2000, seed: int = 0) -> DataFrame:
    """Difference of two scores' AUROCs on the same resamples: ``diff``, ``ci_lo``, ``ci_hi``, ``differs``, ``n``."""
    keys = list(group)
    slim = df.select(*dict.fromkeys([*keys, *key, label, a, b])).dropna(subset=[label, a, b]).withColumn("_all", F.lit(1))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(list(key), kind="stable")
        y, s, t = part[label].to_numpy().astype(int), part[a].to_numpy(dtype=float), part[b].to_numpy(dtype=float)
        of_a, of_b = resampled_aurocs(y, [s, t], times, seed)
        got = (of_a - of_b)[~np.isnan(of_a)]
        lo, hi, mean = (*np.percentile(got, [2.5, 97.5]), float(np.mean(got))) if len(got) else (None, None, None)
        return pd.DataFrame([[*part[keys].iloc[0].tolist(), mean, lo, hi, bool(len(got)) and not lo <= 0 <= hi, len(y)]], columns=[*keys, "diff", "ci_lo", "ci_hi", "differs", "n"])

    kinds = ", ".join([*(f"`{k}` {slim.schema[k].dataType.simpleString()}" for k in keys), "diff double, ci_lo double, ci_hi double, differs boolean, n bigint"])
    return slim.groupBy(*(keys or ["_all"])).applyInPandas(run, kinds)


def poisson_bootstrap(df: DataFrame, label: Column, score: str, key: str, group: list[str] = (), times: int = 200, seed: int = 0) -> DataFrame:
    """Bootstrap interval for groups of any size: each row gets a Poisson(1) weight per resample, from a hash of its key.

    Rows become weighted levels per (group, resample), so after the map-side combine only distinct scores move; the levels
    of a group and resample are summed over the cluster.
    """
    trial = df.select(*group, label.cast("int").alias("_y"), F.col(score).alias("_s"), F.col(key).alias("_k"), F.explode(F.sequence(F.lit(1), F.lit(times))).alias("trial")).filter("_y IS NOT NULL AND _s IS NOT NULL")
    u = (F.pmod(F.xxhash64(F.lit(seed), "trial", "_k"), F.lit(2**52)) + 0.5) / F.lit(float(2**52))
    steps, acc, term = [], 0.0, math.exp(-1)
    for k in range(8):
        acc += term
        steps.append((acc, k))
        term /= k + 1
    weight = F.lit(8)
    for acc, k in reversed(steps):
        weight = F.when(u <= acc, F.lit(k)).otherwise(weight)
    weighted = trial.withColumn("_w", weight).filter("_w > 0")
    levels = weighted.groupBy(*group, "trial", "_s").agg(F.sum("_w").alias("nn"), F.sum(F.col("_w") * F.col("_y")).alias("pp"))
    ran = running_totals(levels, [*group, "trial"], ["_s"], {"_upto": F.col("nn") - F.col("pp")})
    per = ran.withColumn("_b", F.col("_upto") - (F.col("nn") - F.col("pp"))).groupBy(*group, "trial").agg(
        F.sum(F.col("pp") * (F.col("_b") + (F.col("nn") - F.col("pp")) / F.lit(2.0))).alias("u"), F.sum("pp").alias("p"), F.sum(F.col("nn") - F.col("pp")).alias("q")
    )
    a = per.filter("p > 0 AND q > 0").withColumn("a", F.col("u") / (F.col("p") * F.col("q")))
    return a.groupBy(*group).agg(F.avg("a").alias("mean"), F.percentile("a", 0.025).alias("ci_lo"), F.percentile("a", 0.975).alias("ci_hi"))
