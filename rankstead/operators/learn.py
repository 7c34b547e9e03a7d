"""Small models on feature tables: leave-one-group-out logistic regression, stacking, gates, boosting, PCA.

Evaluation tables have tens to thousands of rows per group. Every held-out group is a fold of its own; the folds are
independent, so they run side by side: each fold's training rows reach one task, standardised there by the training rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankstead.operators.ranking import hash_order, with_zscore
from rankstead.operators.skew import positions_within


def fit_logistic(x: np.ndarray, y: np.ndarray, c: float = 1.0, steps: int = 50) -> np.ndarray:
    """Coefficients (intercept last) of C * sum of losses + |w|^2 / 2, by Newton steps; the intercept isn't penalised."""
    n, k = x.shape
    a = np.hstack([x, np.ones((n, 1))])
    w = np.zeros(k + 1)
    ridge = np.diag([1.0] * k + [1e-12])
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(a @ w, -35, 35)))
        grad = c * a.T @ (p - y) + ridge @ w
        hess = c * (a * (p * (1 - p))[:, None]).T @ a + ridge
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-10:
            break
    return w


def _fold_rows(df: DataFrame, group: str, key: list[str], label: str, features: list[str]) -> DataFrame:
    """Each row once per fold that needs it: as a test row of its own group's fold, as a training row of every other's.

    The number of groups multiplies the rows; both are small for an evaluation set, whose groups are a stated list.
    """
    slim = df.select(group, *key, F.col(label).cast("int").alias("_y"), *[F.col(f).cast("double").alias(f) for f in features]).dropna()
    groups = slim.agg(F.sort_array(F.collect_set(group)).alias("_gs")).scalar()
    return slim.withColumn("_gs", groups).withColumn("_fold", F.explode("_gs")).drop("_gs")


def logo_predictions(df: DataFrame, group: str, key: list[str], label: str, features: list[str], c: float = 1.0, components: int | None = None) -> DataFrame:
    """``group``, ``key``, ``label``, ``score``: each group's rows scored by a model fitted on all other groups.

    Features are standardised by the training rows (population deviation; constant ones become 0). With ``components``,
    they are first reduced to that many principal components of the training rows. A fold whose training rows have one
    class gives its rows a null score.
    """
    rows = _fold_rows(df, group, key, label, features)
    kinds = ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in (group, *key))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        test = part[group] == part["_fold"]
        x, y = part[features].to_numpy(dtype=float), part["_y"].to_numpy(dtype=float)
        train = ~test.to_numpy()
        out = part.loc[test, [group, *key]].copy()
        out["label"] = part.loc[test, "_y"]
        if len(set(y[train])) < 2:
            out["score"] = np.nan
            return out
        mean, sd = x[train].mean(axis=0), x[train].std(axis=0)
        z = (x - mean) / np.where(sd > 0, sd, 1.0)
        if components:
            _, _, v = np.linalg.svd(z[train], full_matrices=False)
            z = z @ v[:components].T
        order = np.lexsort([part[k].astype(str).to_numpy() for k in (*key, group)])
        order = order[train[order]]
        w = fit_logistic(z[order], y[order], c)
        out["score"] = z[test.to_numpy()] @ w[:-1] + w[-1]
        return out

    scored = rows.groupBy("_fold").applyInPandas(run, f"{kinds}, label int, score double")
    return scored.withColumn("score", F.nanvl("score", F.lit(None).cast("double")))


def logistic_coefficients(df: DataFrame, label: str, features: list[str], c: float = 1.0) -> DataFrame:
    """``feature``, ``coef`` on standardised features over all rows; fitted in one task, meant for evaluation tables."""
    rows = df.select(F.col(label).cast("int").alias("_y"), *[F.col(f).cast("double").alias(f) for f in features]).dropna().withColumn("_all", F.lit(1))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        x = part[features].to_numpy(dtype=float)
        z = (x - x.mean(axis=0)) / np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
        w = fit_logistic(z, part["_y"].to_numpy(dtype=float), c)
        return pd.DataFrame({"feature": [*features, "intercept"], "coef": w})

    return rows.groupBy("_all").applyInPandas(run, "feature string, coef double")


def gated(df: DataFrame, group: list[str], a: str, b: str, gate: str) -> DataFrame:
    """Features of the gated model: both scores standardised by group, and each times the gate or its complement."""
    g = F.col(gate)
    both = with_zscore(with_zscore(df, a, group, "za"), b, group, "zb")
    return both.withColumns({"ga": F.col("za") * g, "gb": F.col("zb") * (F.lit(1.0) - g)})


def shuffled_gate(df: DataFrame, gate: str, key: list[str], seed: int, group: list[str] = ()) -> DataFrame:
    """A permutation control: the gate's values dealt anew to the rows (of each group) in hash order.

    Rows are numbered over the cluster (:func:`rankstead.operators.skew.positions_within`), so a group may have any size.
    ``key`` must be unique within a group.
    """
    a = positions_within(df, list(group), list(key), name="_rn")
    dealt = df.select(*group, *key, F.col(gate).alias("_g")).withColumn("_h", hash_order(seed, *key))
    b = positions_within(dealt, list(group), ["_h", *key], name="_rn").select(*group, "_g", "_rn")
    return a.join(b, [*group, "_rn"]).withColumn(gate, F.col("_g")).drop("_g", "_rn")


def predict_batches(df: DataFrame, key: list[str], features: list[str], model, name: str = "score") -> DataFrame:
    """``key`` and the scores of a given model, a function from a two-dimensional array of features to one score per row.

    Arrow batches go through the model as they come, without a shuffle; rows with a missing feature get a null score.
    """
    slim = df.select(*key, *[F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features)])
    kinds = ", ".join([*(f"`{k}` {slim.schema[k].dataType.simpleString()}" for k in key), f"`{name}` double"])
    columns = [f"_x{i}" for i in range(len(features))]

    def run(parts):
        for part in parts:
            x = part[columns].to_numpy(dtype=float)
            whole = ~np.isnan(x).any(axis=1)
            got = pd.Series([None] * len(part), dtype="Float64")
            if whole.any():
                got[whole] = np.asarray(model(x[whole]), dtype=float)
            out = part[list(key)].copy()
            out[name] = got.to_numpy(dtype=object, na_value=None)
            yield out

    return slim.mapInPandas(run, kinds)


def feature_block(df: DataFrame, key: list[str], prefix: str, lower_is_positive: list[str] = (), leave: tuple[str, ...] = ("kind", "label", "in_train", "score")) -> DataFrame:
    """``key`` and the features of a table as ``prefix__name``, those whose low values speak for the positive class negated."""
    features = [c for c in df.columns if c not in (*key, *leave)]
    return df.select(*key, *[(-F.col(c) if c in lower_is_positive else F.col(c)).alias(f"{prefix}__{c}") for c in features])


def impute_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing numbers replaced by their column's mean; one number per column reaches the driver."""
    means = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(means[c])) for c in columns})


def gate_controls(df: DataFrame, group: str, key: list[str], label: str, a: str, b: str, gate: str, seeds: tuple[int, ...] = (0, 1, 2, 3, 4), c: float = 0.1) -> DataFrame:
    """Scores of the gated model beside its controls: ``model`` is ``gated``, ``ungated`` (both scores, no gate) or
    ``shuffled_<seed>`` (the gate's values dealt anew): ``model``, ``group``, ``key``, ``label``, ``score``."""
    z, own = ["za", "zb"], ["za", "zb", "ga", "gb"]
    runs = {"gated": (df, own), "ungated": (df, z)} | {f"shuffled_{s}": (shuffled_gate(df, gate, key, s), own) for s in seeds}
    out = None
    for name, (rows, features) in runs.items():
        one = logo_predictions(gated(rows, [group], a, b, gate), group, key, label, features, c).withColumn("model", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def weight_sweep(df: DataFrame, a: str, b: str, steps: int = 10) -> DataFrame:
    """Each row at each weight: ``weight`` (of ``a``) and ``mixed`` = w a + (1 - w) b."""
    w = df.withColumn("weight", F.explode(F.array(*[F.lit(i / steps) for i in range(steps + 1)])))
    return w.withColumn("mixed", F.col("weight") * F.col(a) + (F.lit(1.0) - F.col("weight")) * F.col(b))


def boosting_logo(df: DataFrame, group: str, key: list[str], label: str, features: list[str], rounds: int = 50, rate: float = 0.1, depth: int = 2) -> DataFrame:
    """Gradient boosting of shallow trees on the logistic loss, leave-one-group-out: same columns as :func:`logo_predictions`."""
    rows = _fold_rows(df, group, key, label, features)
    kinds = ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in (group, *key))

    def best_split(x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple | None:
        total_g, total_h, found = g.sum(), h.sum(), None
        base = total_g**2 / (total_h + 1.0)
        for f in range(x.shape[1]):
            o = np.argsort(x[:, f], kind="stable")
            cg, ch, v = np.cumsum(g[o])[:-1], np.cumsum(h[o])[:-1], x[o, f]
            ok = v[1:] > v[:-1]
            if not ok.any():
                continue
            gain = np.where(ok, cg**2 / (ch + 1.0) + (total_g - cg) ** 2 / (total_h - ch + 1.0) - base, -np.inf)
            i = int(np.argmax(gain))
            if gain[i] > 1e-12 and (found is None or gain[i] > found[0]):
                found = (gain[i], f, (v[i] + v[i + 1]) / 2)
        return found

    def grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, left: int) -> tuple:
        s = best_split(x, g, h) if left and len(g) > 3 else None
        if s is None:
            return (-g.sum() / (h.sum() + 1.0),)
        low = x[:, s[1]] <= s[2]
        return s[1], s[2], grow(x[low], g[low], h[low], left - 1), grow(x[~low], g[~low], h[~low], left - 1)

    def value(tree: tuple, x: np.ndarray) -> np.ndarray:
        if len(tree) == 1:
            return np.full(len(x), tree[0])
        low = x[:, tree[0]] <= tree[1]
        out = np.empty(len(x))
        out[low], out[~low] = value(tree[2], x[low]), value(tree[3], x[~low])
        return out

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([group, *key], kind="stable")
        test = (part[group] == part["_fold"]).to_numpy()
        x, y = part[features].to_numpy(dtype=float), part["_y"].to_numpy(dtype=float)
        score = np.zeros(len(part))
        for _ in range(rounds if len(set(y[~test])) == 2 else 0):
            p = 1.0 / (1.0 + np.exp(-score))
            tree = grow(x[~test], (p - y)[~test], (p * (1 - p))[~test], depth)
            score += rate * value(tree, x)
        out = part.loc[test, [group, *key]].copy()
        out["label"], out["score"] = part.loc[test, "_y"], score[test]
        return out

    return rows.groupBy("_fold").applyInPandas(run, f"{kinds}, label int, score double")
