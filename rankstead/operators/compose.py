"""Selections made of several operators: decoys, benchmark sets, panels and ablations.

``own`` is a table of distinct (group, sequence) of one length. Candidates are found by joins on anchor letters or group
names and scored in their own row; only the last step, max-min selection, runs group by group on what is left.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankstead.operators import joins, motif, select
from rankstead.operators.ranking import hash_order, top_k

#: Places whose letters decide whether a sequence fits a group.
ANCHORS = (2, -1)


def _place(p: int, length: int) -> int:
    return p if p > 0 else length + p + 1


def _profile(own: DataFrame, group: str, seq: str, length: int) -> tuple[DataFrame, DataFrame]:
    """Weights (natural log) of each group, and the letters' counts they come from."""
    return motif.log_odds(motif.frequencies(own, [group], seq, length, whole=True)), motif.position_counts(own, [group], seq)


def own_cutoffs(own: DataFrame, pwm: DataFrame, group: str, seq: str, length: int, percentile: float) -> DataFrame:
    """``group``, ``cut``: the percentile (interpolated) of the scores of each group's own sequences.

    Scores are rounded to 9 digits and their distinct values weighted by number, so that no group is gathered anywhere.
    """
    from rankstead.operators.weighted import compress_values, per_key_percentiles

    scored = motif.score(own, pwm, [group], [], seq, length).withColumn("score", F.round("score", 9))
    return per_key_percentiles(compress_values(scored, group, "score"), [percentile / 100]).select(F.col("key").alias(group), F.col("p0").alias("cut"))


def hard_candidates(own: DataFrame, group: str, seq: str, length: int, percentile: float = 50.0, top_letters: int = 4, anchors: tuple[int, ...] = ANCHORS) -> DataFrame:
    """``group``, ``seq``, ``score``: sequences of other groups, not of the group itself, that carry its frequent letters at
    all anchors but score no higher than the percentile of its own."""
    pwm, counts = _profile(own, group, seq, length)
    cut = own_cutoffs(own, pwm, group, seq, length, percentile)
    want = motif.frequent_letters(counts, [group], top_letters, "n")
    places = [_place(p, length) for p in anchors]
    fits = None
    for i, p in enumerate(places):
        letters = want.filter(F.col("pos") == p).select(group, F.col("aa").alias(f"_a{i}"))
        fits = letters if fits is None else fits.join(letters, group)
    pool = own.select(F.col(seq)).distinct().select(seq, *[F.substring(seq, p, 1).alias(f"_a{i}") for i, p in enumerate(places)])
    cand = pool.join(fits, [f"_a{i}" for i in range(len(places))]).select(group, seq).join(own.select(group, seq), [group, seq], "left_anti")
    return motif.score(cand, pwm, [group], [seq], seq, length).join(cut, group).filter(F.round("score", 9) <= F.col("cut")).select(group, seq, "score")


def clean_candidates(own: DataFrame, pairs: DataFrame, group: str, seq: str, length: int, donors: int = 3, percentile: float = 25.0, top_letters: int = 4, anchors: tuple[int, ...] = ANCHORS) -> DataFrame:
    """``group``, ``seq``, ``score``: sequences of the ``donors`` farthest groups that carry the group's frequent letters at no
    anchor and score no higher than the percentile of its own. ``pairs``: distances ``a``, ``b``, ``d`` of all group pairs."""
    pwm, counts = _profile(own, group, seq, length)
    cut = own_cutoffs(own, pwm, group, seq, length, percentile)
    want = motif.frequent_letters(counts, [group], top_letters, "n")
    far = motif.farthest_groups(pairs, "d", donors).select(F.col("a").alias(group), F.col("b").alias("_donor"))
    cand = far.join(own.select(F.col(group).alias("_donor"), seq), "_donor").select(group, seq).distinct()
    for p in (_place(p, length) for p in anchors):
        letters = want.filter(F.col("pos") == p).select(group, F.col("aa").alias("_aa"))
        cand = cand.withColumn("_aa", F.substring(seq, p, 1)).join(letters, [group, "_aa"], "left_anti").select(group, seq)
    return motif.score(cand, pwm, [group], [seq], seq, length).join(cut, group).filter(F.round("score", 9) <= F.col("cut")).select(group, seq, "score")


def donor_candidates(own: DataFrame, pairs: DataFrame, group: str, seq: str) -> DataFrame:
    """``group``, ``donor``, ``seq``: the sequences of each group's farthest other group (ties: least name)."""
    far = motif.farthest_groups(pairs, "d", 1).select(F.col("a").alias(group), F.col("b").alias("donor"))
    return far.join(own.select(F.col(group).alias("donor"), seq), "donor").select(group, "donor", seq)


def decoys(candidates: DataFrame, group: str, seq: str, k: int) -> DataFrame:
    """``k`` candidates per group by max-min, beginning with the least: ``group``, ``seq``, ``place``."""
    return select.maxmin_select(candidates, [group], seq, seq, k)


def diverse_groups(consensus: DataFrame, group: str, seq: str, n: int, forced: list[str] = ()) -> DataFrame:
    """``n`` groups by max-min distance of their sequences, forced ones first: ``group``, ``place``. Groups are a stated list."""
    return select.maxmin_select(consensus, [], seq, group, n, list(forced), name=group)


def diverse_set(own: DataFrame, consensus: DataFrame, group: str, seq: str, group_seq: str, n_groups: int, k: int, forced: list[str] = ()) -> DataFrame:
    """Max-min on groups, then on the sequences of each that was picked: ``group``, ``seq``, ``place``."""
    picked = diverse_groups(consensus, group, group_seq, n_groups, forced).select(group)
    return select.maxmin_select(own.join(picked, group), [group], seq, seq, k)


def canonical_set(own: DataFrame, consensus: DataFrame, group: str, seq: str, group_seq: str, length: int, n_groups: int, k: int, share: float = 0.1, forced: list[str] = ()) -> DataFrame:
    """Max-min on groups; of each that was picked the top share of its own sequences by profile score (ties: later sequence),
    ``k`` at least; of these ``k`` by max-min, beginning with the best: ``group``, ``seq``, ``place``."""
    from rankstead.operators.ranking import top_fraction

    picked = diverse_groups(consensus, group, group_seq, n_groups, forced).select(group)
    mine = own.join(picked, group)
    pwm, _ = _profile(mine, group, seq, length)
    scored = motif.score(mine, pwm, [group], [seq], seq, length).withColumn("score", F.round("score", 9)).filter("score IS NOT NULL")
    best = top_fraction(scored, share, k, [group], [F.desc("score"), F.desc(seq)])
    ordered = best.withColumn("_o", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), F.desc(seq))))
    return select.maxmin_select(ordered, [group], seq, "_o", k)


def measured_set(df: DataFrame, group: str, seq: str, value: str, relation: str, known: DataFrame, k: int, strong: float, weak: float, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """``k`` binders and ``k`` non-binders of each group that has as many (``group``, ``seq``, ``label``), and per group the
    numbers there were, with ``taken``.

    Labels heed the inequality of the measurement; sequences among ``known`` are left out, and so are those measured both
    ways. The draw goes by hash order.
    """
    fresh = df.join(known.select(seq).distinct(), seq, "left_anti")
    labelled = fresh.select(group, seq, joins.censored_label(value, relation, strong, weak).alias("label")).filter("label IS NOT NULL").distinct()
    clear = joins.without_ambiguous(labelled, [group, seq], "label")
    counts = joins.conditional_counts(clear, [group], "label").withColumn("taken", (F.col("n_pos") >= k) & (F.col("n_neg") >= k))
    drawn = top_k(clear.join(counts.filter("taken").select(group), group), k, [group, "label"], [hash_order(seed, group, seq), F.col(seq)])
    return drawn.select(group, seq, "label"), counts


def _panel(df: DataFrame, name: str, value: str, columns: list[str], run) -> DataFrame:
    rows = df.select(F.col(name).cast("string").alias(name), *[F.col(c).cast("double").alias(c) for c in dict.fromkeys([value, *columns])], "eligible").dropna(subset=[value]).withColumn("_all", F.lit(1))
    return rows.groupBy("_all").applyInPandas(run, f"`{name}` string, stratum int, place int")


def _with_kept(part: pd.DataFrame, name: str, keep: list[str], n: int, quotas, strata, pick, rest) -> pd.DataFrame:
    """Kept names first (stratum -1), then each stratum's quota and what earlier ones left over, then the best of the rest."""
    part = part.sort_values(name, kind="stable").reset_index(drop=True)
    kept = part[part[name].isin(keep)][name].tolist()
    pool, out, carried = part[part["eligible"] & ~part[name].isin(keep)], [(x, -1) for x in kept], 0
    need = max(0, n - len(kept))
    if need and len(pool):
        for s, (quota, inside) in enumerate(zip(quotas(need), strata(part[part["eligible"]], pool), strict=True)):
            own = pool[inside & ~pool[name].isin([x for x, _ in out])]
            got = pick(own, min(quota + carried, len(own)))
            carried += quota - len(got)
            out += [(x, s) for x in got]
        left = pool[~pool[name].isin([x for x, _ in out])]
        out += [(x, len(quotas(need))) for x in rest(left, carried)]
    return pd.DataFrame({name: [x for x, _ in out], "stratum": [s for _, s in out], "place": range(1, len(out) + 1)})


def panel_by_score(df: DataFrame, name: str, score: str, spread: str, n: int, strata: int = 4, keep: list[str] = ()) -> DataFrame:
    """A panel of ``n`` named things: those to ``keep``, then even quotas from equally wide strata of ``score``, lowest first,
    within each the ones most spread over ``spread``; what a stratum lacks goes on to the next, and at last to the lowest
    scores. ``eligible`` (boolean column) says who may be drawn. Columns: ``name``, ``stratum`` (-1: kept), ``place``.

    The things are a stated list (some hundreds); the panel is drawn in one task.
    """
    quotas = lambda need: [need // strata + (i < need % strata) for i in range(strata)]

    def inside(eligible: pd.DataFrame, pool: pd.DataFrame):
        edges = np.linspace(eligible[score].min(), eligible[score].max() + 1e-9, strata + 1)
        return [(pool[score] >= a) & (pool[score] < b) for a, b in zip(edges, edges[1:], strict=False)]

    def pick(own: pd.DataFrame, k: int) -> list[str]:
        own = own.sort_values([spread, name], kind="stable")
        v, taken = own[spread].to_numpy(), []
        for i in range(k):
            if i < 2:
                taken.append(0 if i == 0 else len(v) - 1)
                continue
            gap = np.abs(v[:, None] - v[taken][None, :]).min(axis=1)
            gap[taken] = -1
            taken.append(int(np.argmax(gap)))
        return own.iloc[sorted(set(taken))][name].tolist()

    rest = lambda left, k: left.sort_values([score, name], kind="stable").head(k)[name].tolist()
    return _panel(df, name, score, [spread], lambda part: _with_kept(part.dropna(subset=[spread]), name, keep, n, quotas, inside, pick, rest))


def panel_by_isolation(df: DataFrame, name: str, distance: str, n: int, weights: list[float], keep: list[str] = ()) -> DataFrame:
    """A panel as in :func:`panel_by_score`, but from strata of ``distance`` from the most isolated down, with weighted quotas
    (what rounding leaves goes to the heaviest), and the most isolated first in each. A stratum has its upper edge in it."""
    w = np.array(weights, dtype=float)

    def quotas(need: int) -> list[int]:
        q = np.floor(w / w.sum() * need).astype(int)
        q[int(np.argmax(w))] += need - q.sum()
        return q.tolist()

    def inside(eligible: pd.DataFrame, pool: pd.DataFrame):
        edges = np.linspace(eligible[distance].max(), eligible[distance].min(), len(w) + 1)
        return [(pool[distance] <= a) & (pool[distance] > b) for a, b in zip(edges, edges[1:], strict=False)]

    best = lambda own, k: own.sort_values([distance, name], ascending=[False, True], kind="stable").head(k)[name].tolist()
    return _panel(df, name, distance, [], lambda part: _with_kept(part, name, keep, n, quotas, inside, best, best))


#: Cells of the two-by-two ablation: is the target's family removed, is the target cut down to the dose.
CELLS = {"full": (False, False), "removed": (True, False), "starved": (False, True), "both": (True, True)}


def ablation_cells(df: DataFrame, group: str, label: str, key: list[str], target: str, in_family: Column, dose: int, seed: int = 0) -> DataFrame:
    """The training rows of each cell, told apart by ``cell``: other groups without the target's family or with it, and the
    target's rows whole or ``dose`` of each label, drawn by hash order.

    The draw is made once over the target's rows; each row then goes to the cells it belongs to, without another shuffle of
    the others.
    """
    is_target = F.col(group) == target
    kept = select.dose_sample(df.filter(is_target & F.col(label).isNotNull()), [label], key, dose, seed).withColumn("_dosed", F.lit(True))
    rest = df.filter(is_target).join(kept.select(*key), list(key), "left_anti").withColumn("_dosed", F.lit(False))
    others = df.filter(~is_target).withColumn("_dosed", F.lit(True))
    rows = others.unionByName(kept.select(*df.columns, "_dosed")).unionByName(rest.select(*df.columns, "_dosed"))
    family = in_family & ~is_target
    fits = [F.when((~family if gone else F.lit(True)) & (F.col("_dosed") if starved else F.lit(True)), F.lit(name)) for name, (gone, starved) in CELLS.items()]
    return rows.withColumn("cell", F.explode(F.filter(F.array(*fits), lambda x: x.isNotNull()))).drop("_dosed")


def anchor_recovery(top: DataFrame, anchors: DataFrame, key: list[str], length: int) -> DataFrame:
    """``key``, ``recovers``: whether all ``top`` places (array) are among the key's ``anchors``; null if it has none."""
    placed = F.transform("anchors", lambda a: F.when(a < 0, F.lit(length) + a + 1).otherwise(a).cast("int"))
    joined = top.join(anchors.select(*key, placed.alias("_a")), list(key), "left")
    return joined.select(*key, "top", F.when(F.size("_a") > 0, F.size(F.array_except(F.col("top").cast("array<int>"), "_a")) == 0).alias("recovers"))


def planted_label(c: Column | str, anchor: Column | str, seed: int = 0, hydrophobic: str = "AVILMFWY", chances: tuple[float, float, float] = (0.05, 0.4, 0.85)) -> Column:
    """A label that can be learnt: the chance of 1 grows with the anchor letter at the second place and a hydrophobic last one.

    The draw is the md5 of the sequence, so it is the same wherever it is made; sequences under three letters get 0.
    """
    s, a = (F.col(x) if isinstance(x, str) else x for x in (c, anchor))
    points = (F.substring(s, 2, 1) == a).cast("int") + (F.position(F.substring(s, -1, 1), F.lit(hydrophobic)) > 0).cast("int")
    draw = F.conv(F.substring(hash_order(seed, s), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    chance = F.element_at(F.array(*[F.lit(x) for x in chances]), points + 1)
    return F.when(F.length(s) < 3, 0).otherwise((draw < chance).cast("int"))


def require(df: DataFrame, problem: str, condition: Column | None = None) -> DataFrame:
    """``df`` itself, if it has rows (that meet ``condition``); else raises ``ValueError`` with the problem."""
    if (df if condition is None else df.filter(condition)).isEmpty():
        raise ValueError(problem)
    return df


def require_all(wanted: DataFrame, have: DataFrame, key: list[str], problem: str) -> DataFrame:
    """``wanted``, if every key of it stands in ``have``; else raises ``ValueError`` with the problem and some of the keys."""
    some = [tuple(r) for r in wanted.select(*key).distinct().join(have.select(*key).distinct(), list(key), "left_anti").limit(5).collect()]
    if some:
        raise ValueError(f"{problem}: {some}")
    return wanted
