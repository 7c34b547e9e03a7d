import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankstead.operators import joins, learn, metrics, motif, ranking, select, stats


@pytest.fixture(scope="module")
def scored(spark):
    rnd = random.Random(5)
    rows = [(i, f"g{i % 3}", rnd.choice([0, 1]), round(rnd.random(), 1), rnd.random()) for i in range(120)]
    return rows, spark.createDataFrame(rows, "i int, g string, y int, s double, t double").repartition(5)


def test_auroc_against_pairs(scored):
    rows, df = scored
    got = {r["g"]: r["auroc"] for r in metrics.auroc(df, "y", "s", ["g"]).collect()}
    for g in got:
        p, n = [r[3] for r in rows if r[1] == g and r[2]], [r[3] for r in rows if r[1] == g and not r[2]]
        want = sum((a > b) + (a == b) / 2 for a in p for b in n) / (len(p) * len(n))
        assert abs(got[g] - want) < 1e-12
    neg = {r["g"]: r["auroc"] for r in metrics.auroc(df.withColumn("m", -F.col("s")), "y", "m", ["g"]).collect()}
    assert all(abs(got[g] + neg[g] - 1) < 1e-12 for g in got)


def test_margins_average_to_auroc(scored):
    _, df = scored
    a = {r["g"]: r["auroc"] for r in metrics.auroc(df, "y", "s", ["g"]).collect()}
    m = metrics.margins(df, "y", "s", ["g"], ["i", "y"]).groupBy("g", "y").agg(F.avg("margin").alias("m")).collect()
    assert all(abs(r["m"] - a[r["g"]]) < 1e-12 for r in m)


def test_one_class_is_null_and_gap_needs_two(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 1, 0.2), ("b", 0, 0.1), ("b", 1, 0.3), ("c", None, 0.3), ("c", 1, None)], "g string, y int, s double")
    got = {r["g"]: (r["auroc"], r["ap"]) for r in metrics.summary(df, "y", "s", ["g"], ("auroc", "ap")).collect()}
    assert got == {"a": (None, None), "b": (1.0, 1.0)}
    assert {r["gap"] for r in metrics.stratified(df, "y", "s", "g").collect()} == {None}
    assert metrics.auroc(df.limit(0), "y", "s", ["g"]).count() == 0


def test_bins_are_half_open_and_clipped(spark):
    df = spark.createDataFrame([(x,) for x in (-5.0, 0.0, 9.9, 10.0, 99.0, 500.0, None)], "x double")
    got = [r[0] for r in df.select(metrics.assign_bins("x", [0, 10, 100], ["lo", "hi"])).collect()]
    assert got == ["lo", "lo", "lo", "hi", "hi", "hi", None]


def test_rank_equals_window_rank(scored):
    _, df = scored
    a = {r["i"]: r["rank"] for r in ranking.ranked(df, "s", ["g"]).collect()}
    b = {r["i"]: r["r"] for r in df.select("i", ranking.average_rank("s", ["g"]).alias("r")).collect()}
    assert a == b


def test_partial_spearman_equals_residuals(scored):
    rows, df = scored
    r = stats.partial_spearman(df, "s", "t", "i").first()

    def rank(v):
        o = sorted(v)
        return np.array([o.index(x) + (o.count(x) + 1) / 2 for x in v])

    x, y, z = (rank([q[k] for q in rows]) for k in (3, 4, 0))
    res = lambda a: a - np.polyval(np.polyfit(z, a, 1), z)
    assert abs(r["partial_rho"] - np.corrcoef(res(x), res(y))[0, 1]) < 1e-9


def test_tail_probabilities():
    assert abs(stats.t_two_sided(2.0, 10) - 0.07338803477074037) < 1e-12
    assert abs(stats.t_two_sided(0.0, 5) - 1) < 1e-12
    assert stats.correlation_p(1.0, 10) == 0.0 and stats.correlation_p(None, 10) is None


def test_ols_against_lstsq(scored):
    rows, df = scored
    got = {r["term"]: r["coef"] for r in stats.ols(df, "s", {"t": F.col("t"), "y": F.col("y")}).collect()}
    x = np.array([[1, r[4], r[2]] for r in rows])
    want = np.linalg.lstsq(x, np.array([r[3] for r in rows]), rcond=None)[0]
    assert np.allclose([got["intercept"], got["t"], got["y"]], want)


def test_bootstrap_is_reproducible_and_holds_the_estimate(scored):
    _, df = scored
    a = stats.bootstrap_ci(df, "y", "s", ["i"], [], times=200).first()
    b = stats.bootstrap_ci(df.repartition(3), "y", "s", ["i"], [], times=200).first()
    assert a == b and a["ci_lo"] <= a["auroc"] <= a["ci_hi"]
    p = stats.poisson_bootstrap(df, F.col("y"), "s", "i", times=60).first()
    assert abs(p["mean"] - a["auroc"]) < 0.1
    d = stats.paired_bootstrap(df, "y", "s", "s", ["i"], [], times=50).first()
    assert d["diff"] == 0 and not d["differs"]


def test_bounded_cells_find_every_band_pair(spark):
    rnd = random.Random(3)
    a = [(i, rnd.uniform(-50, 50)) for i in range(150)] + [(999, None)]
    left, right = spark.createDataFrame(a, "i int, x double"), spark.createDataFrame([(-i, v) for i, v in a], "j int, y double")
    got = {(r["i"], r["j"]) for r in joins.band_pairs(left, right, "x", "y", 2.5).collect()}
    assert got == {(i, -j) for i, v in a for j, w in a if v is not None and w is not None and abs(v - w) <= 2.5}


def test_hamming_pairs_equal_brute_force(spark):
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("AB") for _ in range(rnd.randint(0, 7))) for _ in range(80)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    got = {(r["left_id"], r["right_id"], r["distance"]) for r in joins.hamming_pairs(df, "i", "s", df, "i", "s", 2).collect()}
    want = set()
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            if a is not None and b is not None and len(a) == len(b) and (d := sum(x != y for x, y in zip(a, b))) <= 2:
                want.add((i, j, d))
    assert got == want


def test_clusters_do_not_depend_on_row_order(spark):
    rnd = random.Random(6)
    rows = [(f"g{i % 2}", "".join(rnd.choice("ACD") for _ in range(8 + i % 2))) for i in range(120)]
    runs = []
    for n in (1, 5):
        rnd.shuffle(rows)
        df = spark.createDataFrame(rows, "g string, s string").repartition(n)
        runs.append({(r["g"], r["s"]): r["cluster"] for r in select.hamming_clusters(df, "g", "s").collect()})
    assert runs[0] == runs[1]
    assert sorted(set(runs[0].values())) == list(range(len(set(runs[0].values()))))
    by: dict = {}
    for (g, s), c in runs[0].items():
        by.setdefault(c, []).append((g, s))
    for members in by.values():
        assert len({(g, len(s)) for g, s in members}) == 1
        first = min(s for _, s in members)
        assert all(sum(a != b for a, b in zip(first, s)) <= round(0.2 * len(s)) for _, s in members)


def test_greedy_clusters_and_folds(spark):
    df = spark.createDataFrame([(1, "AAAAAAAA"), (2, "AAAAAAAC"), (3, "CCCCCCCC"), (4, "AAAAAAAAA"), (5, "AAAAAAAA")], "o int, s string")
    c = select.greedy_clusters(df, "s", "o")
    assert {r["o"]: r["cluster"] for r in c.collect()} == {1: 0, 2: 0, 3: 1, 4: 2, 5: 0}
    folds = select.grouped_folds(c, 2).collect()
    assert len({(r["cluster"], r["fold"]) for r in folds}) == 3
    held = select.cluster_holdout(c, 0.34).collect()
    assert len({r["cluster"] for r in held if r["held_out"]}) == 1


def test_maxmin_starts_with_the_first_and_spreads(spark):
    df = spark.createDataFrame([("g", "AAAA", 1), ("g", "AAAC", 2), ("g", "CCCC", 3), ("g", "CCAA", 4)], "g string, s string, o int")
    got = [r["s"] for r in select.maxmin_select(df, ["g"], "s", "o", 3).orderBy("place").collect()]
    assert got == ["AAAA", "CCCC", "CCAA"]


def test_spread_pick_takes_both_ends(spark):
    df = spark.createDataFrame([("g", str(i), float(v)) for i, v in enumerate([0, 1, 5, 9, 10])], "g string, k string, v double")
    assert [r["k"] for r in select.spread_pick(df, ["g"], "k", "v", 3).orderBy("place").collect()] == ["0", "4", "2"]


def test_negatives_are_never_own_positives(spark):
    rnd = random.Random(8)
    rows = list({("hot" if rnd.random() < 0.5 else f"g{rnd.randrange(5)}", "".join(rnd.choice("ACDE") for _ in range(5))) for _ in range(600)})
    df = spark.createDataFrame(rows, "g string, s string")
    neg = [(r["g"], r["s"]) for r in select.pool_negatives(df, "g", "s").collect()]
    assert len(neg) == len(set(neg)) and not set(neg) & set(rows)
    pool = {s for _, s in rows}
    for g in {g for g, _ in rows}:
        own = {s for h, s in rows if h == g}
        assert sum(h == g for h, _ in neg) == min(len(own), len(pool) - len(own))


def test_shapley_is_efficient(spark):
    df = spark.createDataFrame([("x", "CDEF")], "k string, s string")
    c = select.coalitions(df, ["k"], "s", ["AAAA", "GGGG"], 4).withColumn("v", F.ascii("variant") * 1.0 + F.ascii(F.substring("variant", 2, 1)) * F.ascii(F.substring("variant", 3, 1)))
    phi = sum(r["phi"] for r in select.shapley(c, ["k"], "mask", "v", 4).collect())
    mean = {r["mask"]: r["m"] for r in c.groupBy("mask").agg(F.avg("v").alias("m")).collect()}
    assert abs(phi - (mean[15] - mean[0])) < 1e-9


def test_divergence_bounds_and_information(spark):
    df = spark.createDataFrame([("a", "AAAA"), ("a", "AACA"), ("b", "CDEF"), ("c", "AAAA"), ("c", "AACA")], "g string, s string")
    f = motif.frequencies(df, ["g"], "s", 4)
    d = {(r["a"], r["b"]): r["jsd"] for r in motif.divergence(f, "g").collect()}
    assert abs(d["a", "c"]) < 1e-12 and 0 < d["a", "b"] < 1 and abs(d["a", "b"] - d["b", "c"]) < 1e-12
    ic = motif.information_content(df, ["g"], "s", 4).collect()
    assert all(-1e-9 <= r["ic"] <= math.log2(20) + 1e-9 for r in ic)


def test_logistic_separates_and_never_sees_its_group(spark):
    rnd = random.Random(9)
    rows = [(f"g{i % 4}", i, int(i % 8 >= 4), (i % 8 >= 4) * 2.0 + rnd.gauss(0, 0.3), rnd.random()) for i in range(80)]
    df = spark.createDataFrame(rows, "g string, i int, y int, a double, b double")
    for f in (learn.logo_predictions, learn.boosting_logo):
        out = f(df, "g", ["i"], "y", ["a", "b"])
        assert out.count() == 80
        assert metrics.auroc(out, "label", "score").first()["auroc"] > 0.95
    assert learn.logo_predictions(df, "g", ["i"], "y", ["a", "b"], components=1).count() == 80
    w = {r["feature"]: r["coef"] for r in learn.logistic_coefficients(df, "y", ["a", "b"]).collect()}
    assert w["a"] > abs(w["b"])


def test_leakage_and_membership_with_nulls(spark):
    a = spark.createDataFrame([("x", "p", 1), ("y", "p", 1), ("y", "p", 0), (None, "q", 0), ("x", None, 1)], "g string, e string, y int")
    t = spark.createDataFrame([("x", "p"), ("x", "p"), (None, None)], "g string, e string")
    got = sorted((str(r["g"]), str(r["e"]), r["y"], r["in_train"]) for r in joins.leakage_flag(a, t, "g", "e", "y").collect())
    assert got == sorted([("x", "p", 1, True), ("y", "p", 1, False), ("y", "p", 0, True), ("None", "q", 0, False), ("x", "None", 1, False)])


def test_average_linkage_and_representatives(spark):
    d = {("a", "b"): 1.0, ("a", "c"): 9.0, ("b", "c"): 8.0, ("a", "d"): 9.5, ("b", "d"): 8.5, ("c", "d"): 2.0}
    pairs = spark.createDataFrame([(x, y, v) for (x, y), v in d.items()], "a string, b string, d double")
    got = {r["member"]: r["class"] for r in select.linkage_classes(pairs, "a", "b", "d", 2).collect()}
    assert got == {"a": 0, "b": 0, "c": 1, "d": 1}
    three = {r["member"]: r["class"] for r in select.linkage_classes(pairs, "a", "b", "d", 3).collect()}
    assert three == {"a": 0, "b": 0, "c": 1, "d": 2}
    w = spark.createDataFrame([("b", 5), ("c", 1)], "g string, n int")
    rep = {r["class"]: r["member"] for r in select.class_representatives(select.linkage_classes(pairs, "a", "b", "d", 2), w, "g", "n", ["d"]).collect()}
    assert rep == {0: "b", 1: "d"}


@pytest.mark.parametrize("length, most, alphabet", [(1, 1, "ACD"), (3, 0, "ACD"), (5, 2, "ACDEF"), (9, 2, "ACDEFGHIKLMNPQRSTVWY"), (9, 2, "aé😀X"), (14, 1, "AC"), (30, 2, "ACDEFGHIKLMNPQRSTVWY")])
def test_representatives_by_places_are_those_by_comparison(length, most, alphabet):
    rnd = random.Random(length)
    made = {"".join(rnd.choices(alphabet, k=length)) for _ in range(300)}
    for t in sorted(made):
        at = rnd.randrange(length)
        made.add(t[:at] + rnd.choice(alphabet) + t[at + 1 :])
    codes = select._codes(sorted(made))
    assert select._by_places(codes, most) == select._by_comparison(codes, most)


def test_a_large_block_is_clustered_in_linear_time():
    rnd = random.Random(7)
    texts = sorted({"".join(rnd.choices("ACDEFGHIKLMNPQRSTVWY", k=9)) for _ in range(150_000)})
    texts = sorted({*texts, *(t[:4] + "CC" + t[6:] for t in texts[:5000])})
    began = time.time()
    reps = select._first_representative(texts, 2)
    assert time.time() - began < 60  # many minutes, when each was compared with all representatives
    assert all(r == i or reps[r] == r < i and sum(a != b for a, b in zip(texts[r], texts[i])) <= 2 for i, r in enumerate(reps)) and len(set(reps)) < len(texts)


def test_many_models_are_compared_in_blocks(spark, monkeypatch):
    """Models lack keys, have ties, or have one value only, for which rho is undefined."""
    rnd = random.Random(8)
    rows = [(f"m{i}é", p, float(rnd.randint(0, 6)) if i % 9 else 1.0) for i in range(40) for p in range(1, 9) if rnd.random() < (0.95 if i % 4 else 0.5)]
    df = spark.createDataFrame([*rows, ("m1é", 98, None), (None, 1, 2.0), ("m2é", 99, None)], "m string, p int, v double")
    monkeypatch.setattr(stats, "BLOCK", 7)
    has = {m: {p: v for x, p, v in rows if x == m} for m, _, _ in rows}
    rank = lambda v: [sum(y < x for y in v) + (sum(y == x for y in v) + 1) / 2 for x in v]
    for least in (0, 5):
        want = {}
        for a in has:
            for b in has:
                both = sorted(set(has[a]) & set(has[b]))
                if a < b and len(both) >= max(least, 1):
                    x, y = (np.array(rank([has[m][p] for p in both])) for m in (a, b))
                    want[a, b] = (len(both), round(float(np.corrcoef(x, y)[0, 1]), 9) if x.std() * y.std() else None)
        found = [tuple(r) for r in stats.pairwise_spearman(df, "m", ["p"], "v", least).collect()]
        assert {(a, b): (n, rho if rho is None else round(rho, 9)) for a, b, n, rho in found} == want and len(found) == len(want) > 300
    assert any(rho is None for _, rho in want.values())


def test_pairs_of_many_models_are_never_joined_by_key(spark, monkeypatch):
    """The rows of a join would be the square of the models times the keys."""
    rnd = random.Random(9)
    df = spark.createDataFrame([(i, p, rnd.random()) for i in range(600) for p in range(9)], "m int, p int, v double")
    monkeypatch.setattr(stats, "spearman", None)
    out = stats.pairwise_spearman(df, "m", ["p"], "v", 5)
    assert out.dtypes[0] == ("a", "int") and out.filter("a < b AND n = 9 AND abs(rho) <= 1").count() == 600 * 599 // 2
