import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankstead import views
from rankstead.functions.sequence import AMINO_ACIDS
from rankstead.operators import compose, joins, learn, metrics, stats


def hamming(a, b):
    return sum(x != y for x, y in zip(a, b))


def greedy(pool, k, far=hamming):
    taken = pool[:1]
    while len(taken) < min(k, len(pool)):
        rest = [p for p in pool if p not in taken]
        taken.append(max(rest, key=lambda p: (min(far(p, t) for t in taken), -pool.index(p))))
    return taken


@pytest.fixture(scope="module")
def own(spark):
    rnd = random.Random(5)
    made = {a: sorted({"".join(rnd.choice(second if i == 1 else last if i == 8 else AMINO_ACIDS) for i in range(9)) for _ in range(120)}) for a, second, last in (("A", "LMIVA", "VLIKY"), ("B", "LPMRA", "LKFVI"), ("C", AMINO_ACIDS, AMINO_ACIDS), ("D", "DE", "RK"))}
    return made, spark.createDataFrame([(a, p) for a in made for p in made[a]], "g string, p string")


def profile(peptides):
    counts = [Counter(p[i] for p in peptides) for i in range(9)]
    score = lambda p: sum(math.log((counts[i][x] + 0.5) / (len(peptides) + 10) * 20) for i, x in enumerate(p))
    return counts, score


def test_hard_clean_and_donor_candidates(spark, own):
    made, df = own
    dist = {("A", "B"): 0.1, ("A", "C"): 0.4, ("A", "D"): 0.9, ("B", "C"): 0.4, ("B", "D"): 0.2, ("C", "D"): 0.4}
    pairs = spark.createDataFrame([(a, b, d) for (a, b), d in dist.items()], "a string, b string, d double")
    hard, clean = {}, {}
    for r in compose.hard_candidates(df, "g", "p", 9).collect():
        hard.setdefault(r["g"], set()).add(r["p"])
    for r in compose.clean_candidates(df, pairs, "g", "p", 9, donors=2).collect():
        clean.setdefault(r["g"], set()).add(r["p"])
    every = set().union(*made.values())
    for g, own_p in made.items():
        counts, score = profile(own_p)
        top = {i: sorted(AMINO_ACIDS, key=lambda x: (counts[i][x], x))[-4:] for i in (1, 8)}
        top = {i: [x for x in t if counts[i][x]] for i, t in top.items()}
        low = lambda q: {p for p in every if score(p) <= np.percentile([score(x) for x in own_p], q) + 1e-8}
        assert hard.get(g, set()) == {p for p in low(50) - set(own_p) if p[1] in top[1] and p[8] in top[8]}
        far = sorted((x for x in made if x != g), key=lambda x: (-dist[tuple(sorted((g, x)))], x))
        donors = {p for x in far[:2] for p in made[x]}
        assert clean.get(g, set()) == {p for p in donors & low(25) if p[1] not in top[1] and p[8] not in top[8]}
        got = {(r["donor"], r["p"]) for r in compose.donor_candidates(df, pairs, "g", "p").filter(F.col("g") == g).collect()}
        assert got == {(far[0], p) for p in made[far[0]]}
    picked = compose.decoys(compose.donor_candidates(df, pairs, "g", "p").filter("g = 'A'"), "g", "p", 3).orderBy("place").collect()
    assert [r["p"] for r in picked] == greedy(made["D"], 3)


def test_diverse_and_canonical_sets(spark, own):
    made, df = own
    names = {"A": "LLLL", "B": "LLLV", "C": "VVVV", "D": "LLLL"}
    cons = spark.createDataFrame(list(names.items()), "g string, c string")
    groups = [r["g"] for r in compose.diverse_groups(cons, "g", "c", 3, ["B"]).orderBy("place").collect()]
    assert groups == ["B", "C", "A"]  # A and D are as far: the earlier name
    got = {}
    for r in compose.diverse_set(df, cons, "g", "p", "c", 2, 4, ["B"]).orderBy("g", "place").collect():
        got.setdefault(r["g"], []).append(r["p"])
    assert got == {g: greedy(made[g], 4) for g in ("B", "C")}
    got = {}
    for r in compose.canonical_set(df, cons, "g", "p", "c", 9, 2, 3, 0.1, ["B"]).orderBy("g", "place").collect():
        got.setdefault(r["g"], []).append(r["p"])
    for g in ("B", "C"):
        _, score = profile(made[g])
        best = sorted(made[g], key=lambda p: (round(score(p), 9), p), reverse=True)[: max(3, int(len(made[g]) * 0.1))]
        assert got[g] == greedy(best, 3)
    assert compose.diverse_set(df.limit(0), cons, "g", "p", "c", 2, 4).count() == 0


def test_panels(spark):
    rnd = random.Random(3)
    rows = [(f"n{i:02d}", rnd.random(), rnd.random(), i % 5 > 0) for i in range(60)] + [("kept", 0.5, None, False), ("null", None, 0.1, True)]
    df = spark.createDataFrame(rows, "n string, score double, spread double, eligible boolean")
    p = compose.panel_by_score(df, "n", "score", "spread", 12, 4, ["n00", "n07"]).orderBy("place").collect()
    assert [r["n"] for r in p[:2]] == ["n00", "n07"] and len(p) == 12 == len({r["n"] for r in p}) and Counter(r["stratum"] for r in p) == {-1: 2, 0: 3, 1: 3, 2: 2, 3: 2}
    ok = {n: s for n, s, v, e in rows if e and s is not None and v is not None}
    assert all(r["n"] in ok for r in p[2:])
    lo, hi = min(ok.values()), max(ok.values())
    for r in p[2:]:
        assert lo + (hi - lo) * r["stratum"] / 4 - 1e-9 <= ok[r["n"]] <= lo + (hi - lo) * (r["stratum"] + 1) / 4 + 1e-8
    q = compose.panel_by_isolation(df, "n", "score", 9, [3, 1, 1], ["n00"]).orderBy("place").collect()
    assert Counter(r["stratum"] for r in q) == {-1: 1, 0: 6, 1: 1, 2: 1}
    top = sorted((n for n, s, _, e in rows if e and s is not None), key=lambda n: -dict((r[0], r[1]) for r in rows)[n])
    assert [r["n"] for r in q if r["stratum"] == 0] == top[:6]
    few = compose.panel_by_score(df.filter("n < 'n06'"), "n", "score", "spread", 30, 4, []).collect()
    assert sorted(r["n"] for r in few) == [f"n0{i}" for i in range(1, 5)]


def test_ablation_cells_and_requirements(spark):
    rows = [(i, ("T", "T2", "X")[i % 3], i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, g string, y int")
    got = {}
    for r in compose.ablation_cells(df, "g", "y", ["i"], "T", F.col("g").startswith("T"), 4).collect():
        got.setdefault(r["cell"], []).append((r["g"], r["y"]))
    n = {c: Counter(v) for c, v in got.items()}
    assert n["full"] == Counter((g, y) for _, g, y in rows)
    assert n["removed"] == Counter((g, y) for _, g, y in rows if g != "T2")
    assert n["starved"] == Counter((g, y) for _, g, y in rows if g != "T") + Counter({("T", 0): 4, ("T", 1): 4})
    assert n["both"] == Counter((g, y) for _, g, y in rows if g == "X") + Counter({("T", 0): 4, ("T", 1): 4})
    with pytest.raises(ValueError, match="nothing"):
        compose.require(df, "nothing left", F.col("i") > 99)
    with pytest.raises(ValueError, match="unknown"):
        compose.require_all(df, df.filter("g <> 'X'"), ["g"], "unknown groups")
    assert compose.require_all(df, df, ["g"], "").count() == compose.require(df, "").count() == 60


def test_measured_set_and_first_rows(spark):
    rows = [("A", "P1", 1.0, "="), ("A", "P2", 1.0, "<"), ("A", "P3", 9000.0, ">"), ("A", "P4", 9000.0, "="), ("A", "P1", 9000.0, "="), ("A", "P5", 1.0, "="), ("A", "KN", 1.0, "="), ("B", "P1", 1.0, "="), ("A", "P6", 60.0, "<"), ("A", "P7", None, "=")]
    df = spark.createDataFrame(rows, "g string, p string, v double, r string")
    drawn, report = compose.measured_set(df, "g", "p", "v", "r", spark.createDataFrame([("KN",)], "p string"), 2, 50.0, 5000.0)
    assert {(r["p"], r["label"]) for r in drawn.collect()} == {("P2", 1), ("P5", 1), ("P3", 0), ("P4", 0)}
    assert {(r["g"], r["n_pos"], r["n_neg"], r["taken"]) for r in report.collect()} == {("A", 2, 2, True), ("B", 1, 0, False)}
    f = joins.first_rows(spark.createDataFrame([(3, "a", "x"), (1, "a", None), (2, None, "z")], "i int, k string, v string"), ["k"], "i")
    assert {tuple(r) for r in f.select("i", "k", "v").collect()} == {(1, "a", None), (2, None, "z")}


def test_statistics_in_tables(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 4, 7)] + [("b", 1.0), ("c", None)], "g string, v double")
    got = {r["g"]: r for r in stats.one_sample_t(df, "v", ["g"]).collect()}
    assert abs(got["a"]["t"] - 3.5 / (np.std([1, 2, 4, 7], ddof=1) / 2)) < 1e-12 and 0.05 < got["a"]["p"] < 0.1  # t of 3.182 and 2.353 at 3 degrees of freedom
    assert got["b"]["p"] is None and got["c"]["n"] == 0
    r = spark.createDataFrame([(0.5, 30), (1.0, 9), (None, 9), (0.1, 2)], "r double, n int")
    p = [x["p"] for x in stats.with_correlation_p(r, "r", "n").collect()]
    assert abs(p[0] - 0.00489) < 1e-4 and p[1] == 0.0 and p[2] is None and p[3] is None
    m = spark.createDataFrame([(1, 3.0), (1, 4.0), (1, 5.0), (0, 1.0), (0, 2.0), (0, 3.0)], "y int, s double")
    u = stats.mann_whitney(m, "y", "s").first()
    assert abs(u["auroc"] - 8.5 / 9) < 1e-12 and abs(u["p"] - 0.1212) < 2e-2
    x = [(float(i), float(i * i), "uvw"[i % 3]) for i in range(12)]
    d = spark.createDataFrame(x, "y double, a double, k string")
    o = {r["term"]: r for r in stats.ols(d, "y", {"a": F.col("a"), **stats.dummies(d, "k")}).collect()}
    design = np.array([[1, a, k == "v", k == "w"] for _, a, k in x], dtype=float)
    beta, *_ = np.linalg.lstsq(design, np.array([y for y, *_ in x]), rcond=None)
    assert np.allclose([o[t]["coef"] for t in ("intercept", "a", "k_v", "k_w")], beta)
    resid = np.array([y for y, *_ in x]) - design @ beta
    assert abs(o["a"]["r2"] - (1 - resid @ resid / np.var([y for y, *_ in x]) / 12)) < 1e-9 and o["a"]["n"] == 12
    b = metrics.bundle(m, "y", "s", "s", k=2).first()
    assert (b["n"], b["n_pos"], b["ppv"]) == (6, 3, 1.0)
    assert set(metrics.evaluate(m.withColumns({"g": F.lit("x"), "t": F.lit("z")}), "y", "s", "s", "g", "t")) == {"pooled", "per_group", "strata"}


def test_models_and_blocks(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 1.0), (3, 0.0, 0.5)], "i int, a double, b double")
    got = {r["i"]: r["score"] for r in learn.predict_batches(df, ["i"], ["a", "b"], lambda x: x[:, 0] - x[:, 1]).collect()}
    assert got == {1: -1.0, 2: None, 3: -0.5}
    block = learn.feature_block(df.withColumn("label", F.lit(1)), ["i"], "m", ["a"])
    assert block.columns == ["i", "m__a", "m__b"] and block.first()["m__a"] == -1.0
    assert [r["a"] for r in learn.impute_mean(df, ["a"]).orderBy("i").collect()] == [1.0, 0.5, 0.0]
    assert learn.predict_batches(df.limit(0), ["i"], ["a"], lambda x: x[:, 0]).count() == 0
    steps = [(0.9, "high"), (0.5, "fair")]
    assert [r[0] for r in spark.createDataFrame([(0.95,), (0.5,), (0.1,), (None,)], "v double").select(stats.ladder(F.col("v"), steps, "low")).collect()] == ["high", "fair", "low", None]


def test_sql_surface(spark, data):
    assert "atlas_labelled" in views.register_tables(spark, data)
    views.register_queries(spark, data, ["p2_allele_stats", "leakage_flags"])
    views.register_functions(spark)
    assert spark.sql("SELECT count(*) AS n FROM p2_allele_stats s JOIN data_type_coverage c USING (allele)").first()["n"] > 0
    r = spark.sql("SELECT hamming('ACD', 'ACE') AS h, hamming('A', 'AC') AS u, is_sequence('ACB') AS s, substitute_letter('ACD', 2, 'W') AS w, slug_of_key('HLA-A*02:01') AS g, key_of_slug('hla_a_02_01') AS k, entropy_gate(0) AS e").first()
    assert (r["h"], r["u"], r["s"], r["w"], r["g"], r["k"]) == (1, 2, False, "AWD", "hla_a_02_01", "HLA-A*02:01") and abs(r["e"]) < 1e-9


def test_resampled_aurocs_equal_one_by_one(monkeypatch):
    rng = np.random.default_rng(4)
    y, s, t = rng.integers(0, 2, 40), np.round(rng.normal(size=40), 1), rng.normal(size=40)
    monkeypatch.setattr(stats, "RESAMPLED_CELLS", 300)
    got, draw = stats.resampled_aurocs(y, [s, t], 50, 9), np.random.default_rng(9)
    for k in range(50):
        i = draw.integers(0, 40, 40)
        assert abs(got[0, k] - stats.auroc_numpy(y[i], s[i])) < 1e-12 and abs(got[1, k] - stats.auroc_numpy(y[i], t[i])) < 1e-12
    assert np.isnan(stats.resampled_aurocs(np.ones(3), [np.arange(3.0)], 5, 1)).all()
