import random

import numpy as np
from pyspark.sql import functions as F

from rankstead.operators.skew import lookup_skew_safe, positions_within
from rankstead.operators.weighted import compress_values, heavy_keys, per_key_percentiles, per_key_summary


def test_hot_lookup_equals_plain_join(spark):
    rnd = random.Random(1)
    rows = [(i, "hot" if rnd.random() < 0.4 else f"k{rnd.randrange(500)}") for i in range(3000)] + [(9999, None)]
    df = spark.createDataFrame(rows, "i int, k string")
    t = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("m"))
    got = {(r["i"], r["m"]) for r in lookup_skew_safe(df, t, ["k"], "n", hot_share=0.05).collect()}
    first = {}
    for i, k in rows:
        first.setdefault(k, i)
    assert got == {(i, first[k]) for i, k in rows if k is not None}
    left = lookup_skew_safe(df, t.filter("k <> 'k1'"), ["k"], "n", "left", hot_share=0.05)
    assert left.count() == len(rows)


def test_positions_of_a_huge_group_and_null_groups(spark):
    rows = [("a", i) for i in range(2000)] + [("b", 5), (None, 7), (None, 3)]
    df = spark.createDataFrame(rows, "g string, v int").repartition(7)
    got = {(r["g"], r["v"]): r["position"] for r in positions_within(df, ["g"], ["v"]).collect()}
    assert all(got["a", i] == i + 1 for i in range(2000))
    assert (got["b", 5], got[None, 3], got[None, 7]) == (1, 1, 2)
    assert positions_within(df.limit(0), ["g"], ["v"]).count() == 0
    whole = {r["v"]: r["position"] for r in positions_within(df.filter("g = 'a'"), [], ["v"]).collect()}
    assert whole[1999] == 2000


def test_weighted_results_against_brute_force(spark):
    rnd = random.Random(2)
    rows = [("hot" if rnd.random() < 0.5 else f"k{rnd.randrange(6)}", rnd.choice([None, 1.0, 2.0, 3.5, 7.0]), rnd.choice([0, 1, None])) for _ in range(2000)]
    df = spark.createDataFrame(rows, "key string, value double, label int")
    c = compress_values(df, "key", "value", {"pos": F.col("label") == 1})
    s = {r["key"]: r for r in per_key_summary(c, ["pos"]).collect()}
    p = {r["key"]: r for r in per_key_percentiles(c, [0.0, 0.3, 1.0]).collect()}
    for k in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == k]
        values = [r[1] for r in own if r[1] is not None]
        assert s[k]["n_rows"] == len(own) and s[k]["pos"] == sum(r[2] == 1 for r in own) and s[k]["n_distinct"] == len(set(values))
        assert s[k]["mode_value"] == min(set(values), key=lambda v: (-values.count(v), v))
        for i, q in enumerate((0, 30, 100)):
            assert abs(p[k][f"p{i}"] - np.percentile(values, q)) < 1e-9


def test_weighted_edges(spark):
    df = spark.createDataFrame([(None, "x"), ("a", None), ("a", None)], "key string, value string")
    c = compress_values(df, "key", "value")
    assert {(r["key"], r["n_rows"], r["n_distinct"], r["mode_value"]) for r in per_key_summary(c).collect()} == {(None, 1, 1, "x"), ("a", 2, 0, None)}
    assert [r["key"] for r in heavy_keys(c, 0.5).collect()] == ["a"]
    e = compress_values(df.limit(0), "key", "value")
    assert per_key_summary(e).count() == heavy_keys(e, 0.1).count() == 0
