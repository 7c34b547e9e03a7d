import random

import pytest
from pyspark.sql import functions as F

from rankstead.llm import splits


def brute_components(links):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for u, v in links:
        up[find(u)] = find(v)
    return {x: find(x) for x in list(up)}


@pytest.mark.parametrize("shape", ["random", "path", "star", "small", "empty"])
def test_roots_equal_components_over_many_levels(spark, shape):
    rnd = random.Random(3)
    links = {
        "random": [(rnd.randrange(400), rnd.randrange(400)) for _ in range(300)],
        "path": [(i, i + 1) for i in range(300)],
        "star": [(0, i) for i in range(1, 300)] + [(500, 501)],
        "small": [(3 * i, 3 * i + 1) for i in range(150)] + [(3 * i + 1, 3 * i + 2) for i in range(150)],
        "empty": [],
    }[shape]
    df = spark.createDataFrame(links, "u bigint, v bigint")
    got = {r["node"]: r["root"] for r in splits.connected_roots(df, links_per_task=40).collect()}
    want = brute_components([(u, v) for u, v in links if u != v])
    assert set(got) == set(want)
    pairs = {(want[x], got[x]) for x in got}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def rows(n, seed):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        pep = rnd.choice([None, "HOT", f" p{rnd.randrange(n)}\t", f"P{rnd.randrange(n)}"]) if rnd.random() < 0.5 else f"u{i}"
        out.append((i, pep, rnd.choice([None, "A", "B"]), rnd.choice([None, f"s{rnd.randrange(n)}"])))
    return out


def keys():
    return [[F.upper(F.regexp_replace("pep", r"^\s+|\s+$", ""))], [F.col("al"), F.col("sa")]]


def test_groups_and_splits(spark):
    data = rows(500, 4)
    df = spark.createDataFrame(data, "row_id bigint, pep string, al string, sa string").repartition(3).withColumn("row", F.lit("clash"))
    groups = splits.cut_lineage(splits.related_groups(df, "row_id", keys(), links_per_task=30))
    got = {r["row_id"]: r["first_id"] for r in groups.collect()}
    links = [(i, i) for i, *_ in data]
    for i, p, a, s in data:
        if p is not None:
            links.append((i, "p" + p.strip().upper()))
        if a is not None and s is not None:
            links.append((i, (a, s)))
    want = brute_components(links)
    first = {}
    for i, *_ in data:
        first.setdefault(want[i], i)
    assert got == {i: first[want[i]] for i, *_ in data}
    placed = splits.assign_splits(groups, {"train": 0.8, "validation": 0.1, "test": 0.1}).collect()
    assert len(placed) == 500 and all(len({r["split"] for r in placed if r["first_id"] == g}) == 1 for g in set(got.values()))


def test_greedy_is_the_greedy(spark):
    rnd = random.Random(5)
    for _ in range(30):
        deficits = [rnd.randrange(-50, 300) for _ in range(3)]
        size, count = rnd.randrange(1, 20), rnd.randrange(1, 40)
        d, want = list(deficits), [0, 0, 0]
        for _ in range(count):
            i = max(range(3), key=lambda k: d[k])
            d[i] -= size
            want[i] += 1
        got = splits.take_largest(list(deficits), size, count)
        assert sum(got) == count and sorted(x - g * size for x, g in zip(deficits, got)) == sorted(d)


def test_shares_are_met_when_groups_are_small(spark):
    g = spark.range(1000).select(F.col("id").alias("row_id"), (F.col("id") - F.col("id") % 2).alias("first_id"))
    n = {r["split"]: r["count"] for r in splits.assign_splits(g, {"train": 0.8, "validation": 0.1, "test": 0.1}).groupBy("split").count().collect()}
    assert n == {"train": 800, "validation": 100, "test": 100}


def test_empty_and_all_null(spark):
    df = spark.createDataFrame([(7, None, None, None), (8, None, "A", None)], "row_id bigint, pep string, al string, sa string")
    assert {(r["row_id"], r["first_id"]) for r in splits.related_groups(df, "row_id", keys()).collect()} == {(7, 7), (8, 8)}
    assert splits.related_groups(df.limit(0), "row_id", keys()).count() == 0
    assert splits.assign_splits(splits.related_groups(df.limit(0), "row_id", keys()), {"a": 1.0}).count() == 0


def test_one_tie_alone_and_least_tasks(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, None), (4, "b")], "i int, k string")
    assert {tuple(r) for r in splits.related_groups(df, "i", [[F.col("k")]]).select("row_id", "first_id").collect()} == {(3, 1), (1, 1), (2, 2), (4, 4)}
    links = spark.createDataFrame([(i, i + 1) for i in range(50)], "u bigint, v bigint")
    for tasks in (1, 5):
        assert splits.connected_roots(links, least_tasks=tasks).select("root").distinct().count() == 1
