import random
import re

from pyspark.sql import functions as F

from rankstead.llm import dedup


def brute(rows):
    """rows: (id, a, b, x). Returns {(first, copy)}."""
    canon = lambda t: None if t is None else re.sub(r"[\W_]", "", t).lower()
    classes = {}
    for i, a, b, x in rows:
        key = (tuple(sorted((repr(canon(a)), repr(canon(b))))), x)
        classes.setdefault(key, []).append(i)
    return {(min(v), i) for v in classes.values() for i in v if i != min(v)}


def test_copies_equal_brute_force_with_a_hot_class(spark):
    rnd = random.Random(1)
    dress = lambda t: "".join(c.upper() if rnd.random() < 0.3 else c + rnd.choice(["", "", "-", " ", "_"]) for c in t)
    rows = []
    for i in range(600):
        hot = rnd.random() < 0.4
        a, b = ("hla", "pep") if hot else (f"h{rnd.randrange(9)}", f"p{rnd.randrange(9)}")
        if rnd.random() < 0.3:
            a, b = b, a
        if rnd.random() < 0.5:
            a, b = dress(a), dress(b)
        if rnd.random() < 0.1:
            b = rnd.choice([None, "", "--"])
        rows.append((i, a, b, rnd.choice([None, 1.5])))
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "row_id int, a string, b string, x double").repartition(5)
    got = [(r["first_id"], r["copy_id"]) for r in dedup.copies(df, "row_id", ["a", "b"], ["x"]).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    one = dedup.collapse(df, "row_id", ["a", "b"], ["x"]).collect()
    assert sum(r["n_copies"] for r in one) == 600 and len(one) == 600 - len(got)
    assert {r["first_id"] for r in one} == {i for i, *_ in rows} - {c for _, c in got}


def test_edges(spark):
    df = spark.createDataFrame([(2, None, None), (1, None, None), (3, "", None), (4, "ab" * 100_000, "x"), (5, "x", "AB" * 100_000)], "row_id int, a string, b string")
    df = df.withColumn("_raw", F.lit("clash")).withColumn("n_raw", F.lit(0)).withColumn("first_id", F.lit(-1))
    assert {(r[0], r[1]) for r in dedup.copies(df, "row_id", ["a", "b"]).select("first_id", "copy_id").collect()} == {(1, 2), (4, 5)}
    assert dedup.copies(df.limit(0), "row_id", ["a", "b"]).count() == dedup.collapse(df.limit(0), "row_id", ["a", "b"]).count() == 0


def test_minus_zero_and_nan_are_compared_as_grouping_does(spark):
    df = spark.createDataFrame([(1, "a", 0.0), (2, "a", -0.0), (3, "A", 0.0), (4, "a", -0.0), (5, "a", float("nan")), (6, "a ", float("nan")), (7, "a", None)], "i int, t string, x double")
    assert {(r["first_id"], r["copy_id"]) for r in dedup.copies(df, "i", ["t"], ["x"]).collect()} == {(1, 2), (1, 3), (1, 4), (5, 6)}
    assert sorted(r["n_copies"] for r in dedup.collapse(df, "i", ["t"], ["x"]).collect()) == [1, 2, 4]
