import collections
import random

from rankstead.llm import terms


def test_counts_equal_brute_force_with_a_hot_term(spark):
    rnd = random.Random(6)
    pairs = [(rnd.choice(["hot", "", None, f"t{rnd.randrange(300)}"]), rnd.randrange(400)) for _ in range(5000)]
    df = spark.createDataFrame(pairs, "t string, r int").repartition(6)
    occ, rec = collections.Counter(), collections.defaultdict(set)
    for t, r in pairs:
        if t is not None:
            occ[t] += 1
            rec[t].add(r)
    got = {r["term"]: (r["n_occurrences"], r["n_records"]) for r in terms.term_frequencies(df, "t", "r").collect()}
    assert got == {t: (occ[t], len(rec[t])) for t in occ}
    marks = {r["term"]: r["mark"] for r in terms.marked(terms.term_frequencies(df, "t", "r"), 5, 100).collect()}
    assert all(marks[t] == ("rare" if len(rec[t]) <= 5 else "common" if len(rec[t]) >= 100 else None) for t in occ)


def test_runs_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        df = spark.createDataFrame([("a", i) for i in range(20)] + [("b", 1)] + [("c", i) for i in range(7)], "t string, r int")
        assert {(r["term"], r["n_records"]) for r in terms.term_frequencies(df, "t", "r").collect()} == {("a", 20), ("b", 1), ("c", 7)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_words_and_empty(spark):
    docs = spark.createDataFrame([(1, "A b, a"), (2, None), (3, ""), (4, "x" * 300_000)], "doc_id int, text string")
    got = {r["term"]: (r["n_occurrences"], r["n_records"]) for r in terms.term_frequencies(terms.explode_terms(docs, "doc_id", "text"), "term", "record").collect()}
    assert got["a"] == (2, 1) and got["b"] == (1, 1) and len(got) == 3
    assert terms.term_frequencies(docs.limit(0), "text", "doc_id").count() == 0


def test_words_of_any_script_are_counted_and_marked(spark, tmp_path):
    from rankstead.llm import queries

    texts = ["Größe naïve 数える", "größe a", None, "", "café Größe größe"] + ["数える x"] * 25
    spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["term"]: (r["n_occurrences"], r["n_records"], r["mark"]) for r in queries.QUERIES["p6_terms"](spark, str(tmp_path)).collect()}
    assert got == {"größe": (4, 3, None), "naïve": (1, 1, "rare"), "数える": (26, 26, "common"), "a": (1, 1, "rare"), "café": (1, 1, "rare"), "x": (25, 25, "common")}
