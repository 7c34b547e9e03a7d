import random

from rankstead.llm import overlap


def test_pairs_equal_brute_force_in_one_and_many_shards(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("ABC") for _ in range(rnd.randint(0, 9)))
    ev = [(i, rnd.choice([word(), word().lower(), None, "HOTHOTHO"])) for i in range(60)]
    tr = [(1000 + i, rnd.choice([word(), f" {word()}\t", None, "HOTHOTHx"])) for i in range(300)]
    e, t = spark.createDataFrame(ev, "test_id int, p string"), spark.createDataFrame(tr, "train_id int, p string").repartition(3)
    want = set()
    for i, a in ev:
        for j, b in tr:
            if a is not None and b is not None:
                x, y = a.strip().upper(), b.strip().upper()
                if len(x) == len(y) and sum(c != d for c, d in zip(x, y)) <= 2:
                    want.add((i, j))
    got = [(r["eval_id"], r["train_id"]) for r in overlap.cross_split_overlaps(e, "test_id", "p", t, "train_id", "p").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    near = overlap.near_texts(t, "train_id", "p", e, "p", 2, texts_per_shard=7)
    texts = {i: a.strip().upper() for i, a in ev if a is not None}
    assert {(r["train_id"], r["eval_text"]) for r in near.collect()} == {(j, texts[i]) for i, j in want}
    cov = {r["eval_id"]: r for r in overlap.coverage(e, "test_id", "p", t, "train_id", "p").collect()}
    for i, a in ev:
        assert cov[i]["n_train"] == sum(x == i for x, _ in want)
        assert (cov[i]["covered"] is None) == (a is None)


def test_coverage_merges_intervals(spark):
    e = spark.createDataFrame([(1, "ABCDEF")], "i int, p string")
    t = spark.createDataFrame([(1, "ABXXEF"), (2, "ABCDXX"), (3, "XXXXXX")], "i int, p string")
    r = overlap.coverage(e, "i", "p", t, "i", "p").first()
    assert (r["n_train"], r["nearest"], r["covered"]) == (2, 2, 1.0)
    assert overlap.coverage(e, "i", "p", t.limit(0), "i", "p").first()["covered"] == 0
    assert overlap.cross_split_overlaps(e.limit(0), "i", "p", t, "i", "p").count() == 0


def test_long_texts(spark):
    long = "ACDEFGHIKL" * 5000
    e = spark.createDataFrame([(1, long)], "i int, p string")
    t = spark.createDataFrame([(1, long[:-1] + "X"), (2, long + "A"), (3, "X" * 3 + long[3:])], "i int, p string")
    assert [r["train_id"] for r in overlap.cross_split_overlaps(e, "i", "p", t, "i", "p").collect()] == [1]


def test_passages_inside_longer_texts_and_many_shards(spark, monkeypatch):
    rnd = random.Random(4)
    word = lambda lo, hi: "".join(rnd.choice("ABC") for _ in range(rnd.randint(lo, hi)))
    ev = [(i, word(0, 9)) for i in range(40)] + [(90, None)]
    tr = [(1000 + i, word(0, 30)) for i in range(120)] + [(5000, None)]
    e, t = spark.createDataFrame(ev, "i int, p string"), spark.createDataFrame(tr, "j int, p string").repartition(3)
    near, letters = {}, {}
    for i, a in ev:
        for j, b in tr:
            if a is None or b is None:
                continue
            for at in range(len(b) - len(a) + 1):
                same = [x == y for x, y in zip(a, b[at : at + len(a)])]
                if len(a) - sum(same) <= 2:
                    near[i, j] = min(len(a) - sum(same), near.get((i, j), 9))
                    letters.setdefault(i, set()).update(k for k, s in enumerate(same) if s)
    monkeypatch.setattr(overlap, "LETTERS_HELD", 200)
    for shards in (200_000, 7):
        monkeypatch.setattr(overlap, "TEXTS_PER_SHARD", shards)
        found = overlap.near_texts(t, "j", "p", e, "p", 2, texts_per_shard=shards, inside=True).collect()
        texts = {}
        for i, a in ev:
            texts.setdefault(a, []).append(i)
        assert {(i, r["train_id"]): r["mismatches"] for r in found for i in texts[r["eval_text"]]} == near
        cov = {r["eval_id"]: r for r in overlap.coverage(e, "i", "p", t, "j", "p", inside=True).collect()}
        for i, a in ev:
            n = [d for (x, _), d in near.items() if x == i]
            assert (cov[i]["n_train"], cov[i]["nearest"]) == (len(n), min(n) if n else None)
            assert cov[i]["covered"] == (None if a is None else len(letters.get(i, ())) / len(a) if a else 0)
