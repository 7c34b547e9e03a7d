import random

import numpy as np
import pytest

from rankstead.llm import leakage


def word_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rnd.choices(words, k=rnd.randint(15, 40)))) for i in range(30)]
    docs, exact, near = [], set(), set()
    for d in range(300):
        text = rnd.choices(words + ["zz"], k=rnd.randint(0, 60))
        kind = d % 3
        if kind:
            i, t = rnd.choice(items)
            w = t.split()
            k = rnd.randrange(len(w) - 11)
            part = w[k : k + 12]
            if kind == 2:
                for _ in range(2):
                    p = rnd.randrange(len(part))
                    rnd.choice([lambda: part.__setitem__(p, "zz"), lambda: part.pop(p), lambda: part.insert(p, "zz")])()
            at = rnd.randrange(len(text) + 1)
            text = text[:at] + part + text[at:]
            (exact if kind == 1 else near).add((i, d))
        docs.append((d, ("  ,".join(text)).upper() if d % 2 else "_ ".join(text)))
    return items, docs, exact, near


def test_exact_windows_are_never_missed(spark, corpus):
    items, docs, exact, _ = corpus
    it = spark.createDataFrame(items, "item_id int, text string")
    df = spark.createDataFrame(docs + [(900, None), (901, ""), (902, "hi " * 50_000)], "doc_id int, text string").repartition(4)
    got = {(r["item_id"], r["doc_id"]): r["edits"] for r in leakage.leaks(df, "doc_id", "text", it, "item_id", "text").collect()}
    grams = {}
    for i, t in items:
        w = leakage.words_of(t)
        for k in range(len(w) - 11):
            grams.setdefault(tuple(w[k : k + 12]), set()).add(i)
    want = set()
    for d, t in docs:
        w = leakage.words_of(t)
        for k in range(len(w) - 11):
            want |= {(i, d) for i in grams.get(tuple(w[k : k + 12]), ())}
    assert {k for k, e in got.items() if e == 0} == want and exact <= want


def test_edit_distances_are_exact_up_to_the_limit():
    rnd = random.Random(9)
    a = np.array([[rnd.randrange(1, 5) for _ in range(8)] for _ in range(400)])
    b = a.copy()
    for r in b:
        for _ in range(rnd.randrange(4)):
            r[rnd.randrange(8)] = rnd.randrange(0, 5)
        if rnd.random() < 0.5:
            r[:] = np.roll(r, 1)
    got = leakage.edit_distances(a, b, 2)
    for x, y, e in zip(a.tolist(), b.tolist(), got.tolist()):
        want = word_distance(x, [(-9, k) if v == 0 else v for k, v in enumerate(y)])
        assert e == want if want <= 2 else e > 2


def test_short_items_and_blocks(spark, monkeypatch):
    """An item shorter than a window is found as a whole, anywhere in a document, and never passes for twelve words."""
    it = spark.createDataFrame([(1, "one two three four five"), (2, None), (3, ""), (4, "a b c d e f g h"), (5, "five six")], "item_id int, text string")
    df = spark.createDataFrame([(1, "one two three four five"), (2, "six seven"), (3, "zero One, two: three four five six"), (4, "one two three four"), (5, "x a b c d Z f g h y"), (6, "one two three four 5")], "doc_id int, text string")
    want = {(1, 1, 0, 5), (1, 3, 0, 5), (5, 3, 0, 2), (4, 5, 1, 8)}
    for words in (leakage.WORDS_PER_BLOCK, 1):
        monkeypatch.setattr(leakage, "WORDS_PER_BLOCK", words)
        assert {tuple(r) for r in leakage.leaks(df, "doc_id", "text", it, "item_id", "text").select("item_id", "doc_id", "edits", "words").collect()} == want
    assert leakage.leaks(df.limit(0), "doc_id", "text", it, "item_id", "text").count() == 0
    assert leakage.leaks(df, "doc_id", "text", it.limit(0), "item_id", "text").count() == 0


def near_pairs(seed, window, edits, place):
    """Items, and texts that hold one window of an item after ``edits`` edits at a place, between words no item has."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(600)]
    items = [(i, " ".join(rnd.choices(words, k=rnd.randint(window, 30)))) for i in range(40)]
    change = [lambda x, p: x.__setitem__(p, "zz"), lambda x, p: x.pop(p), lambda x, p: x.insert(p, rnd.choice(words))]
    texts = []
    for i, t in items:
        whole = t.split()
        for _ in range(10):
            k = rnd.randrange(len(whole) - window + 1)
            part = whole[k : k + window]
            for _ in range(edits):
                lo, hi = {"start": (0, 3), "middle": (window // 2 - 2, window // 2 + 2), "end": (len(part) - 3, len(part)), "any": (0, len(part))}[place]
                rnd.choice(change)(part, min(rnd.randrange(lo, hi), len(part) - 1))
            texts.append(" ".join(["yy"] * rnd.randrange(4) + part + ["yy"] * rnd.randrange(4)))
    return items, texts


def brute(items, texts, window, most):
    """(text, item): fewest edits of windows of both, each compared with each."""
    rows = [(i, w[k : k + window]) for i, t in items for w in [leakage.words_of(t)] for k in range(len(w) - window + 1)]
    ids = {}
    code = lambda ws: [ids.setdefault(w, len(ids) + 1) for w in ws]
    item_rows, owners = np.array([code(r) for _, r in rows]), np.array([i for i, _ in rows])
    out = {}
    for n, t in enumerate(texts):
        w = code(leakage.words_of(t))
        for k in range(len(w) - window + 1):
            edits = leakage.edit_distances(np.repeat(np.array(w[k : k + window])[None, :], len(item_rows), 0), item_rows, most)
            for i, e in zip(owners[edits <= most].tolist(), edits[edits <= most].tolist()):
                out[n, i] = min(e, out.get((n, i), most + 1))
    return out


@pytest.mark.parametrize("place", ["start", "middle", "end", "any"])
def test_recall_over_near_pairs_only(place):
    """Pairs without an equal window, edits at stated places, three seeds, against all windows with all windows."""
    found = near = 0
    for seed in (1, 2, 3):
        items, texts = near_pairs(seed, 12, 1 + seed % 2, place)
        truth = brute(items, texts, 12, 2)
        got = {(t, i): e for t, i, e, n in leakage.WindowIndex(items).search(texts) if n == 12}
        assert set(got) <= set(truth) and all(e == 0 for k, e in got.items() if truth[k] == 0) and {k for k, e in truth.items() if e == 0} <= set(got)
        near += sum(e > 0 for e in truth.values())
        found += sum(e > 0 and k in got for k, e in truth.items())
    assert near >= 300 and found >= 0.95 * near, (found, near)


def test_repetitions_follow_the_hit_chance():
    assert leakage.repetitions(0.99, 12, 0) == 1
    assert 1 < leakage.repetitions(0.99, 12, 1) < leakage.repetitions(0.99, 12, 2) < leakage.repetitions(0.99, 12, 4)
    assert leakage.repetitions(0.5, 12, 2) < leakage.repetitions(0.99, 12, 2) < leakage.repetitions(0.999, 12, 2)
    assert [leakage.edits_for(n) for n in (1, 5, 6, 11, 12, 40)] == [0, 0, 1, 1, 2, 2]


def test_a_passage_that_all_items_share_and_a_crowded_bucket(monkeypatch):
    monkeypatch.setattr(leakage, "PAIRS", 50)
    shared = " ".join(f"s{i}" for i in range(14))
    items = [(i, f"{shared} own{i}") for i in range(200)]
    got = leakage.WindowIndex(items).search([f"x {shared} y", None, "", "s1 s2"])
    assert {(t, i) for t, i, e, n in got if e == 0} == {(0, i) for i in range(200)}


def test_words_of_long_texts_are_read_in_parts(monkeypatch):
    items = [(1, " ".join(f"w{i}" for i in range(15)))]
    text = "Über_w0, " * 30 + items[0][1].upper() + " end" * 40
    index = leakage.WindowIndex(items)
    want = index._ids(text)
    assert want == [index.vocabulary.get(w, 0) for w in leakage.words_of(text)]
    for n in (1, 7, 50):
        monkeypatch.setattr(leakage, "LONG_TEXT", n)
        assert index._ids(text) == want and index._ids("") == index._ids(None) == []
    assert [(t, i, e) for t, i, e, _ in index.search([text])] == [(0, 1, 0)]
