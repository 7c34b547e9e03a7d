import hashlib
import math
import random
import time
from collections import Counter

import numpy as np

from rankstead.operators import select
from rankstead.operators.motif import AMINO_ACIDS
from rankstead.plans import sequences


def test_hard_decoys_come_from_the_pool_of_other_alleles(spark, tmp_path):
    rnd = random.Random(3)
    made = {a: {"".join(rnd.choice(second if i == 1 else last if i == 8 else AMINO_ACIDS) for i in range(9)) for _ in range(n)} for a, second, last, n in (("A", "LMIVA", "VLIKY", 300), ("B", "LPMRA", "LKFVI", 300), ("C", AMINO_ACIDS, AMINO_ACIDS, 20))}
    rows = [(a, p, 1) for a in made for p in sorted(made[a])] + [("A", "LLLLLLLLL", 0)]
    spark.createDataFrame(rows, "allele string, peptide string, label int").write.parquet(str(tmp_path / "atlas_labelled.parquet"))
    got = {}
    for r in sequences.QUERIES["hard_decoy_pool"](spark, str(tmp_path)).orderBy("allele", "place").collect():
        got.setdefault(r["allele"], []).append(r["peptide"])
    want = {}
    for a in "AB":
        own = made[a]
        counts = [Counter(p[i] for p in own) for i in range(9)]
        score = lambda p: sum(math.log2((counts[i][x] + 0.5) / (len(own) + 10) * 20) for i, x in enumerate(p))
        top = [sorted(AMINO_ACIDS, key=lambda x: (counts[i][x], x))[-4:] for i in (1, 8)]
        cut = np.percentile([score(p) for p in own], 50)
        low = sorted(p for p in set().union(*made.values()) - own if p[1] in top[0] and p[8] in top[1] and score(p) <= cut + 1e-9)
        assert len(low) > 6
        taken = low[:1]
        while len(taken) < 6:
            taken.append(max((p for p in low if p not in taken), key=lambda p: (min(sum(x != y for x, y in zip(p, q)) for q in taken), -low.index(p))))
        want[a] = taken
    assert got == want


def test_near_pairs_of_every_split_are_found(spark, data):
    splits = {r["test_id"]: r for r in sequences.tests(spark, data).collect()}
    train = [(r["train_id"], r["peptide"]) for r in sequences.train_pairs(spark, data).collect() if r["peptide"]]
    want = set()
    for i, t in splits.items():
        for j, p in train:
            if len(p) == len(t["peptide"]) and (h := sum(x != y for x, y in zip(p, t["peptide"]))) <= 2:
                want.add((i, j, h))
    got = [tuple(r) for r in sequences.QUERIES["hamming_join"](spark, data).select("left_id", "right_id", "distance").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert len({splits[i]["fold_set"] for i, _, _ in want}) > 1


def windows_by_hand(texts, need, exclude, seed):
    out = set()
    for n, k in need:
        found = {t[i : i + n] for t in texts if t for i in range(len(t) - n + 1)} - set(exclude)
        free = sorted((hashlib.md5(f"{seed}|{w}".encode()).hexdigest(), w) for w in found if set(w) <= set(AMINO_ACIDS))
        out |= {(w, n) for _, w in free[:k]}
    return out


def test_window_negatives_read_a_long_text_in_linear_time(spark):
    rnd = random.Random(5)
    texts = ["".join(rnd.choices(AMINO_ACIDS, k=400_000)), "ACDX" * 60, "ACD", None, ""]
    need, exclude = [(8, 50), (9, 100)], [texts[0][i : i + 8] for i in range(0, 4000, 3)]
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    began = time.time()
    got = select.window_negatives(frame([(t,) for t in texts], "t string"), "t", frame(need, "length int, k int"), frame([(x,) for x in exclude], "s string"), "s", 3).collect()
    assert time.time() - began < 120  # minutes, when every window was counted off from the start of its text
    assert len(got) == 150 and {tuple(r) for r in got} == windows_by_hand(texts, need, exclude, 3)


def test_window_negatives_are_drawn_from_all_windows(spark):
    """Few distinct windows among many, others excluded, lengths beyond a piece or a text, more wanted than there are."""
    rnd = random.Random(6)
    texts = ["ACDEFGHIK" * 300, "".join(rnd.choices("ACx", k=1500)), "".join(rnd.choices(AMINO_ACIDS, k=700)), "Aé😀CDEFGHIKL" * 20, None]
    need, exclude = [(3, 40), (8, 9), (99, 5), (150, 7), (651, 100), (2800, 3)], ["ACDEFGHI", "CDEFGHIK", "AAA", texts[2][:99]]
    got = select.window_negatives(spark.createDataFrame([(t,) for t in texts], "t string"), "t", spark.createDataFrame(need, "length int, k int"), spark.createDataFrame([(x,) for x in [*exclude, None]], "s string"), "s", 1).collect()
    assert {tuple(r) for r in got} == windows_by_hand(texts, need, exclude, 1) and len(got) == len({tuple(r) for r in got})
