"""Order-dependent algorithms: clustering, diversity selection, folds, sampling, mutagenesis and attributions.

What is sequential by nature runs in ``applyInPandas`` on blocks that the operator names (group and length); the order is
always a stated one, so results don't depend on how rows are partitioned.
"""

from __future__ import annotations

import array
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankstead.functions.sequence import AMINO_ACIDS, letters, mosaic, substitute
from rankstead.operators.ranking import hash_order, top_k
from rankstead.operators.skew import cut_lineage, positions_within, tasks_for


def _codes(texts: list[str]) -> np.ndarray:
    """Code points of texts of one length, one row each."""
    n = len(texts[0]) if texts else 0
    return np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).reshape(len(texts), n) if n else np.zeros((len(texts), 0), np.uint32)


def _first_representative(texts: list[str], most: int) -> list[int]:
    """For texts of one length in order: the number of the first representative within ``most`` mismatches.

    Two texts are within ``most`` mismatches if they agree when some ``most`` places are left out. There are few choices of
    places for short texts, and the work is then linear in the texts; else each is compared with all representatives.
    """
    n, length = len(texts), len(texts[0]) if texts else 0
    choices = math.comb(length, min(most, length))
    return _by_places(_codes(texts), min(most, length)) if choices * COMPARED_BY_CHOICE < n else _by_comparison(_codes(texts), most)


#: Comparisons of two texts that cost as much as looking up a text by one choice of places; texts looked up at once.
COMPARED_BY_CHOICE, LOOKED_UP_AT_ONCE = 20, 20_000


def _same(columns: list[np.ndarray]) -> np.ndarray:
    """A number for each row, equal for rows that are equal in all columns."""
    out = np.unique(columns[0], return_inverse=True)[1].astype(np.int64)
    for c in columns[1:]:
        here = np.unique(c, return_inverse=True)[1].astype(np.int64)
        out = np.unique(out * (here.max() + 1) + here, return_inverse=True)[1].astype(np.int64)
    return out


def _by_places(codes: np.ndarray, most: int) -> list[int]:
    n, length = codes.shape
    letters = np.unique(codes, return_inverse=True)[1].reshape(codes.shape).astype(np.int64)
    bits = max(1, int(letters.max()).bit_length())
    each = 63 // bits  # letters of a packed word
    where, bucket, buckets = [], [], 0
    for out in itertools.combinations(range(length), most):
        kept = [p for p in range(length) if p not in out]
        words = []
        for i in range(0, len(kept), each):
            w = np.zeros(n, np.int64)
            for p in kept[i : i + each]:
                w = w << bits | letters[:, p]
            words.append(w)
        same = _same(words) if words else np.zeros(n, np.int64)
        size = np.bincount(same)
        shared = np.flatnonzero(size[same] > 1)  # a text that agrees with no other is of no use to any
        number = np.cumsum(size > 1) - 1
        where.append(shared.astype(np.int32))
        bucket.append(number[same[shared]] + buckets)
        buckets += int((size > 1).sum())
    where, bucket = np.concatenate(where), np.concatenate(bucket)
    order = np.argsort(where, kind="stable")
    bucket, ends = bucket[order], np.searchsorted(where[order], np.arange(n + 1))
    reps, held = np.arange(n), array.array("i", [n]) * buckets  # the first representative in each bucket
    for at in range(0, n, LOOKED_UP_AT_ONCE):
        some = ends[at : at + LOOKED_UP_AT_ONCE + 1].tolist()
        own = bucket[some[0] : some[-1]].tolist()
        for i in np.flatnonzero(np.diff(some)).tolist():
            mine = own[some[i] - some[0] : some[i + 1] - some[0]]
            nearest = min(map(held.__getitem__, mine))
            if nearest < n:
                reps[at + i] = nearest
            else:
                for b in mine:
                    held[b] = at + i
    return reps.tolist()


def _by_comparison(codes: np.ndarray, most: int) -> list[int]:
    reps, out = np.empty(0, dtype=np.int64), []
    held = np.empty((0, codes.shape[1]), dtype=np.uint32)
    room = 0
    for i in range(len(codes)):
        near = np.flatnonzero((held[:room] != codes[i]).sum(axis=1) <= most) if room else ()
        if len(near):
            out.append(int(reps[near[0]]))
            continue
        if room == len(held):
            grown = np.empty((max(64, 2 * room), codes.shape[1]), dtype=np.uint32)
            grown[:room] = held[:room]
            held, reps = grown, np.concatenate([reps, np.empty(len(grown) - len(reps), dtype=np.int64)])
        held[room], reps[room] = codes[i], i
        room += 1
        out.append(i)
    return out


def hamming_clusters(df: DataFrame, group: str, seq: str, identity: float = 0.8) -> DataFrame:
    """``group``, ``seq``, ``cluster`` of every distinct sequence: greedy, within group and length, in sorted order.

    A sequence joins the first representative within ``round((1 - identity) * length)`` mismatches, else it is one itself.
    Cluster numbers run over all groups, lengths and representatives in sorted order. A block of one group and length is
    one task, whose work is linear in its sequences if they are short (:func:`_first_representative`); distinct sequences only.
    """
    unique = df.select(F.col(group).alias("g"), F.col(seq).alias("s")).dropna().distinct().withColumn("n", F.length("s"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("s")
        length = int(part["n"].iloc[0])
        reps = _first_representative(part["s"].tolist(), round((1 - identity) * length))
        return part.assign(rep=[part["s"].iloc[i] for i in reps])[["g", "s", "n", "rep"]]

    kind = unique.schema["g"].dataType.simpleString()
    placed = unique.groupBy("g", "n").applyInPandas(run, f"g {kind}, s string, n int, rep string")
    return _numbered(placed, ["g", "n", "rep"]).select(F.col("g").alias(group), F.col("s").alias(seq), "cluster")


def _numbered(placed: DataFrame, keys: list[str]) -> DataFrame:
    """Number the distinct ``keys`` from 0 in sorted order."""
    placed = cut_lineage(placed)
    numbers = positions_within(placed.select(*keys).distinct(), [], keys, name="cluster").withColumn("cluster", F.col("cluster") - 1)
    return placed.join(numbers, keys)


def greedy_clusters(df: DataFrame, seq: str, order: str, identity: float = 0.8) -> DataFrame:
    """``order``, ``seq``, ``cluster``: greedy over all rows in ``order``; identity at least ``identity``, equal lengths only.

    Blocks are lengths; clusters are numbered by the first row that shows them.
    """
    rows = df.select(F.col(order).alias("o"), F.col(seq).alias("s")).dropna()
    firsts = rows.groupBy("s").agg(F.min("o").alias("o")).withColumn("n", F.length("s"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("o")
        length = int(part["n"].iloc[0])
        most = math.floor((1 - identity) * length + 1e-9)
        reps = _first_representative(part["s"].tolist(), most)
        return part.assign(first=[part["o"].iloc[i] for i in reps])[["s", "first"]]

    kind = rows.schema["o"].dataType.simpleString()
    placed = firsts.groupBy("n").applyInPandas(run, f"s string, first {kind}")
    placed = cut_lineage(placed)
    numbers = positions_within(placed.select("first").distinct(), [], ["first"], name="cluster").withColumn("cluster", F.col("cluster") - 1)
    found = placed.join(numbers, "first")
    return rows.join(found, "s").select(F.col("o").alias(order), F.col("s").alias(seq), "cluster")


def exact_clusters(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """``key`` columns and ``cluster``: equal keys share a number, given by first appearance in ``order``."""
    firsts = df.groupBy(*key).agg(F.min(order).alias("_first"))
    return positions_within(firsts, [], ["_first", *key], name="cluster").withColumn("cluster", F.col("cluster") - 1).drop("_first")


def cluster_holdout(clusters: DataFrame, share: float = 0.2, seed: int = 42, cluster: str = "cluster") -> DataFrame:
    """Add ``held_out``: true for ``max(1, round(n * share))`` whole clusters, drawn by hash order."""
    ids = clusters.select(cluster).distinct()
    drawn = positions_within(ids.withColumn("_h", hash_order(seed, cluster)), [], ["_h", cluster], name="_rn")
    n = ids.agg(F.greatest(F.lit(1), F.bround(F.count(F.lit(1)) * F.lit(share))).alias("k")).scalar()
    held = drawn.filter(F.col("_rn") <= n).select(cluster).withColumn("held_out", F.lit(True))
    return clusters.join(held, cluster, "left").fillna(False, ["held_out"])


def grouped_folds(clusters: DataFrame, k: int, cluster: str = "cluster") -> DataFrame:
    """Add ``fold``: whole clusters, largest first (ties: least id), go to the fold with the fewest rows.

    The driver sees one count per distinct cluster size, of which there are at most the square root of twice the rows.
    Clusters of one size are interchangeable; how many of them each fold gets is reckoned at once (:func:`take_largest`).
    """
    sizes = clusters.groupBy(cluster).agg(F.count(F.lit(1)).alias("_size"))
    ranked = positions_within(sizes, ["_size"], [cluster], name="_rank")
    free, dealt = [0] * k, []
    for size, count in sorted(((r["_size"], r["count"]) for r in sizes.groupBy("_size").count().toLocalIterator()), reverse=True):
        upto = 0
        for f, n in enumerate(take_largest(free, size, count)):
            free[f] -= n * size
            if n:
                dealt.append((size, upto, upto + n, f))
                upto += n
    table = clusters.sparkSession.createDataFrame(dealt, "_size bigint, _above bigint, _upto bigint, fold int")  # a row per size and fold
    placed = ranked.join(table, "_size").filter("_rank > _above AND _rank <= _upto").select(cluster, "fold")
    return clusters.join(placed, cluster)


def take_largest(deficits: list[int], size: int, count: int) -> list[int]:
    """How often each place is picked when ``count`` things of ``size`` go, one by one, to the largest deficit.

    Picking lowers a deficit by ``size``; the picks are the ``count`` largest terms of falling progressions, found by
    bisection on the term's value instead of one by one. Ties go to the earlier place.
    """

    def above(t: int) -> list[int]:
        return [max(0, -(-(d - t) // size)) for d in deficits]

    lo, hi = min(deficits) - size * (count + 1), max(deficits)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if sum(above(mid)) > count:
            lo = mid
        else:
            hi = mid
    picks = above(hi)
    for i, d in enumerate(deficits):
        if sum(picks) < count and d - picks[i] * size == hi:
            picks[i] += 1
    return picks


def maxmin_select(df: DataFrame, group: list[str], seq: str, order: str, k: int, forced: list[str] = (), name: str | None = None) -> DataFrame:
    """Greedy max-min diversity by Hamming distance (unequal lengths: the greater length): ``group``, ``seq``, ``place``.

    Forced sequences come first, else the first in ``order``; then always the one farthest from those taken, ties to the
    earliest. With ``name``, it is the named things that are picked, forced and put out, by the distance of their sequences.
    A group is one task.
    """
    rows = df.select(*group, F.col(seq).alias("s"), F.col(order).alias("o"), F.col(name or seq).cast("string").alias("e")).dropna(subset=["s", "e"]).withColumn("_all", F.lit(1))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["o", "e"], kind="stable").drop_duplicates("e")
        texts, names = part["s"].tolist(), part["e"].tolist()
        lengths = np.array([len(t) for t in texts])
        codes = _codes([t.ljust(int(lengths.max()), "\0") for t in texts])
        taken = [names.index(t) for t in forced if t in names] or [0]
        taken = taken[:k]

        def far(i: int) -> np.ndarray:
            d = (codes != codes[i]).sum(axis=1)
            return np.where(lengths == lengths[i], d, np.maximum(lengths, lengths[i]))

        near = np.min([far(i) for i in taken], axis=0)
        while len(taken) < min(k, len(texts)):
            near[taken] = -1
            i = int(np.argmax(near))
            taken.append(i)
            near = np.minimum(near, far(i))
        head = part[group].iloc[[0] * len(taken)].reset_index(drop=True)
        return head.assign(e=[names[i] for i in taken], place=range(1, len(taken) + 1))

    kinds = ", ".join([*(f"`{g}` {rows.schema[g].dataType.simpleString()}" for g in group), "e string, place int"])
    return rows.groupBy(*(group or ["_all"])).applyInPandas(run, kinds).withColumnRenamed("e", name or seq)


def spread_pick(df: DataFrame, group: list[str], key: str, value: str, k: int) -> DataFrame:
    """``k`` rows spread over one number: both extremes first, then always the widest gap to those taken."""
    rows = df.select(*group, F.col(key).alias("k_"), F.col(value).cast("double").alias("v_")).dropna().withColumn("_all", F.lit(1))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["v_", "k_"], kind="stable").reset_index(drop=True)
        v = part["v_"].to_numpy()
        taken = [0, len(v) - 1][: min(k, len(v))] if len(v) > 1 else [0]
        while len(taken) < min(k, len(v)):
            gap = np.abs(v[:, None] - v[taken][None, :]).min(axis=1)
            gap[taken] = -1
            taken.append(int(np.argmax(gap)))
        return part.iloc[taken].assign(place=range(1, len(taken) + 1))[[*group, "k_", "place"]]

    kinds = ", ".join([*(f"`{g}` {rows.schema[g].dataType.simpleString()}" for g in group), f"k_ {rows.schema['k_'].dataType.simpleString()}, place int"])
    return rows.groupBy(*(group or ["_all"])).applyInPandas(run, kinds).withColumnRenamed("k_", key)


#: Places of the pool that one row makes at once; lengths that windows may be wanted of.
AT_ONCE, MOST_LENGTHS = 100_000, 1000
#: Letters of a piece of a long text, and pieces handed on at once.
PIECE, PIECES_AT_ONCE = 100, 10_000


def pool_negatives(positives: DataFrame, group: str, seq: str, ratio: float = 1.0, seed: int = 0) -> DataFrame:
    """Per (group, length), ``round(n * ratio)`` sequences of the same length that are positives of other groups only.

    The pool of each length is put in hash order and numbered over the cluster. A group reads it from a start of its own,
    only as far as it needs: its own positives, which are ruled out, are fewer than it has, so ``k`` plus their number of
    places always suffice, and the draw falls short only where the pool is exhausted. The work is linear in the positives.
    """
    pos = positives.select(F.col(group).alias("g"), F.col(seq).alias("s")).dropna().distinct().withColumn("n", F.length("s"))
    need = pos.groupBy("g", "n").agg(F.count(F.lit(1)).alias("own"), F.bround(F.count(F.lit(1)) * F.lit(ratio)).cast("bigint").alias("k"))
    pool = cut_lineage(positions_within(pos.select("s", "n").distinct().withColumn("_h", hash_order(seed, "s")), ["n"], ["_h", "s"], name="at").drop("_h"))
    sizes = pool.groupBy("n").agg(F.count(F.lit(1)).alias("size"))
    start = F.conv(F.substring(hash_order(seed, "g"), 1, 8), 16, 10).cast("bigint")
    steps = F.least(F.col("size"), F.col("k") + F.col("own"))
    # No array grows with a group: the places are made in parts of ``AT_ONCE``, part numbers first.
    parts = need.join(sizes, "n").select("g", "n", "k", "size", start.alias("_from"), steps.alias("_steps")).filter("_steps > 0")
    outer = parts.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("_steps") - 1) / AT_ONCE))).alias("_part")).repartition("g", "n", "_part")
    ends = F.least(F.col("_steps"), (F.col("_part") + 1) * AT_ONCE) - 1
    cand = outer.select("g", "n", "k", "size", "_from", F.explode(F.sequence(F.col("_part") * AT_ONCE, ends)).alias("step"))
    cand = cand.withColumn("at", F.pmod(F.col("_from") + F.col("step"), F.col("size")) + 1)
    free = cand.join(pool, ["n", "at"]).join(pos.select("g", "s"), ["g", "s"], "left_anti").select("g", "n", "k", "s", "step")
    drawn = positions_within(free, ["g", "n"], ["step"]).filter("position <= k")
    return drawn.select(F.col("g").alias(group), F.col("s").alias(seq), F.lit(0).alias("label"), F.col("n").alias("length"))


def _pieces(texts: DataFrame, text: str, overlap: int) -> DataFrame:
    """Texts cut, in one walk over each, into parts of ``PIECE`` letters and the ``overlap`` that follow: ``_t``, spread evenly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                t = t.as_py()
                for at in range(0, len(t), PIECE * PIECES_AT_ONCE):
                    ends = range(at, min(len(t), at + PIECE * PIECES_AT_ONCE), PIECE)
                    yield pa.RecordBatch.from_arrays([pa.array([t[i : i + PIECE + overlap] for i in ends], pa.string())], names=["_t"])

    cut = texts.select(F.col(text).alias("_t")).dropna().mapInArrow(run, "_t string")
    return cut.repartition(tasks_for(texts))


def window_negatives(texts: DataFrame, text: str, need: DataFrame, exclude: DataFrame, seq: str, seed: int = 0, alphabet: str = AMINO_ACIDS) -> DataFrame:
    """Windows of given lengths (``need``: ``length``, ``k``) of long texts, valid and not excluded, drawn by hash order.

    The work is linear in the letters, however long a text: windows are made from short pieces of it. Only those whose
    hash is below a bound move on, to be made distinct and held against what is excluded; where they turn out fewer than
    wanted, the bound is raised and all is done again, up to no bound at all. So the draw is that from all windows.
    """
    from rankstead.functions.sequence import is_valid

    wanted = need.select(F.col("length").cast("int"), F.col("k").cast("bigint")).limit(MOST_LENGTHS + 1).collect()
    if len(wanted) > MOST_LENGTHS:
        raise ValueError(f"more than {MOST_LENGTHS} lengths are wanted")
    if not wanted:
        return exclude.select(F.col(seq), F.length(seq).alias("length")).limit(0)
    lengths = F.explode(F.array(*[F.struct(F.lit(r["length"]).alias("length"), F.lit(r["k"]).alias("k")) for r in wanted])).alias("w")
    pieces = cut_lineage(_pieces(texts, text, max(0, *(r["length"] - 1 for r in wanted))))
    n = pieces.count() * PIECE
    places = F.explode(F.sequence(F.lit(1), F.length("_t") - F.col("length") + 1)).alias("_at")
    long = pieces.select("_t", lengths).select("w.*", "_t").filter("length > 0 AND length <= length(_t)").select("length", "k", "_t", places)
    cut = long.select("length", "k", F.substring("_t", F.col("_at"), F.col("length")).alias("s"))
    barred = exclude.select(F.col(seq).alias("s")).distinct()
    draw, most = hash_order(seed, "s"), max(r["k"] or 0 for r in wanted)
    bound = 16 * most / max(n, 1)
    while True:
        low = cut if bound >= 1 else cut.filter(F.substring(draw, 1, 8) < f"{int(bound * 2**32):08x}")
        ok = cut_lineage(low.filter(is_valid("s", alphabet)).distinct().join(barred, "s", "left_anti"))
        got = {(r["length"], r["k"]): r["count"] for r in ok.groupBy("length", "k").count().collect()}
        if bound >= 1 or all(got.get((r["length"], r["k"]), 0) >= (r["k"] or 0) for r in wanted):
            break
        bound *= 64
    return top_k(ok, F.col("k"), ["length"], [draw, F.col("s")]).select(F.col("s").alias(seq), "length")


def dose_sample(df: DataFrame, by: list[str], key: list[str], dose: int, seed: int = 0) -> DataFrame:
    """``min(dose, n)`` rows of each class ``by``, by hash order of ``key``."""
    return top_k(df, dose, by, [hash_order(seed, *key), *[F.col(k) for k in key]])


def trials(df: DataFrame, by: list[str], key: list[str], n: int, times: int) -> DataFrame:
    """``times`` samples of ``n`` rows without replacement of each class, told apart by ``trial``."""
    each = df.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    return top_k(each, n, [*by, "trial"], [F.md5(F.concat_ws("|", "trial", *[F.col(k).cast("string") for k in key])), *[F.col(k) for k in key]])


def saturation_variants(df: DataFrame, key: list[str], seq: str, alphabet: str = AMINO_ACIDS) -> DataFrame:
    """The wild type (null position) and every single substitution: ``key``, ``position``, ``aa``, ``variant``."""
    wt = df.select(*key, F.lit(None).cast("int").alias("position"), F.lit(None).cast("string").alias("aa"), F.col(seq).alias("variant"))
    at = df.select(*key, F.col(seq).alias("_s"), F.posexplode(letters(seq)).alias("_p", "_was")).withColumn("position", (F.col("_p") + 1).cast("int"))
    each = at.select("*", F.explode(F.array(*[F.lit(a) for a in alphabet])).alias("aa")).filter("aa <> _was")
    return wt.unionByName(each.select(*key, "position", "aa", substitute("_s", "position", "aa").alias("variant")))


def coalitions(df: DataFrame, key: list[str], seq: str, background: list[str], length: int) -> DataFrame:
    """All 2^length mixtures of each sequence with each background: ``key``, ``mask``, ``variant``. Bit i: place i + 1 kept."""
    masks = df.filter(F.length(seq) == length).select(*key, F.col(seq).alias("_s"), F.explode(F.sequence(F.lit(0), F.lit(2**length - 1))).alias("mask"))
    back = F.array(*[F.lit(b) for b in background if len(b) == length])
    return masks.select(*key, "mask", "_s", F.explode(back).alias("_b")).select(*key, "mask", mosaic("_s", "_b", "mask").alias("variant"))


def shapley(values: DataFrame, key: list[str], mask: str, value: str, length: int) -> DataFrame:
    """Exact Shapley values by place from the mean value of every coalition: ``key``, ``position``, ``phi``.

    Each coalition adds to the places it holds and takes from those it lacks, with the weight of its size.
    """
    mean = values.groupBy(*key, mask).agg(F.avg(value).alias("_v"))
    size = F.bit_count(F.col(mask))
    weights = F.array(*[F.lit(1.0 / (length * math.comb(length - 1, k))) for k in range(length)])
    at = F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("_p")
    long = mean.select(*key, mask, "_v", size.alias("_k"), at)
    has = F.pmod(F.floor(F.col(mask) / F.pow(F.lit(2.0), F.col("_p"))), F.lit(2)) == 1
    part = F.when(has, F.col("_v") * F.element_at(weights, F.col("_k"))).otherwise(-F.col("_v") * F.element_at(weights, F.col("_k") + 1))
    return long.withColumn("_w", part).groupBy(*key, (F.col("_p") + 1).cast("int").alias("position")).agg(F.sum("_w").alias("phi"))


def landscape_sensitivity(df: DataFrame, key: list[str], position: str, value: str, population: bool = True) -> DataFrame:
    """Per key and place, the deviation of the mean values over letters: ``key``, ``position``, ``sensitivity``."""
    sd: Column = (F.stddev_pop if population else F.stddev_samp)(F.col(value))
    return df.groupBy(*key, position).agg(sd.alias("sensitivity"))


def top_positions(sens: DataFrame, key: list[str], position: str = "position", value: str = "sensitivity", n: int = 2) -> DataFrame:
    """``key``, ``top``: the places with the ``n`` highest values, highest first (ties: first place)."""
    w = Window.partitionBy(*key).orderBy(F.desc(value), position)
    best = sens.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
    return best.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_rn", F.col(position).alias("p")))), lambda x: x["p"]).alias("top"))


def linkage_classes(pairs: DataFrame, a: str, b: str, distance: str, k: int) -> DataFrame:
    """``member``, ``class`` of an average-linkage tree cut into ``k`` classes, numbered by their least member.

    ``pairs`` holds every pair of a stated list of groups once (some hundreds at most); the tree is built in one task.
    Ties merge the pair of classes that was named first.
    """
    rows = pairs.select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"), F.col(distance).cast("double").alias("d")).withColumn("_all", F.lit(1))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(part["a"]) | set(part["b"]))
        at = {n: i for i, n in enumerate(names)}
        d = np.full((len(names), len(names)), np.inf)
        i, j = part["a"].map(at).to_numpy(), part["b"].map(at).to_numpy()
        d[i, j] = d[j, i] = part["d"].to_numpy()
        members = [[n] for n in names]
        while len(members) > k:
            x, y = sorted(divmod(int(np.argmin(d)), len(d)))
            nx, ny = len(members[x]), len(members[y])
            d[x] = d[:, x] = (nx * d[x] + ny * d[y]) / (nx + ny)
            d[x, x] = np.inf
            d = np.delete(np.delete(d, y, 0), y, 1)
            members[x] += members.pop(y)
        members.sort(key=min)
        return pd.DataFrame([(m, c) for c, ms in enumerate(members) for m in sorted(ms)], columns=["member", "class"])

    return rows.groupBy("_all").applyInPandas(run, "member string, class int")


def class_representatives(classes: DataFrame, weights: DataFrame, member: str, weight: str, forced: list[str] = ()) -> DataFrame:
    """One member per class, larger classes first: a forced one, else the one with most weight (ties: least name)."""
    sized = classes.join(weights.select(F.col(member).alias("member"), F.col(weight).alias("_w")), "member", "left").withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("class")))
    must = F.when(F.col("member").isin(list(forced)), 0).otherwise(1) if forced else F.lit(1)
    w = Window.partitionBy("class").orderBy(must, F.desc(F.coalesce("_w", F.lit(0))), "member")
    one = sized.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
    return one.select("class", "size", "member", F.coalesce("_w", F.lit(0)).alias(weight), F.row_number().over(Window.orderBy(F.desc("size"), "class")).alias("place"))


def even_strata(df: DataFrame, value: str, count: int, name: str = "stratum") -> DataFrame:
    """Add the number (from 0) of the equally wide stratum of a value between its least and most; the most is in the last."""
    from rankstead.operators.ranking import with_group_stats

    t = with_group_stats(df, [], {"_lo": F.min(value), "_hi": F.max(value)})
    width = F.nullif((F.col("_hi") - F.col("_lo")).cast("double") / count, F.lit(0.0))
    at = F.least(F.floor((F.col(value) - F.col("_lo")) / width), F.lit(count - 1))
    return t.withColumn(name, F.when(F.col(value).isNotNull(), F.coalesce(at, F.lit(0)).cast("int"))).drop("_lo", "_hi")
