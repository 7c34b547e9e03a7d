"""Position frequencies, information content, divergences and scores of short sequences, in long form.

A profile is a table (group, pos, aa, ...): groups times places times letters rows, whatever the number of sequences, and
made by one aggregation that combines map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankstead.functions.sequence import AMINO_ACIDS, is_valid, letters


#: Parts into which the groups are cut for each place and letter when all pairs of groups are made.
SALTS = 4


def position_counts(df: DataFrame, group: list[str], seq: str, alphabet: str = AMINO_ACIDS) -> DataFrame:
    """``group``, ``pos`` (from 1), ``aa``, ``n``: letters of the alphabet by place."""
    long = df.select(*group, F.posexplode(letters(seq)).alias("_p", "aa")).withColumn("pos", F.col("_p") + 1)
    return long.filter(F.instr(F.lit(alphabet), F.col("aa")) > 0).groupBy(*group, "pos", "aa").agg(F.count(F.lit(1)).alias("n"))


def frequencies(df: DataFrame, group: list[str], seq: str, length: int, pseudocount: float = 0.5, alphabet: str = AMINO_ACIDS, whole: bool = False) -> DataFrame:
    """``group``, ``pos``, ``aa``, ``freq`` for every place up to ``length`` and every letter: (n + c) / (N + c * letters).

    Sequences of other lengths don't count, and with ``whole`` neither do those with a letter that the alphabet lacks;
    without, only such letters are passed over. N is the number of counted letters at the place.
    """
    own = df.filter(F.length(seq) == length)
    counts = position_counts(own.filter(is_valid(seq, alphabet)) if whole else own, group, seq, alphabet)
    per = counts.groupBy(*group).agg(F.count(F.lit(1)).alias("_")).drop("_")
    grid = per.select(*group, F.explode(F.sequence(F.lit(1), F.lit(length))).alias("pos")).select(*group, "pos", F.explode(F.array(*[F.lit(a) for a in alphabet])).alias("aa"))
    keys = [*group, "pos", "aa"]
    full = grid.join(counts, keys, "left").fillna(0, ["n"])
    total = F.sum("n").over(Window.partitionBy(*group, "pos"))
    return full.select(*keys, ((F.col("n") + F.lit(pseudocount)) / (total + F.lit(pseudocount * len(alphabet)))).alias("freq"))


def log_odds(freq: DataFrame, background: float = 1 / 20, base: str = "e") -> DataFrame:
    """Add ``weight``, the log of frequency over background; base ``e`` or ``2``."""
    ratio = F.col("freq") / F.lit(background)
    return freq.withColumn("weight", F.log2(ratio) if base == "2" else F.log(ratio))


def score(df: DataFrame, pwm: DataFrame, group: list[str], key: list[str], seq: str, length: int, weight: str = "weight", alphabet: str = AMINO_ACIDS) -> DataFrame:
    """``group``, ``key``, ``score``: the sum of weights of a sequence's letters; null for a wrong length or a bad letter, or
    where the group has no profile.

    A profile becomes one row per group, an array of ``length`` times letters weights (``pwm`` must have them all), so a
    sequence is scored in its own row: no letter of it moves.
    """
    wide = pwm.groupBy(*group).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "aa", F.col(weight).alias("w")))), lambda x: x["w"]).alias("_w"))
    order = "".join(sorted(alphabet))  # as the array is sorted
    code = lambda i: F.position(F.substring("_seq", i + 1, 1), F.lit(order))
    at = lambda i: F.when(code(i) > 0, F.get("_w", F.lit(i * len(order)) + code(i) - 1))
    total = sum((at(i) for i in range(1, length)), at(0))
    ok = (F.length("_seq") == length) & (F.size("_w") == length * len(order))
    return df.select(*group, *key, F.col(seq).alias("_seq")).join(wide, list(group), "left").select(*group, *key, F.when(ok, total).alias("score"))


def information_content(df: DataFrame, group: list[str], seq: str, length: int, alphabet: str = AMINO_ACIDS) -> DataFrame:
    """``group``, ``pos``, ``ic``: log2(letters) plus the sum of p log2 p over the letters seen, without pseudocount."""
    counts = position_counts(df.filter(F.length(seq) == length), group, seq, alphabet)
    p = F.col("n") / F.sum("n").over(Window.partitionBy(*group, "pos"))
    return counts.withColumn("p", p).groupBy(*group, "pos").agg((F.log2(F.lit(float(len(alphabet)))) + F.sum(F.col("p") * F.log2("p"))).alias("ic"))


def anchors(ic: DataFrame, group: list[str], length: int, least: float = 1.0) -> DataFrame:
    """``group``, ``anchors`` (places with at least that much information, the last one as -1), ``ic`` rounded to 3 digits.

    Groups without any anchor have an empty array.
    """
    place = F.when(F.col("pos") == length, -1).otherwise(F.col("pos")).cast("int")
    got = F.sort_array(F.collect_list(F.when(F.col("ic") >= least, F.struct("pos", place.alias("a")))))
    every = F.sort_array(F.collect_list(F.struct("pos", F.bround("ic", 3).alias("v"))))
    return ic.groupBy(*group).agg(F.transform(got, lambda x: x["a"]).alias("anchors"), F.transform(every, lambda x: x["v"]).alias("ic"))


def anchor_survey(table: DataFrame, locus: Column, default: tuple[int, ...] = (2, -1)) -> DataFrame:
    """Per locus: groups, those with just the default anchors, with others besides, without the first default, without any."""
    want = F.array(*[F.lit(x) for x in default])
    a = F.col("anchors")
    n = lambda c: F.sum(c.cast("bigint"))
    return table.groupBy(locus.alias("locus")).agg(
        F.count(F.lit(1)).alias("n_groups"),
        n((F.size(F.array_except(a, want)) == 0) & (F.size(F.array_except(want, a)) == 0)).alias("n_default"),
        n(F.size(F.array_except(a, want)) > 0).alias("n_extra"),
        n(~F.array_contains(a, default[0])).alias("n_without_first"),
        n(F.size(a) == 0).alias("n_none"),
    )


def breadth(ic: DataFrame, group: list[str], least: float = 1.0) -> DataFrame:
    """Informative places, the peak, the total and the peak's share of it."""
    return ic.groupBy(*group).agg(
        F.sum((F.col("ic") >= least).cast("bigint")).alias("n_informative"), F.max("ic").alias("peak"), F.sum("ic").alias("total"), (F.max("ic") / F.nullif(F.sum("ic"), F.lit(0.0))).alias("peak_share")
    )


def ic_features(ic: DataFrame, group: list[str], length: int, anchors: DataFrame | None = None) -> DataFrame:
    """Information at the second and last place, their mean and the total; with ``anchors`` (group, array of places) also the
    mean over each group's own anchors, null without any."""
    second, last = F.max(F.when(F.col("pos") == 2, F.col("ic"))), F.max(F.when(F.col("pos") == length, F.col("ic")))
    more = []
    if anchors is not None:
        ic = ic.join(anchors.select(*group, "anchors"), list(group), "left")
        own = F.exists("anchors", lambda a: F.when(a < 0, F.lit(length) + a + 1).otherwise(a) == F.col("pos"))
        more = [F.avg(F.when(own, F.col("ic"))).alias("ic_anchor_mean")]
    return ic.groupBy(*group).agg(second.alias("ic_p2"), last.alias("ic_last"), ((second + last) / 2).alias("ic_p2_last"), F.sum("ic").alias("ic_total"), *more)


def consensus(counts: DataFrame, group: list[str], value: str = "n") -> DataFrame:
    """``group``, ``consensus``: the most frequent letter of each place (ties: the later letter), in order."""
    best = counts.groupBy(*group, "pos").agg(F.max(F.struct(value, "aa"))["aa"].alias("aa"))
    return best.groupBy(*group).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "aa"))), lambda x: x["aa"]), "").alias("consensus"))


def divergence(freq: DataFrame, group: str, distance: bool = False, positions: list[int] | None = None) -> DataFrame:
    """``a``, ``b``, ``jsd`` of every pair of groups a < b: mean over places of the Jensen-Shannon divergence, base 2.

    With ``distance``, the mean of its square roots. The pairs are of groups; they join on place and letter.
    """
    f = freq if positions is None else freq.filter(F.col("pos").isin(positions))
    x = f.select(F.col(group).alias("a"), "pos", "aa", F.col("freq").alias("p"))
    y = f.select(F.col(group).alias("b"), "pos", "aa", F.col("freq").alias("q"))
    # All pairs of groups are the result; a salt spreads the letters' 20 by places keys over more tasks.
    salt = F.pmod(F.xxhash64("a"), F.lit(SALTS)).alias("_salt")
    pairs = x.select("*", salt).join(y.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("_salt")), ["pos", "aa", "_salt"]).filter("a < b")
    m = (F.col("p") + F.col("q")) / 2
    kl = lambda u: F.when(F.col(u) > 0, F.col(u) * F.log2(F.col(u) / m)).otherwise(0.0)
    per = pairs.groupBy("a", "b", "pos").agg(F.sum((kl("p") + kl("q")) / 2).alias("d"))
    d = F.greatest(F.col("d"), F.lit(0.0))
    return per.groupBy("a", "b").agg(F.avg(F.sqrt(d) if distance else d).alias("jsd"))


def divergence_from(sample: DataFrame, freq: DataFrame, group: str, also: list[str]) -> DataFrame:
    """``also``, ``a``, ``b``, ``jsd``: divergence of each sample's profile (group, ``also``, pos, aa, freq) from the whole profile
    of every other group."""
    x = sample.select(*also, F.col(group).alias("a"), "pos", "aa", F.col("freq").alias("p"))
    y = freq.select(F.col(group).alias("b"), "pos", "aa", F.col("freq").alias("q"))
    pairs = x.join(y, ["pos", "aa"]).filter("a <> b")
    m = (F.col("p") + F.col("q")) / 2
    kl = lambda u: F.when(F.col(u) > 0, F.col(u) * F.log2(F.col(u) / m)).otherwise(0.0)
    per = pairs.groupBy(*also, "a", "b", "pos").agg(F.greatest(F.sum((kl("p") + kl("q")) / 2), F.lit(0.0)).alias("d"))
    return per.groupBy(*also, "a", "b").agg(F.avg("d").alias("jsd"))


def both_ways(pairs: DataFrame, value: str) -> DataFrame:
    """Each unordered pair as two rows."""
    return pairs.select("a", "b", value).unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), value))


def nearest_groups(pairs: DataFrame, value: str, k: int = 3) -> DataFrame:
    """Per group: the least distance, whose it is (ties: least name), the mean of the ``k`` least and of all."""
    w = Window.partitionBy("a").orderBy(value, "b")
    r = both_ways(pairs, value).withColumn("_rn", F.row_number().over(w))
    return r.groupBy("a").agg(F.min(value).alias("nn_dist"), F.min_by("b", F.struct(value, "b")).alias("nn"), F.avg(F.when(F.col("_rn") <= k, F.col(value))).alias("mean_k"), F.avg(value).alias("mean_all"))


def farthest_groups(pairs: DataFrame, value: str, n: int) -> DataFrame:
    """The ``n`` farthest groups of each group (ties: least name): ``a``, ``b``, ``place``."""
    w = Window.partitionBy("a").orderBy(F.desc(value), "b")
    return both_ways(pairs, value).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def substitution_distance(pairs: DataFrame, a: str, b: str, matrix: DataFrame, key: list[str]) -> DataFrame:
    """``key``, ``distance`` = 1 - S_ab / sqrt(S_aa S_bb) of two sequences by a substitution matrix (``x``, ``y``, ``s``).

    Null where lengths differ or a self-score isn't positive.
    """
    zipped = F.posexplode(F.arrays_zip(letters(a).alias("x"), letters(b).alias("y")))
    long = pairs.select(*key, (F.length(a) == F.length(b)).alias("_same"), zipped.alias("pos", "_xy")).select(*key, "_same", F.col("_xy.x").alias("_x"), F.col("_xy.y").alias("_y"))

    def add(t: DataFrame, u: str, v: str, name: str) -> DataFrame:
        m = F.broadcast(matrix.select(F.col("x").alias(f"_m{name}"), F.col("y").alias(f"_n{name}"), F.col("s").alias(name)))  # letters squared rows
        return t.join(m, (F.col(u) == F.col(f"_m{name}")) & (F.col(v) == F.col(f"_n{name}")), "left").drop(f"_m{name}", f"_n{name}")

    scored = add(add(add(long, "_x", "_y", "ab"), "_x", "_x", "aa"), "_y", "_y", "bb")
    sums = scored.groupBy(*key).agg(F.first("_same").alias("_same"), *[F.sum(c).cast("double").alias(c) for c in ("ab", "aa", "bb")])
    d = F.lit(1.0) - F.col("ab") / F.sqrt(F.col("aa") * F.col("bb"))
    return sums.select(*key, F.when(F.col("_same") & (F.col("aa") > 0) & (F.col("bb") > 0), d).alias("distance"))


def read_matrix(spark, path: str) -> DataFrame:
    """A substitution matrix file in the usual layout (comments, a line of letters, a line per letter) as ``x``, ``y``, ``s``.

    The public matrices come as such files; they are a parameter of :func:`substitution_distance`.
    """
    lines = [r["value"].split() for r in spark.read.text(path).limit(1000).collect() if r["value"].strip() and not r["value"].startswith("#")]  # a matrix has a score of lines
    letters_, rows = lines[0], lines[1:]
    return spark.createDataFrame([(r[0], y, int(v)) for r in rows for y, v in zip(letters_, r[1:], strict=True)], "x string, y string, s int")


def frequent_letters(freq: DataFrame, group: list[str], n: int, value: str = "freq") -> DataFrame:
    """The ``n`` most frequent letters at each place (ties: the later letter)."""
    w = Window.partitionBy(*group, "pos").orderBy(F.desc(value), F.desc("aa"))
    return freq.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).select(*group, "pos", "aa")


def carries_anchors(df: DataFrame, key: list[str], seq: str, wanted: DataFrame, group: list[str], places: list[int], every: bool = True) -> DataFrame:
    """``key``, ``carries``: whether the letters at ``places`` (negative: from the end) are among the group's wanted ones.

    All of them with ``every``, else any. ``df`` holds ``group``, ``key`` and ``seq``.
    """
    at = F.explode(F.array(*[F.lit(p) for p in places])).alias("_at")
    rows = df.select(*group, *key, F.col(seq).alias("_s"), at)
    pos = F.when(F.col("_at") < 0, F.length("_s") + F.col("_at") + 1).otherwise(F.col("_at"))
    rows = rows.withColumn("pos", pos).withColumn("aa", F.substring("_s", F.col("pos"), F.lit(1)))
    hit = rows.join(wanted.select(*group, "pos", "aa").distinct().withColumn("_in", F.lit(True)), [*group, "pos", "aa"], "left")
    fold = F.bool_and if every else F.bool_or
    return hit.groupBy(*group, *key).agg(fold(F.coalesce("_in", F.lit(False))).alias("carries"))
