"""Membership, alignment, band, nearest-neighbour and similarity joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankstead.functions.sequence import hamming


def mark(df: DataFrame, keys: DataFrame, on: list[str], name: str) -> DataFrame:
    """Add a boolean: whether the row's key is among ``keys``. A null key is in no set: false."""
    have = keys.select(*on).dropna().distinct().withColumn(name, F.lit(True))
    return df.join(have, on, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def member_share(df: DataFrame, keys: DataFrame, on: list[str], group: list[str] = ()) -> DataFrame:
    """Share of rows whose key is among ``keys``, per group: ``n``, ``n_found``, ``share``."""
    m = mark(df, keys, on, "_in")
    return m.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_in").cast("bigint")).alias("n_found"), F.avg(F.col("_in").cast("double")).alias("share"))


def leakage_flag(df: DataFrame, train: DataFrame, group: str, entity: str, label: str, name: str = "in_train") -> DataFrame:
    """Positives are looked up by (group, entity), negatives by entity alone."""
    a = mark(df, train, [group, entity], "_pair")
    b = mark(a, train, [entity], "_entity")
    return b.withColumn(name, F.when(F.col(label) == 1, F.col("_pair")).when(F.col(label) == 0, F.col("_entity"))).drop("_pair", "_entity")


def overlap_flags(df: DataFrame, train: DataFrame, group: str, entity: str) -> DataFrame:
    """Three marks: the pair, the entity and the group occur in ``train``."""
    out = mark(df, train, [group, entity], "pair_in_train")
    out = mark(out, train, [entity], "entity_in_train")
    return mark(out, train, [group], "group_in_train")


def split_rejects(df: DataFrame, dim: DataFrame, on: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a known key, with its value attached, and per unknown key the number of rows turned away."""
    joined = df.join(dim.select(on, value), on, "left")
    return joined.filter(F.col(value).isNotNull()), joined.filter(F.col(value).isNull()).groupBy(on).agg(F.count(F.lit(1)).alias("n_rejected"))


def align(tables: dict[str, DataFrame], on: list[str], value: str) -> DataFrame:
    """Keys that all tables share, with each table's value under the table's name."""
    parts = [t.select(*on, F.col(value).alias(n)) for n, t in tables.items()]
    return reduce(lambda a, b: a.join(b, on), parts)


def outer_with_suffix(left: DataFrame, right: DataFrame, on: list[str], suffix: str) -> DataFrame:
    """Full outer join; columns of the right side that also stand on the left get the suffix."""
    clash = {c: f"{c}{suffix}" for c in right.columns if c in left.columns and c not in on}
    return left.join(right.withColumnsRenamed(clash), on, "full")


def alias_join(df: DataFrame, name: str, dim: DataFrame, aliases: Column) -> DataFrame:
    """Join a written name with any of the spellings that ``aliases`` gives for a row of ``dim``."""
    spelt = dim.withColumn("_alias", F.explode(F.array_distinct(aliases)))
    return df.join(spelt, F.col(name) == F.col("_alias")).drop("_alias")


def left_fill(df: DataFrame, dim: DataFrame, on: list[str], fill: dict[str, object]) -> DataFrame:
    """Left join with the gaps of the right side's columns filled."""
    return df.join(dim, on, "left").fillna(fill)


def band_pairs(left: DataFrame, right: DataFrame, x: str, y: str, width: float) -> DataFrame:
    """Pairs of rows with ``|x - y| <= width``, found by equality on cells of that width.

    A left row looks into its own cell and both next ones, so each pair is met exactly once; no range join, no cross join.
    """
    lx = left.withColumn("_cell", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda o: F.floor(F.col(x) / F.lit(width)) + o)))
    ry = right.withColumn("_cell", F.floor(F.col(y) / F.lit(width)))
    return lx.join(ry, "_cell").filter(F.abs(F.col(x) - F.col(y)) <= F.lit(width)).drop("_cell")


def matched_controls(cases: DataFrame, controls: DataFrame, key: str, confound: str, outcome: str, width: float) -> DataFrame:
    """Per case: number and mean outcome of the controls within ``width`` of its confound, and the difference.

    Controls are summed by cells of an eighth of the width. The 15 cells around a case lie wholly inside its band, so their
    sums count as they are; only the controls of the two cells at the border are compared one by one. Controls without an
    outcome count in neither; cases without any control have no row.
    """
    parts = 8
    cell = lambda c: F.floor(F.col(c) / F.lit(width / parts))
    c = controls.select(F.col(confound).alias("_cc"), F.col(outcome).cast("double").alias("_co")).dropna().withColumn("_cell", cell("_cc"))
    sums = c.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"), F.sum("_co").alias("_s"))
    own = cases.select(key, confound, outcome).withColumn("_at", cell(confound))
    inner = own.withColumn("_cell", F.explode(F.transform(F.sequence(F.lit(1 - parts), F.lit(parts - 1)), lambda o: F.col("_at") + o))).join(sums, "_cell")
    border = own.withColumn("_cell", F.explode(F.array(F.col("_at") - parts, F.col("_at") + parts))).join(c, "_cell").filter(F.abs(F.col(confound) - F.col("_cc")) <= F.lit(width))
    names = [key, confound, outcome]
    both = inner.select(*names, "_n", "_s").unionByName(border.select(*names, F.lit(1).cast("bigint").alias("_n"), F.col("_co").alias("_s")))
    out = both.groupBy(*names).agg(F.sum("_n").alias("n_controls"), F.sum("_s").alias("_s")).withColumn("control_mean", F.col("_s") / F.col("n_controls")).drop("_s")
    return out.withColumn("difference", F.col(outcome) - F.col("control_mean"))


def hamming_pairs(left: DataFrame, left_id: str, left_seq: str, right: DataFrame, right_id: str, right_seq: str, most: int) -> DataFrame:
    """``left_id``, ``right_id``, ``distance`` of all pairs of one length within ``most`` mismatches.

    By the pigeonhole principle such a pair shares one of ``most + 1`` pieces at its place: distinct texts of each side
    are joined on (length, piece number, piece), verified, made distinct, and only then spread to the rows. Texts no longer
    than ``most`` share an empty piece and so meet all others of their length.
    """

    def side(df: DataFrame, seq: str, name: str) -> DataFrame:
        t = df.select(F.col(seq).alias(name)).dropna().distinct().withColumn("_n", F.length(name))
        k = F.explode(F.sequence(F.lit(0), F.lit(most))).alias("_k")
        cut = lambda i: F.floor(F.col("_n") * i / F.lit(most + 1)).cast("int")
        return t.select(name, "_n", k).withColumn("_piece", F.substring(F.col(name), cut(F.col("_k")) + 1, cut(F.col("_k") + 1) - cut(F.col("_k"))))

    near = side(left, left_seq, "_a").join(side(right, right_seq, "_b"), ["_n", "_k", "_piece"]).select("_a", "_b").distinct()
    near = near.withColumn("distance", hamming("_a", "_b")).filter(F.col("distance") <= most)
    ids = left.select(F.col(left_id).alias("left_id"), F.col(left_seq).alias("_a"))
    other = right.select(F.col(right_id).alias("right_id"), F.col(right_seq).alias("_b"))
    return near.join(ids, "_a").join(other, "_b").select("left_id", "right_id", "distance")


def near_share(left: DataFrame, left_seq: str, right: DataFrame, right_seq: str, most: int) -> DataFrame:
    """Distinct left texts, how many occur on the right, and how many have a right text within ``most`` mismatches."""
    lt, rt = left.select(F.col(left_seq).alias("t")).dropna().distinct(), right.select(F.col(right_seq).alias("t")).dropna().distinct()
    near = hamming_pairs(lt.withColumn("i", F.col("t")), "i", "t", rt.withColumn("i", F.col("t")), "i", "t", most)
    best = near.groupBy(F.col("left_id").alias("t")).agg(F.min("distance").alias("d"))
    return lt.join(best, "t", "left").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("d") == 0).cast("bigint")).alias("n_exact"), F.count("d").alias("n_near"))


def against_wild_type(df: DataFrame, by: list[str], is_wt: Column, value: str, name: str = "delta") -> DataFrame:
    """Add the value minus that of the wild type of the same ``by`` (of several, the largest); rows without one are dropped,
    and so are wild types. The wild types, one row per ``by``, are joined to the others, which may be any number."""
    wt = df.filter(is_wt & F.col(value).isNotNull()).groupBy(*by).agg(F.max(value).alias("_wt"))
    return df.filter(~is_wt).join(wt, list(by)).withColumn(name, F.col(value) - F.col("_wt")).drop("_wt")


def conditional_counts(df: DataFrame, by: list[str], label: str) -> DataFrame:
    """``n_pos`` and ``n_neg`` of each key, 0 where there are none."""
    n = lambda v: F.sum((F.col(label) == v).cast("bigint"))
    return df.groupBy(*by).agg(F.coalesce(n(1), F.lit(0)).alias("n_pos"), F.coalesce(n(0), F.lit(0)).alias("n_neg"))


def entity_prior(counts: DataFrame) -> DataFrame:
    """Add ``prior`` = n_pos / (n_pos + n_neg); null for entities without a labelled row."""
    total = F.col("n_pos") + F.col("n_neg")
    return counts.withColumn("prior", F.col("n_pos") / F.nullif(total.cast("double"), F.lit(0.0)))


def without_ambiguous(df: DataFrame, by: list[str], label: str) -> DataFrame:
    """Rows whose key bears only one label."""
    bad = df.groupBy(*by).agg(F.count_distinct(label).alias("_k")).filter("_k > 1").select(*by)
    return df.join(bad, by, "left_anti")


def censored_label(value: str, relation: str, strong: float = 50.0, weak: float = 5000.0) -> Column:
    """1 for a measurement surely below ``strong``, 0 for one surely above ``weak``, else null, minding the inequality."""
    v, r = F.col(value), F.col(relation)
    below = ((r == "=") & (v < strong)) | ((r == "<") & (v <= strong))
    above = ((r == "=") & (v > weak)) | ((r == ">") & (v >= weak))
    return F.when(below, 1).when(above, 0)


def first_rows(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """One row per key, the first in ``order`` (which should be unique); an aggregate that combines map-side."""
    rest = [c for c in df.columns if c not in by]
    least = df.groupBy(*by).agg(F.min_by(F.struct(*rest), order).alias("_r"))
    return least.select(*by, "_r.*").select(*df.columns)
