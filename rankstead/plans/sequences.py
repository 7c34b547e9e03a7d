"""Queries of the join, motif, selection, key and structure operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankstead.functions import keys, sequence
from rankstead.functions.text import folded
from rankstead.operators import joins, motif, ranking, select, stats, structure
from rankstead.plans.evaluation import AFF, R, aff, rounded, table
from rankstead.sources import files

LEAST_GROUP = 50


def train_pairs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "motmaen_train").select("train_id", "allele", folded("peptide").alias("peptide"), "source")


def tests(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "motmaen_testset_overlap")
    return t.select("test_id", "fold_set", "kind", "allele", folded("peptide").alias("peptide"), (F.col("kind") == "NA").cast("int").alias("label"))


def nine(spark: SparkSession, d: str) -> DataFrame:
    """Distinct positive 9-mers of alleles that have enough of them."""
    a = table(spark, d, "atlas_labelled").filter("label = 1 AND allele IS NOT NULL").select("allele", folded("peptide").alias("peptide")).filter("length(peptide) = 9").distinct()
    enough = a.groupBy("allele").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_GROUP).select("allele")
    return a.join(enough, "allele")


# Joins


def leakage_flags(spark, d):
    return joins.leakage_flag(tests(spark, d), train_pairs(spark, d), "allele", "peptide", "label").select("test_id", "in_train")


def overlap_flags(spark, d):
    return joins.overlap_flags(tests(spark, d), train_pairs(spark, d), "allele", "peptide").select("test_id", "pair_in_train", "entity_in_train", "group_in_train")


def negative_member_share(spark, d):
    return rounded(joins.member_share(tests(spark, d).filter("label = 0"), train_pairs(spark, d), ["peptide"], ["fold_set"]), "share")


def split_survival(spark, d):
    """Per fold set and allele: how many test pairs are new to the training side, in percent."""
    m = joins.mark(tests(spark, d), train_pairs(spark, d), ["allele", "peptide"], "seen")
    new = F.sum((~F.col("seen")).cast("bigint"))
    return rounded(m.groupBy("fold_set", "allele").agg(F.count(F.lit(1)).alias("n"), new.alias("n_new"), (new / F.count(F.lit(1)) * 100).alias("percent")), "percent")


def held_out_rows(spark, d):
    return table(spark, d, "motmaen_train").select("train_id", "allele", folded("peptide").alias("peptide")).join(tests(spark, d).select("allele", "peptide").distinct(), ["allele", "peptide"], "left_anti").select("train_id")


def validation_rows(spark, d):
    return train_pairs(spark, d).join(tests(spark, d).select("allele", "peptide").distinct(), ["allele", "peptide"], "left_semi").select("train_id")


def reject_counts(spark, d):
    """Training rows whose allele isn't in the coverage table, counted by allele."""
    return joins.split_rejects(train_pairs(spark, d), table(spark, d, "data_type_coverage"), "allele", "atlas_ms")[1]


def coverage_filled(spark, d):
    n = table(spark, d, "atlas_labelled").groupBy("allele").agg(F.count(F.lit(1)).alias("n_rows"))
    return joins.left_fill(table(spark, d, "data_type_coverage").select("allele", "affinity"), n, ["allele"], {"n_rows": 0, "affinity": 0})


def outer_features(spark, d):
    c = table(spark, d, "data_type_coverage").select("allele", "locus", F.col("atlas_ms").alias("n"))
    t = train_pairs(spark, d).filter("allele IS NOT NULL").groupBy("allele").agg(F.count(F.lit(1)).alias("n"))
    return joins.outer_with_suffix(c, t, ["allele"], "_train")


def aligned_counts(spark, d):
    """Alleles known to three tables, with each table's rows."""
    n = lambda t: table(spark, d, t).groupBy("allele").agg(F.count(F.lit(1)).alias("n"))
    return joins.align({"atlas": n("atlas_labelled"), "train": n("motmaen_train"), "tuned": n("aff_finetuned")}, ["allele"], "n")


def alias_join(spark, d):
    v = table(spark, d, "rq3_variants_b37").select("row_id", F.col("hla_b_37_01").alias("slug"))
    return joins.alias_join(v, "slug", table(spark, d, "data_type_coverage").select("allele"), keys.spellings("allele")).select("row_id", "allele")


def band_controls(spark, d):
    s = table(spark, d, "supplier").withColumn("grp", F.col("s_nationkey") % 5)
    out = joins.matched_controls(s.filter("grp = 0"), s.filter("grp <> 0"), "s_suppkey", "s_acctbal", "s_nationkey", 200.0)
    return rounded(out.select("s_suppkey", "n_controls", "control_mean", "difference"), "control_mean", "difference")


def hamming_join(spark, d):
    """The near pairs of all evaluation splits."""
    return joins.hamming_pairs(tests(spark, d), "test_id", "peptide", train_pairs(spark, d), "train_id", "peptide", 2)


def near_share(spark, d):
    return joins.near_share(tests(spark, d), "peptide", train_pairs(spark, d), "peptide", 1)


def wild_type_delta(spark, d):
    """Confidence of each row less the best binder's of the same allele."""
    a = aff(spark, d).filter("allele IS NOT NULL AND plddt_pep IS NOT NULL")
    return rounded(joins.against_wild_type(a, ["allele"], F.col("label") == 1, "plddt_pep").select("row_id", "delta"), "delta")


def unambiguous_peptides(spark, d):
    a = table(spark, d, "atlas_labelled").filter("peptide IS NOT NULL AND label IS NOT NULL AND allele IS NOT NULL")
    return joins.without_ambiguous(a, ["allele", "peptide"], "label").groupBy("allele").agg(F.count(F.lit(1)).alias("n"))


def censored_labels(spark, d):
    a = aff(spark, d).withColumn("rel", F.element_at(F.array(F.lit("="), F.lit("<"), F.lit(">")), (F.col("row_id") % 3 + 1).cast("int")))
    lab = joins.censored_label("inter_pae", "rel", 5.0, 20.0)
    return a.groupBy(lab.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


# Motifs


def _freq(spark, d):
    return motif.frequencies(nine(spark, d), ["allele"], "peptide", 9)


def position_frequency(spark, d):
    return rounded(_freq(spark, d), "freq")


def pwm_log_odds(spark, d):
    return rounded(motif.log_odds(_freq(spark, d)).select("allele", "pos", "aa", "weight"), "weight")


def pwm_score(spark, d):
    own = tests(spark, d).select("test_id", "allele", "peptide")
    return rounded(motif.score(own, motif.log_odds(_freq(spark, d), base="2"), ["allele"], ["test_id"], "peptide", 9).select("test_id", "score"), "score")


def _ic(spark, d):
    return motif.information_content(nine(spark, d), ["allele"], "peptide", 9)


def position_ic(spark, d):
    return rounded(_ic(spark, d), "ic")


def derive_anchors(spark, d):
    return motif.anchors(_ic(spark, d), ["allele"], 9).select("allele", F.array_join(F.col("anchors").cast("array<string>"), ",").alias("anchors"))


def anchor_survey(spark, d):
    return motif.anchor_survey(motif.anchors(_ic(spark, d), ["allele"], 9), keys.locus("allele"))


def motif_breadth(spark, d):
    return rounded(motif.breadth(_ic(spark, d), ["allele"]), "peak", "total", "peak_share")


def ic_features(spark, d):
    return rounded(motif.ic_features(_ic(spark, d), ["allele"], 9), "ic_p2", "ic_last", "ic_p2_last", "ic_total")


def jsd_pairs(spark, d):
    return rounded(motif.divergence(_freq(spark, d), "allele"), "jsd")


def js_distance_anchors(spark, d):
    return rounded(motif.divergence(_freq(spark, d), "allele", distance=True, positions=[2, 9]), "jsd")


def _pairs(spark, d):
    return rounded(motif.divergence(_freq(spark, d), "allele"), "jsd")


def motif_neighbours(spark, d):
    return rounded(motif.nearest_groups(_pairs(spark, d), "jsd"), "nn_dist", "mean_k", "mean_all")


def farthest_donors(spark, d):
    return motif.farthest_groups(_pairs(spark, d), "jsd", 3).select("a", "b", "place", "jsd")


# A small substitution matrix: equal letters 4, letters of one class 1, others -1.
CLASSES = ["AVILMC", "FWYH", "STNQGP", "DE", "KR"]


def substitution_matrix(spark: SparkSession) -> DataFrame:
    kind = {x: i for i, c in enumerate(CLASSES) for x in c}
    return spark.createDataFrame([(x, y, 4 if x == y else 1 if kind[x] == kind[y] else -1) for x in kind for y in kind], "x string, y string, s int")


def substitution_distance(spark, d):
    t = tests(spark, d)
    p = t.select("test_id", "peptide", F.reverse("peptide").alias("other"))
    return rounded(motif.substitution_distance(p, "peptide", "other", substitution_matrix(spark), ["test_id"]), "distance")


def frequent_letters(spark, d):
    return motif.frequent_letters(motif.position_counts(nine(spark, d), ["allele"], "peptide"), ["allele"], 2, "n")


def carries_anchors(spark, d):
    want = motif.frequent_letters(motif.position_counts(nine(spark, d), ["allele"], "peptide"), ["allele"], 3, "n")
    return motif.carries_anchors(tests(spark, d).filter("length(peptide) = 9").select("allele", "test_id", "peptide"), ["test_id"], "peptide", want, ["allele"], [2, -1]).select("test_id", "carries")


def hard_decoys(spark, d):
    """Tests that carry their allele's anchors but score no higher than the 75th percentile of its own peptides."""
    pwm = motif.log_odds(_freq(spark, d), base="2")
    own = nine(spark, d).withColumn("k", F.col("peptide"))
    cut = motif.score(own, pwm, ["allele"], ["k"], "peptide", 9).groupBy("allele").agg(F.percentile("score", 0.75).alias("cut"))
    scored = motif.score(tests(spark, d), pwm, ["allele"], ["test_id"], "peptide", 9)
    both = scored.join(cut, "allele").join(carries_anchors(spark, d), "test_id").filter("carries AND score <= cut")
    return rounded(both.select("test_id", "score"), "score")


def hard_decoy_pool(spark, d):
    """Each allele's hard decoys: of all 9-mers seen with other alleles but not with it, those that carry its anchors at
    both places and score no higher than the median of its own peptides; six of them, by max-min."""
    own = nine(spark, d)
    pwm = motif.log_odds(_freq(spark, d), base="2")
    cut = motif.score(own.withColumn("k", F.col("peptide")), pwm, ["allele"], ["k"], "peptide", 9).groupBy("allele").agg(F.percentile("score", 0.5).alias("cut"))
    want = motif.frequent_letters(motif.position_counts(own, ["allele"], "peptide"), ["allele"], 4, "n")
    second, last = (want.filter(F.col("pos") == p).select("allele", F.col("aa").alias(c)) for p, c in ((2, "second"), (9, "last")))
    seen = table(spark, d, "atlas_labelled").filter("label = 1 AND allele IS NOT NULL").select(folded("peptide").alias("peptide")).filter("length(peptide) = 9").distinct()
    pool = seen.withColumns({"second": F.substring("peptide", 2, 1), "last": F.substring("peptide", 9, 1)})
    fit = pool.join(second.join(last, "allele"), ["second", "last"]).select("allele", "peptide").join(own, ["allele", "peptide"], "left_anti")
    scored = motif.score(fit.withColumn("k", F.col("peptide")), pwm, ["allele"], ["k"], "peptide", 9).withColumnRenamed("k", "peptide")
    low = scored.join(cut, "allele").filter("score <= cut").select("allele", "peptide")
    return select.maxmin_select(low, ["allele"], "peptide", "peptide", 6)


# Selection


def canonical_top(spark, d):
    """Each allele's best tenth of its own peptides, five at least, by profile score (ties: later peptide)."""
    own = nine(spark, d).withColumn("k", F.col("peptide"))
    s = rounded(motif.score(own, motif.log_odds(_freq(spark, d)), ["allele"], ["k"], "peptide", 9), "score")
    return ranking.top_fraction(s, 0.1, 5, ["allele"], [F.desc("score"), F.desc("k")]).select("allele", F.col("k").alias("peptide"))


def stratified_quota(spark, d):
    c = table(spark, d, "data_type_coverage")
    return ranking.quota_pick(c, "locus", "allele", [F.desc("atlas_ms"), F.col("allele")], {"HLA-C": 30, "HLA-A": 5, "HLA-B": 5}).select("locus", "allele", "picked")


def dose_subsample(spark, d):
    a = table(spark, d, "atlas_labelled").filter("allele IS NOT NULL AND label IS NOT NULL")
    return select.dose_sample(a, ["allele", "label"], ["row_id"], 20).select("row_id")


def repeated_trials(spark, d):
    t = select.trials(nine(spark, d), ["allele"], ["allele", "peptide"], 200, 20)
    return t.groupBy("allele", "trial").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.substring("peptide", 2, 1)).alias("n_second"))


def pool_negatives(spark, d):
    return select.pool_negatives(nine(spark, d), "allele", "peptide", 1.0, 7).select("allele", "peptide", "label", "length")


def window_negatives(spark, d):
    need = spark.createDataFrame([(8, 50), (9, 100)], "length int, k int")
    t = nine(spark, d).groupBy("allele").agg(F.array_join(F.sort_array(F.collect_set("peptide")), "").alias("t"))
    return select.window_negatives(t, "t", need, nine(spark, d), "peptide", 3)


def saturation_variants(spark, d):
    wt = tests(spark, d).select("test_id", "peptide")
    return select.saturation_variants(wt, ["test_id"], "peptide")


def _additive(spark, d) -> DataFrame:
    """Every mixture of the test peptides of nine letters with a background, scored by an additive rule."""
    wt = tests(spark, d).select("test_id", "peptide")
    c = select.coalitions(wt, ["test_id"], "peptide", ["AAAAAAAAA", "GGGGGGGGG"], 9)
    value = F.aggregate(F.transform(sequence.letters("variant"), lambda x, i: F.ascii(x) * (i + 1.0)), F.lit(0.0), lambda s, v: s + v)
    return c.withColumn("value", value)


def shapley_exact(spark, d):
    return rounded(select.shapley(_additive(spark, d), ["test_id"], "mask", "value", 9), "phi")


def _landscape(spark, d) -> DataFrame:
    v = table(spark, d, "rq3_variants_b37").select("row_id", folded("peptide").alias("peptide"), keys.variant_note("note").alias("n"))
    value = F.pmod(F.col("row_id") * 37, F.lit(101)).cast("double")
    return v.filter("n.position IS NOT NULL AND n.seed IS NOT NULL").select("row_id", F.col("n.seed").alias("seed"), F.col("n.position").alias("position"), F.col("n.aa").alias("aa"), value.alias("delta"))


def landscape_sensitivity(spark, d):
    m = _landscape(spark, d).groupBy("position", "aa").agg(F.avg("delta").alias("delta"))
    return rounded(select.landscape_sensitivity(m, [], "position", "delta"), "sensitivity")


def landscape_top_positions(spark, d):
    m = _landscape(spark, d).groupBy("seed", "position", "aa").agg(F.avg("delta").alias("delta"))
    s = rounded(select.landscape_sensitivity(m, ["seed"], "position", "delta"), "sensitivity").filter("sensitivity IS NOT NULL")
    t = select.top_positions(s, ["seed"])
    return t.select("seed", F.array_join(F.col("top").cast("array<string>"), ",").alias("top"), (F.size(F.array_except("top", F.array(F.lit(2), F.lit(9)))) == 0).alias("recovers"))


def seed_stability(spark, d):
    m = _landscape(spark, d).groupBy("seed", "position").agg(F.avg("delta").alias("delta"))
    return rounded(stats.pairwise_spearman(m, "seed", ["position"], "delta", 5), "rho")


def hamming_clusters(spark, d):
    return select.hamming_clusters(nine(spark, d), "allele", "peptide")


def greedy_clusters(spark, d):
    return select.greedy_clusters(tests(spark, d), "peptide", "test_id")


def exact_clusters(spark, d):
    return select.exact_clusters(tests(spark, d), ["peptide"], "test_id")


def _clusters(spark, d):
    c = select.exact_clusters(tests(spark, d), ["peptide"], "test_id")
    return tests(spark, d).join(c, "peptide").select("test_id", "cluster")


def cluster_holdout(spark, d):
    return select.cluster_holdout(_clusters(spark, d))


def grouped_folds(spark, d):
    return select.grouped_folds(_clusters(spark, d), 5)


def grouped_fold_sizes(spark, d):
    """Rows and clusters of each fold."""
    return grouped_folds(spark, d).groupBy("fold").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("cluster").alias("n_clusters"))


def maxmin_select(spark, d):
    return select.maxmin_select(nine(spark, d), ["allele"], "peptide", "peptide", 12)


def spread_pick(spark, d):
    return select.spread_pick(table(spark, d, "data_type_coverage"), ["locus"], "allele", "atlas_ms", 4)


def motif_classes(spark, d):
    return select.linkage_classes(_pairs(spark, d), "a", "b", "jsd", 4)


def class_representatives(spark, d):
    n = tests(spark, d).groupBy("allele").agg(F.count(F.lit(1)).alias("n_tests"))
    return select.class_representatives(motif_classes(spark, d), n, "allele", "n_tests", ["HLA-A*02:01"])


def coverage_strata(spark, d):
    c = select.even_strata(table(spark, d, "data_type_coverage"), "atlas_ms", 4)
    return c.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), F.min("atlas_ms").alias("least"), F.max("atlas_ms").alias("most"))


TRIAL_SIZE, TRIALS = 100, 10


def subsample_inflation(spark, d):
    """Nearest-motif distance of samples of an allele's peptides from the whole profiles of the others, less that of all its
    peptides: mean and spread (population) over the trials, for alleles with more peptides than a sample has."""
    own, freq = nine(spark, d), _freq(spark, d)
    full = motif.nearest_groups(motif.divergence(freq, "allele"), "jsd").select(F.col("a").alias("allele"), F.col("nn_dist").alias("nn_full"))
    large = own.groupBy("allele").agg(F.count(F.lit(1)).alias("n_full")).filter(F.col("n_full") > TRIAL_SIZE)
    t = select.trials(own.join(large, "allele"), ["allele"], ["allele", "peptide"], TRIAL_SIZE, TRIALS)
    far = motif.divergence_from(motif.frequencies(t, ["allele", "trial"], "peptide", 9), freq, "allele", ["trial"])
    sub = far.groupBy(F.col("a").alias("allele"), "trial").agg(F.min("jsd").alias("nn")).groupBy("allele").agg(F.avg("nn").alias("nn_sub_mean"), F.stddev_pop("nn").alias("nn_sub_sd"))
    out = large.join(full, "allele").join(sub, "allele").withColumn("inflation", F.col("nn_sub_mean") - F.col("nn_full"))
    return rounded(out, "nn_full", "nn_sub_mean", "nn_sub_sd", "inflation")


# Scalars


def normalized_keys(spark, d):
    s = F.col("hla_b_37_01")
    v = table(spark, d, "rq3_variants_b37").select("row_id", keys.normalize_key(s).alias("key"), keys.normalize_key_strict(s).alias("strict"), keys.extract_key(s).alias("found"))
    return v.groupBy("key", "strict", "found").agg(F.count(F.lit(1)).alias("n"))


def key_spellings(spark, d):
    c = table(spark, d, "data_type_coverage").select("allele")
    return c.select("allele", keys.key_to_slug("allele").alias("slug"), keys.short_key("allele").alias("short"), keys.predictor_key("allele").alias("predictor"), keys.slug_to_key(keys.key_to_slug("allele")).alias("back"), keys.locus("allele").alias("locus"))


def encoded_sequences(spark, d):
    t = tests(spark, d)
    return t.select("test_id", F.array_join(sequence.encode("peptide", 12).cast("array<string>"), ",").alias("code"), F.size(F.filter(sequence.length_mask("peptide", 12), lambda x: x)).alias("n_mask"))


def hamming_functions(spark, d):
    t = tests(spark, d).select("test_id", "peptide", F.reverse("peptide").alias("r"))
    return rounded(t.select("test_id", sequence.hamming("peptide", "r").alias("h"), sequence.hamming_identity("peptide", "r").alias("identity"), sequence.within("peptide", "r", 6).alias("near")), "identity")


def event_props(spark, d):
    """A map-valued JSON column, one row per entry, summed."""
    e = files.json_map(table(spark, d, "events"), "props", "map<string, bigint>")
    return e.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def positives(spark, d):
    raw = table(spark, d, "atlas_labelled").filter("label = 1")
    p = files.labelled_positives(raw, keys.normalize_key_strict("allele"), F.col("peptide"))
    return p.groupBy("allele", "length").agg(F.count(F.lit(1)).alias("n"))


# Structures


def _cells(spark, d) -> DataFrame:
    """Each embedding as an 8 by 8 matrix in long form."""
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("p", "v"))
    return e.select("vec_id", (F.floor(F.col("p") / 8) + 1).cast("int").alias("i"), (F.col("p") % 8 + 1).cast("int").alias("j"), F.col("v").cast("double").alias("v"))


def pae_blocks(spark, d):
    return rounded(structure.interface_pae(_cells(spark, d), ["vec_id"], 6, 3), "pae_pep_mhc", "pae_anchor2", "pae_anchor_last", "pae_anchors", "pae_pep", "pae_all")


def pae_consistency(spark, d):
    return rounded(structure.consistency(_cells(spark, d), ["vec_id"], 6, 3), "pae_spread", "asymmetry")


def _own_lengths(spark, d) -> DataFrame:
    """The same matrices, each with a peptide of its own length (2 to 4) at its end."""
    c = _cells(spark, d).withColumn("length", (F.col("vec_id") % 3 + 2).cast("int"))
    return structure.at_the_end(c, ["vec_id"], "length")


def pae_own_lengths(spark, d):
    c = _own_lengths(spark, d)
    a = structure.interface_pae(c, ["vec_id"], "first", "length").select("vec_id", "pae_pep_mhc", "pae_anchors").join(structure.consistency(c, ["vec_id"], "first", "length"), "vec_id")
    return rounded(a, "pae_pep_mhc", "pae_anchors", "pae_spread", "asymmetry")


def _places(spark, d) -> DataFrame:
    """Anchor places of each structure: the second, one that only some have, and the last."""
    return table(spark, d, "embeddings").select("vec_id", F.array(F.lit(2), (F.col("vec_id") % 4 + 1).cast("int"), F.lit(-1)).alias("anchors"))


def pae_anchors(spark, d):
    """Mean error at each structure's own anchor places."""
    return rounded(structure.anchor_pae(_own_lengths(spark, d), _places(spark, d), ["vec_id"], "first", "length"), "pae_anchors_ic")


def plddt_consistency(spark, d):
    return rounded(structure.confidence_consistency(_atoms(spark, d), _places(spark, d), ["vec_id"], "C"), "plddt_spread", "anchor_gap")


def _atoms(spark, d) -> DataFrame:
    """Each embedding as 20 atoms in two chains."""
    e = table(spark, d, "embeddings")
    at = F.explode(F.sequence(F.lit(0), F.lit(19))).alias("k")
    rows = e.select("vec_id", "embedding", at)
    xyz = [(F.element_at("embedding", (F.col("k") * 3 + i + 1).cast("int")).cast("double") * 10).alias(c) for i, c in enumerate("xyz")]
    chain: Column = F.when(F.col("k") < 6, "C").otherwise("A")
    return rows.select("vec_id", chain.alias("chain"), (F.floor(F.col("k") / 2) + 1).cast("int").alias("resseq"), F.lit("GLY").alias("resname"), F.lit("CA").alias("atom"), F.lit("C").alias("element"), *xyz, (F.col("k") * 5.0).alias("b"))


def contact_features(spark, d):
    return rounded(structure.contact_features(_atoms(spark, d), ["vec_id"], "C", "A"), "mean_degree", "min_distance")


def interface_geometry(spark, d):
    return rounded(structure.interface_geometry(_atoms(spark, d), ["vec_id"], "C", "A", _places(spark, d)), "contacts_per_residue", "anchor2_min", "anchor_last_min", "mean_min_dist", "buried_frac")


def interface_plddt(spark, d):
    return rounded(structure.interface_plddt(_atoms(spark, d), ["vec_id"], "C", "A"), "interface_plddt", "peptide_plddt")


QUERIES = {
    f.__name__: f
    for f in (
        leakage_flags, overlap_flags, negative_member_share, split_survival, held_out_rows, validation_rows, reject_counts, coverage_filled, outer_features,
        aligned_counts, alias_join, band_controls, hamming_join, near_share, wild_type_delta, unambiguous_peptides, censored_labels, position_frequency, pwm_log_odds,
        pwm_score, position_ic, derive_anchors, anchor_survey, motif_breadth, ic_features, jsd_pairs, js_distance_anchors, motif_neighbours, farthest_donors,
        substitution_distance, frequent_letters, carries_anchors, hard_decoys, hard_decoy_pool, canonical_top, stratified_quota, dose_subsample, repeated_trials, pool_negatives,
        window_negatives, saturation_variants, shapley_exact, landscape_sensitivity, landscape_top_positions, seed_stability, hamming_clusters, greedy_clusters,
        exact_clusters, cluster_holdout, grouped_folds, grouped_fold_sizes, maxmin_select, spread_pick, motif_classes, class_representatives, coverage_strata, subsample_inflation, normalized_keys, key_spellings, encoded_sequences, hamming_functions, event_props,
        positives, pae_blocks, pae_consistency, pae_own_lengths, pae_anchors, plddt_consistency, contact_features, interface_geometry, interface_plddt,
    )
}

FOLD = r"upper(regexp_replace(peptide, '^\s+|\s+$', '', 'g'))"
T = f"t AS (SELECT test_id, fold_set, kind, allele, {FOLD} AS peptide, (kind = 'NA')::INT AS label FROM motmaen_testset_overlap)"
TR = f"tr AS (SELECT train_id, allele, {FOLD} AS peptide, source FROM motmaen_train)"
NINE = f"""p9 AS (SELECT DISTINCT allele, {FOLD} AS peptide FROM atlas_labelled WHERE label = 1 AND allele IS NOT NULL AND length({FOLD}) = 9),
    nine AS (SELECT * FROM p9 WHERE allele IN (SELECT allele FROM p9 GROUP BY allele HAVING count(*) >= {LEAST_GROUP}))"""
AA = "ACDEFGHIKLMNPQRSTVWY"
COUNTS = f"""{NINE}, cnt AS (SELECT allele, pos, substr(peptide, pos, 1) AS aa, count(*) AS n FROM (SELECT *, unnest(range(1, 10)) AS pos FROM nine)
    WHERE contains('{AA}', substr(peptide, pos, 1)) GROUP BY ALL)"""
FREQ = f"""{COUNTS}, grid AS (SELECT allele, pos, aa FROM (SELECT DISTINCT allele FROM cnt), unnest(range(1, 10)) AS u(pos), unnest(string_split('{AA}', '')) AS v(aa) WHERE aa <> ''),
    freq AS (SELECT allele, pos, aa, (coalesce(n, 0) + 0.5) / (sum(coalesce(n, 0)) OVER (PARTITION BY allele, pos) + 10)::DOUBLE AS freq FROM grid LEFT JOIN cnt USING (allele, pos, aa))"""
IC = f"{COUNTS}, ic AS (SELECT allele, pos, log2(20) + sum(p * log2(p)) AS ic FROM (SELECT *, n / sum(n) OVER (PARTITION BY allele, pos)::DOUBLE AS p FROM cnt) GROUP BY ALL)"


def _jsd(where: str = "TRUE", f: str = "greatest(d, 0)") -> str:
    return f"""{FREQ}, jp AS (SELECT a, b, round(avg({f}), 6) AS jsd FROM (SELECT x.allele AS a, y.allele AS b, pos,
        sum((x.freq * log2(x.freq / ((x.freq + y.freq) / 2)) + y.freq * log2(y.freq / ((x.freq + y.freq) / 2))) / 2) AS d
        FROM freq x JOIN freq y USING (pos, aa) WHERE x.allele < y.allele AND {where} GROUP BY ALL) GROUP BY ALL)"""


BOTH = "bw AS (SELECT a, b, jsd FROM jp UNION ALL SELECT b, a, jsd FROM jp)"
SCORE = """sc AS (SELECT k, allele, CASE WHEN count(w) = 9 AND any_value(length(peptide)) = 9 THEN sum(w) END AS score FROM
    (SELECT q.*, w.w FROM (SELECT *, unnest(range(1, length(peptide) + 1)) AS pos FROM {src}) q LEFT JOIN (SELECT allele, pos, aa, {log} AS w FROM freq) w
     ON w.allele = q.allele AND w.pos = q.pos AND w.aa = substr(q.peptide, q.pos, 1)) GROUP BY k, allele)"""
WANT = "want AS (SELECT allele, pos, aa FROM cnt QUALIFY row_number() OVER (PARTITION BY allele, pos ORDER BY n DESC, aa DESC) <= {n})"
CARRY = """ca AS (SELECT test_id, allele, bool_and(w.aa IS NOT NULL) AS carries FROM (SELECT *, unnest([2, 9]) AS pos FROM t WHERE length(peptide) = 9) q
    LEFT JOIN want w ON w.allele = q.allele AND w.pos = q.pos AND w.aa = substr(q.peptide, q.pos, 1) GROUP BY test_id, q.allele AS allele)"""
CARRY = CARRY.replace("SELECT test_id, allele, bool_and", "SELECT test_id, any_value(q.allele) AS allele, bool_and").replace("GROUP BY test_id, q.allele AS allele", "GROUP BY test_id")
LAND = r"""ld AS (SELECT row_id, regexp_extract(note, '^(seed\d+)', 1) AS seed, regexp_extract(note, '_p(\d+)([A-Z])$', 1)::INT AS position, regexp_extract(note, '_p(\d+)([A-Z])$', 2) AS aa,
    (row_id * 37 % 101)::DOUBLE AS delta FROM rq3_variants_b37 WHERE regexp_matches(note, '_p(\d+)([A-Z])$') AND regexp_matches(note, '^seed\d+'))"""
CELLS = "cl AS (SELECT vec_id, (p - 1) // 8 + 1 AS i, (p - 1) % 8 + 1 AS j, embedding[p]::DOUBLE AS v FROM embeddings, unnest(range(1, 65)) AS u(p))"
ATOMS = """atm AS (SELECT vec_id, CASE WHEN k < 6 THEN 'C' ELSE 'A' END AS chain, k // 2 + 1 AS r, embedding[k * 3 + 1]::DOUBLE * 10 AS x, embedding[k * 3 + 2]::DOUBLE * 10 AS y,
    embedding[k * 3 + 3]::DOUBLE * 10 AS z, k * 5.0::DOUBLE AS b, k FROM embeddings, unnest(range(0, 20)) AS u(k)),
    ap AS (SELECT p.vec_id, p.k AS pk, p.r AS pr, m.r AS mr, sqrt((p.x - m.x) ** 2 + (p.y - m.y) ** 2 + (p.z - m.z) ** 2) AS d FROM atm p JOIN atm m ON p.vec_id = m.vec_id AND p.chain = 'C' AND m.chain = 'A')"""
_NEXT = "list_transform({rest}, lambda x: list_min(list_transform({got}, lambda y: hamming(x, y))))"


def maxmin_sql(src: str, group: str, k: int, name: str = "mm", order: str = "peptide") -> str:
    """Recursive relations: ``mm`` has, by group, the list ``got`` of what max-min takes from ``src`` (group, distinct peptide),
    beginning with the first in ``order``."""
    far = _NEXT.format(rest="rest", got="got")
    return f"""{name}p AS (SELECT {group}, list(peptide ORDER BY {order}) AS pool FROM {src} GROUP BY {group}),
        {name}r AS (SELECT {group}, pool, [pool[1]] AS got FROM {name}p UNION ALL
          SELECT {group}, pool, list_append(got, rest[list_position({far}, list_max({far}))]) FROM (SELECT *, list_filter(pool, lambda z: NOT list_contains(got, z)) AS rest FROM {name}r WHERE len(got) < {k} AND len(got) < len(pool))),
        {name} AS (SELECT {group}, got FROM {name}r QUALIFY row_number() OVER (PARTITION BY {group} ORDER BY len(got) DESC) = 1)"""


def clusters_sql(src: str, keys: str, order: str, most: str) -> str:
    """Recursive relations: ``cl`` gives each peptide of ``src`` (by ``keys``) the first representative within ``most`` mismatches."""
    same = " AND ".join(f"q.{k} = g.{k}" for k in keys.split(", "))
    cols = ", ".join(f"q.{k}" for k in keys.split(", "))
    return f"""q AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS k FROM {src}),
        g AS (SELECT {keys}, k, peptide, peptide AS rep, [peptide] AS reps FROM q WHERE k = 1 UNION ALL
          SELECT {keys}, k, peptide, coalesce(h, peptide), CASE WHEN h IS NULL THEN list_append(reps, peptide) ELSE reps END FROM
            (SELECT {cols}, q.k, q.peptide, g.reps, list_filter(g.reps, lambda x: hamming(x, q.peptide) <= {most})[1] AS h FROM g JOIN q ON {same} AND q.k = g.k + 1)),
        cl AS (SELECT {keys}, peptide, rep FROM g)"""


OWN = f"""{CELLS}, ol AS (SELECT *, vec_id % 3 + 2 AS n, 8 - (vec_id % 3 + 2) + 1 AS f FROM cl), oc AS (SELECT *, i >= f AS fi FROM ol WHERE (i >= f) <> (j >= f))"""
CROSS = "((i BETWEEN 6 AND 8) <> (j BETWEEN 6 AND 8))"
SEEN = "EXISTS (SELECT 1 FROM tr WHERE tr.peptide = t.peptide)"
PAIR = "EXISTS (SELECT 1 FROM tr WHERE tr.peptide = t.peptide AND tr.allele = t.allele)"

SQL = {
    "leakage_flags": f"WITH {T}, {TR} SELECT test_id, CASE WHEN label = 1 THEN {PAIR} ELSE {SEEN} END AS in_train FROM t",
    "overlap_flags": f"WITH {T}, {TR} SELECT test_id, {PAIR} AS pair_in_train, {SEEN} AS entity_in_train, EXISTS (SELECT 1 FROM tr WHERE tr.allele = t.allele) AS group_in_train FROM t",
    "negative_member_share": f"WITH {T}, {TR}, m AS (SELECT fold_set, {SEEN} AS s FROM t WHERE label = 0) SELECT fold_set, count(*) AS n, count(*) FILTER (WHERE s) AS n_found, round(avg(s::INT), 6) AS share FROM m GROUP BY fold_set",
    "split_survival": f"WITH {T}, {TR}, m AS (SELECT fold_set, allele, {PAIR} AS s FROM t) SELECT fold_set, allele, count(*) AS n, count(*) FILTER (WHERE NOT s) AS n_new, round(count(*) FILTER (WHERE NOT s) / count(*)::DOUBLE * 100, 6) AS percent FROM m GROUP BY ALL",
    "held_out_rows": f"WITH {T}, {TR} SELECT train_id FROM tr WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.allele = tr.allele AND t.peptide = tr.peptide)",
    "validation_rows": f"WITH {T}, {TR} SELECT train_id FROM tr WHERE EXISTS (SELECT 1 FROM t WHERE t.allele = tr.allele AND t.peptide = tr.peptide)",
    "reject_counts": f"WITH {TR} SELECT tr.allele, count(*) AS n_rejected FROM tr LEFT JOIN data_type_coverage c ON c.allele = tr.allele WHERE c.atlas_ms IS NULL GROUP BY tr.allele",
    "coverage_filled": "SELECT c.allele, coalesce(affinity, 0) AS affinity, coalesce(n, 0) AS n_rows FROM data_type_coverage c LEFT JOIN (SELECT allele, count(*) AS n FROM atlas_labelled GROUP BY allele) a ON a.allele = c.allele",
    "outer_features": "SELECT coalesce(c.allele, m.allele) AS allele, locus, atlas_ms AS n, m.n AS n_train FROM data_type_coverage c FULL JOIN (SELECT allele, count(*) AS n FROM motmaen_train WHERE allele IS NOT NULL GROUP BY allele) m ON m.allele = c.allele",
    "aligned_counts": """SELECT allele, a.n AS atlas, b.n AS train, c.n AS tuned FROM (SELECT allele, count(*) AS n FROM atlas_labelled GROUP BY allele) a
        JOIN (SELECT allele, count(*) AS n FROM motmaen_train GROUP BY allele) b USING (allele) JOIN (SELECT allele, count(*) AS n FROM aff_finetuned GROUP BY allele) c USING (allele)""",
    "alias_join": r"""SELECT row_id, allele FROM rq3_variants_b37 v JOIN (SELECT DISTINCT allele, unnest([allele, lower(regexp_replace(allele, '[-*:]', '_', 'g')), replace(replace(replace(allele, 'HLA-', ''), '*', ''), ':', ''), replace(allele, '*', '')]) AS s
        FROM data_type_coverage) c ON v.hla_b_37_01 = c.s""",
    "band_controls": """SELECT a.s_suppkey, count(*) AS n_controls, round(avg(b.s_nationkey), 6) AS control_mean, round(a.s_nationkey - avg(b.s_nationkey), 6) AS difference FROM supplier a JOIN supplier b
        ON a.s_nationkey % 5 = 0 AND b.s_nationkey % 5 <> 0 AND abs(a.s_acctbal - b.s_acctbal) <= 200 GROUP BY a.s_suppkey, a.s_nationkey""",
    "hamming_join": f"WITH {T}, {TR} SELECT test_id AS left_id, train_id AS right_id, hamming(t.peptide, tr.peptide) AS distance FROM t JOIN tr ON length(t.peptide) = length(tr.peptide) AND hamming(t.peptide, tr.peptide) <= 2",
    "near_share": f"""WITH {T}, {TR}, a AS (SELECT DISTINCT peptide FROM t), b AS (SELECT DISTINCT peptide FROM tr),
        m AS (SELECT a.peptide, (SELECT min(hamming(a.peptide, b.peptide)) FROM b WHERE length(b.peptide) = length(a.peptide)) AS h FROM a)
        SELECT count(*) AS n, count(*) FILTER (WHERE h = 0) AS n_exact, count(*) FILTER (WHERE h <= 1) AS n_near FROM m""",
    "wild_type_delta": f"WITH {AFF}, w AS (SELECT allele, max(plddt_pep) AS wt FROM aff WHERE y = 1 AND plddt_pep IS NOT NULL GROUP BY allele) SELECT row_id, round(plddt_pep - wt, 6) AS delta FROM aff JOIN w USING (allele) WHERE y <> 1 AND plddt_pep IS NOT NULL",
    "unambiguous_peptides": """WITH a AS (SELECT * FROM atlas_labelled WHERE peptide IS NOT NULL AND label IS NOT NULL AND allele IS NOT NULL)
        SELECT allele, count(*) AS n FROM a WHERE (allele, peptide) NOT IN (SELECT (allele, peptide) FROM a GROUP BY allele, peptide HAVING count(DISTINCT label) > 1) GROUP BY allele""",
    "censored_labels": """SELECT CASE WHEN (r = 0 AND v < 5) OR (r = 1 AND v <= 5) THEN 1 WHEN (r = 0 AND v > 20) OR (r = 2 AND v >= 20) THEN 0 END AS outcome, count(*) AS n
        FROM (SELECT row_id % 3 AS r, inter_pae AS v FROM aff_finetuned) GROUP BY 1""",
    "position_frequency": f"WITH {FREQ} SELECT allele, pos, aa, round(freq, 6) AS freq FROM freq",
    "pwm_log_odds": f"WITH {FREQ} SELECT allele, pos, aa, round(ln(freq / 0.05::DOUBLE), 6) AS weight FROM freq",
    "pwm_score": f"WITH {T}, {FREQ}, q0 AS (SELECT test_id AS k, allele, peptide FROM t), {SCORE.format(src='q0', log='log2(freq / 0.05::DOUBLE)')} SELECT k AS test_id, round(score, 6) AS score FROM sc",
    "position_ic": f"WITH {IC} SELECT allele, pos, round(ic, 6) AS ic FROM ic",
    "derive_anchors": f"WITH {IC} SELECT allele, coalesce(string_agg(CASE WHEN ic >= 1 THEN CASE WHEN pos = 9 THEN -1 ELSE pos END END::VARCHAR, ',' ORDER BY pos), '') AS anchors FROM ic GROUP BY allele",
    "anchor_survey": f"""WITH {IC}, an AS (SELECT allele, coalesce(list(CASE WHEN pos = 9 THEN -1 ELSE pos END ORDER BY pos) FILTER (WHERE ic >= 1), []) AS a FROM ic GROUP BY allele)
        SELECT substr(allele, 5, 1) AS locus, count(*) AS n_groups, count(*) FILTER (WHERE list_sort(a) = [-1, 2]) AS n_default, count(*) FILTER (WHERE len(list_filter(a, lambda x: x <> 2 AND x <> -1)) > 0) AS n_extra,
        count(*) FILTER (WHERE NOT list_contains(a, 2)) AS n_without_first, count(*) FILTER (WHERE len(a) = 0) AS n_none FROM an GROUP BY 1""",
    "motif_breadth": f"WITH {IC} SELECT allele, count(*) FILTER (WHERE ic >= 1) AS n_informative, round(max(ic), 6) AS peak, round(sum(ic), 6) AS total, round(max(ic) / nullif(sum(ic), 0), 6) AS peak_share FROM ic GROUP BY allele",
    "ic_features": f"""WITH {IC}, f AS (SELECT allele, max(ic) FILTER (WHERE pos = 2) AS a, max(ic) FILTER (WHERE pos = 9) AS b, sum(ic) AS t FROM ic GROUP BY allele)
        SELECT allele, round(a, 6) AS ic_p2, round(b, 6) AS ic_last, round((a + b) / 2, 6) AS ic_p2_last, round(t, 6) AS ic_total FROM f""",
    "jsd_pairs": f"WITH {_jsd()} SELECT * FROM jp",
    "js_distance_anchors": f"WITH {_jsd('pos IN (2, 9)', 'sqrt(greatest(d, 0))')} SELECT * FROM jp",
    "motif_neighbours": f"""WITH {_jsd()}, {BOTH}, r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY jsd, b) AS rn FROM bw)
        SELECT a, round(min(jsd), 6) AS nn_dist, max(CASE WHEN rn = 1 THEN b END) AS nn, round(avg(jsd) FILTER (WHERE rn <= 3), 6) AS mean_k, round(avg(jsd), 6) AS mean_all FROM r GROUP BY a""",
    "farthest_donors": f"WITH {_jsd()}, {BOTH} SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY jsd DESC, b) AS place, jsd FROM bw QUALIFY place <= 3",
    "substitution_distance": f"""WITH {T}, cls AS (SELECT unnest(string_split(c, '')) AS x, c FROM unnest({CLASSES!r}) AS u(c)), l AS (SELECT test_id, substr(peptide, i, 1) AS x, substr(reverse(peptide), i, 1) AS y FROM (SELECT *, unnest(range(1, length(peptide) + 1)) AS i FROM t))
        SELECT test_id, round(1 - sum(CASE WHEN l.x = l.y THEN 4 WHEN a.c = b.c THEN 1 ELSE -1 END) / (count(*) * 4)::DOUBLE, 6) AS distance FROM l JOIN cls a ON a.x = l.x JOIN cls b ON b.x = l.y GROUP BY test_id""",
    "frequent_letters": f"WITH {COUNTS}, {WANT.format(n=2)} SELECT * FROM want",
    "carries_anchors": f"WITH {T}, {COUNTS}, {WANT.format(n=3)}, {CARRY} SELECT test_id, carries FROM ca",
    "hard_decoys": f"""WITH {T}, {FREQ}, {WANT.format(n=3)}, {CARRY}, q0 AS (SELECT peptide AS k, allele, peptide FROM nine), {SCORE.format(src='q0', log='log2(freq / 0.05::DOUBLE)')},
        cut AS (SELECT allele, quantile_cont(score, 0.75) AS cut FROM sc GROUP BY allele), q1 AS (SELECT test_id AS k, allele, peptide FROM t), {SCORE.format(src='q1', log='log2(freq / 0.05::DOUBLE)').replace('sc AS', 'sd AS')}
        SELECT sd.k AS test_id, round(sd.score, 6) AS score FROM sd JOIN cut USING (allele) JOIN ca ON ca.test_id = sd.k WHERE carries AND sd.score <= cut""",
    "canonical_top": f"""WITH {FREQ}, q0 AS (SELECT peptide AS k, allele, peptide FROM nine), {SCORE.format(src='q0', log='ln(freq / 0.05::DOUBLE)')}
        SELECT allele, k AS peptide FROM sc QUALIFY row_number() OVER (PARTITION BY allele ORDER BY round(score, 6) DESC NULLS LAST, k DESC) <= greatest(5, floor(count(*) OVER (PARTITION BY allele) * 0.1))""",
    "stratified_quota": """WITH c AS (SELECT locus, count(*) AS n FROM data_type_coverage GROUP BY locus), q AS (SELECT (SELECT n FROM c WHERE locus = 'HLA-C') AS nc, (SELECT n FROM c WHERE locus = 'HLA-A') AS na, (SELECT n FROM c WHERE locus = 'HLA-B') AS nb),
        l AS (SELECT least(30, nc) AS lc, least(5 + 30 - least(30, nc), na) AS la, nb, 5 + 30 - least(30, nc) AS qa FROM q),
        k AS (SELECT lc, la, least(5 + qa - la, nb) AS lb FROM l)
        SELECT locus, allele, row_number() OVER (PARTITION BY locus ORDER BY atlas_ms DESC, allele) AS picked FROM data_type_coverage, k
        QUALIFY picked <= CASE locus WHEN 'HLA-C' THEN lc WHEN 'HLA-A' THEN la WHEN 'HLA-B' THEN lb ELSE 0 END""",
    "dose_subsample": "SELECT row_id FROM atlas_labelled WHERE allele IS NOT NULL AND label IS NOT NULL QUALIFY row_number() OVER (PARTITION BY allele, label ORDER BY md5('0|' || row_id), row_id) <= 20",
    "repeated_trials": f"""WITH {NINE}, d AS (SELECT * FROM nine, unnest(range(0, 20)) AS u(trial) QUALIFY row_number() OVER (PARTITION BY allele, trial ORDER BY md5(trial || '|' || allele || '|' || peptide), allele, peptide) <= 200)
        SELECT allele, trial, count(*) AS n, count(DISTINCT substr(peptide, 2, 1)) AS n_second FROM d GROUP BY ALL""",
    "pool_negatives": f"""WITH {NINE}, need AS (SELECT allele, count(*) AS k, ('0x' || substr(md5('7|' || allele), 1, 8))::BIGINT AS f FROM nine GROUP BY allele),
        pool AS (SELECT peptide, row_number() OVER (ORDER BY md5('7|' || peptide), peptide) - 1 AS at_, count(*) OVER () AS size FROM (SELECT DISTINCT peptide FROM nine))
        SELECT allele, peptide, 0 AS label, 9 AS length FROM need, pool WHERE (allele, peptide) NOT IN (SELECT (allele, peptide) FROM nine)
        QUALIFY row_number() OVER (PARTITION BY allele ORDER BY (at_ - f % size + size) % size) <= k""",
    "window_negatives": f"""WITH {NINE}, tx AS (SELECT string_agg(peptide, '' ORDER BY peptide) AS t FROM nine GROUP BY allele), w AS (SELECT DISTINCT n AS length, substr(t, i, n) AS peptide FROM (SELECT t, n, unnest(range(1, length(t) - n + 2)) AS i FROM tx, unnest([8, 9]) AS u(n)))
        SELECT peptide, length FROM w WHERE regexp_full_match(peptide, '[{AA}]+') AND peptide NOT IN (SELECT peptide FROM nine) QUALIFY row_number() OVER (PARTITION BY length ORDER BY md5('3|' || peptide), peptide) <= CASE length WHEN 8 THEN 50 ELSE 100 END""",
    "saturation_variants": f"""WITH {T}, w AS (SELECT test_id, peptide FROM t)
        SELECT test_id, NULL::INT AS position, NULL AS aa, peptide AS variant FROM w UNION ALL
        SELECT test_id, i, aa, substr(peptide, 1, i - 1) || aa || substr(peptide, i + 1) FROM (SELECT *, unnest(range(1, length(peptide) + 1)) AS i FROM w), unnest(string_split('{AA}', '')) AS v(aa) WHERE aa <> substr(peptide, i, 1)""",
    "shapley_exact": f"""WITH {T} SELECT test_id, i AS position, round(i * (ascii(substr(peptide, i, 1)) - 68.0::DOUBLE), 6) AS phi
        FROM (SELECT *, unnest(range(1, 10)) AS i FROM t WHERE length(peptide) = 9)""",
    "landscape_sensitivity": f"WITH {LAND}, m AS (SELECT position, aa, avg(delta) AS delta FROM ld GROUP BY ALL) SELECT position, round(stddev_pop(delta), 6) AS sensitivity FROM m GROUP BY position",
    "landscape_top_positions": f"""WITH {LAND}, m AS (SELECT seed, position, aa, avg(delta) AS delta FROM ld GROUP BY ALL), s AS (SELECT seed, position, round(stddev_pop(delta), 6) AS v FROM m GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY v DESC, position) AS rn FROM s)
        SELECT seed, string_agg(position::VARCHAR, ',' ORDER BY rn) AS top, bool_and(position IN (2, 9)) AS recovers FROM r WHERE rn <= 2 GROUP BY seed""",
    "seed_stability": f"""WITH {LAND}, m AS (SELECT seed, position, avg(delta) AS v FROM ld GROUP BY ALL), j AS (SELECT x.seed AS a, y.seed AS b, x.v AS p, y.v AS q FROM m x JOIN m y USING (position) WHERE x.seed < y.seed),
        r AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY p) + (count(*) OVER (PARTITION BY a, b, p) - 1) / 2.0 AS rp, rank() OVER (PARTITION BY a, b ORDER BY q) + (count(*) OVER (PARTITION BY a, b, q) - 1) / 2.0 AS rq FROM j)
        SELECT a, b, count(*) AS n, round(corr(rp, rq), 6) AS rho FROM r GROUP BY ALL HAVING count(*) >= 5""",
    "exact_clusters": f"WITH {T}, f AS (SELECT peptide, min(test_id) AS o FROM t GROUP BY peptide) SELECT peptide, row_number() OVER (ORDER BY o, peptide) - 1 AS cluster FROM f",
    "cluster_holdout": f"""WITH {T}, f AS (SELECT peptide, row_number() OVER (ORDER BY min(test_id), peptide) - 1 AS cluster FROM t GROUP BY peptide), r AS (SELECT cluster, row_number() OVER (ORDER BY md5('42|' || cluster), cluster) AS rn, count(*) OVER () AS n FROM f)
        SELECT test_id, cluster, rn <= greatest(1, round_even(n * 0.2::DOUBLE, 0)) AS held_out FROM t JOIN f USING (peptide) JOIN r USING (cluster)""",
    "coverage_strata": """SELECT coalesce(least(floor((atlas_ms - lo) / nullif((hi - lo) / 4.0::DOUBLE, 0)), 3), 0)::INT AS stratum, count(*) AS n, min(atlas_ms) AS least, max(atlas_ms) AS most
        FROM (SELECT *, min(atlas_ms) OVER () AS lo, max(atlas_ms) OVER () AS hi FROM data_type_coverage) GROUP BY 1""",
    "key_spellings": r"""SELECT allele, lower(regexp_replace(allele, '[-*:]', '_', 'g')) AS slug, regexp_replace(replace(allele, 'HLA-', ''), '[*:]', '', 'g') AS short, replace(allele, '*', '') AS predictor, allele AS back, substr(allele, 5, 1) AS locus FROM data_type_coverage""",
    "encoded_sequences": f"""WITH {T} SELECT test_id, rtrim(string_agg(CASE WHEN i > length(peptide) THEN 0 WHEN strpos('{AA}', substr(peptide, i, 1)) > 0 THEN strpos('{AA}', substr(peptide, i, 1)) ELSE 21 END::VARCHAR, ',' ORDER BY i)) AS code,
        any_value(least(length(peptide), 12))::INT AS n_mask FROM (SELECT *, unnest(range(1, 13)) AS i FROM t) GROUP BY test_id""",
    "hamming_functions": f"WITH {T} SELECT test_id, hamming(peptide, reverse(peptide)) AS h, round(1 - hamming(peptide, reverse(peptide)) / length(peptide)::DOUBLE, 6) AS identity, hamming(peptide, reverse(peptide)) <= 6 AS near FROM t",
    "event_props": "SELECT k AS key, count(*) AS n, sum((props->>('$.' || k))::BIGINT)::BIGINT AS total FROM (SELECT props, unnest(json_keys(props)) AS k FROM events) GROUP BY k",
    "positives": f"""SELECT allele, length, count(*) AS n FROM (SELECT DISTINCT allele, upper(trim(peptide)) AS p, length(trim(peptide)) AS length FROM atlas_labelled WHERE label = 1 AND allele IS NOT NULL
        AND regexp_full_match(upper(trim(peptide)), '[{AA}]+') AND length(trim(peptide)) BETWEEN 8 AND 11) GROUP BY ALL""",
    "pae_blocks": f"""WITH {CELLS}, a AS (SELECT vec_id, avg(v) FILTER (WHERE {CROSS}) AS x, avg(v) FILTER (WHERE {CROSS} AND (i = 7 OR j = 7)) AS s, avg(v) FILTER (WHERE {CROSS} AND (i = 8 OR j = 8)) AS e,
        avg(v) FILTER (WHERE i BETWEEN 6 AND 8 AND j BETWEEN 6 AND 8) AS p, avg(v) AS w FROM cl GROUP BY vec_id)
        SELECT vec_id, round(x, 6) AS pae_pep_mhc, round(s, 6) AS pae_anchor2, round(e, 6) AS pae_anchor_last, round((s + e) / 2, 6) AS pae_anchors, round(p, 6) AS pae_pep, round(w, 6) AS pae_all FROM a""",
    "pae_consistency": f"""WITH {CELLS}, c AS (SELECT *, i BETWEEN 6 AND 8 AS f FROM cl WHERE {CROSS}), q AS (SELECT vec_id, i, avg(v) AS m FROM c WHERE f GROUP BY ALL),
        a AS (SELECT vec_id, stddev_pop(m) AS s FROM q GROUP BY vec_id), b AS (SELECT vec_id, abs(avg(v) FILTER (WHERE f) - avg(v) FILTER (WHERE NOT f)) AS y FROM c GROUP BY vec_id)
        SELECT vec_id, round(s, 6) AS pae_spread, round(y, 6) AS asymmetry FROM a JOIN b USING (vec_id)""",
    "pae_own_lengths": f"""WITH {OWN}, q AS (SELECT vec_id, i, avg(v) AS m FROM oc WHERE fi GROUP BY ALL), s AS (SELECT vec_id, stddev_pop(m) AS s FROM q GROUP BY vec_id),
        a AS (SELECT vec_id, avg(v) AS x, avg(v) FILTER (WHERE i = f + 1 OR j = f + 1) AS p, avg(v) FILTER (WHERE i = 8 OR j = 8) AS e, abs(avg(v) FILTER (WHERE fi) - avg(v) FILTER (WHERE NOT fi)) AS y FROM oc GROUP BY vec_id)
        SELECT vec_id, round(x, 6) AS pae_pep_mhc, round((p + e) / 2, 6) AS pae_anchors, round(s, 6) AS pae_spread, round(y, 6) AS asymmetry FROM a JOIN s USING (vec_id)""",
    "pae_anchors": f"""WITH {OWN}, w AS (SELECT vec_id, unnest([1, 2, 3]) AS k, unnest([2, vec_id % 4 + 1, -1]) AS a FROM embeddings),
        p AS (SELECT oc.vec_id, k, avg(v) AS m FROM oc JOIN w ON w.vec_id = oc.vec_id AND a <= n AND CASE WHEN a < 0 THEN f + n + a ELSE f + a - 1 END IN (i, j) GROUP BY ALL)
        SELECT vec_id, round(avg(m), 6) AS pae_anchors_ic FROM p GROUP BY vec_id""",
    "plddt_consistency": f"""WITH {ATOMS}, r AS (SELECT vec_id, r, avg(b) AS b, r = 2 OR r = vec_id % 4 + 1 OR r = 3 AS a FROM atm WHERE chain = 'C' GROUP BY ALL)
        SELECT vec_id, round(stddev_pop(b), 6) AS plddt_spread, round(avg(b) FILTER (WHERE a) - avg(b) FILTER (WHERE NOT a), 6) AS anchor_gap FROM r GROUP BY vec_id""",
    "contact_features": f"""WITH {ATOMS}, r AS (SELECT vec_id, pr, mr, min(d) AS d FROM ap GROUP BY ALL)
        SELECT vec_id, count(*) FILTER (WHERE d <= 4) AS n_contacts, count(DISTINCT pr) FILTER (WHERE d <= 4) AS n_pep_residues, count(DISTINCT mr) FILTER (WHERE d <= 4) AS n_mhc_residues,
        round(count(*) FILTER (WHERE d <= 4) / count(DISTINCT pr)::DOUBLE, 6) AS mean_degree, round(min(d), 6) AS min_distance FROM r GROUP BY vec_id""",
    "interface_geometry": f"""WITH {ATOMS}, r AS (SELECT vec_id, pr, count(*) FILTER (WHERE d < 4.5) AS c, count(*) FILTER (WHERE d < 3.5) AS h, min(d) AS m FROM ap GROUP BY ALL),
        t AS (SELECT vec_id, avg((m < 4.5)::INT) AS bf FROM (SELECT vec_id, pk, min(d) AS m FROM ap GROUP BY ALL) GROUP BY vec_id)
        SELECT vec_id, sum(c)::BIGINT AS n_contacts, sum(h)::BIGINT AS n_close, round(avg(c), 6) AS contacts_per_residue, max(c) FILTER (WHERE pr = 2) AS anchor2_contacts, max(c) FILTER (WHERE pr = 3) AS anchor_last_contacts,
        round(max(m) FILTER (WHERE pr = 2), 6) AS anchor2_min, round(max(m) FILTER (WHERE pr = 3), 6) AS anchor_last_min, round(avg(m), 6) AS mean_min_dist, round(any_value(bf), 6) AS buried_frac,
        sum(c * ((pr = 2)::INT + (pr = vec_id % 4 + 1)::INT + (pr = 3)::INT))::BIGINT AS anchor_ic_contacts FROM r JOIN t USING (vec_id) GROUP BY vec_id""",
    "interface_plddt": f"""WITH {ATOMS}, rs AS (SELECT vec_id, r, avg(b) AS b FROM atm WHERE chain = 'C' GROUP BY ALL), tc AS (SELECT DISTINCT vec_id, pr AS r FROM ap WHERE d <= 5)
        SELECT vec_id, round(avg(b) FILTER (WHERE t.r IS NOT NULL), 6) AS interface_plddt, round(avg(b), 6) AS peptide_plddt, count(t.r) AS n_interface, count(*) AS n_peptide
        FROM rs LEFT JOIN tc t USING (vec_id, r) GROUP BY vec_id""",
    "greedy_clusters": f"""WITH RECURSIVE {T}, f AS (SELECT peptide, min(test_id) AS o, length(peptide) AS n FROM t GROUP BY peptide), {clusters_sql('f', 'n', 'o', 'floor(0.2::DOUBLE * q.n + 1e-9)')}
        SELECT t.test_id, t.peptide, dense_rank() OVER (ORDER BY f.o) - 1 AS cluster FROM t JOIN cl ON cl.peptide = t.peptide JOIN f ON f.peptide = cl.rep""",
    "hamming_clusters": f"""WITH RECURSIVE {NINE}, {clusters_sql('nine', 'allele', 'peptide', '2')} SELECT allele, peptide, dense_rank() OVER (ORDER BY allele, rep) - 1 AS cluster FROM cl""",
    "maxmin_select": f"""WITH RECURSIVE {NINE}, {maxmin_sql('nine', 'allele', 12)} SELECT allele, unnest(got) AS peptide, unnest(range(1, len(got) + 1))::INT AS place FROM mm""",
    "spread_pick": """WITH RECURSIVE p AS (SELECT locus, list(allele ORDER BY atlas_ms, allele) AS k, list(atlas_ms::DOUBLE ORDER BY atlas_ms, allele) AS v FROM data_type_coverage WHERE atlas_ms IS NOT NULL GROUP BY locus),
        r AS (SELECT locus, k, v, CASE WHEN len(v) > 1 THEN [1, len(v)] ELSE [1] END AS got FROM p UNION ALL
          SELECT locus, k, v, list_append(got, list_position(gap, list_max(gap))) FROM (SELECT *, list_transform(range(1, len(v) + 1), lambda i: CASE WHEN list_contains(got, i) THEN -1 ELSE list_min(list_transform(got, lambda j: abs(v[i] - v[j]))) END) AS gap FROM r WHERE len(got) < 4 AND len(got) < len(v))),
        b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY locus ORDER BY len(got) DESC) = 1)
        SELECT locus, unnest(list_transform(got, lambda i: k[i])) AS allele, unnest(range(1, len(got) + 1))::INT AS place FROM b""",
    "grouped_fold_sizes": f"""WITH RECURSIVE {T}, c AS (SELECT count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, min(test_id)) AS k FROM t GROUP BY peptide),
        r AS (SELECT 0::BIGINT AS k, [0, 0, 0, 0, 0]::BIGINT[] AS s, [0, 0, 0, 0, 0]::BIGINT[] AS m UNION ALL
          SELECT k + 1, list_transform(s, lambda x, i: x + CASE WHEN i = at_ THEN n ELSE 0 END), list_transform(m, lambda x, i: x + CASE WHEN i = at_ THEN 1 ELSE 0 END)
          FROM (SELECT r.k, r.s, r.m, c.n, list_position(r.s, list_min(r.s)) AS at_ FROM r JOIN c ON c.k = r.k + 1)),
        b AS (SELECT * FROM r ORDER BY k DESC LIMIT 1)
        SELECT unnest(range(0, 5))::INT AS fold, unnest(s) AS n_rows, unnest(m) AS n_clusters FROM b""",
    "normalized_keys": r"""WITH a AS (SELECT hla_b_37_01 AS s, upper(regexp_replace(hla_b_37_01, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS u FROM rq3_variants_b37), b AS (SELECT *, regexp_replace(replace(u, ' ', ''), '^HLA-', '') AS t FROM a),
        c AS (SELECT *, CASE WHEN NOT contains(t, '*') AND length(t) >= 5 THEN regexp_replace(t, '^(\p{L}+)', '\1*') ELSE t END AS st FROM b),
        e AS (SELECT *, split_part(st, '*', 1) AS lo, regexp_replace(substr(st, strpos(st, '*') + 1), '[^0-9]', '', 'g') AS dg, regexp_replace(regexp_replace(u, '^HLA-', ''), '[*:]', '', 'g') AS k FROM c),
        x AS (SELECT 'HLA-' || CASE WHEN contains(st, '*') AND NOT contains(st, ':') AND length(dg) >= 4 THEN lo || '*' || substr(dg, 1, 2) || ':' || substr(dg, 3, 2) ELSE st END AS key,
          CASE WHEN regexp_full_match(k, '[ABC][0-9]{4,}') THEN 'HLA-' || substr(k, 1, 1) || '*' || substr(k, 2, 2) || ':' || substr(k, 4) END AS strict,
          CASE WHEN regexp_matches(upper(s), '[ABC]\*?\d{2}:?\d{2,3}') THEN 'HLA-' || regexp_extract(upper(s), '([ABC])\*?(\d{2}):?(\d{2,3})', 1) || '*' || regexp_extract(upper(s), '([ABC])\*?(\d{2}):?(\d{2,3})', 2) || ':' || regexp_extract(upper(s), '([ABC])\*?(\d{2}):?(\d{2,3})', 3) END AS found FROM e)
        SELECT key, strict, found, count(*) AS n FROM x GROUP BY ALL""",
    "subsample_inflation": f"""WITH {FREQ}, k AS (SELECT allele, count(*) AS n_full FROM nine GROUP BY allele HAVING count(*) > {TRIAL_SIZE}),
        d AS (SELECT nine.*, trial FROM nine JOIN k USING (allele), unnest(range(0, {TRIALS})) AS u(trial) QUALIFY row_number() OVER (PARTITION BY allele, trial ORDER BY md5(trial || '|' || allele || '|' || peptide), allele, peptide) <= {TRIAL_SIZE}),
        c AS (SELECT allele, trial, pos, substr(peptide, pos, 1) AS aa, count(*) AS n FROM (SELECT *, unnest(range(1, 10)) AS pos FROM d) WHERE contains('{AA}', substr(peptide, pos, 1)) GROUP BY ALL),
        gr AS (SELECT allele, trial, pos, aa FROM k, unnest(range(0, {TRIALS})) AS t(trial), unnest(range(1, 10)) AS u(pos), unnest(string_split('{AA}', '')) AS v(aa) WHERE aa <> ''),
        sf AS (SELECT allele, trial, pos, aa, (coalesce(n, 0) + 0.5) / (sum(coalesce(n, 0)) OVER (PARTITION BY allele, trial, pos) + 10)::DOUBLE AS freq FROM gr LEFT JOIN c USING (allele, trial, pos, aa)),
        j AS (SELECT x.allele, x.trial, y.allele AS b, pos, greatest(sum((x.freq * log2(x.freq / ((x.freq + y.freq) / 2)) + y.freq * log2(y.freq / ((x.freq + y.freq) / 2))) / 2), 0) AS d FROM sf x JOIN freq y USING (pos, aa) WHERE x.allele <> y.allele GROUP BY ALL),
        nn AS (SELECT allele, trial, min(m) AS nn FROM (SELECT allele, trial, b, avg(d) AS m FROM j GROUP BY ALL) GROUP BY ALL), sb AS (SELECT allele, avg(nn) AS m, stddev_pop(nn) AS s FROM nn GROUP BY allele),
        fp AS (SELECT x.allele AS a, y.allele AS b, pos, greatest(sum((x.freq * log2(x.freq / ((x.freq + y.freq) / 2)) + y.freq * log2(y.freq / ((x.freq + y.freq) / 2))) / 2), 0) AS d FROM freq x JOIN freq y USING (pos, aa) WHERE x.allele <> y.allele GROUP BY ALL),
        fl AS (SELECT a AS allele, min(m) AS f FROM (SELECT a, b, avg(d) AS m FROM fp GROUP BY ALL) GROUP BY a)
        SELECT allele, n_full, round(f, 6) AS nn_full, round(m, 6) AS nn_sub_mean, round(s, 6) AS nn_sub_sd, round(m - f, 6) AS inflation FROM k JOIN fl USING (allele) JOIN sb USING (allele)""",
}
