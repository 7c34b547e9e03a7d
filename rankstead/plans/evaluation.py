"""Queries of the metric, rank and gate operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankstead.operators import joins, learn, metrics, ranking, stats

R = 6
EDGES, BINS = [0.0, 20.0, 100.0, 1e12], ["rare", "mid", "common"]
MODELS = ["m1", "m2", "m3"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, R) for n in names})


def aff(spark: SparkSession, d: str) -> DataFrame:
    """Complexes of the fine-tuned network; a low error speaks for a binder."""
    return table(spark, d, "aff_finetuned").select("row_id", "allele", "peptide", "label", "inter_pae", "plddt_pep", (-F.col("inter_pae")).alias("score"))


def models(spark: SparkSession, d: str) -> DataFrame:
    """Three components of the embeddings as the scores of three models; the label is whether the class is even."""
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.col("label").alias("grp"), (F.col("vec_id") % 2).cast("int").alias("y"), *[F.col("embedding")[i].cast("double").alias(m) for i, m in enumerate(MODELS)])


def auroc_pooled(spark, d):
    return rounded(metrics.auroc(aff(spark, d), "label", "score"), "auroc")


def auroc_by_group(spark, d):
    return rounded(metrics.auroc(aff(spark, d), "label", "score", ["allele"]), "auroc")


def auroc_scopes(spark, d):
    a = aff(spark, d).filter("allele IS NOT NULL")
    return rounded(metrics.with_overall(metrics.auroc(a, "label", "score", ["allele"]), metrics.auroc(a, "label", "score"), "allele"), "auroc")


def feature_auroc_oriented(spark, d):
    return rounded(metrics.feature_auroc(aff(spark, d), "label", ["inter_pae", "plddt_pep"], ["inter_pae"]), "auroc")


def auroc_auto_orient(spark, d):
    a = metrics.feature_auroc(aff(spark, d), "label", ["inter_pae", "plddt_pep"], [])
    return rounded(metrics.auto_oriented(a).drop("n", "n_pos"), "auroc", "auroc_oriented")


def average_precision_by_group(spark, d):
    return rounded(metrics.average_precision(aff(spark, d), "label", "score", ["allele"]), "ap")


def ppv_at_k(spark, d):
    return rounded(metrics.ppv_at_k(aff(spark, d), "label", "score", "row_id", 10, ["allele"]), "ppv")


def metric_summary(spark, d):
    return rounded(metrics.summary(table(spark, d, "orders"), F.col("o_orderstatus") == "F", "o_totalprice", ["o_orderpriority"]), "auroc", "ap")


def _strata(spark, d):
    a = aff(spark, d).filter("allele IS NOT NULL")
    counts = a.groupBy("allele").agg(F.sum(F.col("label").cast("bigint")).alias("n_binders"))
    return a.join(counts.withColumn("stratum", metrics.assign_bins("n_binders", EDGES, BINS)).select("allele", "stratum"), "allele")


def equity_gap(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: AUROC by stratum of groups (binned by their binders), with the gap between best and worst."""
    return rounded(metrics.stratified(_strata(spark, d), "label", "score", "stratum"), "auroc", "gap")


def equity_compare_models(spark, d):
    long = metrics.unpivot(_strata(spark, d), ["row_id", "label", "stratum"], ["score", "plddt_pep"], "model", "s")
    return rounded(metrics.stratified(long, "label", "s", "stratum", ["model"]), "auroc", "gap")


def youden_point(spark, d):
    return rounded(metrics.youden_point(aff(spark, d), "label", "score", ["allele"]), "sensitivity", "specificity", "asymmetry", "threshold")


def margins(spark, d):
    return rounded(metrics.margins(aff(spark, d), "label", "score", ["allele"], ["row_id"]), "margin")


def worst_set_jaccard(spark, d):
    return rounded(metrics.worst_set_jaccard(models(spark, d), "vec_id", MODELS, 0.25), "jaccard", "chance")


def model_pair_spearman(spark, d):
    long = metrics.unpivot(models(spark, d), ["vec_id"], MODELS, "model", "value")
    return rounded(stats.pairwise_spearman(long, "model", ["vec_id"], "value", 20), "rho")


def partial_spearman(spark, d):
    return rounded(stats.partial_spearman(models(spark, d), "m1", "m2", "m3"), "raw_rho", "partial_rho", "rho_x_z")


def zscore_group(spark, d):
    return rounded(ranking.with_zscore(aff(spark, d), "inter_pae", ["allele"]).select("row_id", "z"), "z")


def zscore_table(spark, d):
    return rounded(ranking.with_zscore(models(spark, d), "m1", population=True).select("vec_id", "z"), "z")


def pct_rank_group(spark, d):
    a = aff(spark, d).filter("score IS NOT NULL")
    return rounded(ranking.ranked(a, "score", ["allele"], share="pct").select("row_id", "pct"), "pct")


def average_ranks(spark, d):
    """Average ranks by levels, which is how groups of any size are ranked."""
    return ranking.ranked(aff(spark, d).select("row_id", "allele", "score"), "score", ["allele"]).select("row_id", "rank")


def rank_average(spark, d):
    return rounded(ranking.with_rank_average(models(spark, d), MODELS).select("vec_id", "mean_rank"), "mean_rank")


def rank_gap(spark, d):
    return ranking.ranked_together(models(spark, d), ["m1", "m2"], ranks=["a", "b"]).select("vec_id", (F.col("a") - F.col("b")).alias("gap"))


def percentile_of_score(spark, d):
    return rounded(ranking.with_percentile_of_score(models(spark, d), "m1", ["grp"]).select("vec_id", "pct"), "pct")


def mad_gate(spark, d):
    return rounded(ranking.mad_gate(models(spark, d), "m1", "grp").select("vec_id", "gate"), "gate")


def entropy_gate(spark, d):
    return rounded(models(spark, d).select("vec_id", ranking.entropy_gate("m1").alias("gate")), "gate")


def minmax_gate(spark, d):
    return rounded(ranking.with_minmax_gate(models(spark, d), "m1").select("vec_id", "gate"), "gate")


def weight_sweep(spark, d):
    z = ranking.ranked_together(models(spark, d), ["m1", "m2"], shares=["a", "b"])
    return rounded(metrics.auroc(learn.weight_sweep(z, "a", "b"), "y", "mixed", ["weight"]), "auroc")


def group_stats(spark, d):
    return rounded(aff(spark, d).groupBy("allele").agg(F.count("inter_pae").alias("n"), F.avg("inter_pae").alias("mean"), F.stddev_samp("inter_pae").alias("sd"), F.min("inter_pae").alias("least"), F.median("inter_pae").alias("median"), F.max("inter_pae").alias("most")), "mean", "sd", "least", "median", "most")


def coverage_by_locus(spark, d):
    c = table(spark, d, "data_type_coverage")
    return c.groupBy("locus").agg(F.count(F.lit(1)).alias("n"), F.median("atlas_ms").alias("atlas"), F.median("affinity").alias("affinity"), F.median("mf_ms").alias("mf"), F.sum((F.coalesce("affinity", F.lit(0)) == 0).cast("bigint")).alias("n_zero"), F.max("affinity").alias("most"))


def length_counts(spark, d):
    return table(spark, d, "atlas_labelled").groupBy("length").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("allele").alias("n_alleles"))


def class_counts(spark, d):
    return joins.entity_prior(joins.conditional_counts(table(spark, d, "atlas_labelled").filter("allele IS NOT NULL"), ["allele"], "label")).withColumn("prior", F.round("prior", R))


def entity_prior_auroc(spark, d):
    """How well an entity's share of positives on one side predicts the labels on the other, by group."""
    rows = table(spark, d, "atlas_labelled").filter("peptide IS NOT NULL AND label IS NOT NULL")
    train, test = rows.filter("row_id % 5 <> 0"), rows.filter("row_id % 5 = 0")
    prior = joins.entity_prior(joins.conditional_counts(train, ["peptide"], "label")).select("peptide", "prior")
    return rounded(metrics.auroc(test.join(prior, "peptide"), "label", "prior", ["allele"]), "auroc")


def best_rows(spark, d):
    """The row with the highest and lowest score of each group (ties: least id)."""
    a = aff(spark, d).filter("score IS NOT NULL")
    return a.groupBy("allele").agg(F.max_by("row_id", F.struct("score", -F.col("row_id"))).alias("best"), F.min_by("row_id", F.struct("score", "row_id")).alias("worst"))


def class_gaps(spark, d):
    """Mean gap between binders and decoys where both have five rows or more."""
    n = lambda v: F.count(F.when(F.col("label") == v, F.col("inter_pae")))
    m = lambda v: F.avg(F.when(F.col("label") == v, F.col("inter_pae")))
    g = aff(spark, d).groupBy("allele").agg(n(1).alias("n1"), n(0).alias("n0"), (m(1) - m(0)).alias("gap"))
    return rounded(g.filter("n1 >= 5 AND n0 >= 5"), "gap")


def dispersion_vs_margin(spark, d):
    m = metrics.margins(aff(spark, d), "label", "score", ["allele"], ["row_id"]).join(table(spark, d, "aff_finetuned").select("row_id", "plddt_pep"), "row_id")
    m = m.withColumn("margin", F.round("margin", 9))
    s = m.groupBy("allele").agg(F.count_distinct("margin").alias("k")).filter("k >= 3").select("allele")
    return rounded(stats.spearman(m.join(s, "allele"), "margin", "plddt_pep", ["allele"]).filter("n >= 10"), "rho")


def ols_predictors(spark, d):
    o = stats.ols(models(spark, d), "m1", {"m2": F.col("m2"), "m3": F.col("m3"), "even": (F.col("grp") % 2)})
    return rounded(o, "coef", "se", "t", "p")


def one_predictor_ols(spark, d):
    return rounded(stats.one_predictor_ols(models(spark, d), "m1", "m2", ["grp"]), "slope", "intercept", "r2")


def bootstrap_ci(spark, d):
    return stats.bootstrap_ci(aff(spark, d).filter("allele IS NOT NULL"), "label", "score", ["row_id"], ["allele"])


def paired_bootstrap(spark, d):
    return stats.paired_bootstrap(models(spark, d), "y", "m1", "m2", ["vec_id"])


def poisson_bootstrap(spark, d):
    return stats.poisson_bootstrap(table(spark, d, "aff_finetuned").withColumn("s", -F.col("inter_pae")), F.col("label"), "s", "row_id")


def logo_logistic(spark, d):
    return learn.logo_predictions(models(spark, d), "grp", ["vec_id"], "y", MODELS)


def logo_pca_logistic(spark, d):
    return learn.logo_predictions(models(spark, d), "grp", ["vec_id"], "y", MODELS, components=2)


def logo_boosting(spark, d):
    return learn.boosting_logo(models(spark, d), "grp", ["vec_id"], "y", MODELS, rounds=60)


def gated_logo(spark, d):
    g = learn.gated(models(spark, d).withColumn("gate", ranking.entropy_gate("m3")), ["grp"], "m1", "m2", "gate")
    return learn.logo_predictions(g, "grp", ["vec_id"], "y", ["za", "zb", "ga", "gb"])


def shuffled_gate_logo(spark, d):
    m = learn.shuffled_gate(models(spark, d).withColumn("gate", ranking.entropy_gate("m3")), "gate", ["vec_id"], 1)
    return learn.logo_predictions(learn.gated(m, ["grp"], "m1", "m2", "gate"), "grp", ["vec_id"], "y", ["za", "zb", "ga", "gb"])


def stack_coefficients(spark, d):
    c = learn.logistic_coefficients(models(spark, d), "y", MODELS)
    return c.orderBy(F.desc(F.abs("coef"))).limit(12)


QUERIES = {
    f.__name__: f
    for f in (
        auroc_pooled, auroc_by_group, auroc_scopes, feature_auroc_oriented, auroc_auto_orient, average_precision_by_group, ppv_at_k, metric_summary, equity_gap,
        equity_compare_models, youden_point, margins, worst_set_jaccard, model_pair_spearman, partial_spearman, zscore_group, zscore_table, pct_rank_group,
        average_ranks, rank_average, rank_gap, percentile_of_score, mad_gate, entropy_gate, minmax_gate, weight_sweep, group_stats, coverage_by_locus, length_counts,
        class_counts, entity_prior_auroc, best_rows, class_gaps, dispersion_vs_margin, ols_predictors, one_predictor_ols, bootstrap_ci, paired_bootstrap,
        poisson_bootstrap, logo_logistic, logo_pca_logistic, logo_boosting, gated_logo, shuffled_gate_logo, stack_coefficients,
    )
}

# SQL. Relations used below.
AFF = "aff AS (SELECT row_id, allele, peptide, label AS y, inter_pae, plddt_pep, -inter_pae AS s FROM aff_finetuned)"
MOD = "mod AS (SELECT vec_id, label AS grp, vec_id % 2 AS y, embedding[1]::DOUBLE AS m1, embedding[2]::DOUBLE AS m2, embedding[3]::DOUBLE AS m3 FROM embeddings)"
STRATA = f"""{AFF}, cnt AS (SELECT allele, sum(y) AS n FROM aff WHERE allele IS NOT NULL GROUP BY allele),
    strata AS (SELECT aff.*, CASE WHEN n < 20 THEN 'rare' WHEN n < 100 THEN 'mid' ELSE 'common' END AS stratum FROM aff JOIN cnt USING (allele))"""


def _by(group: str) -> str:
    return f"PARTITION BY {group}" if group else ""


def _rank(s: str, group: str = "") -> str:
    part = f"PARTITION BY {group}, {s}" if group else f"PARTITION BY {s}"
    return f"(rank() OVER ({_by(group)} ORDER BY {s}) + (count(*) OVER ({part}) - 1) / 2.0)"


def auroc_sql(rel: str, group: str, s: str = "s", y: str = "y") -> str:
    g = f"{group}, " if group else ""
    tail = f"GROUP BY {group}" if group else ""
    return f"""SELECT {g}count(*) AS n, sum(y)::BIGINT AS n_pos,
        round((sum(CASE WHEN y = 1 THEN rk ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * (count(*) - sum(y)), 0), 6) AS auroc
        FROM (SELECT {g}{y}::INT AS y, {_rank(s, group)} AS rk FROM {rel} WHERE {y} IS NOT NULL AND {s} IS NOT NULL) {tail}"""


def levels_sql(rel: str, group: str, s: str = "s", y: str = "y") -> str:
    return f"""lev AS (SELECT *, sum(nn) OVER w AS cn, sum(pp) OVER w AS cp, sum(nn) OVER g AS n, sum(pp) OVER g AS p FROM
        (SELECT {group}, {s} AS s, count(*) AS nn, sum({y}::INT) AS pp FROM {rel} WHERE {s} IS NOT NULL AND {y} IS NOT NULL GROUP BY {group}, {s})
        WINDOW w AS (PARTITION BY {group} ORDER BY s DESC), g AS (PARTITION BY {group}))"""


_GAP = """SELECT {m}stratum, n, n_pos, auroc,
        CASE WHEN k >= 2 THEN round(hi - lo, 6) END AS gap, CASE WHEN k >= 2 THEN best END AS best, CASE WHEN k >= 2 THEN worst END AS worst
        FROM (SELECT *, count(auroc) OVER w AS k, max(auroc) OVER w AS hi, min(auroc) OVER w AS lo,
              first_value(stratum) OVER (PARTITION BY {p} ORDER BY auroc DESC NULLS LAST, stratum) AS best,
              first_value(stratum) OVER (PARTITION BY {p} ORDER BY auroc ASC NULLS LAST, stratum) AS worst
              FROM ({a}) WINDOW w AS (PARTITION BY {p}))"""
_AP = "round(sum(pp / p::DOUBLE * (cp / cn::DOUBLE)), 6)"
_MARGIN = f"""WITH {AFF}, mg AS (SELECT allele, row_id, plddt_pep, CASE WHEN y = 1 THEN (rk - rc) / nullif(n - nc, 0) ELSE 1 - (rk - rc) / nullif(n - nc, 0) END AS margin FROM
    (SELECT *, {_rank('s', 'allele')} AS rk, {_rank('s', 'allele, y')} AS rc, count(*) OVER (PARTITION BY allele) AS n, count(*) OVER (PARTITION BY allele, y) AS nc
     FROM aff WHERE s IS NOT NULL AND y IS NOT NULL))"""

SQL = {
    "auroc_pooled": f"WITH {AFF} {auroc_sql('aff', '')}",
    "auroc_by_group": f"WITH {AFF} {auroc_sql('aff', 'allele')}",
    "auroc_scopes": f"""WITH {AFF}, k AS (SELECT * FROM aff WHERE allele IS NOT NULL)
        SELECT 'per_group' AS scope, * FROM ({auroc_sql('k', 'allele')}) UNION ALL SELECT 'pooled', 'ALL', * FROM ({auroc_sql('k', '')})""",
    "feature_auroc_oriented": f"""WITH {AFF}, l AS (SELECT 'inter_pae' AS feature, y, s FROM aff UNION ALL SELECT 'plddt_pep', y, plddt_pep FROM aff) {auroc_sql('l', 'feature')}""",
    "auroc_auto_orient": f"""WITH {AFF}, l AS (SELECT 'inter_pae' AS feature, y, inter_pae AS s FROM aff UNION ALL SELECT 'plddt_pep', y, plddt_pep FROM aff)
        SELECT feature, auroc, round(greatest(auroc, 1 - auroc), 6) AS auroc_oriented, CASE WHEN auroc >= 0.5 THEN 1 ELSE -1 END AS direction FROM ({auroc_sql('l', 'feature')})""",
    "average_precision_by_group": f"WITH {AFF}, {levels_sql('aff', 'allele')} SELECT allele, any_value(n)::BIGINT AS n, any_value(p)::BIGINT AS n_pos, CASE WHEN any_value(n) > any_value(p) AND any_value(p) > 0 THEN {_AP} END AS ap FROM lev GROUP BY allele",
    "ppv_at_k": f"WITH {AFF} SELECT allele, round(avg(y), 6) AS ppv FROM (SELECT *, row_number() OVER (PARTITION BY allele ORDER BY s DESC, row_id) AS rn FROM aff WHERE s IS NOT NULL) WHERE rn <= 10 GROUP BY allele",
    "metric_summary": f"""WITH o AS (SELECT o_orderpriority, (o_orderstatus = 'F')::INT AS y, o_totalprice AS s FROM orders), {levels_sql('o', 'o_orderpriority')},
        ap AS (SELECT o_orderpriority, {_AP} AS ap FROM lev GROUP BY ALL) SELECT a.*, ap FROM ({auroc_sql('o', 'o_orderpriority')}) a JOIN ap USING (o_orderpriority)""",
    "equity_gap": f"WITH {STRATA} " + _GAP.format(m="", p="1", a=auroc_sql("strata", "stratum")),
    "equity_compare_models": f"""WITH {STRATA}, l AS (SELECT 'score' AS model, stratum, y, s FROM strata UNION ALL SELECT 'plddt_pep', stratum, y, plddt_pep FROM strata) """
    + _GAP.format(m="model, ", p="model", a=auroc_sql("l", "model, stratum")),
    "youden_point": f"""WITH {AFF}, {levels_sql('aff', 'allele')}, t AS (SELECT allele, s, cp / p::DOUBLE AS tpr, (cn - cp) / (n - p)::DOUBLE AS fpr FROM lev WHERE p > 0 AND n > p)
        SELECT allele, round(tpr, 6) AS sensitivity, round(1 - fpr, 6) AS specificity, round(tpr - (1 - fpr), 6) AS asymmetry, round(s, 6) AS threshold FROM t
        QUALIFY row_number() OVER (PARTITION BY allele ORDER BY round(tpr - fpr, 9) DESC, s DESC) = 1""",
    "margins": f"{_MARGIN} SELECT allele, row_id, round(margin, 6) AS margin FROM mg",
    "worst_set_jaccard": f"""WITH {MOD}, l AS (UNPIVOT (SELECT vec_id, m1, m2, m3 FROM mod) ON m1, m2, m3 INTO NAME model VALUE v),
        w AS (SELECT model, vec_id FROM l QUALIFY row_number() OVER (PARTITION BY model ORDER BY v, vec_id) <= greatest(1, floor(count(*) OVER (PARTITION BY model) * 0.25))),
        z AS (SELECT model, count(*) AS n FROM w GROUP BY model)
        SELECT p.model AS a, q.model AS b, round(k / (p.n + q.n - k)::DOUBLE, 6) AS jaccard, round(0.25 / 1.75, 6)::DOUBLE AS chance
        FROM z p JOIN z q ON p.model < q.model, LATERAL (SELECT count(*) AS k FROM w x JOIN w y USING (vec_id) WHERE x.model = p.model AND y.model = q.model)""",
    "model_pair_spearman": f"""WITH {MOD}, l AS (UNPIVOT (SELECT vec_id, m1, m2, m3 FROM mod) ON m1, m2, m3 INTO NAME model VALUE v),
        r AS (SELECT model, vec_id, {_rank('v', 'model')} AS rk FROM l)
        SELECT x.model AS a, y.model AS b, count(*) AS n, round(corr(x.rk, y.rk), 6) AS rho FROM r x JOIN r y USING (vec_id) WHERE x.model < y.model GROUP BY ALL""",
    "partial_spearman": f"""WITH {MOD}, r AS (SELECT {_rank('m1')} AS x, {_rank('m2')} AS y, {_rank('m3')} AS z FROM mod), c AS (SELECT count(*) AS n, corr(x, y) AS xy, corr(x, z) AS xz, corr(y, z) AS yz FROM r)
        SELECT n, round(xy, 6) AS raw_rho, round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) AS partial_rho, round(xz, 6) AS rho_x_z FROM c""",
    "zscore_group": "SELECT row_id, round((inter_pae - avg(inter_pae) OVER w) / nullif(stddev_samp(inter_pae) OVER w, 0), 6) AS z FROM aff_finetuned WINDOW w AS (PARTITION BY allele)",
    "zscore_table": f"WITH {MOD} SELECT vec_id, round((m1 - avg(m1) OVER ()) / stddev_pop(m1) OVER (), 6) AS z FROM mod",
    "pct_rank_group": f"WITH {AFF} SELECT row_id, round({_rank('s', 'allele')} / count(*) OVER (PARTITION BY allele), 6) AS pct FROM aff WHERE s IS NOT NULL",
    "average_ranks": f"WITH {AFF}, r AS (SELECT row_id, {_rank('s', 'allele')} AS rank FROM aff WHERE s IS NOT NULL) SELECT row_id, rank FROM aff LEFT JOIN r USING (row_id)",
    "rank_average": f"WITH {MOD} SELECT vec_id, round(({_rank('m1')} + {_rank('m2')} + {_rank('m3')}) / count(*) OVER () / 3, 6) AS mean_rank FROM mod",
    "rank_gap": f"WITH {MOD} SELECT vec_id, {_rank('m1')} - {_rank('m2')} AS gap FROM mod",
    "percentile_of_score": f"WITH {MOD} SELECT vec_id, round((rank() OVER (PARTITION BY grp ORDER BY m1) - 1) / count(*) OVER (PARTITION BY grp)::DOUBLE * 100, 6) AS pct FROM mod",
    "mad_gate": f"""WITH {MOD}, o AS (SELECT vec_id, grp, abs(m1 - median(m1) OVER (PARTITION BY grp)) AS d FROM mod)
        SELECT vec_id, round(coalesce(1 / (1 + d / nullif(median(d) OVER (PARTITION BY grp), 0)), 0.5), 6) AS gate FROM o""",
    "entropy_gate": f"WITH {MOD}, q AS (SELECT vec_id, least(greatest(1 / (1 + exp(-m1)), 1e-6), 1 - 1e-6) AS p FROM mod) SELECT vec_id, round(1 + p * log2(p) + (1 - p) * log2(1 - p), 6) AS gate FROM q",
    "minmax_gate": f"WITH {MOD} SELECT vec_id, round(CASE WHEN max(m1) OVER () = min(m1) OVER () THEN 0.5 ELSE 1 - (m1 - min(m1) OVER ()) / (max(m1) OVER () - min(m1) OVER ()) END, 6) AS gate FROM mod",
    "weight_sweep": f"""WITH {MOD}, r AS (SELECT y, {_rank('m1')} / count(*) OVER () AS a, {_rank('m2')} / count(*) OVER () AS b FROM mod),
        l AS (SELECT y, w / 10.0::DOUBLE AS weight, (w / 10.0::DOUBLE) * a + (1 - w / 10.0::DOUBLE) * b AS s FROM r, unnest(range(0, 11)) AS t(w)) {auroc_sql('l', 'weight')}""",
    "group_stats": """SELECT allele, count(inter_pae) AS n, round(avg(inter_pae), 6) AS mean, round(stddev_samp(inter_pae), 6) AS sd, round(min(inter_pae), 6) AS least,
        round(median(inter_pae), 6) AS median, round(max(inter_pae), 6) AS most FROM aff_finetuned GROUP BY allele""",
    "coverage_by_locus": """SELECT locus, count(*) AS n, median(atlas_ms) AS atlas, median(affinity) AS affinity, median(mf_ms) AS mf,
        count(*) FILTER (WHERE coalesce(affinity, 0) = 0) AS n_zero, max(affinity) AS most FROM data_type_coverage GROUP BY locus""",
    "length_counts": "SELECT length, count(*) AS n, count(DISTINCT allele) AS n_alleles FROM atlas_labelled GROUP BY length",
    "class_counts": """SELECT allele, p AS n_pos, q AS n_neg, round(p / nullif(p + q, 0)::DOUBLE, 6) AS prior FROM
        (SELECT allele, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS q FROM atlas_labelled WHERE allele IS NOT NULL GROUP BY allele)""",
    "entity_prior_auroc": f"""WITH r AS (SELECT * FROM atlas_labelled WHERE peptide IS NOT NULL AND label IS NOT NULL),
        p AS (SELECT peptide, avg(label) AS prior FROM r WHERE row_id % 5 <> 0 GROUP BY peptide),
        t AS (SELECT allele, label AS y, prior AS s FROM r JOIN p USING (peptide) WHERE row_id % 5 = 0) {auroc_sql('t', 'allele')}""",
    "best_rows": f"""WITH {AFF} SELECT DISTINCT allele, first_value(row_id) OVER (PARTITION BY allele ORDER BY s DESC, row_id) AS best, first_value(row_id) OVER (PARTITION BY allele ORDER BY s, row_id) AS worst
        FROM aff WHERE s IS NOT NULL""",
    "class_gaps": """SELECT allele, count(inter_pae) FILTER (WHERE label = 1) AS n1, count(inter_pae) FILTER (WHERE label = 0) AS n0,
        round(avg(inter_pae) FILTER (WHERE label = 1) - avg(inter_pae) FILTER (WHERE label = 0), 6) AS gap FROM aff_finetuned GROUP BY allele HAVING n1 >= 5 AND n0 >= 5""",
    "dispersion_vs_margin": f"""{_MARGIN}, k AS (SELECT allele FROM mg GROUP BY allele HAVING count(DISTINCT round(margin, 9)) >= 3), j AS (SELECT allele, plddt_pep, round(margin, 9) AS margin FROM mg JOIN k USING (allele) WHERE margin IS NOT NULL AND plddt_pep IS NOT NULL)
        SELECT allele, count(*) AS n, round(corr(a, b), 6) AS rho FROM (SELECT allele, {_rank('margin', 'allele')} AS a, {_rank('plddt_pep', 'allele')} AS b FROM j) GROUP BY allele HAVING count(*) >= 10""",
    "one_predictor_ols": f"WITH {MOD} SELECT grp, round(regr_slope(m1, m2), 6) AS slope, round(regr_intercept(m1, m2), 6) AS intercept, round(regr_r2(m1, m2), 6) AS r2 FROM mod GROUP BY grp",
}
