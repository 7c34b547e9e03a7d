"""Queries of the composed selections, the statistics in tables and the sources, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankstead.functions import keys
from rankstead.functions.text import folded
from rankstead.operators import compose, joins, learn, metrics, motif, ranking, select, stats
from rankstead.plans.evaluation import AFF, MOD, MODELS, aff, auroc_sql, models, rounded, table
from rankstead.plans.sequences import AA, BOTH, COUNTS, FREQ, IC, NINE, T, _jsd, maxmin_sql, nine, tests
from rankstead.sources import files


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Distances of all pairs of alleles, rounded so that ties are ties everywhere."""
    f = motif.frequencies(nine(spark, d), ["allele"], "peptide", 9)
    return rounded(motif.divergence(f, "allele"), "jsd").withColumnRenamed("jsd", "d")


def _consensus(spark: SparkSession, d: str) -> DataFrame:
    return motif.consensus(motif.position_counts(nine(spark, d), ["allele"], "peptide"), ["allele"])


# Decoys


def hard_decoy_candidates(spark, d):
    return rounded(compose.hard_candidates(nine(spark, d), "allele", "peptide", 9), "score")


def clean_decoy_candidates(spark, d):
    return rounded(compose.clean_candidates(nine(spark, d), _pairs(spark, d), "allele", "peptide", 9), "score")


def donor_decoy_candidates(spark, d):
    return compose.donor_candidates(nine(spark, d), _pairs(spark, d), "allele", "peptide")


def clean_decoys(spark, d):
    return compose.decoys(compose.clean_candidates(nine(spark, d), _pairs(spark, d), "allele", "peptide", 9), "allele", "peptide", 2)


def donor_decoys(spark, d):
    return compose.decoys(compose.donor_candidates(nine(spark, d), _pairs(spark, d), "allele", "peptide"), "allele", "peptide", 2)


# Benchmark sets


def consensus_letters(spark, d):
    return _consensus(spark, d)


def diverse_set(spark, d):
    return compose.diverse_set(nine(spark, d), _consensus(spark, d), "allele", "peptide", "consensus", 5, 4, ["HLA-A*02:01"])


def canonical_set(spark, d):
    return compose.canonical_set(nine(spark, d), _consensus(spark, d), "allele", "peptide", "consensus", 9, 5, 2, forced=["HLA-A*02:01"])


def _measured(spark, d) -> tuple:
    a = aff(spark, d).filter("allele IS NOT NULL AND peptide IS NOT NULL AND inter_pae IS NOT NULL").withColumn("peptide", folded("peptide"))
    a = a.withColumn("rel", F.element_at(F.array(F.lit("="), F.lit("<"), F.lit(">")), (F.col("row_id") % 3 + 1).cast("int")))
    known = table(spark, d, "atlas_labelled").filter("label = 1 AND peptide IS NOT NULL").select(folded("peptide").alias("peptide"))
    return compose.measured_set(a, "allele", "peptide", "inter_pae", "rel", known, 2, 10.0, 15.0)


def measured_set(spark, d):
    return _measured(spark, d)[0]


def measured_report(spark, d):
    return _measured(spark, d)[1]


def _panel_rows(spark, d) -> DataFrame:
    c = table(spark, d, "data_type_coverage")
    return c.select("allele", F.col("atlas_ms").cast("double").alias("score"), F.coalesce("mf_ms", F.lit(0)).cast("double").alias("spread"), (F.coalesce("affinity", F.lit(0)) > 0).alias("eligible"))


def panel_by_score(spark, d):
    return compose.panel_by_score(_panel_rows(spark, d), "allele", "score", "spread", 15, keep=["HLA-A*02:01", "HLA-B*07:02"])


def panel_by_isolation(spark, d):
    return compose.panel_by_isolation(_panel_rows(spark, d), "allele", "score", 15, [3.0, 2.0, 1.0, 1.0], keep=["HLA-A*02:01", "HLA-B*07:02"])


def ablation_cells(spark, d):
    """Rows, positives and alleles of each cell of the two-by-two ablation around one allele."""
    a = table(spark, d, "atlas_labelled").filter("allele IS NOT NULL AND label IS NOT NULL").select("row_id", "allele", "label")
    cells = compose.ablation_cells(a, "allele", "label", ["row_id"], "HLA-A*02:01", keys.is_family("allele", pattern=r"HLA-A\*02:"), 20)
    return cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("n_pos"), F.count_distinct("allele").alias("n_alleles"), F.sum("row_id").alias("row_sum"))


def family_rows(spark, d):
    """Rows of each allele of two families, by prefix and by pattern."""
    a = table(spark, d, "atlas_labelled").withColumns({"in_a2": keys.is_family("allele", prefix="HLA-A*02:"), "in_a3": keys.is_family("allele", pattern=r"HLA-A\*(03|11):")})
    return a.filter("in_a2 OR in_a3").groupBy("allele", "in_a2", "in_a3").agg(F.count(F.lit(1)).alias("n"))


def planted_labels(spark, d):
    t = table(spark, d, "atlas_labelled").filter("peptide IS NOT NULL").select("row_id", folded("peptide").alias("p"))
    return t.select("row_id", compose.planted_label("p", F.lit("L"), 5).alias("label"))


def landscape_recovery(spark, d):
    """The two most informative places of each allele against its anchors."""
    ic = motif.information_content(nine(spark, d), ["allele"], "peptide", 9).withColumn("ic", F.round("ic", 6))
    top = select.top_positions(ic.withColumnRenamed("pos", "position"), ["allele"], value="ic")
    r = compose.anchor_recovery(top, motif.anchors(ic, ["allele"], 9), ["allele"], 9)
    return r.select("allele", F.array_join(F.col("top").cast("array<string>"), ",").alias("top"), "recovers")


def ic_anchor_means(spark, d):
    ic = motif.information_content(nine(spark, d), ["allele"], "peptide", 9)
    f = motif.ic_features(ic, ["allele"], 9, motif.anchors(ic, ["allele"], 9))
    return rounded(f.select("allele", "ic_anchor_mean"), "ic_anchor_mean")


def whole_frequencies(spark, d):
    """Letter frequencies over sequences without any foreign letter."""
    own = table(spark, d, "atlas_labelled").filter("label = 1 AND allele IS NOT NULL").select("allele", folded("peptide").alias("peptide")).distinct()
    return rounded(motif.frequencies(own, ["allele"], "peptide", 9, whole=True), "freq")


# Statistics


def metric_bundle(spark, d):
    return rounded(metrics.bundle(aff(spark, d), "label", "score", "row_id", ["allele"]), "auroc", "ap", "ppv")


def standardised_orientation(spark, d):
    a = aff(spark, d).filter("allele IS NOT NULL")
    return rounded(metrics.standardised_orientation(a, "label", ["inter_pae", "plddt_pep"], "allele"), "auroc", "auroc_z")


def correlation_p(spark, d):
    long = metrics.unpivot(models(spark, d), ["vec_id"], MODELS, "model", "value")
    return rounded(stats.with_correlation_p(stats.pairwise_spearman(long, "model", ["vec_id"], "value"), "rho", "n"), "rho", "p")


def one_sample_t(spark, d):
    return rounded(stats.one_sample_t(models(spark, d), "m1", ["grp"]), "mean", "ci_lo", "ci_hi", "t", "p").drop("p")


def mann_whitney(spark, d):
    return rounded(stats.mann_whitney(aff(spark, d), "label", "score", ["allele"]), "auroc", "p")


def ols_dummies(spark, d):
    m = models(spark, d)
    o = stats.ols(m, "m1", stats.dummies(m, "grp"))
    return rounded(o.drop("p"), "coef", "se", "t", "r2")


def ols_standardised(spark, d):
    m = stats.standardised(models(spark, d), MODELS)
    o = stats.ols(m, "m1", {"m2": F.col("m2"), "m3": F.col("m3")})
    return rounded(o.filter("term <> 'intercept'").select("term", "coef", "r2", "n"), "coef", "r2")


def seed_stability_summary(spark, d):
    long = metrics.unpivot(models(spark, d), ["vec_id", "grp"], MODELS, "model", "value")
    a = long.select("grp", "vec_id", F.col("model").alias("a"), F.col("value").alias("va"))
    b = long.select("grp", "vec_id", F.col("model").alias("b"), F.col("value").alias("vb"))
    rho = stats.spearman(a.join(b, ["grp", "vec_id"]).filter("a < b"), "va", "vb", ["grp", "a", "b"]).filter("n > 20")
    return rounded(stats.stability(rho, ["grp"]), "mean_rho", "min_rho")


def verdict_ladder(spark, d):
    per = metrics.auroc(aff(spark, d), "label", "score", ["allele"])
    return per.select("allele", stats.ladder(F.round("auroc", 6), [(0.9, "high"), (0.7, "fair"), (0.5, "low")], "reversed").alias("verdict")).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def plot_rows(spark, d):
    """What a strip plot by locus shows: each group's value with its locus' median, and whether it is among the worst four."""
    c = table(spark, d, "data_type_coverage").select("allele", "locus", F.col("atlas_ms").alias("value"))
    worst = ranking.top_k(c, 4, [], [F.col("value"), F.col("allele")]).select("allele", F.lit(True).alias("named"))
    m = c.groupBy("locus").agg(F.median("value").alias("locus_median"))
    return c.join(m, "locus").join(worst, "allele", "left").fillna(False, ["named"])


def feature_block(spark, d):
    a = table(spark, d, "aff_finetuned").select("row_id", "label", "inter_pae", "plddt_pep")
    b = learn.impute_mean(learn.feature_block(a, ["row_id"], "tuned", ["inter_pae"]), ["tuned__inter_pae", "tuned__plddt_pep"])
    return rounded(b, "tuned__inter_pae", "tuned__plddt_pep")


def gate_controls(spark, d):
    """AUROC of the gated model, of the ungated one, and of five shuffles of the gate."""
    m = models(spark, d).withColumn("gate", ranking.entropy_gate("m3"))
    return rounded(metrics.auroc(learn.gate_controls(m, "grp", ["vec_id"], "y", "m1", "m2", "gate"), "label", "score", ["model"]), "auroc")


def predicted_scores(spark, d):
    """A given linear model over Arrow batches."""
    return rounded(learn.predict_batches(models(spark, d), ["vec_id"], MODELS, lambda x: x @ [0.5, -1.0, 2.0] + 0.25), "score")


# Sources and sinks


def _blocks(spark, d) -> DataFrame:
    """Captured outputs of a predictor: the lines of each run below a header of their own."""
    head = "Pos MHC Peptide Core Of Gp Gl Ip Il Icore Identity Score_EL %Rank_EL Score_BA %Rank_BA Aff(nM) BindLevel"
    lines = table(spark, d, "netmhcpanrecord").filter("layout = 'stdout' AND raw IS NOT NULL AND run_id IS NOT NULL AND line_no IS NOT NULL")
    lines = lines.select("run_id", "line_no", "record_id", F.regexp_replace("raw", r"[\r\n]", " ").alias("raw"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "record_id", "raw"))), lambda x: x["raw"]), "\n")
    return lines.groupBy("run_id").agg(F.concat(F.lit(head + "\n"), text).alias("text"))


def predictor_records(spark, d):
    """Typed rows of the first block of each run."""
    r = files.predictor_records(files.parse_predictor_blocks(_blocks(spark, d), "run_id", "text"), "run_id")
    return rounded(r.select("run_id", F.col("line_no").cast("int").alias("line_no"), "allele", "peptide", "pos", "score_el", "rank_ba", "aff_nm", "bind_level", "is_binder"), "score_el", "rank_ba", "aff_nm")


def reject_report(spark, d):
    """Wanted pairs that no output covers, and outputs nobody wanted, by kind."""
    t, a = tests(spark, d).select("allele", "peptide"), aff(spark, d).filter("allele IS NOT NULL AND peptide IS NOT NULL").select("allele", folded("peptide").alias("peptide"))
    return files.unmatched(t, a, ["allele", "peptide"]).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def target_sequences(spark, d):
    """Targets of nine letters, on chains made of the region names."""
    t = tests(spark, d).select(F.col("kind").alias("tag"), keys.key_to_slug("allele").alias("allele_slug"), "peptide")
    chains = table(spark, d, "data_type_coverage").select(keys.key_to_slug("allele").alias("allele_slug"), F.rpad("allele", 15, "G").alias("sequence"))
    return files.target_sequences(t, chains, 24)[0]


def target_rejects(spark, d):
    t = tests(spark, d).select(F.col("kind").alias("tag"), keys.key_to_slug("allele").alias("allele_slug"), "peptide")
    chains = table(spark, d, "data_type_coverage").filter("locus = 'HLA-A'").select(keys.key_to_slug("allele").alias("allele_slug"), F.rpad("allele", 15, "G").alias("sequence"))
    return files.target_sequences(t, chains, 24)[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def alignment_problems(spark, d):
    """Validation of template alignments made of the suppliers, some of which are damaged."""
    s = table(spark, d, "supplier").select((F.col("s_suppkey") % 40).alias("file"), F.lit(3).alias("target_len"), F.when(F.col("s_suppkey") % 7 == 0, 4).otherwise(3).alias("template_len"), F.when(F.col("s_suppkey") % 11 == 0, "0:0;1:2;2:2").otherwise("0:0;1:1;2:2").alias("alignstring"))
    return files.validated_alignment(s, "file")


def first_rows(spark, d):
    """Distinct peptides of the training side, each with its first row."""
    t = table(spark, d, "motmaen_train").filter("peptide IS NOT NULL").select("train_id", "allele", folded("peptide").alias("peptide"))
    return joins.first_rows(t, ["peptide"], "train_id")


QUERIES = {
    f.__name__: f
    for f in (
        hard_decoy_candidates, clean_decoy_candidates, donor_decoy_candidates, clean_decoys, donor_decoys, consensus_letters, diverse_set, canonical_set, measured_set, measured_report, panel_by_score,
        panel_by_isolation, ablation_cells, family_rows, planted_labels, landscape_recovery, ic_anchor_means, whole_frequencies, metric_bundle, standardised_orientation, correlation_p, one_sample_t,
        mann_whitney, ols_dummies, ols_standardised, seed_stability_summary, verdict_ladder, plot_rows, feature_block, gate_controls, predicted_scores, predictor_records, reject_report,
        target_sequences, target_rejects, alignment_problems, first_rows,
    )
}

# SQL. The score of a sequence by its group's profile, and the cut-offs of the groups' own.
_W = "w AS (SELECT allele, pos, aa, ln(freq / 0.05::DOUBLE) AS w FROM freq)"
_SC = """{name} AS (SELECT q.allele, q.peptide, sum(w.w) AS score FROM (SELECT *, unnest(range(1, 10)) AS pos FROM {src}) q
    JOIN w ON w.allele = q.allele AND w.pos = q.pos AND w.aa = substr(q.peptide, q.pos, 1) GROUP BY q.allele, q.peptide HAVING count(*) = 9)"""
_TOP = "top4 AS (SELECT allele, pos, aa FROM cnt QUALIFY row_number() OVER (PARTITION BY allele, pos ORDER BY n DESC, aa DESC) <= 4)"
_CUT = "cut AS (SELECT allele, round(quantile_cont(round(score, 9), {q}), 9) AS cut FROM so GROUP BY allele)"
_FAR = "far AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY jsd DESC, b) AS place FROM bw)"
_CLEAR = f"""{AFF}, known AS (SELECT DISTINCT upper(regexp_replace(peptide, '^\\s+|\\s+$', '', 'g')) AS p FROM atlas_labelled WHERE label = 1 AND peptide IS NOT NULL),
    m AS (SELECT allele, upper(regexp_replace(peptide, '^\\s+|\\s+$', '', 'g')) AS peptide, inter_pae AS v, row_id % 3 AS r FROM aff WHERE allele IS NOT NULL AND peptide IS NOT NULL AND inter_pae IS NOT NULL),
    lab AS (SELECT DISTINCT allele, peptide, CASE WHEN (r = 0 AND v < 10) OR (r = 1 AND v <= 10) THEN 1 WHEN (r = 0 AND v > 15) OR (r = 2 AND v >= 15) THEN 0 END AS label FROM m WHERE peptide NOT IN (SELECT p FROM known)),
    clear AS (SELECT allele, peptide, any_value(label) AS label FROM lab WHERE label IS NOT NULL GROUP BY allele, peptide HAVING count(DISTINCT label) = 1),
    rep AS (SELECT allele, count(*) FILTER (WHERE label = 1) AS n_pos, count(*) FILTER (WHERE label = 0) AS n_neg FROM clear GROUP BY allele)"""
_TOK = r"""ln AS (SELECT run_id, raw, row_number() OVER (PARTITION BY run_id ORDER BY line_no, record_id) AS k, regexp_replace(raw, '[\r\n]', ' ', 'g') AS l FROM netmhcpanrecord
      WHERE layout = 'stdout' AND raw IS NOT NULL AND run_id IS NOT NULL AND line_no IS NOT NULL),
    stop AS (SELECT run_id, min(k) AS s FROM ln WHERE regexp_matches(l, '^\s*(Protein|Number)') GROUP BY run_id),
    tok AS (SELECT ln.run_id, k, list_filter(string_split_regex(trim(regexp_replace(l, '\s+', ' ', 'g')), ' '), lambda x: x NOT IN ('<=', 'SB', 'WB')) AS t, list_filter(string_split_regex(trim(regexp_replace(l, '\s+', ' ', 'g')), ' '), lambda x: x IN ('SB', 'WB')) AS b
      FROM ln LEFT JOIN stop USING (run_id) WHERE (s IS NULL OR k < s) AND NOT regexp_matches(l, '^\s*(#|-+\s*$)'))"""

SQL = {
    "hard_decoy_candidates": f"""WITH {FREQ}, {_W}, {_SC.format(name='so', src='nine')}, {_CUT.format(q=0.5)}, {_TOP},
        pool AS (SELECT DISTINCT peptide FROM nine), fit AS (SELECT x.allele, peptide FROM pool JOIN top4 x ON x.pos = 2 AND x.aa = substr(peptide, 2, 1) JOIN top4 y ON y.allele = x.allele AND y.pos = 9 AND y.aa = substr(peptide, 9, 1)),
        cand AS (SELECT * FROM fit WHERE (allele, peptide) NOT IN (SELECT (allele, peptide) FROM nine)), {_SC.format(name='sc', src='cand')}
        SELECT allele, peptide, round(score, 6) AS score FROM sc JOIN cut USING (allele) WHERE round(score, 9) <= cut""",
    "clean_decoy_candidates": f"""WITH {_jsd()}, {BOTH}, {_FAR}, {_W}, {_SC.format(name='so', src='nine')}, {_CUT.format(q=0.25)}, {_TOP},
        cand AS (SELECT DISTINCT a AS allele, peptide FROM far JOIN nine ON nine.allele = far.b WHERE place <= 3 AND NOT EXISTS (SELECT 1 FROM top4 t WHERE t.allele = far.a AND ((t.pos = 2 AND t.aa = substr(peptide, 2, 1)) OR (t.pos = 9 AND t.aa = substr(peptide, 9, 1))))),
        {_SC.format(name='sc', src='cand')}
        SELECT allele, peptide, round(score, 6) AS score FROM sc JOIN cut USING (allele) WHERE round(score, 9) <= cut""",
    "donor_decoy_candidates": f"WITH {_jsd()}, {BOTH}, {_FAR} SELECT a AS allele, b AS donor, peptide FROM far JOIN nine ON nine.allele = far.b WHERE place = 1",
    "consensus_letters": f"WITH {COUNTS}, best AS (SELECT allele, pos, aa FROM cnt QUALIFY row_number() OVER (PARTITION BY allele, pos ORDER BY n DESC, aa DESC) = 1) SELECT allele, string_agg(aa, '' ORDER BY pos) AS consensus FROM best GROUP BY allele",
    "measured_set": f"""WITH {_CLEAR} SELECT allele, peptide, label FROM clear JOIN rep USING (allele) WHERE n_pos >= 2 AND n_neg >= 2
        QUALIFY row_number() OVER (PARTITION BY allele, label ORDER BY md5('0|' || allele || '|' || peptide), peptide) <= 2""",
    "measured_report": f"WITH {_CLEAR} SELECT *, n_pos >= 2 AND n_neg >= 2 AS taken FROM rep",
    "ablation_cells": r"""WITH a AS (SELECT row_id, allele, label, allele = 'HLA-A*02:01' AS tg, regexp_matches(allele, '^HLA-A\*02:') AND allele <> 'HLA-A*02:01' AS fam,
          row_number() OVER (PARTITION BY allele = 'HLA-A*02:01', label ORDER BY md5('0|' || row_id), row_id) AS rn FROM atlas_labelled WHERE allele IS NOT NULL AND label IS NOT NULL),
        c AS (SELECT * FROM (VALUES ('full', false, false), ('removed', true, false), ('starved', false, true), ('both', true, true)) v(cell, gone, starved))
        SELECT cell, count(*) AS n, sum(label)::BIGINT AS n_pos, count(DISTINCT allele) AS n_alleles, sum(row_id)::BIGINT AS row_sum FROM a, c WHERE NOT (gone AND fam) AND NOT (starved AND tg AND rn > 20) GROUP BY cell""",
    "family_rows": r"""SELECT allele, starts_with(allele, 'HLA-A*02:') AS in_a2, regexp_matches(allele, '^HLA-A\*(03|11):') AS in_a3, count(*) AS n FROM atlas_labelled
        WHERE starts_with(allele, 'HLA-A*02:') OR regexp_matches(allele, '^HLA-A\*(03|11):') GROUP BY ALL""",
    "planted_labels": r"""WITH p AS (SELECT row_id, upper(regexp_replace(peptide, '^\s+|\s+$', '', 'g')) AS p FROM atlas_labelled WHERE peptide IS NOT NULL),
        q AS (SELECT *, (substr(p, 2, 1) = 'L')::INT + (length(p) > 0 AND contains('AVILMFWY', right(p, 1)))::INT AS n, ('0x' || substr(md5('5|' || p), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM p)
        SELECT row_id, CASE WHEN length(p) < 3 THEN 0 ELSE (u < CASE n WHEN 0 THEN 0.05 WHEN 1 THEN 0.4 ELSE 0.85 END)::INT END AS label FROM q""",
    "landscape_recovery": f"""WITH {IC}, r AS (SELECT allele, pos, round(ic, 6) AS ic, row_number() OVER (PARTITION BY allele ORDER BY round(ic, 6) DESC, pos) AS rn FROM ic),
        h AS (SELECT allele, count(*) FILTER (WHERE ic >= 1) AS k FROM r GROUP BY allele)
        SELECT allele, string_agg(pos::VARCHAR, ',' ORDER BY rn) AS top, CASE WHEN any_value(k) > 0 THEN bool_and(ic >= 1) END AS recovers FROM r JOIN h USING (allele) WHERE rn <= 2 GROUP BY allele""",
    "ic_anchor_means": f"WITH {IC} SELECT allele, round(avg(ic) FILTER (WHERE ic >= 1), 6) AS ic_anchor_mean FROM ic GROUP BY allele",
    "whole_frequencies": f"""WITH p AS (SELECT DISTINCT allele, upper(regexp_replace(peptide, '^\\s+|\\s+$', '', 'g')) AS p FROM atlas_labelled WHERE label = 1 AND allele IS NOT NULL AND peptide IS NOT NULL),
        g AS (SELECT * FROM p WHERE regexp_full_match(p, '[{AA}]{{9}}')), c AS (SELECT allele, pos, substr(p, pos, 1) AS aa, count(*) AS n FROM (SELECT *, unnest(range(1, 10)) AS pos FROM g) GROUP BY ALL),
        k AS (SELECT allele, count(*) AS total FROM g GROUP BY allele), grid AS (SELECT allele, total, pos, aa FROM k, unnest(range(1, 10)) AS u(pos), unnest(string_split('{AA}', '')) AS v(aa) WHERE aa <> '')
        SELECT allele, pos, aa, round((coalesce(n, 0) + 0.5) / (total + 10)::DOUBLE, 6) AS freq FROM grid LEFT JOIN c USING (allele, pos, aa)""",
    "metric_bundle": None,
    "standardised_orientation": f"""WITH {AFF}, k AS (SELECT allele, y, coalesce(inter_pae, avg(inter_pae) OVER ()) AS a, coalesce(plddt_pep, avg(plddt_pep) OVER ()) AS b FROM aff WHERE allele IS NOT NULL),
        l AS (SELECT 'inter_pae' AS feature, allele, y, a AS s FROM k UNION ALL SELECT 'plddt_pep', allele, y, b FROM k),
        z AS (SELECT feature, y, round(coalesce((s - avg(s) OVER w) / nullif(stddev_samp(s) OVER w, 0), 0), 9) AS s FROM l WINDOW w AS (PARTITION BY feature, allele)),
        r AS ({auroc_sql('l', 'feature')}), q AS ({auroc_sql('z', 'feature')})
        SELECT r.feature, round(greatest(r.auroc, 1 - r.auroc), 6) AS auroc, CASE WHEN r.auroc >= 0.5 THEN 1 ELSE -1 END AS direction, round(CASE WHEN r.auroc >= 0.5 THEN q.auroc ELSE 1 - q.auroc END, 6) AS auroc_z FROM r JOIN q USING (feature)""",
    "one_sample_t": f"""WITH {MOD}, s AS (SELECT grp, count(*) AS n, avg(m1) AS m, stddev_samp(m1) / sqrt(count(*)) AS se FROM mod GROUP BY grp)
        SELECT grp, n, round(m, 6) AS mean, round(m - 1.96 * se, 6) AS ci_lo, round(m + 1.96 * se, 6) AS ci_hi, round(m / se, 6) AS t FROM s""",
    "ols_dummies": f"""WITH {MOD}, g AS (SELECT grp::VARCHAR AS g, count(*) AS n, avg(m1) AS m, sum(m1 * m1) - count(*) * avg(m1) ** 2 AS ss FROM mod GROUP BY grp),
        f AS (SELECT g AS g0, n AS n0, m AS m0 FROM g ORDER BY g LIMIT 1), t AS (SELECT sum(n) AS n, sum(ss) AS rss, count(*) AS k FROM g), a AS (SELECT sum(m1 * m1) - count(*) * avg(m1) ** 2 AS tss FROM mod)
        SELECT CASE WHEN g = g0 THEN 'intercept' ELSE 'grp_' || g END AS term, round(c, 6) AS coef, round(e, 6) AS se, round(c / e, 6) AS t, round(1 - rss / tss, 6) AS r2, n::BIGINT AS n
        FROM (SELECT g.g, g0, CASE WHEN g.g = g0 THEN m ELSE m - m0 END AS c, sqrt(rss / (t.n - k) * CASE WHEN g.g = g0 THEN 1 / g.n::DOUBLE ELSE 1 / g.n::DOUBLE + 1 / n0::DOUBLE END) AS e, rss, tss, t.n FROM g, f, t, a)""",
    "ols_standardised": f"""WITH {MOD}, c AS (SELECT corr(m1, m2) AS a, corr(m1, m3) AS b, corr(m2, m3) AS r, count(*) AS n FROM mod), k AS (SELECT *, (a - r * b) / (1 - r * r) AS p, (b - r * a) / (1 - r * r) AS q FROM c)
        SELECT 'm2' AS term, round(p, 6) AS coef, round(p * a + q * b, 6) AS r2, n FROM k UNION ALL SELECT 'm3', round(q, 6), round(p * a + q * b, 6), n FROM k""",
    "seed_stability_summary": f"""WITH {MOD}, l AS (UNPIVOT (SELECT vec_id, grp, m1, m2, m3 FROM mod) ON m1, m2, m3 INTO NAME model VALUE v), r AS (SELECT grp, model, vec_id, rank() OVER (PARTITION BY grp, model ORDER BY v) + (count(*) OVER (PARTITION BY grp, model, v) - 1) / 2.0 AS rk FROM l),
        p AS (SELECT x.grp, corr(x.rk, y.rk) AS rho FROM r x JOIN r y ON x.grp = y.grp AND x.vec_id = y.vec_id AND x.model < y.model GROUP BY x.grp, x.model, y.model HAVING count(*) > 20)
        SELECT grp, count(*) AS n_pairs, round(avg(rho), 6) AS mean_rho, round(min(rho), 6) AS min_rho FROM p GROUP BY grp""",
    "verdict_ladder": f"""WITH {AFF}, a AS ({auroc_sql('aff', 'allele')}) SELECT CASE WHEN auroc >= 0.9 THEN 'high' WHEN auroc >= 0.7 THEN 'fair' WHEN auroc >= 0.5 THEN 'low' WHEN auroc IS NOT NULL THEN 'reversed' END AS verdict, count(*) AS n FROM a GROUP BY 1""",
    "plot_rows": """SELECT locus, allele, atlas_ms AS value, median(atlas_ms) OVER (PARTITION BY locus) AS locus_median, row_number() OVER (ORDER BY atlas_ms, allele) <= 4 AS named FROM data_type_coverage""",
    "feature_block": """SELECT row_id, round(coalesce(-inter_pae, avg(-inter_pae) OVER ()), 6) AS tuned__inter_pae, round(coalesce(plddt_pep, avg(plddt_pep) OVER ()), 6) AS tuned__plddt_pep FROM aff_finetuned""",
    "predicted_scores": f"WITH {MOD} SELECT vec_id, round(0.5 * m1 - m2 + 2 * m3 + 0.25, 6) AS score FROM mod",
    "predictor_records": f"""WITH {_TOK} SELECT run_id, k::INT AS line_no, t[2] AS allele, t[3] AS peptide, CASE WHEN regexp_full_match(t[1], '[+-]?[0-9]+') THEN TRY_CAST(t[1] AS INT) END AS pos, round(TRY_CAST(t[12] AS DOUBLE), 6) AS score_el, round(TRY_CAST(t[15] AS DOUBLE), 6) AS rank_ba,
        round(TRY_CAST(t[16] AS DOUBLE), 6) AS aff_nm, b[-1] AS bind_level, len(b) > 0 AS is_binder FROM tok WHERE len(t) = 16""",
    "reject_report": f"""WITH {T}, a AS (SELECT DISTINCT allele, upper(regexp_replace(peptide, '^\\s+|\\s+$', '', 'g')) AS peptide FROM aff_finetuned WHERE allele IS NOT NULL AND peptide IS NOT NULL), w AS (SELECT DISTINCT allele, peptide FROM t)
        SELECT 'missing' AS status, count(*) AS n FROM w WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.allele = w.allele AND a.peptide = w.peptide) UNION ALL SELECT 'unmatched', count(*) FROM a WHERE NOT EXISTS (SELECT 1 FROM w WHERE a.allele = w.allele AND a.peptide = w.peptide)""",
    "target_sequences": f"""WITH {T} SELECT DISTINCT regexp_replace(t.allele, '^HLA-', '') AS mhc, 0 AS start, peptide, kind || '__' || lower(regexp_replace(t.allele, '[-*:]', '_', 'g')) || '__' || lower(peptide) AS targetid, rpad(c.allele, 15, 'G') || '/' || peptide AS target_chainseq
        FROM t JOIN data_type_coverage c ON c.allele = t.allele WHERE length(peptide) = 9""",
    "target_rejects": f"""WITH {T} SELECT CASE WHEN length(peptide) <> 9 THEN 'peptide length' WHEN c.allele IS NULL THEN 'no sequence' END AS reason, count(*) AS n FROM t LEFT JOIN data_type_coverage c ON c.allele = t.allele AND c.locus = 'HLA-A' GROUP BY 1 HAVING reason IS NOT NULL""",
    "alignment_problems": """SELECT s_suppkey % 40 AS file, 3 AS target_len, CASE WHEN bool_or(s_suppkey % 7 = 0) THEN 'template length is not the target length' WHEN bool_or(s_suppkey % 11 = 0) THEN 'places are not mapped to themselves' END AS problem FROM supplier GROUP BY 1""",
    "first_rows": r"""SELECT train_id, allele, p AS peptide FROM (SELECT *, upper(regexp_replace(peptide, '^\s+|\s+$', '', 'g')) AS p FROM motmaen_train WHERE peptide IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY p ORDER BY train_id) = 1""",
}
_CLEAN_SQL = SQL["clean_decoy_candidates"].removeprefix("WITH ")
_DONOR_SQL = SQL["donor_decoy_candidates"].removeprefix("WITH ")
SQL["clean_decoys"] = "WITH RECURSIVE " + _CLEAN_SQL.rpartition("SELECT allele, peptide, round")[0] + f""", picks AS (SELECT allele, peptide FROM sc JOIN cut USING (allele) WHERE round(score, 9) <= cut), {maxmin_sql('picks', 'allele', 2)}
    SELECT allele, unnest(got) AS peptide, unnest(range(1, len(got) + 1))::INT AS place FROM mm"""
SQL["donor_decoys"] = "WITH RECURSIVE " + _DONOR_SQL.rpartition("SELECT a AS")[0] + f""", picks AS (SELECT a AS allele, peptide FROM far JOIN nine ON nine.allele = far.b WHERE place = 1), {maxmin_sql('picks', 'allele', 2)}
    SELECT allele, unnest(got) AS peptide, unnest(range(1, len(got) + 1))::INT AS place FROM mm"""
# Five alleles by max-min on their consensus letters, the forced one first, and what is picked of each.
_GROUPS = f"""{FREQ}, best AS (SELECT allele, pos, aa FROM cnt QUALIFY row_number() OVER (PARTITION BY allele, pos ORDER BY n DESC, aa DESC) = 1), cons AS (SELECT allele, string_agg(aa, '' ORDER BY pos) AS c FROM best GROUP BY allele),
    gp AS (SELECT list(allele ORDER BY allele) AS k, list(c ORDER BY allele) AS v FROM cons),
    gr AS (SELECT k, v, [coalesce(nullif(list_position(k, 'HLA-A*02:01'), 0), 1)] AS got FROM gp UNION ALL SELECT k, v, list_append(got, list_position(gap, list_max(gap))) FROM
      (SELECT *, list_transform(range(1, len(v) + 1), lambda i: CASE WHEN list_contains(got, i) THEN -1 ELSE list_min(list_transform(got, lambda j: hamming(v[i], v[j]))) END) AS gap FROM gr WHERE len(got) < 5 AND len(got) < len(v))),
    picked AS (SELECT unnest(list_transform(got, lambda i: k[i])) AS allele FROM (SELECT * FROM gr ORDER BY len(got) DESC LIMIT 1)), mine AS (SELECT nine.* FROM nine JOIN picked USING (allele))"""
_PICKS = "SELECT allele, unnest(got) AS peptide, unnest(range(1, len(got) + 1))::INT AS place FROM mm"
SQL["diverse_set"] = f"WITH RECURSIVE {_GROUPS}, {maxmin_sql('mine', 'allele', 4)} {_PICKS}"
SQL["canonical_set"] = f"""WITH RECURSIVE {_GROUPS}, {_W}, {_SC.format(name='sc', src='mine')},
    top AS (SELECT allele, peptide, round(score, 9) AS s FROM sc QUALIFY row_number() OVER (PARTITION BY allele ORDER BY round(score, 9) DESC, peptide DESC) <= greatest(2, floor(count(*) OVER (PARTITION BY allele) * 0.1))),
    {maxmin_sql('top', 'allele', 2, order='s DESC, peptide DESC')} {_PICKS}"""
SQL["hard_decoy_pool"] = f"""WITH RECURSIVE {FREQ}, w AS (SELECT allele, pos, aa, log2(freq / 0.05::DOUBLE) AS w FROM freq), {_SC.format(name='so', src='nine')}, cut AS (SELECT allele, quantile_cont(score, 0.5) AS cut FROM so GROUP BY allele), {_TOP},
    pool AS (SELECT DISTINCT peptide FROM p9), fit AS (SELECT x.allele, peptide FROM pool JOIN top4 x ON x.pos = 2 AND x.aa = substr(peptide, 2, 1) JOIN top4 y ON y.allele = x.allele AND y.pos = 9 AND y.aa = substr(peptide, 9, 1)),
    cand AS (SELECT * FROM fit WHERE (allele, peptide) NOT IN (SELECT (allele, peptide) FROM nine)), {_SC.format(name='sc', src='cand')}, low AS (SELECT allele, peptide FROM sc JOIN cut USING (allele) WHERE score <= cut), {maxmin_sql('low', 'allele', 6)} {_PICKS}"""
SQL["metric_bundle"] = f"""WITH {AFF}, lev AS (SELECT *, sum(nn) OVER w AS cn, sum(pp) OVER w AS cp, sum(nn) OVER g AS n, sum(pp) OVER g AS p FROM (SELECT allele, s, count(*) AS nn, sum(y::INT) AS pp FROM aff WHERE s IS NOT NULL AND y IS NOT NULL GROUP BY allele, s)
        WINDOW w AS (PARTITION BY allele ORDER BY s DESC), g AS (PARTITION BY allele)), ap AS (SELECT allele, CASE WHEN any_value(n) > any_value(p) AND any_value(p) > 0 THEN round(sum(pp / p::DOUBLE * (cp / cn::DOUBLE)), 6) END AS ap FROM lev GROUP BY allele),
        pv AS (SELECT allele, round(avg(y), 6) AS ppv FROM (SELECT *, row_number() OVER (PARTITION BY allele ORDER BY s DESC, row_id) AS rn FROM aff WHERE s IS NOT NULL) WHERE rn <= 100 GROUP BY allele), a AS ({auroc_sql('aff', 'allele')})
        SELECT a.*, ap, ppv FROM a JOIN ap ON a.allele IS NOT DISTINCT FROM ap.allele JOIN pv ON a.allele IS NOT DISTINCT FROM pv.allele"""
