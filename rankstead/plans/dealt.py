"""Queries of the general training-data problems (1 and 2) over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankstead.functions.text import folded, stripped
from rankstead.operators.weighted import compress_values, heavy_keys, per_key_percentiles, per_key_summary
from rankstead.sources.predictor_lines import ROW_SCHEMA, load_with_rejects


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return load_with_rejects(spark.read.parquet(f"{d}/netmhcpanrecord.parquet"), keep=["record_id"])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).filter(F.col("kind") == "reject").select("record_id")


def p1_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).groupBy("kind", "reason").agg(F.count(F.lit(1)).alias("n_lines"))


def p1_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Rows, rejects and lines that are neither, by layout."""
    lines = load_with_rejects(spark.read.parquet(f"{d}/netmhcpanrecord.parquet"), keep=["layout"])
    return lines.groupBy("kind", "layout").agg(F.count(F.lit(1)).alias("n_lines"))


def p1_rows(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).filter(F.col("kind") == "row").drop("kind", "reason")


def _allele_values(spark: SparkSession, d: str) -> DataFrame:
    atlas = spark.read.parquet(f"{d}/atlas_labelled.parquet")
    return compress_values(atlas, "allele", folded("peptide"), {"n_pos": F.col("label") == 1})


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy_keys(_allele_values(spark, d), 0.04).select(F.col("key").alias("allele"))


def p2_allele_stats(spark: SparkSession, d: str) -> DataFrame:
    s = per_key_summary(_allele_values(spark, d), ["n_pos"]).filter(F.col("key").isNotNull())
    return s.select(F.col("key").alias("allele"), "n_rows", "n_pos", F.col("n_distinct").alias("n_peptides"), F.col("mode_value").alias("top_peptide"))


def p2_length_percentiles(spark: SparkSession, d: str) -> DataFrame:
    atlas = spark.read.parquet(f"{d}/atlas_labelled.parquet").filter(F.col("allele").isNotNull())
    v = compress_values(atlas, "allele", F.length(stripped("peptide")).cast("double"))
    return per_key_percentiles(v, [0.1, 0.5, 0.9]).select(F.col("key").alias("allele"), F.round("p0", 6).alias("p10"), F.round("p1", 6).alias("p50"), F.round("p2", 6).alias("p90"))


QUERIES = {f.__name__: f for f in (p1_found, p1_reasons, p1_kinds, p1_rows, p2_found, p2_allele_stats, p2_length_percentiles)}

_PEP, _INT, _NUM = "[ACDEFGHIKLMNPQRSTVWY]{8,14}", "[0-9]+", r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
_HEAD = ["0*[1-9][0-9]*", r"HLA-[ABC]\*[0-9]{2}:[0-9]{2,3}", _PEP, "[ACDEFGHIKLMNPQRSTVWY-]{9}", *[_INT] * 5, _PEP]


def _csv_line(taken: int = -1) -> str:
    """Pattern of a valid line, with groups (quoted, bare) around the field number ``taken`` of the 17."""
    plain = [*_HEAD, None, *[_NUM] * 5, "(?:SB|WB)?"]
    pairs = [('(?:[^"]|"")+', '[^",]+') if x is None else (x, x) for x in plain]
    return "^" + ",".join(f'(?:"({q})"|({u}))' if i == taken else f'(?:"{q}"|{u})' for i, (q, u) in enumerate(pairs)) + "$"


def _out_line(taken: int = -1) -> str:
    plain = [*_HEAD, "[^ \t]+", *[_NUM] * 5]
    level = "(?:[ \t]+<=[ \t]+(SB|WB))?" if taken == 16 else "(?:[ \t]+<=[ \t]+(?:SB|WB))?"
    return "^" + "[ \t]+".join(f"({x})" if i == taken else x for i, x in enumerate(plain)) + level + "$"


_GROUPS = ", ".join(
    f"coalesce(nullif(regexp_extract(l, '{_csv_line(i + 11)}', 1), ''), nullif(regexp_extract(l, '{_csv_line(i + 11)}', 2), '')) AS c{i}, regexp_extract(l, '{_out_line(i + 11)}', 1) AS o{i}" for i in range(5)
)
_FITS = lambda c: " AND ".join(f"TRY_CAST({c}{i} AS DOUBLE) BETWEEN 0 AND {m}" for i, m in enumerate((1, 100, 1, 100, 1e308))) + f" AND TRY_CAST({c}4 AS DOUBLE) > 0"

_LINES = f"""t AS (SELECT record_id, layout, bind_level, raw, regexp_replace(regexp_replace(raw, '[ \t\r\n]+$', ''), '^[ \t]+', '') AS l FROM netmhcpanrecord),
        f AS (SELECT *, {_GROUPS} FROM t)"""
_BAD_LEVEL = "(bind_level IS NOT NULL AND upper(trim(bind_level)) NOT IN ('SB', 'WB'))"
_NO_ROW = """(regexp_full_match(l, '-*') OR regexp_matches(l, '^(#|Protein|Number)') OR (layout = 'csv' AND regexp_matches(l, '^"?Pos"?,"?MHC"?,"?Peptide"?(,|$)')) OR (layout = 'stdout' AND regexp_matches(l, '^Pos[ \t]+MHC[ \t]+Peptide([ \t]|$)')))"""
_IS_ROW = f"""((layout = 'csv' AND coalesce(regexp_matches(l, '{_csv_line()}') AND {_FITS("c")}, false)) OR (layout = 'stdout' AND coalesce(regexp_matches(l, '{_out_line()}') AND {_FITS("o")}, false)))"""
_FIELD = lambda i: f"CASE layout WHEN 'csv' THEN coalesce(nullif(replace(regexp_extract(l, '{_csv_line(i)}', 1), '\"\"', '\"'), ''), nullif(regexp_extract(l, '{_csv_line(i)}', 2), '')) ELSE nullif(regexp_extract(l, '{_out_line(i)}', 1), '') END"
_KINDS = ["BIGINT", *["VARCHAR"] * 3, *["BIGINT"] * 5, *["VARCHAR"] * 2, *["DOUBLE"] * 5, "VARCHAR"]
_NAMES = ["Pos", "MHC", "Peptide", "Core", "Of", "Gp", "Gl", "Ip", "Il", "Icore", "Identity", "Score_EL", "%Rank_EL", "Score_BA", "%Rank_BA", "Aff(nM)"]


def _first_bad() -> str:
    """The first field that isn't as it should be: Identity, then the others in order."""
    tests = [("Identity", "f[11] = ''"), ("Pos", "NOT regexp_full_match(f[1], '[0-9]{1,18}') OR TRY_CAST(f[1] AS BIGINT) < 1")]
    tests += [(_NAMES[i], f"NOT regexp_full_match(f[{i + 1}], '{_HEAD[i]}')") for i in (1, 2, 3)]
    tests += [(_NAMES[i], f"NOT regexp_full_match(f[{i + 1}], '[0-9]{{1,18}}')") for i in range(4, 9)] + [("Icore", f"NOT regexp_full_match(f[10], '{_PEP}')")]
    for i, most in zip(range(11, 16), (1, 100, 1, 100, 1.7976931348623157e308), strict=True):
        low = " OR TRY_CAST(f[16] AS DOUBLE) <= 0" if i == 15 else ""
        tests.append((_NAMES[i], f"NOT regexp_full_match(f[{i + 1}], '{_NUM}') OR coalesce(TRY_CAST(f[{i + 1}] AS DOUBLE) NOT BETWEEN 0 AND {most}, true){low}"))
    return " ".join(f"WHEN {test} THEN 'bad_value:{name}'" for name, test in tests)


_QUOTED = '"(?:[^"]|"")*"'
_REASONS = f"""t AS (SELECT layout, raw, bind_level, regexp_replace(regexp_replace(raw, '[ \t\r\n]+$', ''), '^[ \t]+', '') AS l FROM netmhcpanrecord),
        g AS (SELECT *, layout = 'csv' AND NOT regexp_full_match(l, '(?:{_QUOTED}|[^",]*)(?:,(?:{_QUOTED}|[^",]*))*') AS broken,
          CASE layout WHEN 'csv' THEN list_transform(regexp_extract_all(l || ',', '({_QUOTED}|[^",]*),', 1), lambda x: CASE WHEN starts_with(x, '"') THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END) ELSE string_split_regex(l, '[ \t]+') END AS w FROM t),
        m AS (SELECT *, CASE WHEN layout = 'csv' THEN w[17] WHEN len(w) = 18 AND w[17] = '<=' THEN w[18] ELSE '' END AS level, CASE WHEN layout = 'stdout' AND len(w) = 18 AND w[17] = '<=' THEN w[1:16] WHEN layout = 'csv' AND len(w) = 17 THEN w[1:16] ELSE w END AS f FROM g),
        k AS (SELECT *, CASE WHEN raw IS NULL THEN 'null_line' WHEN {{no_row}} THEN NULL WHEN broken THEN 'broken_quoting' WHEN layout = 'csv' AND len(w) <> 17 THEN 'wrong_columns:' || len(w)
          WHEN level NOT IN ('', 'SB', 'WB') OR (layout = 'stdout' AND len(w) = 18 AND w[17] = '<=' AND level = '') THEN 'bad_value:BindLevel' WHEN layout = 'stdout' AND len(f) <> 16 THEN 'wrong_columns:' || len(w) {{bad}} END AS why,
          coalesce({{no_row}}, false) AS other FROM m)"""

SQL = {
    "p1_reasons": f"""WITH {_REASONS.format(no_row=_NO_ROW, bad=_first_bad())}, r AS (SELECT *, why IS NULL AND bind_level IS NOT NULL AND upper(trim(bind_level)) NOT IN ('SB', 'WB') AS bad FROM k)
        SELECT CASE WHEN why IS NOT NULL OR bad THEN 'reject' WHEN other THEN 'other' ELSE 'row' END AS kind, CASE WHEN bad THEN 'bad_bind_level' ELSE why END AS reason, count(*) AS n_lines FROM r GROUP BY ALL""",
    "p1_found": f"WITH {_LINES} SELECT record_id FROM f WHERE raw IS NULL OR {_BAD_LEVEL} OR NOT ({_NO_ROW} OR {_IS_ROW})",
    "p1_rows": f"""WITH {_LINES} SELECT record_id, {', '.join(f"CAST({_FIELD(i)} AS {k}) AS {n}" for i, (n, k) in enumerate(zip(ROW_SCHEMA.fieldNames(), _KINDS, strict=True)))}
        FROM f WHERE raw IS NOT NULL AND NOT {_BAD_LEVEL} AND NOT {_NO_ROW} AND {_IS_ROW}""",
    "p1_kinds": f"""WITH {_LINES} SELECT CASE WHEN raw IS NULL OR {_BAD_LEVEL} OR NOT ({_NO_ROW} OR {_IS_ROW}) THEN 'reject' WHEN {_NO_ROW} THEN 'other' ELSE 'row' END AS kind,
        layout, count(*) AS n_lines FROM f GROUP BY ALL""",
    "p2_found": """
        WITH s AS (SELECT allele, count(*) AS n FROM atlas_labelled WHERE allele IS NOT NULL GROUP BY allele)
        SELECT allele FROM s WHERE n >= 0.04 * (SELECT sum(n) FROM s)""",
    "p2_allele_stats": r"""
        WITH v AS (SELECT allele, upper(regexp_replace(peptide, '^\s+|\s+$', '', 'g')) AS p, label FROM atlas_labelled WHERE allele IS NOT NULL),
        c AS (SELECT allele, p, count(*) AS n FROM v WHERE p IS NOT NULL GROUP BY allele, p),
        m AS (SELECT allele, p FROM c QUALIFY row_number() OVER (PARTITION BY allele ORDER BY n DESC, p) = 1)
        SELECT v.allele, count(*) AS n_rows, count(*) FILTER (WHERE label = 1) AS n_pos,
               count(DISTINCT v.p) AS n_peptides, any_value(m.p) AS top_peptide
        FROM v LEFT JOIN m ON v.allele = m.allele GROUP BY v.allele""",
    "p2_length_percentiles": r"""
        SELECT allele, round(quantile_cont(n, 0.1), 6) AS p10, round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.9), 6) AS p90
        FROM (SELECT allele, length(regexp_replace(peptide, '^\s+|\s+$', '', 'g'))::DOUBLE AS n FROM atlas_labelled WHERE allele IS NOT NULL AND peptide IS NOT NULL) GROUP BY allele""",
}
