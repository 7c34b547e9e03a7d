"""Queries of problems 3 to 9 over the test tables, and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankstead.functions.text import folded
from rankstead.llm import dedup, leakage, overlap, residue, splits, terms, tokenizer


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# Problem 3. The compared fields of each table: text columns, then columns compared as they are.
COMPARED = {
    "aff_finetuned": (["allele", "peptide"], ["label", "inter_pae", "plddt_pep"]),
    "rq3_variants_b37": (["tag", "locus", "hla_b_37_01", "peptide", "note"], []),
}


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    out = [dedup.copies(_table(spark, d, t), "row_id", *c).select(F.lit(t).alias("src_table"), "first_id", "copy_id") for t, c in COMPARED.items()]
    return out[0].unionByName(out[1])


def p3_records(spark: SparkSession, d: str) -> DataFrame:
    out = [dedup.collapse(_table(spark, d, t), "row_id", *c).select(F.lit(t).alias("src_table"), "first_id", "n_copies") for t, c in COMPARED.items()]
    return out[0].unionByName(out[1])


# Problem 4
MAX_MISMATCHES = 2


def _split_pair(spark: SparkSession, d: str) -> tuple:
    return _table(spark, d, "motmaen_testset_overlap"), "test_id", "peptide", _table(spark, d, "motmaen_train"), "train_id", "peptide", MAX_MISMATCHES


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.cross_split_overlaps(*_split_pair(spark, d)).select(F.col("eval_id").alias("test_id"), "train_id")


def p4_by_split_and_source(spark: SparkSession, d: str) -> DataFrame:
    """Pairs, exact pairs, and records of either side, by evaluation split and training source."""
    tests, _, _, train, *_ = _split_pair(spark, d)
    # The source comes along with the scan, and counting over distinct texts first keeps the pairs of copies from being made.
    near = overlap.near_texts(train, "train_id", "peptide", tests, "peptide", MAX_MISMATCHES, keep=["source"])
    sourced = near.groupBy("eval_text", "source").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("mismatches") == 0).cast("bigint")).alias("n0"))
    sets = tests.select("fold_set", folded("peptide").alias("eval_text"))
    return sourced.join(sets, "eval_text").groupBy("fold_set", "source").agg(F.sum("n").alias("n_pairs"), F.sum("n0").alias("n_exact_pairs"), F.count(F.lit(1)).alias("n_tests"))


def p4_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Of each test peptide: training rows with a near passage, fewest mismatches, share of letters that these repeat."""
    return overlap.coverage(*_split_pair(spark, d), inside=True).select(F.col("eval_id").alias("test_id"), "n_train", "nearest", F.round("covered", 6).alias("covered"))


# Problem 5
SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}


def _groups(spark: SparkSession, d: str) -> DataFrame:
    return splits.related_groups(_table(spark, d, "atlas_labelled"), "row_id", [[folded("peptide")], [F.col("allele"), F.col("sample_id")]])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _groups(spark, d).filter("row_id > first_id").select("first_id", "row_id")


def p5_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.assign_splits(splits.cut_lineage(_groups(spark, d)), SHARES)


def p5_split_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Rows and groups of each split."""
    return p5_splits(spark, d).groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("first_id").alias("n_groups"))


# Problem 6
RARE_UPTO, COMMON_FROM = 1, 25


def _peptide_counts(spark: SparkSession, d: str) -> DataFrame:
    pairs = _table(spark, d, "atlas_labelled").select(folded("peptide").alias("term"), F.col("row_id").alias("record"))
    return terms.marked(terms.term_frequencies(pairs, "term", "record"), RARE_UPTO, COMMON_FROM)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _peptide_counts(spark, d).filter("mark IS NOT NULL").select(F.col("term").alias("peptide"), "mark")


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    return _peptide_counts(spark, d).select(F.col("term").alias("peptide"), "n_occurrences", "n_records", "mark")


def p6_words(spark: SparkSession, d: str) -> DataFrame:
    pairs = terms.explode_terms(_table(spark, d, "documents"), "doc_id", "text")
    return terms.term_frequencies(pairs, "term", "record").select("term", "n_occurrences", "n_records")


def p6_terms(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct word of the documents, in letters of any script, with its mark."""
    return terms.marked(p6_words(spark, d), RARE_UPTO, COMMON_FROM)


# Problem 7
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
# Fixed value: the pattern that goes with the vocabulary.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _ranks() -> dict[bytes, int]:
    return tokenizer.read_ranks(f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode_column(_table(spark, d, "documents"), "doc_id", "text", _ranks(), SPLIT_PATTERN, blanks_lead=True)


def p7_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Whether the decoded ids of each document give its text again (for null texts, the empty text)."""
    docs = _table(spark, d, "documents")
    back = tokenizer.decode_column(p7_ids(spark, d), "doc_id", "ids", _ranks())
    return docs.select("doc_id", F.col("text").alias("was")).join(back, "doc_id").select("doc_id", (F.coalesce("was", F.lit("")) == F.col("text")).alias("same"))


# Problem 8
def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(_table(spark, d, "documents"), "doc_id", "text", _table(spark, d, "eval_items"), "item_id", "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs whose nearest windows, of twelve words, are equal."""
    return _leaks(spark, d).filter(f"edits = 0 AND words = {leakage.WINDOW}").select("item_id", "doc_id")


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Each item with the number of documents that repeat twelve words of it exactly."""
    found = _leaks(spark, d).filter(f"edits = 0 AND words = {leakage.WINDOW}").groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"))
    return _table(spark, d, "eval_items").select("item_id", "suite", "split").join(found, "item_id", "left").fillna(0, ["n_docs"])


def p8_near(spark: SparkSession, d: str) -> DataFrame:
    """All pairs with windows within two edits (short items: fewer), with the fewest edits found and the windows' words."""
    return _leaks(spark, d)


# Problem 9
def _residue(spark: SparkSession, d: str) -> DataFrame:
    return residue.find_residue(_table(spark, d, "documents"), "doc_id", "text", "source")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _residue(spark, d).filter("kind IS NOT NULL").select("doc_id")


def p9_kinds(spark: SparkSession, d: str) -> DataFrame:
    return _residue(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n_docs"))


def p9_boilerplate(spark: SparkSession, d: str) -> DataFrame:
    """Recurrent lines of each host, one per row, with the documents they stand in."""
    return residue.boilerplate_lines(_table(spark, d, "documents"), "text", "source")


QUERIES = {
    f.__name__: f
    for f in (p3_found, p3_records, p4_found, p4_by_split_and_source, p4_coverage, p5_found, p5_splits, p5_split_sizes, p6_found, p6_counts, p6_words, p6_terms, p7_ids, p7_round_trip, p8_found, p8_items, p8_near, p9_found, p9_kinds, p9_boilerplate)
}

_CANON = r"regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]', '', 'g')"
_FOLD = r"upper(regexp_replace(peptide, '^\s+|\s+$', '', 'g'))"


def _bags(table: str) -> str:
    texts, exact = COMPARED[table]
    bag = "list_sort([" + ", ".join(f"coalesce('v' || {_CANON.format(c)}, 'n')" for c in texts) + "])"
    return f"SELECT '{table}' AS src_table, row_id, min(row_id) OVER w AS first_id FROM {table} WINDOW w AS (PARTITION BY {', '.join([bag, *exact])})"


_CLASSES = f"WITH c AS ({_bags('aff_finetuned')} UNION ALL {_bags('rq3_variants_b37')})"
_NEAR = f"""
    WITH e AS (SELECT test_id, fold_set, {_FOLD} AS p FROM motmaen_testset_overlap),
    t AS (SELECT train_id, source, {_FOLD} AS p FROM motmaen_train),
    near AS (SELECT test_id, fold_set, train_id, source, hamming(e.p, t.p) AS h FROM e JOIN t ON length(e.p) = length(t.p) AND hamming(e.p, t.p) <= 2)"""
_COUNTS = f"WITH c AS (SELECT {_FOLD} AS peptide, count(*) AS n FROM atlas_labelled WHERE peptide IS NOT NULL GROUP BY 1)"

_WORDS = r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents),
    w AS (SELECT term, count(*) AS n_occurrences, count(DISTINCT doc_id) AS n_records FROM t GROUP BY term)"""
_RUNS = "SELECT {0}, list_aggregate(w[k:k + 11], 'string_agg', ' ') AS g FROM (SELECT {0}, w, unnest(range(1, len(w) - 10)) AS k FROM (SELECT {0}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM {1}))"
_LETTERS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
_SHARED = f"""WITH shared AS (SELECT DISTINCT item_id, doc_id FROM ({_RUNS.format('item_id', 'eval_items')}) JOIN ({_RUNS.format('doc_id', 'documents')}) USING (g))"""

_TIED = f"""WITH RECURSIVE r AS (SELECT row_id, {_FOLD} AS p, allele || '|' || sample_id AS g FROM atlas_labelled),
        e AS (SELECT row_id AS a, min(row_id) OVER (PARTITION BY p) AS b FROM r WHERE p IS NOT NULL
              UNION SELECT row_id, min(row_id) OVER (PARTITION BY g) FROM r WHERE g IS NOT NULL),
        s AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
        w(a, f) USING KEY (a) AS (
            SELECT row_id, row_id FROM r
            UNION SELECT s.a, min(w.f) FROM s JOIN w ON s.b = w.a JOIN recurring.w AS o ON o.a = s.a WHERE w.f < o.f GROUP BY s.a)"""

SQL = {
    "p3_found": f"{_CLASSES} SELECT src_table, first_id, row_id AS copy_id FROM c WHERE row_id > first_id",
    "p3_records": f"{_CLASSES} SELECT src_table, first_id, count(*) AS n_copies FROM c GROUP BY ALL",
    "p4_found": f"{_NEAR} SELECT test_id, train_id FROM near",
    "p4_by_split_and_source": f"""{_NEAR} SELECT fold_set, source, count(*) AS n_pairs, count(*) FILTER (WHERE h = 0) AS n_exact_pairs,
        count(DISTINCT test_id) AS n_tests FROM near GROUP BY ALL""",
    "p4_coverage": f"""{_NEAR.split("near AS")[0]} d AS (SELECT DISTINCT p FROM e WHERE p IS NOT NULL), u AS (SELECT p, count(*) AS k FROM t WHERE p IS NOT NULL GROUP BY p),
        w AS (SELECT d.p, u.p AS q, k, substr(u.p, o::INT, length(d.p)::INT) AS s FROM d JOIN u ON length(d.p) <= length(u.p), LATERAL (SELECT unnest(range(1, length(u.p) - length(d.p) + 2)) AS o)),
        m AS (SELECT *, CASE WHEN length(p) = 0 THEN 0 ELSE hamming(p, s) END AS h FROM w),
        g AS (SELECT p, q, any_value(k) AS k, min(h) AS h FROM m WHERE h <= 2 GROUP BY p, q), c AS (SELECT p, sum(k) AS n, min(h) AS h FROM g GROUP BY p),
        l AS (SELECT p, count(DISTINCT i) AS letters FROM (SELECT p, s, unnest(range(1, length(p) + 1)) AS i FROM m WHERE h <= 2) WHERE substr(p, i, 1) = substr(s, i, 1) GROUP BY p)
        SELECT test_id, coalesce(n, 0)::BIGINT AS n_train, h AS nearest, CASE WHEN length(e.p) > 0 THEN round(coalesce(letters, 0) / length(e.p)::DOUBLE, 6) WHEN e.p IS NOT NULL THEN 0.0 END AS covered
        FROM e LEFT JOIN c USING (p) LEFT JOIN l USING (p)""",
    "p5_found": f"{_TIED} SELECT f AS first_id, a AS row_id FROM w WHERE a > f",
    # Largest group first, to the split whose rows are furthest below its target; ties to the split named first.
    "p5_split_sizes": f"""{_TIED}, z AS (SELECT count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, f) AS k FROM w GROUP BY f), tot AS (SELECT sum(n) AS t FROM z),
        q AS (SELECT 0::BIGINT AS k, [round(0.8 * t * 1000000), round(0.1 * t * 1000000), round(0.1 * t * 1000000)]::BIGINT[] AS d, [0, 0, 0]::BIGINT[] AS s, [0, 0, 0]::BIGINT[] AS m FROM tot UNION ALL
          SELECT k + 1, list_transform(d, lambda x, i: x - CASE WHEN i = at_ THEN n * 1000000 ELSE 0 END), list_transform(s, lambda x, i: x + CASE WHEN i = at_ THEN n ELSE 0 END), list_transform(m, lambda x, i: x + CASE WHEN i = at_ THEN 1 ELSE 0 END)
          FROM (SELECT q.k, q.d, q.s, q.m, z.n, list_position(q.d, list_max(q.d)) AS at_ FROM q JOIN z ON z.k = q.k + 1)),
        b AS (SELECT * FROM q ORDER BY k DESC LIMIT 1)
        SELECT unnest(['train', 'validation', 'test']) AS split, unnest(s) AS n_rows, unnest(m) AS n_groups FROM b""",
    "p6_found": f"{_COUNTS} SELECT peptide, CASE WHEN n = 1 THEN 'rare' ELSE 'common' END AS mark FROM c WHERE n = 1 OR n >= 25",
    "p6_counts": f"""{_COUNTS} SELECT peptide, n AS n_occurrences, n AS n_records,
        CASE WHEN n = 1 THEN 'rare' WHEN n >= 25 THEN 'common' END AS mark FROM c""",
    "p6_words": f"{_WORDS} SELECT * FROM w",
    "p6_terms": f"{_WORDS} SELECT *, CASE WHEN n_records <= 1 THEN 'rare' WHEN n_records >= 25 THEN 'common' END AS mark FROM w",
    "p8_found": f"{_SHARED} SELECT item_id, doc_id FROM shared",
    # Every item here has twelve words or more.
    "p8_near": f"""WITH it AS (SELECT item_id, {_LETTERS} AS w FROM eval_items), iw AS (SELECT DISTINCT item_id, w[k:k + 11] AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM it)),
        v AS (SELECT DISTINCT unnest(g) AS x FROM iw), dt AS (SELECT doc_id, {_LETTERS} AS w FROM documents),
        dk AS (SELECT doc_id, k, (x IS NOT NULL)::INT AS known FROM (SELECT doc_id, unnest(w) AS y, unnest(range(1, len(w) + 1)) AS k FROM dt) LEFT JOIN v ON x = y),
        ds AS (SELECT doc_id, k, sum(known) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) AS n FROM dk),
        dw AS (SELECT DISTINCT doc_id, w[k:k + 11] AS g FROM ds JOIN dt USING (doc_id) WHERE n >= 10 AND k + 11 <= len(w)),
        -- Windows of one length within two edits differ in two words at most, or agree when each loses one word.
        u AS (SELECT DISTINCT false AS d, g FROM iw UNION ALL SELECT DISTINCT true, g FROM dw),
        o1 AS (SELECT d, g, hash(list_concat(g[1:i - 1], g[i + 1:12])) AS h FROM u, unnest(range(1, 13)) AS r(i)),
        o2 AS (SELECT d, g, i, j, hash(list_concat(g[1:i - 1], g[i + 1:j - 1], g[j + 1:12])) AS h FROM u, unnest(range(1, 13)) AS r(i), unnest(range(1, 13)) AS q(j) WHERE i < j),
        p AS (SELECT a.g AS a, b.g AS b FROM o1 a JOIN o1 b USING (h) WHERE NOT a.d AND b.d UNION SELECT a.g, b.g FROM o2 a JOIN o2 b USING (i, j, h) WHERE NOT a.d AND b.d),
        e AS (SELECT a, b, least(2, list_sum(list_transform(range(1, 13), lambda i: (a[i] <> b[i])::INT))) AS n FROM p)
        SELECT item_id, doc_id, min(n)::INT AS edits, 12 AS words FROM e JOIN iw ON iw.g = e.a JOIN dw ON dw.g = e.b GROUP BY item_id, doc_id""",
    "p8_items": f"""{_SHARED} SELECT e.item_id, e.suite, e.split, count(s.doc_id) AS n_docs FROM eval_items e LEFT JOIN shared s USING (item_id)
        GROUP BY ALL""",
    "p9_boilerplate": r"""
        WITH d AS (SELECT coalesce(source, '') AS host, doc_id, regexp_replace(translate(lower(text), '123456789', '000000000'), '[ \t\r\f\x0b]+', ' ', 'g') AS t FROM documents),
        l AS (SELECT DISTINCT host, doc_id, trim(unnest(string_split(t, chr(10)))) AS line FROM d),
        s AS (SELECT host, count(*) AS n_docs FROM d GROUP BY host)
        SELECT host, line, count(*) AS n, any_value(n_docs) AS n_docs FROM l JOIN s USING (host) WHERE line <> '' GROUP BY host, line HAVING count(*) >= 5 AND count(*) >= 0.003 * any_value(n_docs)""",
    "p7_round_trip": "SELECT doc_id, true AS same FROM documents",
}
