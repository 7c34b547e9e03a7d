"""Readers with explicit schemas for the files of the pipeline, and its sinks.

Line-based formats are split by Spark; only formats whose records span lines without a separator that Spark can split at
(alignments, predictor blocks, JSON documents) are read as whole files, one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankstead.functions.keys import slug_to_key, tag_label
from rankstead.functions.sequence import is_valid

FOLD_SCHEMA = "tag string, locus string, allele_slug string, peptide string, note string"
SCORES_SCHEMA = "allele string, peptide string, label int, in_train string, score double"
COVERAGE = "map<string, struct<pos: bigint, neg: bigint, ms: bigint, binding: bigint>>"
PSEUDO = "map<string, struct<canonical_allele: struct<protein_allele_name: string>, pocket_pseudosequence: string>>"
ANCHORS = "struct<min_ic: double, length: int, alleles: map<string, struct<anchors: array<int>, ic: array<double>, n_peptides: bigint>>>"


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",", header: bool = True) -> DataFrame:
    """CSV (also compressed) with a given schema; the text ``NA`` is a value, never null."""
    return spark.read.schema(schema).option("header", header).option("sep", sep).option("nullValue", "").csv(path)


def read_fold_set(spark: SparkSession, path: str) -> DataFrame:
    """Headerless list of five columns: with ``allele`` and ``label``; rows without a peptide are skipped."""
    rows = read_csv(spark, path, FOLD_SCHEMA, header=False).filter(F.length(F.coalesce("peptide", F.lit(""))) > 0)
    return rows.withColumns({"allele": slug_to_key("allele_slug"), "label": tag_label("tag")})


def read_maybe_headed(spark: SparkSession, path: str, schema: str, column: int, titles: tuple[str, ...]) -> DataFrame:
    """CSV that may or may not begin with a header: rows whose ``column`` holds one of the titles are dropped."""
    names = T.StructType.fromDDL(schema).fieldNames()
    raw = read_csv(spark, path, ", ".join(f"`{n}` string" for n in names), header=False)
    kept = raw.filter(~F.coalesce(F.lower(names[column]).isin(*titles), F.lit(False)))
    return kept.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(schema).fields])


def resolve_column(df: DataFrame, aliases: list[str]) -> str:
    """The first of ``aliases`` that is a column, without regard to case and blanks; raises ``KeyError`` if none is."""
    have = {c.strip().lower(): c for c in df.columns}
    for a in aliases:
        if a.strip().lower() in have:
            return have[a.strip().lower()]
    raise KeyError(f"none of {aliases} among {df.columns}")


def read_folded_tsv(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """Tab-separated text with a header whose names are folded to lower case; raises if a required one is missing."""
    df = spark.read.option("header", True).option("sep", "\t").csv(path)
    df = df.toDF(*[c.strip().lower() for c in df.columns])
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns {missing}")
    return df


def labelled_positives(raw: DataFrame, allele: Column, peptide: Column, lengths: tuple[int, int] = (8, 11)) -> DataFrame:
    """Distinct valid (peptide, allele) with ``label`` 1 and ``length``: unknown alleles, bad letters and lengths dropped."""
    rows = raw.select(F.upper(F.trim(peptide)).alias("peptide"), allele.alias("allele")).filter(F.col("allele").isNotNull() & is_valid("peptide"))
    rows = rows.withColumn("length", F.length("peptide")).filter(F.col("length").between(*lengths))
    return rows.dropDuplicates(["peptide", "allele"]).withColumn("label", F.lit(1))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``header``, ``sequence`` (in capitals, lines joined); empty records are dropped. A record begins at a line with ``>``;
    one inside a header is part of it."""
    rec = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("value")).filter(F.trim("value") != "")
    lines = F.split("value", r"\r?\n")
    seq = F.upper(F.array_join(F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.regexp_replace(x, r"\s", "")), ""))
    return rec.select(F.trim(lines[0]).alias("header"), seq.alias("sequence")).filter("sequence <> ''")


def read_alignment(spark: SparkSession, path: str) -> DataFrame:
    """A3M files: ``file``, ``ord``, ``header``, ``sequence``; the length header and ``###`` lines are skipped."""
    whole = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    entries = whole.select("file", F.posexplode(F.split(F.regexp_replace("value", r"(?m)^#.*\n?", ""), r"(?m)^>")).alias("ord", "e")).filter("trim(e) <> ''")
    lines = F.split("e", r"\r?\n")
    return entries.select("file", "ord", F.trim(lines[0]).alias("header"), F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), "").alias("sequence"))


def alignment_columns(alignment: DataFrame, start: int, length: int) -> DataFrame:
    """The part of each aligned row from ``start`` (from 1), without rows that are all gaps there.

    Raises at run time on lower-case letters (insertions), which have no column, and on rows of another length than the
    first of their file.
    """
    lengths = alignment.groupBy("file").agg(F.min_by(F.length("sequence"), "ord").alias("_n"))
    problem = F.when(F.col("sequence").rlike("[a-z]"), "insertions have no column").when(F.length("sequence") != F.col("_n"), "rows of unequal length")
    checked = F.when(problem.isNotNull(), F.raise_error(problem)).otherwise(F.substring("sequence", start, length))
    return alignment.join(lengths, "file").withColumn("sequence", checked).drop("_n").filter(~F.col("sequence").rlike("^-*$"))


def validated_alignment(rows: DataFrame, file: str) -> DataFrame:
    """``file``, ``target_len`` and ``problem`` (null: none) of template alignments: rows with ``target_len``,
    ``template_len`` and ``alignstring`` (``0:0;1:1;...``).

    All rows of a file must give one target length, equal to every template length, and map each place to itself. A file
    has a few rows; the whole check is one aggregation.
    """
    pairs = F.split("alignstring", ";")
    identity = F.forall(pairs, lambda p: F.split(p, ":")[0] == F.split(p, ":")[1]) & (F.size(pairs) == F.col("target_len"))
    t, m = F.collect_set("target_len"), F.collect_set("template_len")
    problem = F.when(F.size(t) != 1, "templates disagree on the target length").when(F.size(F.array_except(m, t)) > 0, "template length is not the target length").when(~F.bool_and(identity), "places are not mapped to themselves")
    return rows.groupBy(file).agg(F.min("target_len").alias("target_len"), problem.alias("problem"))


def parse_predictor_blocks(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Header-driven parse of whole predictor outputs: one row per result line of the first block of each text.

    The header line (Pos, MHC, Peptide ...) names the columns; the block ends at the first line after it that begins with
    Protein or Number; separators, comments and lines with another number of tokens are skipped (the level and its arrow
    aside, wherever they stand). Names may come in any order as long as the header has Pos, MHC and Peptide. Columns:
    ``key``, ``line_no``, ``fields`` (map), ``bind_level``, ``is_binder``. A text is one block; its lines stay together.
    """
    lines = texts.select(key, F.posexplode(F.split(text, r"\r?\n")).alias("line_no", "_l")).withColumn("_t", F.split(F.trim(F.regexp_replace("_l", r"\s+", " ")), " "))
    w = Window.partitionBy(key)
    is_head = F.size(F.array_intersect("_t", F.array(F.lit("Pos"), F.lit("MHC"), F.lit("Peptide")))) == 3
    lines = lines.withColumn("_h", F.min(F.when(is_head, F.struct("line_no", "_t"))).over(w))
    after = F.col("line_no") > F.col("_h.line_no")
    lines = lines.withColumn("_end", F.min(F.when(after & F.col("_l").rlike(r"^\s*(Protein|Number)"), F.col("line_no"))).over(w))
    head = F.col("_h._t")
    names = F.when(F.element_at(head, -1) == "BindLevel", F.slice(head, F.lit(1), F.size(head) - 1)).otherwise(head)
    rows = lines.filter(after & (F.col("line_no") < F.coalesce("_end", F.lit(2**31 - 1)))).filter(~F.col("_l").rlike(r"^\s*(#|-+\s*$)") & (F.trim("_l") != ""))
    is_level = lambda x: x.isin("SB", "WB")
    level = F.try_element_at(F.filter("_t", is_level), F.lit(-1))
    core = F.filter("_t", lambda x: ~is_level(x) & (x != "<="))
    good = rows.withColumns({"bind_level": level, "_c": core, "_n": names}).filter(F.size("_c") == F.size("_n"))
    return good.select(key, "line_no", F.map_from_arrays("_n", "_c").alias("fields"), "bind_level", F.col("bind_level").isNotNull().alias("is_binder"))


def predictor_records(blocks: DataFrame, key: str) -> DataFrame:
    """Typed rows of :func:`parse_predictor_blocks`; scores, ranks and affinities under either name that predictors give
    them. What is no number is null."""
    f = lambda *names: F.coalesce(*[F.nullif(F.try_element_at("fields", F.lit(n)), F.lit("")) for n in names]).try_cast("double")
    text = lambda n: F.coalesce(F.try_element_at("fields", F.lit(n)), F.lit(""))
    return blocks.select(
        key, "line_no", text("MHC").alias("allele"), text("Peptide").alias("peptide"), F.try_element_at("fields", F.lit("Pos")).try_cast("int").alias("pos"), f("Score_EL", "Score").alias("score_el"), f("%Rank_EL", "%Rank").alias("rank_el"),
        f("Score_BA").alias("score_ba"), f("%Rank_BA").alias("rank_ba"), f("Aff(nM)", "Aff(nM)_BA").alias("aff_nm"), "bind_level", "is_binder",
    )


def parse_commented_table(texts: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Tab-separated result after comment lines: its rows as maps, and the nearest alleles named in the preamble."""
    lines = texts.select(key, F.posexplode(F.split(text, r"\r?\n")).alias("line_no", "_l"))
    w = Window.partitionBy(key)
    head = F.min(F.when(F.col("_l").rlike("^Peptide\\b"), F.struct("line_no", "_l"))).over(w)
    marked = lines.withColumn("_h", head)
    names = F.split(F.col("_h._l"), "\t")
    rows = marked.filter((F.col("line_no") > F.col("_h.line_no")) & (F.trim("_l") != "") & ~F.col("_l").startswith("#")).withColumn("_v", F.split("_l", "\t"))
    good = rows.filter(F.size("_v") == F.size(names)).select(key, "line_no", F.map_from_arrays(names, F.col("_v")).alias("fields"))
    pre = marked.filter("_h IS NULL OR line_no < _h.line_no").select(key, F.explode(F.regexp_extract_all("_l", F.lit(r"([A-Z]\d{4})\s*\(([\d.]+)\)"), 0)).alias("_m"))
    near = pre.select(key, F.regexp_extract("_m", r"([A-Z]\d{4})", 1).alias("nearest"), F.regexp_extract("_m", r"\(([\d.]+)\)", 1).try_cast("double").alias("distance"))
    return good, near


def nearest_training_allele(texts: DataFrame, key: str, text: str) -> DataFrame:
    """From captured output: each training allele the predictor used, its distance, and whether it stands in for another.

    All matches of a text come out, equal ones once.
    """
    pat = r"(HLA-[ABC]\*?\d{2}:?\d{2,3})\s*:?\s*Distance to training data\s+([\d.]+)\s*\(using nearest neighbor\s+(HLA-[ABC]\*?\d{2}:?\d{2,3})\)"
    got = lambda i: F.regexp_extract("_m", pat, i)
    found = texts.select(key, F.explode(F.regexp_extract_all(text, F.lit(pat), 0)).alias("_m"))
    return found.select(key, got(1).alias("allele"), got(2).try_cast("double").alias("distance"), got(3).alias("nearest")).distinct().withColumn("substituted", F.col("allele") != F.col("nearest"))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Two columns parted by blanks: ``key``, ``value``; comments and blank lines skipped. Raises if nothing is left."""
    t = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter("trim(value) <> '' AND NOT trim(value) LIKE '#%'").withColumn("_t", t).filter(F.size("_t") >= 2)
    out = rows.select(F.col("_t")[0].alias("key"), F.col("_t")[1].alias("value"))
    if out.isEmpty():
        raise ValueError(f"no entries in {path}")
    return out


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """One value per line, stripped; blank lines skipped."""
    return spark.read.text(path).select(F.trim("value").alias("value")).filter("value <> ''")


def json_map(df: DataFrame, text: str, kind: str) -> DataFrame:
    """``key``, ``value`` of a JSON object whose values have one type; null values and texts that are no JSON are skipped."""
    return df.select(F.explode(F.from_json(text, kind)).alias("key", "value")).filter("value IS NOT NULL")


def pseudosequences(df: DataFrame, text: str) -> DataFrame:
    """``allele``, ``pseudosequence`` from the nested JSON; the name falls back to the key."""
    m = json_map(df, text, PSEUDO)
    return m.select(F.coalesce("value.canonical_allele.protein_allele_name", "key").alias("allele"), F.col("value.pocket_pseudosequence").alias("pseudosequence")).filter("pseudosequence IS NOT NULL")


def _from_zero(a: Column) -> Column:
    return F.transform(a, lambda x: F.when(x >= 0, x + 1).otherwise(x))


def _to_zero(a: Column) -> Column:
    return F.transform(a, lambda x: F.when(x > 0, x - 1).otherwise(x))


def anchor_table(df: DataFrame, text: str) -> DataFrame:
    """``allele``, ``anchors``, ``ic``, ``n_peptides`` from the nested JSON, whose places count from 0; here they do from 1.
    Places from the end (-1 is the last) are the same in both."""
    t = df.select(F.explode(F.from_json(text, ANCHORS)["alleles"]).alias("allele", "v")).select("allele", "v.*")
    return t.withColumn("anchors", _from_zero(F.col("anchors")))


def anchor_document(table: DataFrame, least: float, length: int) -> DataFrame:
    """The nested JSON that :func:`anchor_table` reads, its places from 0: column ``document``. One row per group."""
    t = table.withColumn("anchors", _to_zero(F.col("anchors")))
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("allele").alias("key"), F.struct("anchors", "ic", "n_peptides").alias("value")))))
    return t.agg(F.to_json(F.struct(F.lit(least).alias("min_ic"), F.lit(length).alias("length"), entries.alias("alleles"))).alias("document"))


def confidence_pair(details: DataFrame, summaries: DataFrame, key: str, text: str, peptide_chain: str = "C", other_chain: str = "A") -> DataFrame:
    """The two documents of one fold, joined on its name without a time stamp: confidences of the summary, pLDDT means of the
    details, and the error matrix's cells between the two chains' tokens as ``cells`` (array of i, j, v; peptide tokens are
    numbered after the others). Names missing on either side are left out; see :func:`unmatched`.
    """
    name = F.regexp_replace(key, r"_\d{8}_\d{6}$", "")
    d = F.from_json(text, "struct<pae: array<array<double>>, token_chain_ids: array<string>, atom_plddts: array<double>, atom_chain_ids: array<string>>")
    s = F.from_json(text, "struct<iptm: double, ptm: double, ranking_score: double, has_clash: double, fraction_disordered: double, chain_pair_iptm: array<array<double>>, chain_pair_pae_min: array<array<double>>>")
    both = details.select(name.alias(key), d.alias("_d")).join(summaries.select(name.alias(key), s.alias("_s")), key)
    at = lambda m, i, j: F.get(F.get(F.col(f"_s.{m}"), F.lit(i)), F.lit(j))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y) / F.nullif(F.size(a).cast("double"), F.lit(0.0))
    own = F.transform(F.filter(F.arrays_zip("_d.atom_plddts", "_d.atom_chain_ids"), lambda z: z["atom_chain_ids"] == peptide_chain), lambda z: z["atom_plddts"])
    places = lambda c: F.filter(F.transform("_d.token_chain_ids", lambda x, i: F.when(x == c, i)), lambda i: i.isNotNull())
    return both.select(
        key, *[F.col(f"_s.{c}").alias(c) for c in ("iptm", "ptm", "ranking_score", "has_clash", "fraction_disordered")], at("chain_pair_iptm", 2, 0).alias("iptm_pep_mhc"), at("chain_pair_iptm", 0, 2).alias("iptm_mhc_pep"),
        ((at("chain_pair_iptm", 2, 0) + at("chain_pair_iptm", 0, 2)) / 2).alias("iptm_pair"), at("chain_pair_iptm", 2, 2).alias("iptm_pep"), at("chain_pair_pae_min", 2, 0).alias("pae_min_pep_mhc"),
        (mean(F.col("_d.atom_plddts")) / 100).alias("plddt"), (mean(own) / 100).alias("plddt_pep"), F.col("_d.pae").alias("pae"), places(other_chain).alias("other_tokens"), places(peptide_chain).alias("peptide_tokens"),
    )


def token_cells(pairs: DataFrame, key: str) -> DataFrame:
    """Long error cells (``key``, ``i``, ``j``, ``v``, ``length``) of :func:`confidence_pair` over the two chains' tokens alone,
    the peptide's last: what :func:`rankstead.operators.structure.at_the_end` takes. Folds without both chains have none."""
    ids = F.concat("other_tokens", "peptide_tokens")
    rows = pairs.filter("size(other_tokens) > 0 AND size(peptide_tokens) > 0").select(key, F.size("peptide_tokens").alias("length"), "pae", ids.alias("_ids"), F.posexplode(ids).alias("_i", "_x"))
    cells = rows.select(key, "length", (F.col("_i") + 1).alias("i"), F.get("pae", F.col("_x")).alias("_row"), F.posexplode("_ids").alias("_j", "_y"))
    return cells.select(key, "i", (F.col("_j") + 1).alias("j"), F.get("_row", F.col("_y")).alias("v"), "length")


def unmatched(wanted: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """Keys that are wanted but not found (``missing``) or found but not wanted (``unmatched``), with ``status``."""
    a, b = wanted.select(*key).distinct(), found.select(*key).distinct()
    return a.join(b, key, "left_anti").withColumn("status", F.lit("missing")).unionByName(b.join(a, key, "left_anti").withColumn("status", F.lit("unmatched")))


def confidence_json(df: DataFrame, key: str, text: str, peptide_length: str | None = None) -> DataFrame:
    """Numeric confidences from a metrics document: overall and chain-pair values, mean pLDDT over all and over the peptide."""
    s = F.from_json(text, "struct<iptm: double, ptm: double, pair_chains_iptm: array<array<double>>, plddt: array<double>>")
    out = df.select("*", s.alias("_s"))
    at = lambda i, j: F.get(F.get(F.col("_s.pair_chains_iptm"), F.lit(i)), F.lit(j))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y) / F.nullif(F.size(a).cast("double"), F.lit(0.0))
    p = F.col("_s.plddt")
    cols = [F.col("_s.iptm").alias("iptm"), F.col("_s.ptm").alias("ptm"), at(0, 2).alias("iptm_mhc_pep"), at(2, 0).alias("iptm_pep_mhc"), ((at(0, 2) + at(2, 0)) / 2).alias("iptm_pair"), at(2, 2).alias("iptm_pep"), (mean(p) / 100).alias("plddt")]
    if peptide_length:
        cols.append((mean(F.slice(p, -F.col(peptide_length), F.col(peptide_length))) / 100).alias("plddt_pep"))
    return out.select(key, *cols)


def pae_long(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``i``, ``j`` (from 1), ``v`` from any of three layouts: nested ``pae`` or ``predicted_aligned_error`` (bare or
    in a list), or the sparse one of residue1, residue2, distance."""
    doc = F.when(F.ltrim(text).startswith("["), F.get_json_object(text, "$[0]")).otherwise(F.col(text))
    s = F.from_json(doc, "struct<pae: array<array<double>>, predicted_aligned_error: array<array<double>>, residue1: array<int>, residue2: array<int>, distance: array<double>>")
    t = df.select(key, s.alias("_s")).withColumn("_m", F.coalesce("_s.pae", "_s.predicted_aligned_error"))
    dense = t.filter("_m IS NOT NULL").select(key, F.posexplode("_m").alias("_i", "_row")).select(key, (F.col("_i") + 1).alias("i"), F.posexplode("_row").alias("_j", "v")).select(key, "i", (F.col("_j") + 1).alias("j"), "v")
    sparse = t.filter("_m IS NULL AND _s.distance IS NOT NULL").select(key, F.explode(F.arrays_zip("_s.residue1", "_s.residue2", "_s.distance")).alias("z")).select(key, F.col("z.residue1").alias("i"), F.col("z.residue2").alias("j"), F.col("z.distance").alias("v"))
    return dense.unionByName(sparse)


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """NPY and NPZ files as ``path``, ``i``, ``j`` (from 1), ``v``: the first array, of a 3-D one the first sheet."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")

    def run(batches):
        import io

        import numpy as np
        import pandas as pd

        for part in batches:
            for p, content in zip(part["path"], part["content"], strict=True):
                data = np.load(io.BytesIO(content), allow_pickle=False)
                a = data if isinstance(data, np.ndarray) else data[data.files[0]]
                a = a[0] if a.ndim == 3 else a
                i, j = np.indices(a.shape)
                yield pd.DataFrame({"path": p, "i": i.ravel() + 1, "j": j.ravel() + 1, "v": a.ravel().astype(float)})

    return files.mapInPandas(run, "path string, i bigint, j bigint, v double")


def read_folder(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """``path``, ``name`` (parent folder) and ``text`` of matching files anywhere below a folder."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
    p = F.input_file_name()
    return files.select(p.alias("path"), F.element_at(F.split(p, "/"), -2).alias("name"), F.col("value").alias("text"))


def parse_pdb(lines: DataFrame, key: str, line: str) -> DataFrame:
    """Atom table of fixed-width lines: ``key``, ``chain``, ``resseq``, ``resname``, ``atom``, ``element``, ``x``, ``y``, ``z``, ``b``.

    ATOM lines only; a blank chain is ``A``, a blank B factor 0; lines whose numbers can't be read are left out.
    """
    cut = lambda a, n: F.trim(F.substring(line, a, n))
    atoms = lines.filter(F.col(line).startswith("ATOM  "))
    blank = lambda c, d: F.when(c == "", F.lit(d)).otherwise(c)
    out = atoms.select(
        key,
        blank(cut(22, 1), "A").alias("chain"),
        cut(23, 4).try_cast("int").alias("resseq"),
        cut(18, 3).alias("resname"),
        cut(13, 4).alias("atom"),
        cut(77, 2).alias("element"),
        *[cut(a, 8).try_cast("double").alias(c) for a, c in ((31, "x"), (39, "y"), (47, "z"))],
        blank(cut(61, 6), "0").try_cast("double").alias("b"),
    )
    return out.dropna(subset=["resseq", "x", "y", "z"])


def parse_mmcif(lines: DataFrame, key: str, line: str, order: str | None = None) -> DataFrame:
    """Atom table of mmCIF files; same columns as :func:`parse_pdb`. Only ``ATOM`` records count.

    With ``order`` (a column that numbers the lines of a key), the fields are found by the names of the file's own
    ``_atom_site`` loop; without, they are taken in the usual order.
    """
    t = F.split(F.trim(line), r"\s+")
    usual = {"auth": 6, "res": 8, "resname": 5, "atom": 3, "element": 2, "x": 10, "y": 11, "z": 12, "b": 14}
    if order is None:
        rows = lines.filter(F.col(line).startswith("ATOM ")).select(key, t.alias("_t")).filter(F.size("_t") >= 17)
        at = lambda n: F.col("_t")[usual[n]]
    else:
        item = F.regexp_extract(line, r"^_atom_site\.(\S+)", 1)
        heads = lines.filter(item != "").groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("n")))), lambda x: x["n"]).alias("_names"))  # a score of names
        rows = lines.filter(F.col(line).startswith("ATOM ")).select(key, t.alias("_t")).join(heads, key).filter(F.size("_t") == F.size("_names"))
        names = {"auth": "label_asym_id", "res": "label_seq_id", "resname": "label_comp_id", "atom": "label_atom_id", "element": "type_symbol", "x": "Cartn_x", "y": "Cartn_y", "z": "Cartn_z", "b": "B_iso_or_equiv"}
        at = lambda n: F.try_element_at("_t", F.nullif(F.array_position("_names", names[n]), F.lit(0)).cast("int"))
    return rows.select(key, at("auth").alias("chain"), at("res").try_cast("int").alias("resseq"), at("resname").alias("resname"), at("atom").alias("atom"), at("element").alias("element"), *[at(c).try_cast("double").alias(c) for c in ("x", "y", "z", "b")]).dropna(subset=["x", "y", "z"])


# Sinks


def write_csv(df: DataFrame, path: str, header: bool = True, sep: str = ",") -> None:
    """CSV; null is empty, ``NA`` stays as it is."""
    df.write.mode("overwrite").option("header", header).option("sep", sep).option("nullValue", "").option("emptyValue", "").csv(path)


def write_list(df: DataFrame, path: str, column: str, order: list[Column]) -> None:
    """A short list in a given order, one file."""
    df.orderBy(*order).select(F.col(column).cast("string")).coalesce(1).write.mode("overwrite").text(path)


def json_document(df: DataFrame, key: str, values: list[str]) -> DataFrame:
    """One JSON object of a small table, key to struct, in key order: column ``document``."""
    entries = F.sort_array(F.collect_list(F.struct(F.col(key).alias("key"), F.struct(*values).alias("value"))))
    return df.agg(F.to_json(F.map_from_entries(entries)).alias("document"))


def json_rows(df: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """One JSON document per row: ``name``, ``document``."""
    return df.select(name, F.to_json(F.struct(*columns)).alias("document"))


def write_once_per_key(df: DataFrame, path: str, key: list[str], sep: str = "\t", lengths: dict[str, int] | None = None) -> None:
    """TSV with a header and one row per key (the least row). A column named in ``lengths`` whose letters (slashes aside) are
    not that many makes the write fail before anything is misaligned."""
    rest = [c for c in df.columns if c not in key]
    one = df.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_r")).select(*key, "_r.*") if rest else df.distinct()
    for c, n in (lengths or {}).items():
        wrong = F.length(F.replace(c, F.lit("/"), F.lit(""))) != n
        one = one.withColumn(c, F.when(wrong, F.raise_error(F.concat(F.lit(f"{c} is not {n} letters long: "), F.col(key[0])))).otherwise(F.col(c)))
    write_csv(one.select(*df.columns), path, sep=sep)


def target_sequences(folds: DataFrame, chains: DataFrame, total: int, length: int = 9) -> tuple[DataFrame, DataFrame]:
    """Targets of one length, and the folds that were turned away with the ``reason``.

    ``folds``: ``tag``, ``allele_slug``, ``peptide``; ``chains``: ``allele_slug``, ``sequence``. The chain is cut to ``total``
    less ``length`` letters and joined with the peptide by a slash. Equal targets come out once.
    """
    cut = total - length
    all_rows = folds.select("tag", "allele_slug", "peptide").join(chains.select("allele_slug", "sequence"), "allele_slug", "left")
    reason = F.when(F.length("peptide") != length, "peptide length").when(F.col("sequence").isNull(), "no sequence").when(F.length("sequence") < cut, "sequence too short")
    marked = all_rows.withColumn("reason", reason)
    slug = F.split("allele_slug", "_")
    short = F.when(F.size(slug) >= 4, F.concat(F.upper(slug[1]), F.lit("*"), slug[2], F.lit(":"), slug[3])).otherwise(F.col("allele_slug"))
    name = F.concat_ws("__", "tag", "allele_slug", F.lower("peptide"))
    good = marked.filter("reason IS NULL").select(short.alias("mhc"), F.lit(0).alias("start"), "peptide", name.alias("targetid"), F.concat_ws("/", F.substring("sequence", 1, cut), "peptide").alias("target_chainseq"))
    return good.dropDuplicates(["targetid"]), marked.filter("reason IS NOT NULL").select("tag", "allele_slug", "peptide", "reason")


def write_siblings(tables: dict[str, DataFrame], path: str) -> None:
    """Several tables of one run, as CSV folders beside each other: ``path_name``."""
    for name, df in tables.items():
        write_csv(df, f"{path}_{name}")


def alignment_files(df: DataFrame, allele: str, sequence: str) -> DataFrame:
    """One alignment document per allele, however many rows name it: ``allele``, ``slug``, ``document``."""
    from rankstead.functions.keys import key_to_slug

    one = df.groupBy(allele).agg(F.min(sequence).alias("_s"))
    return one.select(allele, key_to_slug(allele).alias("slug"), F.concat(F.lit(">query\n"), F.col("_s"), F.lit("\n")).alias("document"))


def missing_outputs(wanted: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """What is still to be made: the wanted rows that no finished output covers."""
    return wanted.join(done.select(*key).distinct(), key, "left_anti")
