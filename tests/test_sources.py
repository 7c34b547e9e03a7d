import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankstead.functions import keys, sequence
from rankstead.operators import structure
from rankstead.sources import files

BLOCK = """# banner
--------
 Pos  MHC  Peptide  Core Of Gp Gl Ip Il Icore Identity Score_EL %Rank_EL BindLevel
--------
 1 HLA-A*02:01 AAAAAAAAA AAAAAAAAA 0 0 0 0 0 AAAAAAAAA P1 0.9 0.1 <= SB
 2 HLA-A*02:01 CCCCCCCCC CCCCCCCCC 0 0 0 0 0 CCCCCCCCC P1 0.5 1.1 <= WB
 3 HLA-A*02:01 DDDDDDDDD DDDDDDDDD 0 0 0 0 0 DDDDDDDDD P1 0.1 9.0
 4 broken row
--------
Protein P1. Allele
 5 HLA-A*02:01 EEEEEEEEE EEEEEEEEE 0 0 0 0 0 EEEEEEEEE P1 0.1 9.0
"""


def test_predictor_block(spark):
    df = spark.createDataFrame([("f", BLOCK), ("empty", ""), ("null", None)], "k string, t string")
    rows = files.parse_predictor_blocks(df, "k", "t").orderBy("line_no").collect()
    assert [(r["fields"]["Peptide"][0], r["bind_level"], r["is_binder"]) for r in rows] == [("A", "SB", True), ("C", "WB", True), ("D", None, False)]
    assert rows[1]["fields"]["%Rank_EL"] == "1.1"


def test_commented_table(spark):
    text = "# ran A0201 (0.00), B0702 (0.12)\nPeptide\tScore\nAAAA\t1\nbad\n#x\nCCCC\t2\n"
    rows, near = files.parse_commented_table(spark.createDataFrame([("f", text)], "k string, t string"), "k", "t")
    assert [r["fields"]["Peptide"] for r in rows.orderBy("line_no").collect()] == ["AAAA", "CCCC"]
    assert {(r["nearest"], r["distance"]) for r in near.collect()} == {("A0201", 0.0), ("B0702", 0.12)}


def test_nearest_training_allele(spark):
    text = "HLA-A02:01 : Distance to training data  0.123 (using nearest neighbor HLA-A02:06)"
    r = files.nearest_training_allele(spark.createDataFrame([("f", text)], "k string, t string"), "k", "t").first()
    assert r["substituted"] and r["distance"] == 0.123


def test_text_formats(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">one a\nacd\nEF\n>empty\n>two\nGG\n")
    assert [(r["header"], r["sequence"]) for r in files.read_fasta(spark, str(tmp_path / "x.fa")).collect()] == [("one a", "ACDEF"), ("two", "GG")]
    (tmp_path / "y.fa").write_text(">sp|P1 a->b\r\nac\r\nDE\r\n>q\nGG")
    assert [(r["header"], r["sequence"]) for r in files.read_fasta(spark, str(tmp_path / "y.fa")).collect()] == [("sp|P1 a->b", "ACDE"), ("q", "GG")]
    (tmp_path / "x.a3m").write_text("#5\t1\n>q\nACDEF\n>h\n--D--\n>g\nAC---\n")
    al = files.read_alignment(spark, str(tmp_path / "x.a3m"))
    assert [r["sequence"] for r in files.alignment_columns(al, 3, 2).orderBy("ord").collect()] == ["DE", "D-"]
    (tmp_path / "p.txt").write_text("# c\nHLA-A*02:01 YFAM\n\n")
    assert files.read_pairs(spark, str(tmp_path / "p.txt")).first()["value"] == "YFAM"
    (tmp_path / "e.txt").write_text("# c\n")
    with pytest.raises(ValueError):
        files.read_pairs(spark, str(tmp_path / "e.txt"))
    (tmp_path / "f.csv").write_text("NA,A,hla_a_02_01,AAAA,n1\nhard,A,hla_a_02_01,CCCC,\nNA,A,hla_a_02_01,,\n")
    rows = files.read_fold_set(spark, str(tmp_path / "f.csv")).collect()
    assert [(r["tag"], r["allele"], r["label"]) for r in rows] == [("NA", "HLA-A*02:01", 1), ("hard", "HLA-A*02:01", 0)]
    (tmp_path / "m.csv").write_text("tag,locus,slug,peptide,n\nNA,A,s,AAAA,3\n")
    assert files.read_maybe_headed(spark, str(tmp_path / "m.csv"), "tag string, locus string, slug string, peptide string, n int", 3, ("peptide", "sequence")).collect()[0]["n"] == 3
    (tmp_path / "t.tsv").write_text(" Allele \tPeptide\nA0201\taaaaaaaaa\nDRB11501\tAAAAAAAAA\nA0201\tAAAAAAAAA\n")
    t = files.read_folded_tsv(spark, str(tmp_path / "t.tsv"), ["allele", "peptide"])
    assert files.labelled_positives(t, keys.normalize_key_strict("allele"), F.col("peptide")).count() == 1
    with pytest.raises(KeyError):
        files.read_folded_tsv(spark, str(tmp_path / "t.tsv"), ["nope"])
    assert files.resolve_column(t, ["x", "PEPTIDE"]) == "peptide"


def test_json_layouts(spark):
    docs = [("a", '{"pae": [[1, 2], [3, 4]]}'), ("b", '[{"predicted_aligned_error": [[5, 6], [7, 8]]}]'), ("c", '{"residue1": [1, 1], "residue2": [1, 2], "distance": [9, 10]}'), ("d", "no json"), ("e", None)]
    got = {(r["k"], r["i"], r["j"]): r["v"] for r in files.pae_long(spark.createDataFrame(docs, "k string, t string"), "k", "t").collect()}
    assert got["a", 2, 1] == 3 and got["b", 1, 2] == 6 and got["c", 1, 2] == 10 and len(got) == 10
    m = '{"iptm": 0.5, "pair_chains_iptm": [[1, 2, 3], [4, 5, 6], [7, 8, 9]], "plddt": [50, 60, 70, 80]}'
    r = files.confidence_json(spark.createDataFrame([("a", m, 2)], "k string, t string, n int"), "k", "t", "n").first()
    assert (r["iptm_pair"], r["iptm_pep"], r["plddt"], r["plddt_pep"]) == (5.0, 9.0, 0.65, 0.75)
    p = '{"hla_a": {"canonical_allele": {"protein_allele_name": "HLA-A*02:01"}, "pocket_pseudosequence": "YF"}, "x": null, "y": {"pocket_pseudosequence": "ZZ"}}'
    got = {(r["allele"], r["pseudosequence"]) for r in files.pseudosequences(spark.createDataFrame([(p,)], "t string"), "t").collect()}
    assert got == {("HLA-A*02:01", "YF"), ("y", "ZZ")}
    a = '{"min_ic": 1, "length": 9, "alleles": {"A": {"anchors": [2, -1], "ic": [0.5], "n_peptides": 7}}}'
    t = files.anchor_table(spark.createDataFrame([(a,)], "t string"), "t")
    assert t.first()["anchors"] == [3, -1]  # places in the document count from 0
    assert files.anchor_document(t, 1.0, 9).first()["document"] == '{"min_ic":1.0,"length":9,"alleles":{"A":{"anchors":[2,-1],"ic":[0.5],"n_peptides":7}}}'


def test_arrays_and_folders(spark, tmp_path):
    (tmp_path / "NA__hla_a_02_01__aaaa").mkdir()
    buf = io.BytesIO()
    np.savez(buf, pae=np.arange(8.0).reshape(2, 2, 2))
    (tmp_path / "NA__hla_a_02_01__aaaa" / "x.npz").write_bytes(buf.getvalue())
    got = {(r["i"], r["j"]): r["v"] for r in files.read_arrays(spark, str(tmp_path)).collect()}
    assert got == {(1, 1): 0.0, (1, 2): 1.0, (2, 1): 2.0, (2, 2): 3.0}
    (tmp_path / "NA__hla_a_02_01__aaaa" / "c.json").write_text("{}")
    f = files.read_folder(spark, str(tmp_path), "*.json").select(keys.fold_name_parts("name").alias("p")).first()["p"]
    assert (f["tag"], f["allele"], f["peptide"]) == ("NA", "HLA-A*02:01", "AAAA")


def _atom(serial, name, chain, res, x, b):
    return f"ATOM  {serial:5d}  {name:<3s} GLY {chain}{res:4d}    {x:8.3f}{0:8.3f}{0:8.3f}{1:6.2f}{b:6.2f}          {name[0]:>2s}"


def test_pdb_contacts(spark):
    lines = [_atom(1, "CA", "A", 1, 0, 90), _atom(2, "CA", "A", 2, 50, 10), _atom(3, "CA", "C", 1, 3, 80), _atom(4, "CA", "C", 2, 30, 70), "HETATM junk", "ATOM  short", _atom(5, "CA", " ", 9, 99, 5)]
    atoms = files.parse_pdb(spark.createDataFrame([("s", x) for x in lines], "k string, l string"), "k", "l")
    assert atoms.count() == 5 and atoms.filter("resseq = 9").first()["chain"] == "A"
    c = structure.contact_features(atoms, ["k"], "C", "A").first()
    assert (c["n_contacts"], c["n_pep_residues"], c["min_distance"]) == (1, 1, 3.0)
    p = structure.interface_plddt(atoms, ["k"], "C", "A").first()
    assert (p["interface_plddt"], p["peptide_plddt"], p["n_interface"], p["n_peptide"]) == (80.0, 75.0, 1, 2)
    assert c["mean_degree"] == 0.5  # residues without any contact count
    assert structure.structure_features(atoms, ["k"], "C", "A").count() == 1
    cif = "ATOM 1 C CA . GLY A 1 5 ? 1.0 2.0 3.0 1.0 77.0 ? 5 GLY A CA 1"
    assert files.parse_mmcif(spark.createDataFrame([("s", cif)], "k string, l string"), "k", "l").first()["b"] == 77.0


def test_anchor_error_and_blocks(spark):
    cells = spark.createDataFrame([("s", i, j, float(10 * i + j)) for i in range(1, 5) for j in range(1, 5)], "k string, i int, j int, v double")
    a = structure.anchor_pae(cells, spark.createDataFrame([("s", [1, -1])], "k string, anchors array<int>"), ["k"], 3, 2).first()["pae_anchors_ic"]
    want = np.mean([np.mean([10 * p + o for o in (1, 2)] + [10 * o + p for o in (1, 2)]) for p in (3, 4)])
    assert abs(a - want) < 1e-12
    b = structure.block_means(cells, ["k"], lambda x: x <= 2, lambda x: x > 2).first()["mean"]
    assert abs(b - np.mean([v for i in (1, 2) for j in (3, 4) for v in (10 * i + j, 10 * j + i)])) < 1e-12


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("NA", "x"), ("hard", None)], "tag string, note string")
    files.write_csv(df, str(tmp_path / "o"), header=False)
    assert {(r[0], r[1]) for r in files.read_csv(spark, str(tmp_path / "o"), "tag string, note string", header=False).collect()} == {("NA", "x"), ("hard", None)}
    files.write_list(df, str(tmp_path / "l"), "tag", [F.desc("tag")])
    assert [r["value"] for r in files.read_list(spark, str(tmp_path / "l")).collect()] == ["hard", "NA"]
    doc = files.json_document(spark.createDataFrame([("b", 2), ("a", 1)], "k string, v int"), "k", ["v"]).first()["document"]
    assert doc == '{"a":{"v":1},"b":{"v":2}}'
    files.write_once_per_key(spark.createDataFrame([("a", 2), ("a", 1)], "k string, v int"), str(tmp_path / "u"), ["k"])
    assert spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "u")).first()["v"] == "1"
    assert files.missing_outputs(df, df.filter("tag = 'NA'"), ["tag"]).count() == 1
    assert files.json_rows(df, "tag", ["tag"]).count() == 2


def test_keys(spark):
    df = spark.createDataFrame([("A0201",), ("HLA-A*02:01",), ("hla-a02:01",), ("A*02:01",), ("A02101",), ("DRB11501",), (None,)], "k string")
    got = [tuple(r) for r in df.select(keys.normalize_key("k"), keys.normalize_key_strict("k"), keys.extract_key("k")).collect()]
    assert [g[0] for g in got[:4]] == ["HLA-A*02:01"] * 4
    assert [g[1] for g in got[:5]] == ["HLA-A*02:01"] * 4 + ["HLA-A*02:101"]
    assert got[4][0] == "HLA-A*02:10" and got[5][1] is None and got[6] == (None, None, None)
    more = spark.createDataFrame([("DRB1*15:01",), ("HLA-DRB1*15:01",), (" a 02:01\u00a0",), ("Mamu",), ("xyz-1",), ("B*4402",)], "k string")
    assert [r[0] for r in more.select(keys.normalize_key("k")).collect()] == ["HLA-DRB1*15:01", "HLA-DRB1*15:01", "HLA-A*02:01", "HLA-MAMU", "HLA-XYZ*-1", "HLA-B*44:02"]
    fam = spark.createDataFrame([("HLA-A*02:01",), ("HLA-A*11:01",), (None,)], "k string")
    assert [tuple(r) for r in fam.select(keys.is_family("k", prefix="HLA-A*02"), keys.is_family("k", pattern=r"HLA-A\*(03|11):")).collect()] == [(True, False), (False, True), (False, False)]
    assert [r[0] for r in fam.select(keys.predictor_key("k", {"HLA-A*11:01": "A1101"})).collect()] == ["HLA-A02:01", "A1101", None]
    n = spark.createDataFrame([("seed3_p9K",), ("seed3",), ("junk",), (None,)], "n string").select(keys.variant_note("n").alias("v")).collect()
    assert [(r["v"]["seed"], r["v"]["position"], r["v"]["aa"]) for r in n] == [("seed3", 9, "K"), ("seed3", None, None), (None, None, None), (None, None, None)]
    assert [r[0] for r in spark.createDataFrame([("NA",), ("hard",), ("wt",), (None,)], "t string").select(keys.tag_label("t")).collect()] == [1, 0, None, None]


def test_sequences(spark):
    df = spark.createDataFrame([("ACD", "ACE"), ("", ""), ("A", "AC"), ("AB-", "ABC")], "a string, b string")
    got = [tuple(r) for r in df.select(sequence.hamming("a", "b"), sequence.hamming_identity("a", "b")).collect()]
    assert [g[0] for g in got] == [1, 0, 2, 1] and got[1][1] == 1.0 and got[2][1] == 0.0 and abs(got[0][1] - 2 / 3) < 1e-12
    assert df.select(sequence.encode("a", 4)).collect()[0][0] == [1, 2, 3, 0]
    assert df.select(sequence.encode("a", 4)).collect()[3][0] == [1, 21, 21, 0]
    assert df.select(sequence.encode("a", 2)).collect()[0][0] == [1, 2]
    assert [r[0] for r in df.select(sequence.is_valid("a")).collect()] == [True, False, True, False]
    assert df.select(sequence.windows("a", 2)).collect()[0][0] == ["AC", "CD"] and df.select(sequence.windows("a", 2)).collect()[1][0] == []
    assert df.select(sequence.mosaic("a", F.lit("GGG"), F.lit(5))).collect()[0][0] == "AGD"
    assert spark.range(1).select(sequence.half_even(F.lit(2.5)), sequence.try_number(F.lit("x"))).first() == (2.0, None)


def test_pair_of_confidence_documents(spark):
    details = '{"pae": [[1, 2, 3], [4, 5, 6], [7, 8, 9]], "token_chain_ids": ["A", "A", "C"], "atom_plddts": [50, 70, 90], "atom_chain_ids": ["A", "A", "C"]}'
    summary = '{"iptm": 0.8, "ptm": 0.7, "ranking_score": 0.9, "has_clash": 0.0, "chain_pair_iptm": [[1, 2, 3], [4, 5, 6], [7, 8, 9]], "chain_pair_pae_min": [[1, 1, 1], [1, 1, 1], [2.5, 1, 1]]}'
    d = spark.createDataFrame([("f_20240101_120000", details), ("lone", details)], "k string, t string")
    s = spark.createDataFrame([("f", summary), ("other", summary)], "k string, t string")
    pair = files.confidence_pair(d, s, "k", "t")
    r = pair.first()
    assert pair.count() == 1 and (r["k"], r["iptm_pair"], r["iptm_pep"], r["pae_min_pep_mhc"], r["plddt"], r["plddt_pep"]) == ("f", 5.0, 9.0, 2.5, 0.7, 0.9)
    cells = structure.at_the_end(files.token_cells(pair, "k"), ["k"], "length")
    got = structure.interface_pae(cells, ["k"], "first", "length").first()
    assert got["pae_pep_mhc"] == np.mean([3, 6, 7, 8]) and got["pae_pep"] == 9.0 and got["pae_anchors"] == got["pae_pep_mhc"]
    assert {(r["k"], r["status"]) for r in files.unmatched(s, d, ["k"]).collect()} == {("f", "missing"), ("other", "missing"), ("f_20240101_120000", "unmatched"), ("lone", "unmatched")}


def test_own_lengths_and_anchor_places(spark):
    cells = spark.createDataFrame([(k, i, j, float(10 * i + j), n) for k, n in (("a", 2), ("b", 1), ("c", 4), ("d", None)) for i in range(1, 5) for j in range(1, 5)], "k string, i int, j int, v double, length int")
    own = structure.at_the_end(cells, ["k"], "length")
    got = {r["k"]: r for r in structure.interface_pae(own, ["k"], "first", "length").collect()}
    cross = lambda p, rest: np.mean([10 * p + o for o in rest] + [10 * o + p for o in rest])
    assert set(got) == {"a", "b"} and abs(got["a"]["pae_anchor2"] - cross(4, (1, 2))) < 1e-12 and abs(got["b"]["pae_anchor2"] - cross(4, (1, 2, 3))) < 1e-12
    c = {r["k"]: r for r in structure.consistency(own, ["k"], "first", "length").collect()}
    rows = [np.mean([31, 32]), np.mean([41, 42])]
    assert abs(c["a"]["pae_spread"] - np.std(rows)) < 1e-12 and abs(c["a"]["asymmetry"] - abs(np.mean(rows) - np.mean([13, 23, 14, 24]))) < 1e-12 and c["b"]["pae_spread"] == 0
    places = spark.createDataFrame([("a", [1, 5, -1, 0]), ("b", [7])], "k string, anchors array<int>")
    a = {r["k"]: r["pae_anchors_ic"] for r in structure.anchor_pae(own, places, ["k"], "first", "length").collect()}
    assert a == {"a": np.mean([cross(3, (1, 2)), cross(4, (1, 2))])}


def test_confidence_spread_and_geometry_at_anchors(spark):
    lines = [_atom(1, "CA", "A", 1, 0, 90), _atom(2, "CA", "C", 5, 3, 80), _atom(3, "H1", "C", 5, 1, 80), _atom(4, "CA", "C", 6, 4, 70), _atom(5, "CA", "C", 9, 30, 60)]
    atoms = files.parse_pdb(spark.createDataFrame([("s", x) for x in lines], "k string, l string"), "k", "l")
    anchors = spark.createDataFrame([("s", [2, -1])], "k string, anchors array<int>")
    r = structure.confidence_consistency(atoms, anchors, ["k"], "C").first()
    assert abs(r["plddt_spread"] - np.std([80, 70, 60])) < 1e-9 and r["anchor_gap"] == 65 - 80
    g = structure.interface_geometry(atoms, ["k"], "C", "A", anchors).first()
    assert (g["n_contacts"], g["n_close"], g["anchor2_contacts"], g["anchor_last_contacts"], g["anchor_last_min"], g["anchor_ic_contacts"]) == (2, 1, 1, 0, 30.0, 1)
    assert abs(g["buried_frac"] - 2 / 3) < 1e-12 and abs(g["contacts_per_residue"] - 2 / 3) < 1e-12
    f = structure.structure_features(atoms, ["k"], "C", "A", spark.createDataFrame([("s", 0.4)], "k string, ipsae double"))
    assert structure.feature_subset(f, ["k"], True).columns == ["k", "interface_plddt", "peptide_plddt", "ipsae"] and "n_contacts" in structure.feature_subset(f, ["k"], False).columns
    cif = [(1, "_atom_site.group_PDB"), (2, "_atom_site.type_symbol"), (3, "_atom_site.label_asym_id"), (4, "_atom_site.label_seq_id"), (5, "_atom_site.Cartn_x"), (6, "_atom_site.Cartn_y"), (7, "_atom_site.Cartn_z"), (8, "_atom_site.B_iso_or_equiv"), (9, "ATOM C A 7 1.5 2.5 3.5 44")]
    t = files.parse_mmcif(spark.createDataFrame([("s", *x) for x in cif], "k string, o int, l string"), "k", "l", "o").first()
    assert (t["chain"], t["resseq"], t["x"], t["b"], t["resname"]) == ("A", 7, 1.5, 44.0, None)


def test_typed_records_and_alignments(spark, tmp_path):
    text = "x\nMHC Pos Peptide Score %Rank Aff(nM) BindLevel\nA 1 PEP 0.5 1.5 x <= WB\nA one PEP 0.1 9 12\nA 2 PEP\nNumber of\nA 3 PEP 1 1 1"
    blocks = files.parse_predictor_blocks(spark.createDataFrame([("f", text)], "k string, t string"), "k", "t")
    r = files.predictor_records(blocks, "k").orderBy("line_no").collect()
    assert [(x["pos"], x["score_el"], x["rank_el"], x["aff_nm"], x["bind_level"], x["is_binder"]) for x in r] == [(1, 0.5, 1.5, None, "WB", True), (None, 0.1, 9.0, 12.0, None, False)]
    rows = [("good", 2, 2, "0:0;1:1"), ("split", 2, 2, "0:0;1:1"), ("split", 3, 3, "0:0;1:1;2:2"), ("other", 2, 3, "0:0;1:1"), ("moved", 2, 2, "0:1;1:0"), ("short", 2, 2, "0:0")]
    got = {x["f"]: x["problem"] for x in files.validated_alignment(spark.createDataFrame(rows, "f string, target_len int, template_len int, alignstring string"), "f").collect()}
    assert got == {"good": None, "split": "templates disagree on the target length", "other": "template length is not the target length", "moved": "places are not mapped to themselves", "short": "places are not mapped to themselves"}
    (tmp_path / "bad.a3m").write_text(">q\nACDEF\n>h\nACD\n")
    with pytest.raises(Exception, match="unequal"):
        files.alignment_columns(files.read_alignment(spark, str(tmp_path / "bad.a3m")), 1, 2).collect()
    folds = spark.createDataFrame([("NA", "hla_a_02_01", "AAA"), ("NA", "hla_a_02_01", "AAA"), ("hard", "hla_b_07_02", "AAA"), ("NA", "hla_a_02_01", "AA"), ("NA", "hla_c_01_02", "AAA")], "tag string, allele_slug string, peptide string")
    chains = spark.createDataFrame([("hla_a_02_01", "GGGGGG"), ("hla_b_07_02", "GG")], "allele_slug string, sequence string")
    good, bad = files.target_sequences(folds, chains, 7, 3)
    assert [tuple(x) for x in good.collect()] == [("A*02:01", 0, "AAA", "NA__hla_a_02_01__aaa", "GGGG/AAA")]
    assert sorted(x["reason"] for x in bad.collect()) == ["no sequence", "peptide length", "sequence too short"]
    files.write_once_per_key(good, str(tmp_path / "t"), ["targetid"], lengths={"target_chainseq": 7})
    with pytest.raises(Exception, match="8 letters"):
        files.write_once_per_key(good, str(tmp_path / "u"), ["targetid"], lengths={"target_chainseq": 8})
    files.write_siblings({"long": good, "summary": bad}, str(tmp_path / "run"))
    assert (tmp_path / "run_long").exists() and (tmp_path / "run_summary").exists()
    assert files.alignment_files(good.withColumn("s", F.lit("GG")), "mhc", "s").count() == 1


def test_substitution_matrix_files(spark, tmp_path):
    from rankstead.operators import motif

    (tmp_path / "m.txt").write_text("# a comment\n   A  C\nA  4  0\nC  0  9\n")
    m = motif.read_matrix(spark, str(tmp_path / "m.txt"))
    pairs = spark.createDataFrame([(1, "AC", "AC"), (2, "AA", "CC"), (3, "A", "AC")], "i int, a string, b string")
    got = {r["i"]: r["distance"] for r in motif.substitution_distance(pairs, "a", "b", m, ["i"]).collect()}
    assert got[1] == 0.0 and got[2] == 1.0 and got[3] is None
