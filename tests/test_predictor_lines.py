import pytest

from rankstead.sources import predictor_lines
from rankstead.sources.predictor_lines import assemble_records, load_with_rejects, parse_line

CSV = '3,HLA-A*02:01,KLGNQESFL,KLGNQESFL,0,0,0,0,0,KLGNQESFL,"gel ""5"" band",0.5,1.2,5e-1,2.5,120.5,SB'
OUT = " 3  HLA-A*02:01  KLGNQESFL  KLGNQESFL  0  0  0  0  0  KLGNQESFL  Pep1  0.5  1.2  0.4  2.5  120.5"


def kind(raw, layout="csv"):
    return parse_line(raw, layout)[:2]


def test_valid_rows():
    k, why, f = parse_line(CSV + "\r", "csv")
    assert (k, why) == ("row", None)
    assert f[0] == 3 and f[10] == 'gel "5" band' and f[15] == 120.5 and f[16] == "SB"
    assert parse_line(OUT + " <= WB", "stdout")[2][-1] == "WB"
    assert parse_line(OUT.replace("  ", "\t"), "stdout")[2][-1] is None
    assert kind(CSV.replace("SB", "")) == ("row", None)


@pytest.mark.parametrize("line", ["", "  \t", "# x", "Protein P. Allele", "Number of", "-----", " Pos  MHC  Peptide Core", "\r"])
def test_lines_that_are_no_rows(line):
    assert parse_line(line, "stdout")[0] == "other"
    assert parse_line(line, "csv")[0] == "other" or line.strip().startswith("Pos")


def test_header_in_csv():
    assert kind("Pos,MHC,Peptide,Core") == ("other", None)


@pytest.mark.parametrize(
    ("line", "layout", "why"),
    [
        (None, "csv", "null_line"),
        (CSV[:40], "csv", "wrong_columns:8"),
        (CSV.replace('"gel ""5"" band"', '"gel "5" band"'), "csv", "broken_quoting"),
        (CSV.replace('"gel ""5"" band"', '"open'), "csv", "broken_quoting"),
        (CSV.replace('"gel ""5"" band"', 'mid"quote'), "csv", "broken_quoting"),
        (CSV.replace('"gel ""5"" band"', ""), "csv", "bad_value:Identity"),
        (CSV.replace("SB", "XB"), "csv", "bad_value:BindLevel"),
        (CSV.replace("A*02:01", "A0201"), "csv", "bad_value:MHC"),
        (CSV.replace("120.5", "0"), "csv", "bad_value:Aff(nM)"),
        (CSV.replace("120.5", "1e999"), "csv", "bad_value:Aff(nM)"),
        (CSV.replace(",0.5,", ",1.5,"), "csv", "bad_value:Score_EL"),
        (CSV.replace("1.2", "nan"), "csv", "bad_value:%Rank_EL"),
        ("0" + CSV[1:], "csv", "bad_value:Pos"),
        (CSV + "\n" + CSV, "csv", "several_records"),
        (OUT + " 7", "stdout", "wrong_columns:17"),
        (OUT + " <= SB <= SB", "stdout", "wrong_columns:20"),
        (OUT + " <= sb", "stdout", "bad_value:BindLevel"),
        (OUT, None, "unknown_layout"),
        ("x" * 500_000, "csv", "wrong_columns:1"),
    ],
)
def test_rejects(line, layout, why):
    assert kind(line, layout) == ("reject", why)


def test_assembly_keeps_quoted_line_breaks():
    assert list(assemble_records(['a,"b', 'c",d', "e"])) == ['a,"b\nc",d', "e"]
    assert list(assemble_records(['a,"b'])) == ['a,"b']


def test_frame_with_clashing_columns_and_repeats(spark):
    rows = [(1, CSV, "csv", " sb ", "x"), (1, CSV, "csv", " sb ", "x"), (2, CSV, "csv", "none", "y"), (3, None, "csv", None, None), (4, "", None, "SB", "z")]
    df = spark.createDataFrame(rows, "record_id int, raw string, layout string, bind_level string, reason string")
    got = sorted((r["record_id"], r["kind"], r["reason"]) for r in load_with_rejects(df, keep=["record_id"]).collect())
    assert got == sorted([(1, "row", None), (1, "row", None), (2, "reject", "bad_bind_level"), (3, "reject", "null_line"), (4, "other", None)], key=lambda r: (r[0], r[1]))
    assert load_with_rejects(df.limit(0), keep=["record_id"]).count() == 0


GOOD = '1,HLA-A*02:01,AAAAAAAAA,AAAAAAAAA,0,0,0,0,0,AAAAAAAAA,"{}",0.9,0.1,0.5,1.0,50.0,SB'


@pytest.mark.parametrize("odd", ["\x0b", "\x0c", "\x1c", "\x85", "\u2028", "\u2029", "\r"])
def test_only_line_feeds_part_records(odd):
    kind, why, fields = predictor_lines.parse_line(GOOD.format(f"id{odd}x"), "csv")
    assert (kind, why) == ("row", None) and fields[10] == f"id{odd}x"
    assert predictor_lines.parse_line(GOOD.replace('"', "").format(f"id{odd}x"), "csv")[0] == "row"


def test_files_are_assembled_over_physical_lines(spark, tmp_path):
    lines = ["Pos,MHC,Peptide", GOOD.format("two\nlines"), GOOD.format("x").replace("HLA-A", "HLA-Z"), 'a stray " quote', *[GOOD.format(i) for i in range(4)], GOOD.format("a,b")]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "a" / "empty.csv").write_text("")
    got = predictor_lines.read_with_rejects(spark, str(tmp_path / "a"), "csv", most_lines=3).orderBy("line_no").collect()
    assert [(r["line_no"], r["kind"]) for r in got] == [(1, "other"), (2, "row"), (4, "reject"), (5, "reject"), *[(k, "row") for k in range(6, 11)]]
    assert got[1]["identity"] == "two\nlines" and got[2]["reason"] == "bad_value:MHC" and got[3]["reason"] == "broken_quoting" and got[-1]["identity"] == "a,b"
    assert list(predictor_lines.assemble_records(['a "', "b", 'c"', "d"])) == ['a "\nb\nc"', "d"]
    assert list(predictor_lines.assemble_records(['a "', "b"], 5)) == ['a "', "b"]
