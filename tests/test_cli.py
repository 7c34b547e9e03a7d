from rankstead import cli


def test_commands(spark, tmp_path):
    rows = [("a", "AAAAAAAA", 1, 0.9), ("a", "AAAAAAAC", 0, 0.1), ("b", "CCCCCCCC", 1, 0.2)]
    spark.createDataFrame(rows, "allele string, peptide string, label int, score double").write.parquet(str(tmp_path / "in"))
    cli.main(["cluster", str(tmp_path / "in"), str(tmp_path / "c")])
    assert {r["cluster"] for r in spark.read.parquet(str(tmp_path / "c")).collect()} == {0, 1}
    cli.main(["evaluate", str(tmp_path / "in"), str(tmp_path / "e")])
    assert spark.read.parquet(str(tmp_path / "e")).first()["auroc"] == 1.0
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.txt").write_text("Pos MHC Peptide\n1 HLA-A*02:01 AAAA\n")
    cli.main(["parse", str(tmp_path / "t"), str(tmp_path / "p")])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1
