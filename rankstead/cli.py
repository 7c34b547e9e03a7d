"""Command line: ``python -m rankstead.cli parse|features|cluster|evaluate ...``; inputs and outputs are Spark paths."""

from __future__ import annotations

import argparse
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from rankstead.operators import metrics, select, structure
from rankstead.sources import files


@dataclass(frozen=True)
class Settings:
    """Defaults of the commands."""

    identity: float = 0.8
    peptide_chain: str = "C"
    other_chain: str = "A"
    edges: tuple[float, ...] = (0.0, 100.0, 1000.0, 1e12)
    bins: tuple[str, ...] = ("rare", "mid", "common")


def parse(spark: SparkSession, a: argparse.Namespace) -> None:
    texts = files.read_folder(spark, a.input, "*")
    rows = files.parse_predictor_blocks(texts, "path", "text")
    rows.select("path", "line_no", F.to_json("fields").alias("fields"), "bind_level", "is_binder").write.mode("overwrite").parquet(a.output)


def features(spark: SparkSession, a: argparse.Namespace) -> None:
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.pdb").text(a.input).select(F.input_file_name().alias("path"), "value")
    atoms = files.parse_pdb(lines, "path", "value")
    structure.structure_features(atoms, ["path"], a.peptide_chain, a.other_chain).write.mode("overwrite").parquet(a.output)


def cluster(spark: SparkSession, a: argparse.Namespace) -> None:
    df = spark.read.parquet(a.input)
    select.hamming_clusters(df, a.group, a.sequence, a.identity).write.mode("overwrite").parquet(a.output)


def evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    s = Settings()
    df = spark.read.parquet(a.input)
    counts = df.groupBy(a.group).agg(F.sum(F.col(a.label).cast("bigint")).alias("_n"))
    binned = df.join(counts, a.group).withColumn("stratum", metrics.assign_bins("_n", list(s.edges), list(s.bins)))
    metrics.stratified(binned, a.label, a.score, "stratum").write.mode("overwrite").parquet(a.output)


def main(argv: list[str] | None = None) -> None:
    s = Settings()
    p = argparse.ArgumentParser(prog="rankstead", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for f in (parse, features, cluster, evaluate):
        c = sub.add_parser(f.__name__)
        c.add_argument("input")
        c.add_argument("output")
        c.set_defaults(run=f)
        if f is features:
            c.add_argument("--peptide-chain", default=s.peptide_chain)
            c.add_argument("--other-chain", default=s.other_chain)
        if f in (cluster, evaluate):
            c.add_argument("--group", default="allele")
        if f is cluster:
            c.add_argument("--sequence", default="peptide")
            c.add_argument("--identity", type=float, default=s.identity)
        if f is evaluate:
            c.add_argument("--label", default="label")
            c.add_argument("--score", default="score")
    a = p.parse_args(argv)
    a.run(SparkSession.builder.appName("rankstead").getOrCreate(), a)


if __name__ == "__main__":
    main()
