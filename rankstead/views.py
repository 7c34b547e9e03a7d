"""The SQL surface: tables, queries and functions by name in ``spark.sql``."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import SparkSession

from rankstead.plans import catalogue


def register_tables(spark: SparkSession, d: str) -> list[str]:
    """A temporary view for each parquet table of a folder, under the table's name; returns the names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(d)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    names = sorted(str(f.getPath().getName()).removesuffix(".parquet") for f in files if str(f.getPath().getName()).endswith(".parquet"))
    for n in names:
        spark.read.parquet(os.path.join(d, f"{n}.parquet")).createOrReplaceTempView(n)
    return names


def register_queries(spark: SparkSession, d: str, names: Iterable[str]) -> None:
    """A temporary view for each named query over the tables of a folder. Its plan is built now, its rows when they are asked for."""
    for n in names:
        catalogue.QUERIES[n](spark, d).createOrReplaceTempView(n)


#: Functions of sequences and keys as SQL expressions, with their arguments and result.
FUNCTIONS = {
    "hamming": ("a STRING, b STRING", "INT", "CASE WHEN length(a) <> length(b) THEN greatest(length(a), length(b)) WHEN length(a) = 0 THEN 0 ELSE aggregate(sequence(1, length(a)), 0, (s, i) -> s + CAST(substring(a, i, 1) <> substring(b, i, 1) AS INT)) END"),
    "is_sequence": ("s STRING", "BOOLEAN", "s RLIKE '^[ACDEFGHIKLMNPQRSTVWY]+$'"),
    "substitute_letter": ("s STRING, place INT, letter STRING", "STRING", "overlay(s PLACING letter FROM place FOR 1)"),
    "slug_of_key": ("k STRING", "STRING", "lower(regexp_replace(k, '[-*:]', '_'))"),
    "key_of_slug": ("s STRING", "STRING", "CASE WHEN size(split(lower(s), '_')) = 4 THEN concat('HLA-', upper(split(s, '_')[1]), '*', split(s, '_')[2], ':', split(s, '_')[3]) END"),
    "entropy_gate": ("x DOUBLE", "DOUBLE", "1 + least(greatest(1 / (1 + exp(-x)), 1e-6D), 1 - 1e-6D) * log2(least(greatest(1 / (1 + exp(-x)), 1e-6D), 1 - 1e-6D)) + (1 - least(greatest(1 / (1 + exp(-x)), 1e-6D), 1 - 1e-6D)) * log2(1 - least(greatest(1 / (1 + exp(-x)), 1e-6D), 1 - 1e-6D))"),
}


def register_functions(spark: SparkSession) -> list[str]:
    """Temporary SQL functions; the optimiser puts their expressions in place, so that no row leaves the JVM."""
    for name, (args, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
