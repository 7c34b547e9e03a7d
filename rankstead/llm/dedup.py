"""Duplicates hidden by formatting: one record per canonical form, with the number of its copies.

1. Byte-identical rows are collapsed with their counts (map-side combine, so a row repeated a billion times is cheap).
2. Only the distinct survivors are canonicalised.
3. They are grouped again on the full canonical text, and the counts are summed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankstead.operators.skew import cut_lineage, lookup_skew_safe


def canonical_text(c: Column | str) -> Column:
    """Letters and digits only, in lower case. Null stays null; a text without letters or digits becomes empty."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def canonical_bag(columns: list[str]) -> Column:
    """The canonical texts of ``columns`` in sorted order, so that it doesn't matter which column holds which value.

    Nulls take part (as null entries, sorted last): a row with a null agrees only with rows that have as many.
    """
    return F.array_sort(F.array(*[canonical_text(c) for c in columns]))


def _as_compared(df: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` with -0.0 as 0.0, which grouping takes for equal but other ways of comparing do not."""
    floats = [f.name for f in df.schema.fields if f.name in columns and isinstance(f.dataType, T.DoubleType | T.FloatType)]
    return df.withColumns({c: F.when(F.col(c) == 0, F.lit(0.0).cast(df.schema[c].dataType)).otherwise(F.col(c)) for c in floats}) if floats else df


def raw_groups(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """Distinct rows over ``columns`` with ``n_raw`` (copies equal in every character) and ``raw_first`` (least id)."""
    slim = _as_compared(df.select(*columns, F.col(id_col).alias("_id")), columns)
    return slim.groupBy(*columns).agg(F.count(F.lit(1)).alias("n_raw"), F.min("_id").alias("raw_first"))


def collapse(df: DataFrame, id_col: str, text_columns: list[str], exact_columns: list[str] = ()) -> DataFrame:
    """One record per class of copies: ``first_id``, ``n_copies`` (rows), ``n_spellings`` and the columns as first written.

    Rows are copies if their ``text_columns`` agree as a bag of canonical texts and their ``exact_columns`` agree as they
    are (null with null, NaN with NaN). Empty tables give an empty result; columns not named are not read, so clashing
    extra columns do no harm.
    """
    columns = [*text_columns, *exact_columns]
    survivors = raw_groups(df, id_col, columns).withColumn("_bag", canonical_bag(text_columns))
    return (
        survivors.groupBy("_bag", *[F.col(c).alias(f"_x_{c}") for c in exact_columns])
        .agg(F.min("raw_first").alias("first_id"), F.sum("n_raw").alias("n_copies"), F.count(F.lit(1)).alias("n_spellings"), F.min_by(F.struct(*columns), "raw_first").alias("_as"))
        .select("first_id", "n_copies", "n_spellings", "_as.*")
    )


def copies(df: DataFrame, id_col: str, text_columns: list[str], exact_columns: list[str] = ()) -> DataFrame:
    """``first_id`` and ``copy_id`` of every row that has a copy with a smaller id, each such row once.

    A survivor of step 1 that is not the first of its canonical class is a copy by its own ``raw_first``; the other rows
    of byte-identical groups are found by going back to the table for those groups only. Both ways back go by the
    texts' 128-bit digests, so that keys have one small size. They are joins from rows to a table with unique
    keys whose row counts are known, so hot keys are told apart and broadcast
    (:func:`rankstead.operators.skew.lookup_skew_safe`) and a class may hold any share of the rows.
    """
    columns = [*text_columns, *exact_columns]
    own = raw_groups(df, id_col, columns).withColumns(_digest("_raw", columns) | {"_bag": canonical_bag(text_columns)})
    survivors = cut_lineage(own.select(*RAW, "_bag", *exact_columns, "n_raw", "raw_first").withColumns(_digest("_class", ["_bag", *exact_columns])))
    # Only classes of several spellings need a first that isn't their own; digests stand for texts that were grouped in full.
    classes = survivors.groupBy("_bag", *exact_columns, *CLASS).agg(F.min("raw_first").alias("first_id"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    keyed = survivors.select(*RAW, *CLASS, "n_raw", "raw_first")
    placed = lookup_skew_safe(keyed, cut_lineage(classes.select(*CLASS, "first_id", "_n")), CLASS, "_n", "left")
    placed = cut_lineage(placed.select(*RAW, "n_raw", "raw_first", F.coalesce("first_id", "raw_first").alias("first_id")).filter("raw_first <> first_id OR n_raw > 1"))
    respelt = placed.filter("raw_first <> first_id").select("first_id", F.col("raw_first").alias("copy_id"))
    rows = _as_compared(df.select(F.col(id_col).alias("copy_id"), *columns), columns).withColumns(_digest("_raw", columns)).select("copy_id", *RAW)
    again = lookup_skew_safe(rows, placed.filter("n_raw > 1"), RAW, "n_raw").filter("copy_id <> raw_first").select("first_id", "copy_id")
    return respelt.unionByName(again)


RAW, CLASS = ["_raw0", "_raw1"], ["_class0", "_class1"]


def _digest(name: str, columns: list[str]) -> dict[str, Column]:
    """128-bit digest of ``columns`` as two numbers, nulls and borders told apart; 10^12 texts clash with a chance near 10^-15."""
    values = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    return {f"{name}{i}": F.xxhash64(F.lit(seed), *values) for i, seed in enumerate((1, 0x9E3779B97F4A7C15 - (1 << 64)))}
