"""Frequency of every distinct term by a range-partitioned external sort and run-length scans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankstead.operators.skew import tasks_for


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each entry but the first differs from the one before it; null equals null."""
    now, before = column.slice(1), column.slice(0, len(column) - 1)
    differ = pc.fill_null(pc.not_equal(now, before), False)
    return pc.or_(differ, pc.xor(pc.is_null(now), pc.is_null(before))).to_numpy(zero_copy_only=False)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal terms in one partition sorted by term and record: term, occurrences, records; a run may span batches."""
    held: list | None = None  # term, occurrences, records, last record
    names = ["term", "n_occurrences", "n_records"]

    def one(run: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([run[0]], pa.string()), pa.array([run[1]], pa.int64()), pa.array([run[2]], pa.int64())], names=names)

    for b in batches:
        n = b.num_rows
        if not n:
            continue
        terms, records = b.column(0), b.column(1)
        new_term = _changes(terms)
        starts = np.concatenate(([0], np.flatnonzero(new_term) + 1))
        fresh = np.concatenate(([1], new_term | _changes(records))).astype(np.int64)  # the first row of each term and record
        occurrences, distinct = np.diff(np.concatenate((starts, [n]))), np.add.reduceat(fresh, starts)
        runs = terms.take(pa.array(starts))
        if held:
            if held[0] == runs[0].as_py():
                distinct[0] += held[2] - (held[3] == records[0].as_py())
                occurrences[0] += held[1]
            else:
                yield one(held)
        k = len(starts) - 1  # the last run may go on in the next batch
        if k:
            yield pa.RecordBatch.from_arrays([runs.slice(0, k), pa.array(occurrences[:k]), pa.array(distinct[:k])], names=names)
        held = [runs[k].as_py(), int(occurrences[k]), int(distinct[k]), records[n - 1].as_py()]
    if held:
        yield one(held)


def term_frequencies(pairs: DataFrame, term: str, record: str) -> DataFrame:
    """``term``, ``n_occurrences``, ``n_records`` of every distinct non-null term of (term, record) ``pairs``.

    The pairs are range-partitioned and sorted by term and record, so that a term that stands in a third of all records is
    spread over many partitions while equal pairs stay together. Each partition is scanned once, which counts occurrences
    and distinct records of every run. A run that goes on in another partition is added up with its other parts at the
    end, when there is but one row per term and partition. There are as many partitions as the inputs' size asks for. An
    empty table gives an empty result; the empty text is a term; null records count as one.
    """
    slim = pairs.filter(F.col(term).isNotNull()).select(F.col(term).alias("_t"), F.col(record).alias("_r"))
    runs = slim.repartitionByRange(tasks_for(pairs), "_t", "_r").sortWithinPartitions("_t", "_r").mapInArrow(_scan, "term string, n_occurrences bigint, n_records bigint")
    return runs.groupBy("term").agg(F.sum("n_occurrences").alias("n_occurrences"), F.sum("n_records").alias("n_records"))


def explode_terms(df: DataFrame, record: str, text: str, pattern: str = r"[\p{L}\p{N}]+") -> DataFrame:
    """(term, record) pairs of the words of a text, in lower case. Null and empty texts give none."""
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(f"({pattern})"), 1)
    return df.select(F.explode(words).alias("term"), F.col(record).alias("record"))


def marked(frequencies: DataFrame, rare_upto: int, common_from: int) -> DataFrame:
    """Add ``mark``: ``rare`` up to that many records, ``common`` from that many, else null."""
    mark: Column = F.when(F.col("n_records") <= rare_upto, "rare").when(F.col("n_records") >= common_from, "common")
    return frequencies.withColumn("mark", mark)
