"""Loading predictor output lines: valid rows come out typed, all others with the reason why they were set apart.

Records are assembled quote-aware, each is parsed by Python's strict ``csv`` reader (``csv`` layout) or split at blanks
(``stdout`` layout) inside ``mapInArrow`` (the DataFrame form of ``mapPartitions``), and structural errors are told apart
from field errors, because the structure is checked before any field is given a type.
"""

from __future__ import annotations

import csv
import math
import re
import sys
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The columns of the predictor's output, and the letters and levels it uses.
FIELDS = ["Pos", "MHC", "Peptide", "Core", "Of", "Gp", "Gl", "Ip", "Il", "Icore", "Identity", "Score_EL", "%Rank_EL", "Score_BA", "%Rank_BA", "Aff(nM)"]
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"
LEVELS = ("SB", "WB")
NOT_ROWS = ("#", "Protein", "Number")

ROW_SCHEMA = T.StructType(
    [T.StructField("pos", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in ("mhc", "peptide", "core")]
    + [T.StructField(n, T.LongType()) for n in ("of", "gp", "gl", "ip", "il")]
    + [T.StructField(n, T.StringType()) for n in ("icore", "identity")]
    + [T.StructField(n, T.DoubleType()) for n in ("score_el", "rank_el", "score_ba", "rank_ba", "aff_nm")]
    + [T.StructField("level", T.StringType())]
)
PARSED = T.StructType([T.StructField("kind", T.StringType()), T.StructField("reason", T.StringType()), *ROW_SCHEMA.fields])

_INTEGER = re.compile(r"[0-9]+")
_NUMBER = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")
_MHC = re.compile(r"HLA-[ABC]\*[0-9]{2}:[0-9]{2,3}")
_PEPTIDE = re.compile(f"[{AMINO_ACIDS}]{{8,14}}")
_CORE = re.compile(f"[{AMINO_ACIDS}-]{{9}}")
_QUOTES_IN_PLACE = re.compile(r'(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*')
_BLANKS = re.compile(r"[ \t]+")
_PHYSICAL = re.compile(r"[^\n]*\n|[^\n]+")
_MARKS = [chr(x) for x in range(0xE000, 0xF8FF)]

csv.field_size_limit(sys.maxsize)  # a damaged line may run to any length


class Rejected(ValueError):
    """A line that is no valid row; the message is the reason."""


def assemble_records(lines: Iterable[str], most_lines: int | None = None) -> Iterator[str]:
    """Join physical lines while a double quote is open, so that a line break inside quotes stays in its record.

    A quote left open at the end yields what was gathered; the parser then names the reason. With ``most_lines``, a record
    that is still open after so many lines has a stray quote: its first line stands alone, and assembly goes on with the
    next, so that one damaged line doesn't swallow the rest of a file.
    """
    source, again = iter(lines), []
    held: list[str] = []
    is_open = False
    while True:
        line = again.pop() if again else next(source, None)
        if line is None:
            if not held:
                return
            if most_lines is None:
                yield "\n".join(held)
                return
        else:
            held.append(line)
            if line.count('"') % 2:
                is_open = not is_open
            if not is_open:
                yield "\n".join(held)
                held = []
                continue
            if most_lines is None or len(held) < most_lines:
                continue
        yield held[0]
        again += reversed(held[1:])
        held, is_open = [], False


def _integer(text: str, least: int, name: str) -> int:
    if not _INTEGER.fullmatch(text) or len(text) > 18 or (value := int(text)) < least:
        raise Rejected(f"bad_value:{name}")
    return value


def _number(text: str, most: float, name: str) -> float:
    if not _NUMBER.fullmatch(text):
        raise Rejected(f"bad_value:{name}")
    value = float(text)
    if not math.isfinite(value) or not 0 <= value <= most:
        raise Rejected(f"bad_value:{name}")
    return value


def _pattern(pattern: re.Pattern, text: str, name: str) -> str:
    if not pattern.fullmatch(text):
        raise Rejected(f"bad_value:{name}")
    return text


def _typed(f: list[str], level: str | None) -> tuple:
    if not f[10]:
        raise Rejected("bad_value:Identity")
    row = (
        _integer(f[0], 1, "Pos"),
        _pattern(_MHC, f[1], "MHC"),
        _pattern(_PEPTIDE, f[2], "Peptide"),
        _pattern(_CORE, f[3], "Core"),
        *[_integer(f[i], 0, FIELDS[i]) for i in range(4, 9)],
        _pattern(_PEPTIDE, f[9], "Icore"),
        f[10],
        _number(f[11], 1, FIELDS[11]),
        _number(f[12], 100, FIELDS[12]),
        _number(f[13], 1, FIELDS[13]),
        _number(f[14], 100, FIELDS[14]),
        _number(f[15], sys.float_info.max, FIELDS[15]),
    )
    if row[-1] <= 0:
        raise Rejected("bad_value:Aff(nM)")
    return (*row, level)


def _csv_fields(line: str) -> list[str]:
    records = list(assemble_records(line.split("\n")))
    if len(records) > 1:
        raise Rejected("several_records")
    mark = next(x for x in _MARKS if x not in line)  # a carriage return inside a line is a letter like any other
    try:
        got = [[x.replace(mark, "\r") for x in r] for r in csv.reader(_PHYSICAL.findall(line.replace("\r", mark)), strict=True)]
    except csv.Error as e:
        raise Rejected("broken_quoting" if '"' in line else f"unreadable:{e}") from e
    if len(got) != 1:
        raise Rejected("several_records")
    if not _QUOTES_IN_PLACE.fullmatch(line):  # the strict reader lets a quote pass inside an unquoted field
        raise Rejected("broken_quoting")
    return got[0]


def parse_line(raw: str | None, layout: str | None) -> tuple[str, str | None, tuple | None]:
    """``(kind, reason, fields)`` of one line: kind is ``row``, ``other`` (no row: comments, headers ...) or ``reject``.

    Null lines are rejects (``null_line``), blank ones ``other``. A carriage return at the end and blanks around the line
    do not count. A layout other than ``csv`` or ``stdout`` is a reject unless the line is no row.
    """
    if raw is None:
        return "reject", "null_line", None
    line = raw.rstrip("\r\n \t").lstrip(" \t")
    if not line or line.startswith(NOT_ROWS) or not line.strip("-"):
        return "other", None, None
    try:
        if layout == "csv":
            fields = _csv_fields(line)
            if [x.strip() for x in fields[:3]] == FIELDS[:3]:
                return "other", None, None
            if len(fields) != 17:
                raise Rejected(f"wrong_columns:{len(fields)}")
            level = fields.pop()
            if level not in ("", *LEVELS):
                raise Rejected("bad_value:BindLevel")
        elif layout == "stdout":
            fields = _BLANKS.split(line)
            if fields[:3] == FIELDS[:3]:
                return "other", None, None
            level = ""
            if len(fields) == 18 and fields[16] == "<=":
                level = fields[17]
                if level not in LEVELS:
                    raise Rejected("bad_value:BindLevel")
                fields = fields[:16]
            if len(fields) != 16:
                raise Rejected(f"wrong_columns:{len(fields)}")
        else:
            raise Rejected("unknown_layout")
        return "row", None, _typed(fields, level or None)
    except Rejected as e:
        return "reject", str(e), None


def load_with_rejects(df: DataFrame, raw: str = "raw", layout: str = "layout", bind_level: str | None = "bind_level", keep: list[str] = ()) -> DataFrame:
    """Every input row with ``kind``, ``reason`` and the typed fields (null unless ``kind`` is ``row``).

    ``keep`` names the input columns to carry along; clashes with the added columns are the caller's to rename. A row
    whose ``bind_level`` column holds something other than null, SB or WB (case and blanks aside) is a reject with reason
    ``bad_bind_level``, unless its line already is one. One pass, no shuffle; any number of rejects. Empty tables give an
    empty result. Repeated rows are all kept.
    """
    extra = [F.col(bind_level)] if bind_level else [F.lit(None).cast("string")]
    slim = df.select(*keep, F.col(raw).alias("_raw"), F.col(layout).alias("_layout"), *[c.alias("_level") for c in extra])
    kept = [f for f in slim.schema.fields if f.name in keep]
    schema = T.StructType([*kept, *PARSED.fields])
    n_fields = len(ROW_SCHEMA.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = (None,) * n_fields
        for b in batches:
            names = b.schema.names
            out: list[tuple] = []
            for r, lay, lev in zip(b.column(names.index("_raw")).to_pylist(), b.column(names.index("_layout")).to_pylist(), b.column(names.index("_level")).to_pylist(), strict=True):
                kind, why, fields = parse_line(r, lay)
                if kind != "reject" and lev is not None and lev.strip().upper() not in LEVELS:
                    kind, why, fields = "reject", "bad_bind_level", None
                out.append((kind, why, *(fields or empty)))
            cols = list(zip(*out, strict=True)) if out else [()] * (n_fields + 2)
            arrays = [b.column(names.index(f.name)) for f in kept]
            arrays += [pa.array(c, type=_ARROW[f.dataType.typeName()]) for c, f in zip(cols, PARSED.fields, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema.fields])

    return slim.mapInArrow(run, schema)


#: Physical lines that a record of a file may span.
MOST_LINES = 50


def read_with_rejects(spark: SparkSession, path: str, layout: str, most_lines: int = MOST_LINES) -> DataFrame:
    """Files of predictor output, any number below ``path``: every record with ``path``, ``line_no`` (its first physical line,
    from 1), ``kind``, ``reason`` and the typed fields.

    In the ``csv`` layout, records are assembled over physical lines in ``mapInArrow``; see :func:`assemble_records` for stray
    quotes. A file is read by one task, as its lines depend on each other; predictors write a file per run.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("line_no", T.LongType()), *PARSED.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty, kinds = (None,) * len(ROW_SCHEMA.fields), [_ARROW[f.dataType.typeName()] for f in schema.fields]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=schema.names)

        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                lines = content.decode("utf-8", "replace").split("\n")
                if lines[-1] == "":
                    lines.pop()
                out, at = [], 1
                for record in assemble_records(lines, most_lines) if layout == "csv" else lines:
                    kind, why, fields = parse_line(record, layout)
                    out.append((name, at, kind, why, *(fields or empty)))
                    at += record.count("\n") + 1
                    if len(out) == 10_000:
                        yield batch(out)
                        out = []
                if out:
                    yield batch(out)

    return files.mapInArrow(run, schema)


_ARROW = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
