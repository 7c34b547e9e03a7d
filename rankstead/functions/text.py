"""Column expressions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stripped(c: Column | str) -> Column:
    """Text without white space around it; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def folded(c: Column | str) -> Column:
    """Text in capitals without white space around it; null stays null."""
    return F.upper(stripped(c))
