"""Column expressions on allele keys and their spellings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _capitals(c: Column | str) -> Column:
    """In capitals, without white space of any kind around it."""
    return F.upper(F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", ""))


def normalize_key(c: Column | str) -> Column:
    """Permissive: any of ``A0201``, ``A*02:01``, ``HLA-A02:01`` ... to ``HLA-A*02:01``.

    Capitals, no blanks, one ``HLA-`` before it. A star goes behind the leading letters of a name of five characters or more
    that has none, and behind it, where there is no colon, four digits or more become two and two. Nothing is dropped: what
    isn't known keeps its text.
    """
    t = F.regexp_replace(F.replace(_capitals(c), F.lit(" "), F.lit("")), "^HLA-", "")
    starred = F.when(~t.contains("*") & (F.length(t) >= 5), F.regexp_replace(t, r"^(\p{L}+)", r"$1*")).otherwise(t)
    locus = F.substring_index(starred, "*", 1)
    digits = F.regexp_replace(F.substring(starred, F.length(locus) + 2, F.length(starred)), "[^0-9]", "")
    parted = F.concat(locus, F.lit("*"), F.substring(digits, 1, 2), F.lit(":"), F.substring(digits, 3, 2))
    return F.concat(F.lit("HLA-"), F.when(starred.contains("*") & ~starred.contains(":") & (F.length(digits) >= 4), parted).otherwise(starred))


def normalize_key_strict(c: Column | str) -> Column:
    """Strict: loci A, B and C only; all digits after the first two make the second field; anything else is null."""
    t = F.regexp_replace(F.regexp_replace(_capitals(c), r"^HLA-", ""), r"[*:]", "")
    ok = t.rlike(r"^[ABC][0-9]{4,}\z")
    return F.when(ok, F.concat(F.lit("HLA-"), F.substring(t, 1, 1), F.lit("*"), F.substring(t, 2, 2), F.lit(":"), F.substring(t, 4, 100)))


def extract_key(c: Column | str) -> Column:
    """The first allele found in a text, with two or three digits in the second field; null if there is none."""
    t = F.upper(_c(c))
    part = lambda i: F.regexp_extract(t, r"([ABC])\*?(\d{2}):?(\d{2,3})", i)
    return F.when(part(1) != "", F.concat(F.lit("HLA-"), part(1), F.lit("*"), part(2), F.lit(":"), part(3)))


def slug_to_key(c: Column | str) -> Column:
    """``hla_a_02_01`` to ``HLA-A*02:01``; null if the slug has other parts."""
    p = F.split(F.lower(_c(c)), "_")
    return F.when(F.size(p) == 4, F.concat(F.lit("HLA-"), F.upper(p[1]), F.lit("*"), p[2], F.lit(":"), p[3]))


def key_to_slug(c: Column | str) -> Column:
    """``HLA-A*02:01`` to ``hla_a_02_01``."""
    return F.lower(F.regexp_replace(_c(c), r"[-*:]", "_"))


def locus(c: Column | str) -> Column:
    """The letter after ``HLA-``."""
    return F.substring(_c(c), 5, 1)


def short_key(c: Column | str) -> Column:
    """``HLA-A*02:01`` to ``A0201``."""
    return F.regexp_replace(F.regexp_replace(_c(c), "^HLA-", ""), r"[*:]", "")


def predictor_key(c: Column | str, special: dict[str, str] | None = None) -> Column:
    """``HLA-A*02:01`` to ``HLA-A02:01``, the spelling that predictors take; ``special`` has the names that they spell else."""
    plain = F.regexp_replace(_c(c), r"\*", "")
    if not special:
        return plain
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in special.items() for x in pair]), _c(c)), plain)


def is_family(c: Column | str, prefix: str | None = None, pattern: str | None = None) -> Column:
    """Whether a key belongs to a family, named by a prefix or by a pattern that must match from its start; null: false."""
    k = _c(c)
    return F.coalesce(k.startswith(prefix) if prefix is not None else k.rlike(f"^(?:{pattern})"), F.lit(False))


def spellings(c: Column | str) -> Column:
    """The ways a key is written in file names, as an array, for alias joins."""
    return F.array(_c(c), key_to_slug(c), short_key(c), predictor_key(c))


def tag_label(c: Column | str, negative: tuple[str, ...] = ("decoy", "hard"), unlabelled: tuple[str, ...] = ("wt", "mut")) -> Column:
    """0 for a negative tag, null for one that carries no label, else 1."""
    return F.when(_c(c).isin(*negative), 0).when(_c(c).isin(*unlabelled), F.lit(None).cast("int")).when(_c(c).isNotNull(), 1)


def fold_name_parts(c: Column | str) -> Column:
    """``tag__slug__peptide`` of a directory name, with a time stamp at its end cut off: struct of tag, allele, peptide."""
    p = F.split(F.regexp_replace(_c(c), r"_\d{8}_\d{6}$", ""), "__")
    return F.when(F.size(p) >= 3, F.struct(p[0].alias("tag"), slug_to_key(p[1]).alias("allele"), F.upper(p[2]).alias("peptide")))


def variant_note(c: Column | str) -> Column:
    """``seedK_p<pos><aa>``: struct of seed, position, aa; a bare ``seedK`` has null position and letter."""
    n = _c(c)
    pos = F.regexp_extract(n, r"_p(\d+)([A-Z])\z", 1)
    return F.struct(
        F.nullif(F.regexp_extract(n, r"^(seed\d+)", 1), F.lit("")).alias("seed"),
        F.try_to_number(F.nullif(pos, F.lit("")), F.lit("99999")).cast("int").alias("position"),
        F.nullif(F.regexp_extract(n, r"_p(\d+)([A-Z])\z", 2), F.lit("")).alias("aa"),
    )
