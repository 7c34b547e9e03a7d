"""Column expressions on short sequences. All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The alphabet, the padding and the code of an unknown letter.
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"
PAD, UNKNOWN = 0, 21


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def letters(c: Column | str) -> Column:
    """Array of the letters; the empty text gives an empty array."""
    return F.filter(F.split(_c(c), ""), lambda x: x != "")


def is_valid(c: Column | str, alphabet: str = AMINO_ACIDS) -> Column:
    return _c(c).rlike(rf"^[{alphabet}]+\z")


def mismatches(a: Column | str, b: Column | str) -> Column:
    """Differing places of two texts of one length."""
    a, b = _c(a), _c(b)
    return F.aggregate(F.sequence(F.lit(1), F.length(a)), F.lit(0), lambda s, i: s + (F.substring(a, i, 1) != F.substring(b, i, 1)).cast("int"))


def hamming(a: Column | str, b: Column | str) -> Column:
    """Differing places; of unequal lengths, the greater length."""
    a, b = _c(a), _c(b)
    n = F.length(a)
    return F.when(n != F.length(b), F.greatest(n, F.length(b))).when(n == 0, 0).otherwise(mismatches(a, b))


def hamming_identity(a: Column | str, b: Column | str) -> Column:
    """Share of equal places; 0 for unequal lengths, 1 for two empty texts."""
    a, b = _c(a), _c(b)
    n = F.length(a)
    return F.when(n != F.length(b), F.lit(0.0)).when(n == 0, F.lit(1.0)).otherwise(F.lit(1.0) - mismatches(a, b) / n)


def within(a: Column | str, b: Column | str, most: int | Column) -> Column:
    """Whether two texts of one length differ in at most ``most`` places."""
    a, b = _c(a), _c(b)
    return (F.length(a) == F.length(b)) & (hamming(a, b) <= most)


def encode(c: Column | str, length: int, alphabet: str = AMINO_ACIDS) -> Column:
    """Array of ``length`` integers: place in the alphabet from 1, UNKNOWN for other letters, PAD after the end."""
    t = F.upper(F.substring(_c(c), 1, length))
    table = F.create_map(*[v for i, a in enumerate(alphabet, 1) for v in (F.lit(a), F.lit(i))])
    known = F.transform(letters(t), lambda x: F.coalesce(F.try_element_at(table, x), F.lit(UNKNOWN)))
    return F.concat(known, F.array_repeat(F.lit(PAD), F.lit(length) - F.size(known)))


def length_mask(c: Column | str, length: int) -> Column:
    """Array of ``length`` booleans, true within the text."""
    n = F.length(_c(c))
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: i < n)


def substitute(c: Column | str, position: Column | str, letter: Column | str) -> Column:
    """The text with the letter at a place, counted from 1, replaced."""
    return F.overlay(_c(c), _c(letter), _c(position), F.lit(1))


def mosaic(a: Column | str, b: Column | str, mask: Column | str) -> Column:
    """Letters of ``a`` where the bit of the place (from 0) is set in ``mask``, else of ``b``."""
    mask = _c(mask)
    pick = F.zip_with(letters(a), letters(b), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    return F.array_join(F.transform(pick, lambda p, i: F.when(F.pmod(F.floor(mask / F.pow(F.lit(2.0), i)), F.lit(2)) == 1, p["x"]).otherwise(p["y"])), "")


def windows(c: Column | str, length: int | Column) -> Column:
    """Array of all windows of a length; empty if the text is shorter."""
    c = _c(c)
    length = F.lit(length) if isinstance(length, int) else length
    n = F.length(c) - length + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(c, i, length))).otherwise(F.array().cast("array<string>"))


def try_number(c: Column | str) -> Column:
    """Double or null."""
    return _c(c).try_cast("double")


def half_even(c: Column | str, digits: int = 0) -> Column:
    """Round half to even, as ``bround`` does."""
    return F.bround(_c(c), digits)
