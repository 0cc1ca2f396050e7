"""String helpers as Column expressions (no Python UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented letters and their plain forms (Spanish alphabet).
ACCENTED = "áéíóúüñÁÉÍÓÚÜÑàèìòùÀÈÌÒÙ"
PLAIN = "aeiouunAEIOUUNaeiouAEIOU"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_accents(col) -> Column:
    """Replace accented letters by their plain forms."""
    return F.translate(_c(col), ACCENTED, PLAIN)


def title_case(col) -> Column:
    """Python ``str.title`` semantics: upper-case a letter that follows a
    non-letter (start, space, hyphen, apostrophe, digit), lower-case the rest.
    Spark's ``initcap`` only capitalises after whitespace, so we walk the
    characters with a higher-order function."""
    chars = F.split(_c(col), "")
    # CASE branches are lazy: the previous character is read only for i > 0
    return F.array_join(F.transform(
        chars,
        lambda ch, i: F.when(i == 0, F.upper(ch))
        .when(~F.element_at(chars, i).rlike(r"^\p{L}$"), F.upper(ch))
        .otherwise(F.lower(ch))), "")


def feature_label(col) -> Column:
    """Column name -> display text: '_' -> ' ' then title case."""
    return title_case(F.regexp_replace(_c(col), "_", " "))


def round_half_even_str(col) -> Column:
    """Python's ``f"{x:.0f}"``: half-even rounding, no separators."""
    return F.bround(_c(col), 0).cast("bigint").cast("string")
