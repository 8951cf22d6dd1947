"""Column-level helpers shared by the operators (all JVM-side expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Python ``str.strip()``: remove every leading/trailing whitespace run
    (``trim`` only removes spaces)."""
    return F.regexp_replace(col_(c), r"^\s+|\s+$", "")


def money(c) -> Column:
    """Cast to the exact money type used before any SUM."""
    return col_(c).cast(MONEY)


def to_double(c) -> Column:
    return col_(c).cast("double")


def ratio(num, den) -> Column:
    """num / den as double; NULL (not an error under ANSI) when den is 0."""
    return F.try_divide(col_(num).cast("double"), col_(den).cast("double"))


def round_half_up_money(num, den, scale: int = 2) -> Column:
    """Exact ``round(num / den, scale)`` on decimals (half-up), as double."""
    return F.round(F.try_divide(col_(num).cast("decimal(38,2)"), col_(den)), scale).cast("double")


def fmt_fixed(c, digits: int) -> Column:
    """``%.{digits}f`` of a value, rounded half-up on an exact decimal so that
    cents never go through binary floating point (plain notation)."""
    return col_(c).cast(f"decimal(38,{digits})").cast("string")


def fmt_or_na(c, digits: int) -> Column:
    return F.coalesce(fmt_fixed(c, digits), F.lit("n/a"))


def words(c) -> Column:
    """Split on whitespace runs, dropping the empty words that a leading or
    trailing run produces (Python ``str.split()``)."""
    return F.filter(F.split(col_(c), r"\s+"), lambda w: w != "")


def terms(c) -> Column:
    """Letter-run terms of lower-cased text, used by every ranking operator."""
    return F.regexp_extract_all(F.lower(col_(c)), F.lit(r"\p{L}+"), 0)
