"""Cleaning and scalar expressions.

All of them are built-in expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# Text that a CSV reader of the reference's stack reads as missing.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_timestamp(c: ColumnOrName, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Text -> timestamp, unparsable -> null (never raises)."""
    col = _c(c)
    return F.try_to_timestamp(F.trim(col.cast("string")), F.lit(fmt))


def parse_number(c: ColumnOrName) -> Column:
    """Text -> double after trim; blanks, junk and NaN -> null."""
    d = F.trim(_c(c).cast("string")).try_cast("double")
    return F.nanvl(d, F.lit(None).cast("double"))


def na_to_null(c: ColumnOrName, tokens: Iterable[str] = NA_TOKENS) -> Column:
    """Map the missing-value tokens of a CSV field to null (IO2)."""
    col = _c(c)
    return F.when(col.isin(list(tokens)), F.lit(None).cast("string")).otherwise(col)


def fill_text(c: ColumnOrName, value: str = "") -> Column:
    """C4: null text -> constant."""
    return F.coalesce(_c(c).cast("string"), F.lit(value))


def fill_id(c: ColumnOrName, value: int = -1) -> Column:
    """C4: null id -> -1, then integral; text with a fraction is truncated, integers stay exact above 2^53."""
    col = _c(c)
    return F.coalesce(col.try_cast("long"), col.try_cast("double").try_cast("long"), F.lit(value).cast("long"))


def is_cancelled(invoice_no: ColumnOrName, quantity: ColumnOrName) -> Column:
    """Cancelled when the invoice starts with 'C' or the quantity is negative."""
    starts = F.coalesce(_c(invoice_no).cast("string").startswith("C"), F.lit(False))
    return starts | F.coalesce(_c(quantity) < 0, F.lit(False))


def floor_day(c: ColumnOrName) -> Column:
    """Timestamp -> calendar day."""
    return F.to_date(_c(c))


def equals_flag(c: ColumnOrName, value: str) -> Column:
    """1 when the column equals ``value``, else 0 (null -> 0)."""
    return F.coalesce((_c(c) == F.lit(value)).cast("int"), F.lit(0))


def map_binary(c: ColumnOrName, positive: str = "Yes", negative: str = "No",
               strict: bool = True) -> Column:
    """Two-valued text -> 1/0.  Unmapped values raise (strict) or give null."""
    col = _c(c)
    other = (F.raise_error(F.concat(F.lit("unmapped label value: "), F.coalesce(col, F.lit("null"))))
             if strict else F.lit(None))
    return (F.when(col == positive, F.lit(1))
             .when(col == negative, F.lit(0))
             .otherwise(other.cast("int")))


def contains_ci(c: ColumnOrName, needle: str) -> Column:
    """Case-insensitive substring test, null -> false."""
    return F.coalesce(F.lower(_c(c)).contains(needle.lower()), F.lit(False))


def clip(c: ColumnOrName, lo: float | None = None, hi: float | None = None) -> Column:
    """T5: clip to [lo, hi]."""
    col = _c(c)
    if lo is not None:
        col = F.greatest(col, F.lit(lo))
    if hi is not None:
        col = F.least(col, F.lit(hi))
    return col


def round4(c: ColumnOrName) -> Column:
    """Round to 4 digits."""
    return F.round(_c(c), 4)


def money_mean(c: ColumnOrName, scale: int = 2) -> Column:
    """Mean of a money column, summed exactly as decimal(18, scale) (one long a value).

    A double sum depends on the order rows arrive in; the decimal sum does not,
    so the mean is the same double on every run and every engine.
    """
    col = _c(c)
    return F.sum(col.cast(f"decimal(18,{scale})")).cast("double") / F.count(col)
