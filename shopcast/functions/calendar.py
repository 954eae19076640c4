"""Calendar features T1-T4 (Monday = 0 day of week, ISO week number)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_of_week(c: Column | str) -> Column:
    """Monday = 0 .. Sunday = 6 (``weekday``, not ``dayofweek``)."""
    return F.weekday(c)


def calendar_columns(date_col: str, prefix: str = "") -> dict[str, Column]:
    """T1-T4 as a mapping for ``withColumns``."""
    d = F.col(date_col)
    dow = F.weekday(d)
    return {
        f"{prefix}day_of_week": dow,
        f"{prefix}month": F.month(d),
        f"{prefix}week_of_year": F.weekofyear(d),
        f"{prefix}is_weekend": (dow >= 5).cast("int"),
    }
