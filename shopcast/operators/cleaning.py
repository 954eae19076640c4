"""DataFrame-level cleaning: C3, C10-C12, C15, C17-C19.

Scalars such as the latest date travel as scalar subqueries (``df.scalar()``):
Spark computes them in a separate small job and inlines the value, so no
broadcast cross join and no driver round trip are needed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def drop_required_nulls(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop rows with a null in any of ``cols``."""
    return df.dropna(subset=list(cols))


def drop_null_rows(df: DataFrame, col: str) -> DataFrame:
    """Keep rows where ``col`` (e.g. a window result) is not null."""
    return df.filter(F.col(col).isNotNull())


def drop_if_present(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop the listed columns that exist (absent ones are ignored)."""
    return df.drop(*[c for c in cols if c in df.columns])


def with_constants(df: DataFrame, constants: Mapping[str, object]) -> DataFrame:
    """Constant columns for fields the data lacks (folded by Catalyst)."""
    return df.withColumns({k: F.lit(v) for k, v in constants.items()})


def trim_incomplete_future(df: DataFrame, date_col: str = "date", days: int = 7,
                           dates_from: DataFrame | None = None) -> DataFrame:
    """Keep rows up to max(date) - ``days`` (the last days have no full future).

    ``dates_from`` may name a cheaper frame with the same dates (e.g. the table
    before its window columns) so the scalar subquery does not recompute them.
    """
    latest = (dates_from if dates_from is not None else df).select(F.max(date_col)).scalar()
    return df.filter(F.col(date_col) <= F.date_sub(latest, days))


def align_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """C17: exactly the columns of ``schema`` in its order; absent -> typed null."""
    have = set(df.columns)
    return df.select([
        (F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schema.fields
    ])


def apply_defaults(df: DataFrame, defaults: Mapping[str, object],
                   types: Mapping[str, str] | None = None) -> DataFrame:
    """Fill null or absent fields with their defaults."""
    types = types or {}
    cols = {}
    for name, value in defaults.items():
        lit = F.lit(value)
        if name in types:
            lit = lit.cast(types[name])
        cols[name] = F.coalesce(F.col(name), lit) if name in df.columns else lit
    return df.withColumns(cols)


def error_list(required: Sequence[str], types: Mapping[str, str] | None = None) -> Column:
    """Array of error codes, empty when the row is valid.

    ``missing:<field>`` for a null required field, ``type:<field>`` for a value
    that its type in ``types`` cannot take (an integral type takes no fraction).
    """
    missing = [F.when(F.col(c).isNull(), F.lit(f"missing:{c}")) for c in required]
    wrong = [F.when(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull(), F.lit(f"type:{c}")) for c, t in (types or {}).items()]
    return F.array_compact(F.array(*missing, *wrong))


def validate_split(df: DataFrame, required: Sequence[str],
                   types: Mapping[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid rows, typed if ``types`` is given; rejected rows with an ``errors`` array).

    Both sides come from one projection; Spark evaluates it per branch, no
    shuffle involved.
    """
    tagged = df.withColumn("errors", error_list(required, types))
    ok = tagged.filter(F.size("errors") == 0).drop("errors")
    if types:
        ok = ok.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})
    return ok, tagged.filter(F.size("errors") > 0)
