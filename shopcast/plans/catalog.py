"""Query catalog: name -> callable(spark, sf_dir) -> DataFrame.

Every query reads the driver tables (through the adapters) and runs on the
whole tables.  Double outputs are rounded to 6 digits so that an independent
engine, summing in another order, produces the same values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}


def query(name: str):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        return fn
    return deco


def round6(c) -> F.Column:
    """Round to 6 digits as ``round(x * 1e6) / 1e6`` on the binary value.

    ``F.round(x, 6)`` rounds the shortest decimal text of x half-up, which
    differs from binary rounding on exact ties such as 2079.5628125; scaling
    first makes both engines round the same double.
    """
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c * F.lit(1e6)) / F.lit(1e6)


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double/float column (comparison-friendly output)."""
    cols = [round6(F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
            for f in df.schema.fields]
    return df.select(cols)


# Importing the modules registers their queries.
from shopcast.plans import (queries_chains, queries_eval, queries_inputs, queries_m1, queries_ml,  # noqa: E402,F401
                            queries_prep, queries_scoring)
