"""Global order without a single task: running totals and order statistics.

A window with no ``partitionBy`` moves every row to one task.  Here global
order comes from Spark's own range partitioning: rows are ranged over the key,
each partition gets its running sums, and the totals of the partitions before it
(a table of one row per partition) are added.  One path serves all sizes and
every orderable key type; NaN sorts above all numbers, as in Spark.

Positions (``rows_at``) are narrowed first: ``percentile_approx`` brackets the
position of every class in one aggregation, rows below the bracket collapse to
one count, and only keys inside it are ordered.  Nothing is looked up on the
driver, so cut values keep their type and no time zone enters.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tables of at most this many counted rows may be broadcast.
BROADCAST_ROWS = 100_000
#: Bytes of a text key that are searched for a prefix common to all rows.
PREFIX_BYTES = 4096


def running_totals(df: DataFrame, key: str, value_cols: Sequence[str], prefix: str = "cum_",
                   classes: Sequence[str] = ()) -> DataFrame:
    """Add ``cum_<v>`` = sum of v over all rows (of the class) with key <= this row's key.

    Ties share the same total.  Rows with a null key are dropped.
    """
    cls = list(classes)
    ranged = (df.filter(F.col(key).isNotNull()).repartitionByRange(*cls, key)
                .withColumn("_part", F.spark_partition_id()).checkpoint(eager=True))
    per_part = ranged.groupBy(*cls, "_part").agg(*[F.sum(c).alias(c) for c in value_cols])
    before = Window.partitionBy(*cls).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select(*[F.col(c).alias(f"_c_{c}") for c in cls], F.col("_part").alias("_p"), *[
        F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_off_{c}") for c in value_cols])
    same = F.col("_part") == F.col("_p")
    for c in cls:
        same = same & F.col(c).eqNullSafe(F.col(f"_c_{c}"))
    inner = Window.partitionBy(*cls, "_part").orderBy(key).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    out = ranged.withColumns({f"_in_{c}": F.sum(c).over(inner) for c in value_cols}).join(offsets, same)
    return (out.withColumns({f"{prefix}{c}": F.col(f"_in_{c}") + F.col(f"_off_{c}") for c in value_cols})
               .drop("_part", "_p", *[f"_c_{c}" for c in cls], *[f"_in_{c}" for c in value_cols],
                     *[f"_off_{c}" for c in value_cols]))


def common_prefix(df: DataFrame, key: str) -> int:
    """Bytes that all text keys begin with (of the first PREFIX_BYTES): those of the least and the greatest; one aggregation."""
    head = F.substring(F.col(key).cast("binary"), 1, PREFIX_BYTES)
    ends = df.agg(F.min(head).alias("least"), F.max(head).alias("greatest")).first()
    return 0 if ends["least"] is None else len(os.path.commonprefix([bytes(ends["least"]), bytes(ends["greatest"])]))


def sort_number(col: Column, dtype: T.DataType, skip: int = 0) -> Column:
    """A double that never decreases when the key increases; null and NaN are NaN, above all.

    Of texts it is six bytes, after ``skip`` bytes that all keys share.
    """
    if isinstance(dtype, (T.DateType,)):
        num = F.unix_date(col).cast("double")
    elif isinstance(dtype, T.TimestampType):
        num = F.unix_micros(col).cast("double")
    elif isinstance(dtype, T.TimestampNTZType):      # calendar fields: no zone enters
        num = (F.unix_date(F.to_date(col)) * 86400 + F.hour(col) * 3600 + F.minute(col) * 60 + F.second(col)).cast("double")
    elif isinstance(dtype, (T.StringType, T.BinaryType)):
        head = F.hex(F.substring(col.cast("binary"), skip + 1, 6))
        num = F.conv(F.rpad(head, 12, "0"), 16, 10).cast("double")
    elif isinstance(dtype, (T.NumericType, T.BooleanType)):
        num = col.cast("double")
    else:
        raise TypeError(f"order key of type {dtype.simpleString()} is not supported")
    return F.coalesce(num, F.lit(float("nan")))


def order_key(keys: Sequence[str]) -> Column:
    """Comparable struct of the keys, nulls last."""
    return F.struct(*[x for i, k in enumerate(keys) for x in (F.col(k).isNull().alias(f"n{i}"), F.col(k).alias(f"k{i}"))])


def few_rows(df: DataFrame) -> DataFrame:
    """The (materialised) table, marked for broadcast if its counted rows are few."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def rows_at(df: DataFrame, classes: Sequence[str], keys: Sequence[str], fraction: float,
            first: Callable[[Column], Column], last: Callable[[Column], Column] | None = None,
            slack: float = 3e-4) -> DataFrame:
    """Per class: n and the ``order_key`` structs at sorted 0-based positions first(n) and last(n).

    Both positions lie near ``fraction`` * n, which steers the bracket; if a
    bracket misses, it is widened, so the result is exact.  A position outside
    0..n-1 gives null.  The input is read twice (three times with text keys, whose
    common prefix is left out of the bracket) and none of its rows are shuffled,
    only counts per key inside the bracket.
    """
    last = last or first
    names = [f"_class{i}" for i in range(max(1, len(classes)))]
    given = [F.col(c) for c in classes] or [F.lit(0)]
    kind = df.schema[keys[0]].dataType
    skip = common_prefix(df, keys[0]) if isinstance(kind, (T.StringType, T.BinaryType)) else 0
    rows = df.select(*[c.alias(x) for c, x in zip(given, names, strict=True)], order_key(keys).alias("_key"),
                     sort_number(F.col(keys[0]), kind, skip).alias("_num"))
    while True:
        small = F.col("n") * slack < 3      # a bracket of a few ranks would miss by rounding: all keys of the class
        sides = F.array(F.lit(max(0.0, fraction - slack)), F.lit(min(1.0, fraction + slack)))
        stats = (rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("_num", sides, 10000).alias("q"))
                 .select(*[F.col(x).alias(f"{x}s") for x in names], "n",
                         F.when(F.lit(fraction - slack <= 0) | small, F.lit(float("-inf"))).otherwise(F.col("q")[0]).alias("_lo"),
                         F.when(F.lit(fraction + slack >= 1) | small, F.lit(float("nan"))).otherwise(F.col("q")[1]).alias("_hi"))
                 .checkpoint(eager=True))
        same = F.lit(True)
        for x in names:
            same = same & F.col(x).eqNullSafe(F.col(f"{x}s"))
        near = rows.join(few_rows(stats), same).filter(F.col("_num") <= F.col("_hi"))
        inside = F.when(F.col("_num") >= F.col("_lo"), F.col("_key"))
        counts = (near.groupBy(*names, inside.isNotNull().alias("_in"), inside.alias("_key"))
                  .agg(F.count(F.lit(1)).alias("_n"), F.first("n").alias("n"))
                  .withColumn("_order", F.struct("_in", "_key")))
        ranked = running_totals(counts, "_order", ["_n"], classes=names).withColumn("_from", F.col("cum__n") - F.col("_n"))

        def at(pos: Column) -> Column:
            here = (F.col("_from") <= pos) & (pos < F.col("cum__n"))
            return F.max(F.when(here & F.col("_in"), F.col("_key")))
        n = F.col("n")
        found = ranked.groupBy(*names).agg(F.max("n").alias("n"), at(first(n)).alias("first"), at(last(n)).alias("last")).checkpoint(eager=True)
        missed = F.lit(False)
        for pos, name in ((first(n), "first"), (last(n), "last")):
            missed = missed | (pos.between(0, n - 1) & F.col(name).isNull())
        if slack >= 1 or found.filter(missed).isEmpty():
            return found.select(*[F.col(x).alias(c) for x, c in zip(names, classes, strict=False)], "n", "first", "last")
        slack *= 16
