"""Order by file position (A10, S2): the row order of the files themselves as a column.

Parquet rows know their file and their index in it.  Files are taken in order of
their path and each gets the number of rows before it; that table has one
row a file.  The position is a plain column, so "first" is an
aggregation and the positional cut a comparison: no sort of the rows, no key needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shopcast.operators.ordering import few_rows


def read_positioned(spark: SparkSession, path: str, columns: Sequence[str] | None = None, out: str = "row_position") -> DataFrame:
    """Parquet rows with their position from 0 in the order of files (by path) and rows."""
    rows = spark.read.parquet(path)
    if out in rows.columns:
        raise ValueError(f"the table already has a column {out}")
    placed = rows.select(*[f"`{c}`" for c in (columns or rows.columns)], F.col("_metadata.file_path").alias("_file"),
                         F.col("_metadata.row_index").alias("_index"))
    sizes = rows.select(F.col("_metadata.file_path").alias("_of")).groupBy("_of").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_of", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")).checkpoint(eager=True)
    joined = placed.join(few_rows(offsets), F.col("_file") == F.col("_of"))
    return joined.withColumn(out, F.col("_before") + F.col("_index")).drop("_file", "_index", "_of", "_before")


def first_in_order(df: DataFrame, keys: Sequence[str], values: Sequence[str], position: str = "row_position") -> DataFrame:
    """A10: per key the first non-null value of each column in file order; one aggregation, partial on the map side."""
    def first(c: str):
        return F.min_by(c, F.when(F.col(c).isNotNull(), F.col(position)))
    return df.groupBy(*keys).agg(*[first(c).alias(f"first_{c}") for c in values])


def positional_split(df: DataFrame, frac: float = 0.8, position: str = "row_position", out: str = "split") -> DataFrame:
    """S2 as the original has it: the first int(frac * n) rows of the file are train."""
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return df.withColumn(out, F.when(F.col(position) < F.floor(n * F.lit(frac)), "train").otherwise("test"))
