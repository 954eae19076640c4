"""IO2, IO3, IO6, IO8: CSV source with missing-value tokens, split parquet sink,
metrics JSON, model registry.

Written tables go under the session's checkpoint location (a shared folder on a
cluster), never a machine-local temp dir.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopcast.functions.cleaning import NA_TOKENS, na_to_null


def read_csv(spark: SparkSession, path: str, schema: T.StructType,
             na_tokens: Sequence[str] = NA_TOKENS) -> DataFrame:
    """IO2: header CSV with an explicit all-string schema; NA tokens -> null.

    Typing happens afterwards with the coercing parsers (C1, C2), so a bad
    value gives null instead of failing the job.
    """
    df = spark.read.option("header", True).option("mode", "PERMISSIVE").schema(schema).csv(path)
    return df.select([na_to_null(F.col(f.name), na_tokens).alias(f.name)
                      if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in schema.fields])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_split_parquet(df: DataFrame, path: str, split_col: str = "split") -> None:
    """IO3/IO4: one table, label kept as a column, partitioned by split."""
    df.write.mode("overwrite").partitionBy(split_col).parquet(path)


def read_split(spark: SparkSession, path: str, split: str | None = None, split_col: str = "split") -> DataFrame:
    """Read back; a split filter prunes partitions at planning time."""
    df = spark.read.parquet(path)
    return df.filter(F.col(split_col) == split) if split is not None else df


def write_metrics_json(metrics: DataFrame, path: str) -> None:
    """IO6: metrics record(s) as JSON lines."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


def model_status(spark: SparkSession, model_root: str, expected: Sequence[str]) -> DataFrame:
    """IO8: which expected model bundles exist under ``model_root``.

    Bundles are folders of files; the public ``binaryFile`` source lists the
    files (distributed, no content read), the first path segment below the
    root names the bundle, and the expected list left-joins the distinct names.
    """
    root = model_root.rstrip("/")
    try:
        files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
                 .select("path"))
        found = (files.select(F.regexp_extract("path", r"^.*?" + _re_escape(root.split(":", 1)[-1]) + r"/([^/]+)/", 1)
                              .alias("model"))
                      .filter(F.col("model") != "").distinct())
    except AnalysisException as e:      # a missing root means no bundle exists; anything else is an error
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], "model string")
    exp = spark.createDataFrame([(e,) for e in expected], "model string")
    return (exp.join(found.withColumn("present", F.lit(True)), "model", "left")
               .select("model", F.coalesce("present", F.lit(False)).alias("present")))


def _re_escape(text: str) -> str:
    import re
    return re.escape(text)


def missing_models(status: DataFrame) -> DataFrame:
    return status.filter(~F.col("present")).select("model")
