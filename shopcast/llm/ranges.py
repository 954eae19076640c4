"""Range shards from sampled splitters: every row gets the number of splitters at or below its key.

Spark's own range partitioner does not tell the plan where its bounds lie; a
shard column does.  Rows dealt by it can be compared with their neighbours
without another exchange, and a group of equals that is larger than a shard
spans several, because keys end in a row's own id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def default_shards(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def splitters(rows: DataFrame, key: Column, weight: Column, shards: int, per_shard: int = 32, seed: int = 11) -> str:
    """JSON array of at most ``shards - 1`` keys in order that cut the rows into shards of about equal weight.

    ``key`` is a struct of strings, integers, booleans and binaries (or arrays of them).  About ``per_shard`` keys a shard are sampled;
    they are sorted in one task, which the sample bounds.  Only the splitters reach the driver.
    """
    n = rows.count()
    fraction = min(1.0, shards * per_shard / max(1, n))
    some = rows.sample(fraction, seed) if fraction < 1 else rows
    keyed = some.select(key.alias("key"), weight.cast("double").alias("w"))
    along = Window.orderBy("key")
    placed = keyed.select("key", "w", F.sum("w").over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
                          F.sum("w").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    shard = F.floor((F.col("upto") - F.col("w") / 2) / F.col("total") * shards)
    firsts = placed.groupBy(shard.alias("shard")).agg(F.min("key").alias("key")).filter("shard > 0")
    return firsts.agg(F.to_json(F.sort_array(F.collect_set("key"))).alias("keys")).first()["keys"]


def shard_of(key: Column, key_type: str, keys: str, n_keys: int) -> Column:
    """The number of splitters (``keys``, JSON) that are at most ``key``, by binary search."""
    if not n_keys:
        return F.lit(0)
    table = F.from_json(F.lit(keys), f"array<{key_type}>")

    def step(at: Column, _: Column) -> Column:
        middle = F.shiftright(at["low"] + at["high"], 1)
        below = F.get(table, middle) <= key
        return F.when(at["low"] >= at["high"], at).otherwise(F.struct(
            F.when(below, middle + 1).otherwise(at["low"]).alias("low"), F.when(below, at["high"]).otherwise(middle).alias("high")))
    start = F.struct(F.lit(0).alias("low"), F.lit(n_keys).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(n_keys.bit_length())), start, step)["low"]
