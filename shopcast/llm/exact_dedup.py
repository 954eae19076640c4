"""Exact dedup by content sort.

Sampled splitters range the normalised texts into shards: first by their leading
bytes, then by a digest of all bytes, then by id, so equal texts lie next to
each other and a large group of copies spans as many shards as its size needs.
Within a shard an external sort places equals adjacent and each text is compared
in full with its neighbour; where a shard ends, its last text is compared in
full with the first one of the next shard.  Each run of equals keeps one row:
the smallest identifier, or the largest.

The text goes through one shuffle; ids, digests and run numbers are
materialised.  DataFrame functions only.

Defined results: a null text counts as empty; a null id is kept only where all
ids of its run are null; of rows equal in text and id one is kept; no rows give
no rows; other columns are not looked at.  Ids are strings or integers.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopcast.llm.common import cut
from shopcast.llm.ranges import default_shards, shard_of, splitters

HEAD_BYTES = 32


def _whole_runs(border: DataFrame, smallest: bool) -> DataFrame:
    """(shard, run, n, keep, decides) of the runs that lie in more than one shard.

    ``border`` has the first and the last run of each shard, two rows a shard at most.
    """
    runs = cut(border)
    lead = Window.orderBy("shard")
    shards = runs.select("shard").distinct().withColumn("next", F.lead("shard").over(lead)).filter("next is not null")
    ending = runs.filter("at_end").select("shard", F.col("body").alias("left"))
    opening = runs.filter("at_start").select(F.col("shard").alias("next"), F.col("body").alias("right"))
    goes_on = (shards.join(ending, "shard").join(opening, "next").filter(F.col("left") == F.col("right"))
               .select(F.col("next").alias("shard"), F.lit(1).alias("run"), F.lit(0).alias("opens")))
    along = Window.orderBy("shard", "run")
    chained = (runs.select("shard", "run", "n", "keep").distinct().join(goes_on, ["shard", "run"], "left")
               .withColumn("chain", F.sum(F.coalesce("opens", F.lit(1))).over(along.rowsBetween(Window.unboundedPreceding, 0))))
    whole, place = Window.partitionBy("chain"), F.struct("shard", "run")
    least = F.min if smallest else F.max
    return (chained.select("shard", "run", F.sum("n").over(whole).alias("whole_n"), least("keep").over(whole).alias("whole_keep"),
                           (place == least(place).over(whole)).alias("decides"), F.count(F.lit(1)).over(whole).alias("parts"))
            .filter("parts > 1").drop("parts"))


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                     normalise: Callable[[Column], Column] = lambda t: t, keep: str = "smallest",
                     columns: tuple[str, ...] = (), shards: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for every row, and ``columns`` as struct ``row`` if any are named.

    ``normalise`` is applied to the text before it is compared; ``shards`` is
    the session's number of shuffle partitions unless given.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be smallest or largest, not {keep!r}")
    id_type = docs.schema[doc_id].dataType
    if not isinstance(id_type, (T.StringType, T.IntegralType)):
        raise TypeError(f"ids of type {id_type.simpleString()} are not supported")
    smallest, spark = keep == "smallest", docs.sparkSession
    shards = shards or default_shards(spark)

    def whole(t: Column) -> Column:
        return F.coalesce(normalise(t), F.lit("")).cast("binary")
    row = [F.struct(*columns).alias("row")] if columns else []
    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *row)
    raw = whole(F.col("text"))
    rows = given.withColumns({"head": F.substring(raw, 1, HEAD_BYTES), "digest": F.unhex(F.sha2(raw, 256)), "size": F.octet_length(raw),
                              "odd": F.col("doc_id").isNull() if smallest else F.col("doc_id").isNotNull()})   # null ids lose
    key = F.struct("head", "digest", "odd", "doc_id")
    key_type = f"struct<head:binary,digest:binary,odd:boolean,doc_id:{id_type.simpleString()}>"
    mean = given.select(F.octet_length(whole(F.col("text"))).alias("size")).sample(0.01, 3).agg(F.avg("size")).first()[0] or 1000.0
    keys = splitters(rows, key, F.lit(1.0) + F.col("size") / F.lit(max(mean, 1.0)), shards)
    dealt = rows.drop("size").withColumn("shard", shard_of(key, key_type, keys, len(json.loads(keys)))).repartition(shards, "shard")

    order = Window.partitionBy("shard").orderBy("head", "digest", "odd", "doc_id")
    bodies = dealt.withColumn("body", whole(F.col("text")))
    before = F.lag("body").over(order)
    marked = bodies.withColumns({"before": before, "last": F.lead("digest").over(order).isNull()})
    opened = marked.withColumns({"first": F.col("before").isNull(), "opens": F.col("before").isNull() | (F.col("before") != F.col("body"))})
    narrow = opened.select("doc_id", "digest", "shard", "first", "last", "opens", F.when(F.col("first") | F.col("last"), F.col("body")).alias("body"),
                           F.sum(F.col("opens").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int").alias("run"),
                           F.coalesce(F.lead("opens").over(order), F.lit(True)).alias("closes"), *(["row"] if columns else []))
    run = Window.partitionBy("shard", "run")
    least = F.min if smallest else F.max
    counted = cut(narrow.withColumns({"n": F.count(F.lit(1)).over(run), "keep": least("doc_id").over(run)}))

    edges = (counted.filter("first or last").groupBy("shard", "run", "n", "keep")
             .agg(F.max("first").alias("at_start"), F.max("last").alias("at_end"), F.max("body").alias("body")))
    over = F.broadcast(_whole_runs(edges, smallest))          # at most two rows a shard
    joined = counted.join(over, ["shard", "run"], "left")
    found, mine = F.col("decides").isNotNull(), F.col("opens") if smallest else F.col("closes")
    return joined.select("doc_id", F.when(found, F.col("whole_keep")).otherwise(F.col("keep")).alias("keep_id"),
                         F.when(found, F.col("whole_n")).otherwise(F.col("n")).alias("group_size"),
                         (mine & F.coalesce("decides", F.lit(True))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
                         *(["row"] if columns else []))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The kept row of every group of equal texts, with all its columns."""
    rows = exact_duplicates(docs, doc_id, text, columns=tuple(f"`{c}`" for c in docs.columns), **settings)
    return rows.filter("kept").select("row.*")
