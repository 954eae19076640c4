"""Sharding: a hierarchical weighted hash tree over regions, racks and shards.

A key descends level by level.  Each child of the current node draws
``-ln(u) / weight`` with u hashed from the key and the child's name, and the
smallest draw wins, so shares follow the weights.  When a weight changes, keys
move only into or out of the subtree it belongs to; everything else stays.

Growth of a numbered set of shards opens a region of its own for each added
shard: the only new draw is the new region's, so rows move into the new shard
and nowhere else.  DataFrame functions only.

Defined results: a null key hashes as empty text; repeated keys share a shard;
a null text has no bytes and the crc of empty text; no rows give no rows.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopcast.llm.common import cut, fresh

#: region -> rack -> shard number -> weight
Tree = Mapping[str, Mapping[str, Mapping[int, float]]]
#: Regions, racks a region and shards a rack of the first 40 shards.
BASE = (5, 2, 4)
HEADER_BYTES = 16


def numbered_tree(shards: int, base: tuple[int, int, int] = BASE) -> dict:
    """The tree of shards 0..n-1, all of weight 1: the base layout, then one region per added shard."""
    regions, racks, each = base
    tree: dict = {}
    first = regions * racks * each
    if shards < first:
        raise ValueError(f"the base layout {base} already has {first} shards")
    for s in range(first):
        region, rest = divmod(s, racks * each)
        tree.setdefault(f"region{region}", {}).setdefault(f"rack{rest // each}", {})[s] = 1.0
    for s in range(first, shards):
        tree[f"added{s}"] = {"rack0": {s: 1.0}}
    return tree


def _draw(key: Column, name: Column, weight: Column) -> Column:
    digest = F.md5(F.concat_ws("|", name, F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2 ** 52))
    return -F.log(u) / weight


def _levels(tree: Tree) -> Column:
    """The tree as one constant: regions with racks with shards, each with its path name and weight."""
    regions = []
    for region, racks in tree.items():
        inner = []
        for rack, shards in racks.items():
            leaves = [{"name": f"{region}/{rack}/{s}", "weight": float(w), "shard": s} for s, w in shards.items() if w > 0]
            if leaves:
                inner.append({"name": f"{region}/{rack}", "weight": sum(x["weight"] for x in leaves), "shards": leaves})
        if inner:
            regions.append({"name": region, "weight": sum(x["weight"] for x in inner), "racks": inner})
    if not regions:
        raise ValueError("the tree has no shard of positive weight")
    shape = ("array<struct<name:string,weight:double,racks:array<struct<name:string,weight:double,"
             "shards:array<struct<name:string,weight:double,shard:int>>>>>>")
    return F.from_json(F.lit(json.dumps(regions)), shape)


def _descend(key: Column, children: Column) -> Column:
    drawn = F.transform(children, lambda c, i: F.struct(_draw(key, c["name"], c["weight"]).alias("d"), i.alias("i")))
    return F.get(children, F.array_min(drawn)["i"])


def place(df: DataFrame, key: str, tree: Tree, out: str = "shard") -> DataFrame:
    """Add the shard of each row: one draw per region, per rack of its region and per shard of its rack."""
    r, k = fresh(df.columns, "_region"), fresh(df.columns, "_rack")
    return (df.withColumn(r, _descend(F.col(key), _levels(tree)))
              .withColumn(k, _descend(F.col(key), F.col(f"{r}.racks")))
              .withColumn(out, _descend(F.col(key), F.col(f"{k}.shards"))["shard"])
              .drop(r, k))


def with_slots(df: DataFrame, shard: str, order: list[str], out: str = "slot") -> DataFrame:
    """Number the rows of each shard from 0 without gaps, by ``order`` (ties as they come).

    The rows are ranged over (shard, order, row id), so a shard spans as many
    partitions as its size needs and repeated keys spread.  Counts per (shard,
    partition) give each partition's offset; that table has about one row per
    partition.
    """
    rid, mark, pid = (fresh(df.columns, x) for x in ("_row", "_mark", "_part"))
    tagged = df.withColumn(rid, F.monotonically_increasing_id())
    keys = [shard, *order, rid]
    placed = cut(tagged.repartitionByRange(*keys).sortWithinPartitions(*keys)
                 .withColumn(mark, F.monotonically_increasing_id()).withColumn(pid, F.shiftright(mark, 33)))
    runs = placed.groupBy(shard, pid).agg(F.min(mark).alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(shard).orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select(shard, pid, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return (placed.join(offsets, [shard, pid]).withColumn(out, F.col(mark) + F.col("_shift"))
                  .drop(rid, mark, pid, "_shift"))


def shard_documents(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law ``key``, shard, slot and the shard under one shard more.

    The text is read once; what is materialised and shuffled is a few numbers a row.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body) + HEADER_BYTES).cast("long").alias("size"),
                         F.crc32(body.cast("binary")).alias("text_crc32"))
    placed = place(place(narrow, "doc_id", numbered_tree(shards)), "doc_id", numbered_tree(shards + 1), "grown_shard")
    numbered = with_slots(cut(placed), "shard", ["doc_id", "text_crc32", "size"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                           F.col("slot").cast("long").alias("slot"), "grown_shard")
