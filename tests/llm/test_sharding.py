"""The hash tree against a plain descent; the law, slots and edge rows."""

import hashlib
import math
import zlib

import pytest
from pyspark.sql import functions as F

from shopcast.llm import sharding


def draw(key, name, weight):
    digest = hashlib.md5(f"{name}|{'' if key is None else key}".encode()).hexdigest()
    return -math.log((int(digest[:13], 16) + 0.5) / 2 ** 52) / weight


def descend(key, tree):
    total = lambda x: sum(total(v) for v in x.values()) if isinstance(x, dict) else x
    region = min(tree, key=lambda r: draw(key, r, total(tree[r])))
    rack = min(tree[region], key=lambda k: draw(key, f"{region}/{k}", total(tree[region][k])))
    shards = tree[region][rack]
    return min(shards, key=lambda s: draw(key, f"{region}/{rack}/{s}", shards[s]))


def test_place_matches_a_plain_descent(spark):
    tree = {"a": {"x": {0: 1.0, 1: 3.0}, "y": {2: 2.0}}, "b": {"x": {3: 4.0}, "z": {4: 0.5, 5: 0.5}}}
    got = sharding.place(spark.range(2000).select(F.col("id").alias("k"), F.lit(1).alias("_region")), "k", tree).collect()
    assert all(r["shard"] == descend(r["k"], tree) for r in got)
    share = sum(r["shard"] in (0, 1, 2) for r in got) / 2000
    assert abs(share - 6 / 11) < 0.05


def test_a_weight_moves_rows_only_through_its_subtree(spark):
    tree = {"a": {"x": {0: 1.0, 1: 1.0}, "y": {2: 1.0}}, "b": {"x": {3: 1.0, 4: 1.0}}}
    heavier = {"a": {"x": {0: 1.0, 1: 2.0}, "y": {2: 1.0}}, "b": tree["b"]}
    df = spark.range(3000).withColumnRenamed("id", "k")
    both = sharding.place(sharding.place(df, "k", tree, "before"), "k", heavier, "after").filter("before <> after").collect()
    assert both and all(r["after"] in (0, 1, 2) for r in both)            # into region a, none into region b
    assert all(r["after"] in (0, 1) for r in both if r["before"] in (0, 1, 2))   # within region a: into rack x


def test_one_more_shard_takes_rows_only_into_itself(spark):
    df = spark.range(4000).withColumnRenamed("id", "k")
    for n, base in ((40, sharding.BASE), (41, sharding.BASE), (1, (1, 1, 1)), (7, (2, 1, 2))):
        before, after = sharding.numbered_tree(n, base), sharding.numbered_tree(n + 1, base)
        grown = sharding.place(sharding.place(df, "k", before), "k", after, "grown")
        assert grown.filter(f"grown <> shard and grown <> {n}").count() == 0
        assert grown.filter(f"grown = {n}").count() > 0
    with pytest.raises(ValueError):
        sharding.numbered_tree(39)


def test_documents(spark):
    rows = [(i, f"text é {i}") for i in range(300)] + [(None, None), (5, "twice"), (5, "twice"), (7, ""), (8, "x" * 200000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash")).withColumn("_row", F.lit(0))
    got = sharding.shard_documents(docs, 40).collect()
    assert len(got) == len(rows)
    want = sorted((d if d is not None else -1, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["size"], r["text_crc32"]) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append((r["slot"], r["doc_id"] if r["doc_id"] is not None else -1))
        assert r["shard"] == descend(r["doc_id"], sharding.numbered_tree(40)) and r["grown_shard"] in (r["shard"], 40)
    for slots in by.values():
        assert [s for s, _ in sorted(slots)] == list(range(len(slots)))
        assert [d for _, d in sorted(slots)] == sorted(d for _, d in slots)
    assert sharding.shard_documents(docs.limit(0), 40).count() == 0
