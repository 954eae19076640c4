"""Exact dedup against plain grouping: groups over many shards, ties, nulls, repeated rows, clashing columns."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from shopcast.llm import exact_dedup as X


def plain(rows, best):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    return {hashlib.sha256(t.encode()).hexdigest(): (best([i for i in ids if i is not None], default=None), len(ids)) for t, ids in groups.items()}


def rows_of(seed=1):
    random.seed(seed)
    texts = ["", None, "a", "x" * 300, "x" * 300 + "y", "x" * 31, "x" * 32, "é" * 40_000] + ["hot"] * 20
    return [(random.choice([None, *range(60)]), random.choice(texts)) for _ in range(400)]


@pytest.mark.parametrize("keep, shards", [("largest", 1), ("largest", 40), ("smallest", 7), ("smallest", 40)])
def test_matches_plain_groups(spark, keep, shards):
    rows = rows_of()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("shard", "run", "head", "keep", "n")})
    got = X.exact_duplicates(df, keep=keep, shards=shards).collect()
    want = plain(rows, max if keep == "largest" else min)
    assert len(got) == len(rows) and {r["text_sha256"]: (r["keep_id"], r["group_size"]) for r in got} == want
    assert {(r["text_sha256"], r["keep_id"], r["group_size"]) for r in got} == {(h, *v) for h, v in want.items()}
    kept = [(r["text_sha256"], r["doc_id"]) for r in got if r["kept"]]
    assert sorted(kept, key=str) == sorted(((h, v[0]) for h, v in want.items()), key=str)      # one row a group, repeated ids too


def test_a_hot_text_spans_shards(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    keys = X.splitters(df, F.struct(F.substring(F.col("text").cast("binary"), 1, 32).alias("head"), "doc_id"), F.lit(1.0), 30)
    assert keys.count("aG90") > 6                                       # base64 of "hot"
    got = X.exact_duplicates(df, shards=30).filter(F.col("doc_id") % 3 == 0).select("keep_id", "group_size").distinct().collect()
    assert [tuple(r) for r in got] == [(0, 1000)]


def test_rows_kept_whole_and_normalised(spark):
    df = spark.createDataFrame([("b", "One", 1), ("a", "one", 2), ("c", "two", 3)], "k string, body string, row int")
    out = X.deduplicate(df, "k", "body", normalise=F.lower)
    assert out.columns == df.columns and sorted(map(tuple, out.collect())) == [("a", "one", 2), ("c", "two", 3)]


def test_nothing_and_wrong_arguments(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert X.exact_duplicates(empty).columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"] and X.exact_duplicates(empty).count() == 0
    with pytest.raises(ValueError):
        X.exact_duplicates(empty, keep="any")
    with pytest.raises(TypeError):
        X.exact_duplicates(empty.withColumn("doc_id", F.lit(1.5)))


def test_text_goes_through_one_shuffle_and_no_python(spark):
    plan = X.exact_duplicates(spark.createDataFrame(rows_of(), "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
