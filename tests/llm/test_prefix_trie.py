"""The trie against plain nested loops: hot conversations over many shards, nulls, ties, repeated rows."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from shopcast.llm import prefix_trie as X

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    """Nodes as rows, over the rebuilt conversations."""
    conv = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            digest = hashlib.sha256(f"{len(r)}:{r}{x}".encode()).digest()
            conv.setdefault(c, []).append((t is not None, t or 0, r, digest, x))
    conv = {c: [(v[2], v[4]) for v in sorted(vs)] for c, vs in conv.items()}
    new = {c: conv.get(c - c % 100, [])[:zlib.crc32(b"%d" % c) % 6] + v[zlib.crc32(b"%d" % c) % 6:] for c, v in conv.items()}
    nodes, kids, out = {}, {}, []
    for c, v in new.items():
        for d in range(len(v) + 1):
            nodes.setdefault(tuple(v[:d]), []).append(c)
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    def visit(p):
        leaves, saved = int(p not in kids), (len(nodes[p]) - 1) * (len(p[-1][1]) if p else 0)
        for k in kids.get(p, []):
            below = visit(k)
            leaves, saved = leaves + below[0], saved + below[1]
        ends = ",".join(str(c) for c in sorted(nodes[p]) if len(new[c]) == len(p))
        out.append((min(nodes[p]), len(p), min(nodes[p[:-1]]) if p else None, len(nodes[p]), len(kids.get(p, [])), leaves, saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
        return leaves, saved
    if nodes:
        visit(())
    return sorted(out, key=str)


def trie(df, **settings):
    return sorted((tuple(r) for r in X.prefix_trie(X.rebuilt(X.turn_sequences(df)), **settings).collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    random.seed(2)
    out = [(c, random.choice([t, t, t, None]), random.choice(["user", "assistant", None]), random.choice(["a", "a", "é" * 3, None]))
           for c in range(300) if c != 100 for t in range(random.choice([0, 1, 1, 2, 4, 5, 6]))]
    out += [(c, 0, "user", "hot") for c in range(1000, 1300)] + [(1001, 0, "user", "hot")] * 2
    return out + [(None, 0, "user", "x"), (2000, 0, "user", "w " * 50_000)] + [(2001, t, "user", str(t % 7)) for t in range(3000)]


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_matches_plain_loops(spark, rows, shards):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("shard", "path", "chars", "first", "h")})
    short = [r for r in rows if r[0] != 2001]                      # the plain loops recurse
    assert trie(df.filter("conv_id is null or conv_id <> 2001"), shards=shards) == plain(short)


def test_a_conversation_of_many_turns(spark, rows):
    got = X.prefix_trie(X.rebuilt(X.turn_sequences(spark.createDataFrame(rows, SCHEMA).filter("conv_id = 2001"))), shards=4)
    h = zlib.crc32(b"2001") % 6
    found = sorted((r["depth"], r["n_convs"], r["n_children"], r["saved_tokens"]) for r in got.collect())
    assert found == [(d, 1, int(d < 3000 - h), 0) for d in range(3000 - h + 1)]


def test_hot_nodes_lie_in_the_skeleton(spark):
    df = spark.range(5000).select(F.col("id").alias("conv_id"), F.array(F.struct(F.unhex(F.lit("aa")).alias("digest"), F.lit(2).cast("long").alias("chars"))).alias("turns"))
    keys = X.splitters(df.select("conv_id", F.col("turns.digest").alias("path")), F.struct("path", "conv_id"), F.lit(1.0), 20)
    assert keys.count("conv_id") > 15                               # one path, cut by id
    root, leaf = sorted(map(tuple, X.prefix_trie(df, shards=20).collect()), key=lambda r: r[1])
    ids = hashlib.sha256(",".join(map(str, range(5000))).encode()).hexdigest()
    assert root == (0, 0, None, 5000, 1, 1, 9998, X.NOTHING) and leaf == (0, 1, 0, 5000, 0, 1, 9998, ids)


def test_no_rows(spark):
    assert trie(spark.createDataFrame([], SCHEMA)) == []
    assert trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)) == []
