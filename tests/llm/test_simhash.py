"""Fingerprints and components against brute force, tiles, skewed groups and edge rows."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from shopcast.llm import simhash
from shopcast.llm.common import table
from shopcast.llm.components import components


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, distance=3):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(fps))]


def test_documents_match_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    fps = [plain_fingerprint(t) for _, t in rows]
    want = {d: (f"{f:016x}", rows[c][0]) for (d, _), f, c in zip(rows, fps, plain_components(fps), strict=True)}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == want
    kept = simhash.deduplicate(docs).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted({c for _, c in want.values()}) and kept[0].asDict().keys() == set(docs.columns)


def test_hash_is_sparks(spark):
    assert spark.sql("select xxhash64('a b c')").first()[0] == np.uint64(xxhash.xxh64_intdigest(b"a b c", 42)).astype(np.int64)


@pytest.mark.parametrize("tile", [4, 64, 2048])
def test_dense_groups_in_tiles(spark, tile):
    rng = np.random.default_rng(tile)
    centres = rng.integers(0, 2 ** 63, 4, dtype=np.uint64)
    values = {int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for c in centres for _ in range(90)}
    fps = sorted(values | {int(x) for x in rng.integers(0, 2 ** 63, 200, dtype=np.uint64)})
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {r["v"]: r["label"] for r in components(simhash.links(df, tile=tile)).collect()}
    labels = [got.get(f, f) for f in signed]
    want = plain_components(fps)
    assert len(set(zip(labels, want, strict=True))) == len(set(labels)) == len(set(want))


def test_long_chains_contract(spark):
    n = 300
    order = np.random.default_rng(1).permutation(n)
    edges = spark.createDataFrame([(int(order[i]), int(order[i + 1])) for i in range(n - 1)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r["v"]: r["label"] for r in components(edges).collect()}
    assert len({got[i] for i in range(n)}) == 1 and got[1000] == got[1001] != got[0] and len(got) == n + 2


def test_edges(spark):
    rows = [(5, None), (3, ""), (9, " \t"), (7, "one"), (8, "ONE"), (2, "same words here again"), (2, "same words here again"),
            (None, "same words here again"), (None, "alone in null " * 5), (1, "w " * 100000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("x")).withColumn("label", F.lit(1)).withColumn("key", F.lit(2))
    got = sorted(((r["doc_id"] is None, r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert [c for n, d, c in got if d in (3, 5, 9)] == [3, 3, 3] and [c for n, d, c in got if d in (7, 8)] == [7, 7]
    assert [c for n, d, c in got if n] in ([None, 2], [2, None]) and len(got) == len(rows)
    kept = simhash.deduplicate(docs).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["1", "2", "3", "7", "None"] and kept[0]["fp"] == "x"
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.deduplicate(docs.limit(0)).count() == 0


def test_unicode_fingerprints(spark):
    texts = ["Él ÉL el", "a b c d", "A\tB\nC D", "x\x1fy z", "İ k K"]
    got = [simhash.fingerprint_of(t.encode()) % (1 << 64) for t in texts]
    assert got == [plain_fingerprint(t) for t in texts]
    big = "lorem ipsum dolor sit amet " * 40
    assert simhash.fingerprint_of(big.encode(), piece=7) == simhash.fingerprint_of(big.encode())
