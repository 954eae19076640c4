"""Neighbour search against brute force, and edge rows."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from shopcast.llm import ann
from shopcast.llm.common import table

KIND = "vec_id long, embedding array<float>"


def brute(rows, is_query, k):
    ok = [(i, np.array(v, np.float64)) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for q, x in ok:
        if is_query(q):
            scored = sorted((-float(np.add.accumulate(x * y)[-1]), i) for i, y in ok if i != q)[:k]
            out[q] = [(r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(v) for q, v in out.items()}


def test_recall_and_exact_scores(spark):
    df = table(spark, "/root/testdata/sf0.1", "embeddings")
    rows = [(r["vec_id"], [float(np.float32(c)) for c in r["embedding"]]) for r in df.collect()]
    want, got = brute(rows, lambda q: q % 20 == 0, 20), found(ann.nearest(df, F.col("vec_id") % 20 == 0))
    assert set(want) == set(got) and all(len(v) == 20 for v in got.values())
    recall = np.mean([len({i for _, i, _ in want[q]} & {i for _, i, _ in got[q]}) / 20 for q in want])
    assert recall >= 0.95
    exact = {(q, i): s for q, v in brute(rows, lambda q: q % 200 == 0, len(rows)).items() for _, i, s in v}
    assert all(exact[q, i] == s for q, v in got.items() if q % 200 == 0 for _, i, s in v)


def test_recall_over_many_cells(spark):
    df = table(spark, "/root/testdata/sf0.1", "embeddings")
    rows = [(r["vec_id"], [float(np.float32(c)) for c in r["embedding"]]) for r in df.collect()]
    want, got = brute(rows, lambda q: q % 40 == 0, 20), found(ann.nearest(df, F.col("vec_id") % 40 == 0, cell_rows=64))
    assert set(want) == set(got)
    assert np.mean([len({i for _, i, _ in want[q]} & {i for _, i, _ in got[q]}) / 20 for q in want]) >= 0.95


def test_small_blocks_and_hot_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(300)] + [(i, [1.0, 2.0, 0.0, 0.0, 0.0, 1.0]) for i in range(300, 500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows, lambda q: q % 20 == 0, 5)
    got = found(ann.nearest(df, F.col("vec_id") % 20 == 0, k=5, confidence=0.9999, cell_rows=20, block=16, chunk=4))
    assert [[x[:2] for x in got[q]] for q in sorted(want)] == [[x[:2] for x in want[q]] for q in sorted(want)]


def test_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (20, [1.0, 1.0]), (20, [1.0, 1.0]),
            (6, [None, 1.0]), (7, [0.5, 0.5]), (8, [1.0, 0.0]), (None, [3.0, 3.0]), (9, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, KIND).withColumn("cell", F.lit("x")).withColumn("vector", F.lit(0))
    got = sorted(tuple(r) for r in ann.nearest(df, F.col("vec_id") % 20 == 0).collect())
    assert [g[1:3] for g in got if g[0] == 0] == [(1, 8), (2, 20), (3, 20), (4, 7)]
    assert len([g for g in got if g[0] == 20]) == 8 and {g[2] for g in got if g[0] == 20} == {0, 7, 8, 20}      # the other row of id 20, not its own
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.nearest(df.filter("vec_id = 0"), F.col("vec_id") % 20 == 0).count() == 0


def test_repeated_ids_and_other_lengths(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.5, 2.0]), (20, [1.0, 0.0]), (3, [2.0, 0.0]), (4, [0.0, 1.0]), (40, [1.0, 1.0, 1.0]), (41, [3.0, 0.0, 0.0]),
            (42, [0.0, 1.0, 0.0]), (60, [1.0, 2.0, 3.0, 4.0])]
    got = [tuple(r) for r in ann.nearest(spark.createDataFrame(rows, KIND), F.col("vec_id") % 20 == 0, k=5).collect()]
    want = []
    for i, (q, v) in enumerate(rows):
        if q % 20 == 0:
            near = sorted((-sum(a * b for a, b in zip(v, w)), c) for j, (c, w) in enumerate(rows) if j != i and len(w) == len(v))
            want += [(q, n, c, -s) for n, (s, c) in enumerate(near[:5], 1)]
    assert sorted(got) == sorted(want)


def test_chi_square_quantile():
    assert abs(ann.chi_square_quantile(0.95, 8) - 15.507) < 1e-3 and abs(ann.chi_square_quantile(0.5, 2) - 1.3863) < 1e-3


def test_leaves_one_by_one_equal_a_scan():
    """Block search: with an open test every leaf counts; ties at the last place go to the smaller ids; a bound leaves out what lies behind."""
    rng = np.random.default_rng(5)
    x = rng.integers(-2, 3, (700, 6)).astype(float)
    x = np.unique(x[(x != 0).any(axis=1)], axis=0)[rng.permutation(600)]
    index = ann.build(x, float((x * x).sum(axis=1).max()), 1, 4)
    base = pd.DataFrame({"vector": list(x), "ids": [[int(i)] for i in rng.permutation(len(x))]})
    ids = np.array([i[0] for i in base["ids"]])
    at = np.arange(0, len(x), 7)
    for bound in (np.inf, 12.0):
        queries = pd.DataFrame({"vector": list(x[at]), "query_row": at, "query_id": ids[at], "bound": np.full(len(at), bound)})
        got = ann._search(base, queries, index, 9, 1e9, leaf=16)
        for i, a in enumerate(at):
            scores = x @ x[a]
            order = np.lexsort((ids, -scores))[:9]
            order = order[(x[a] @ x[a] + index.norm2 - 2 * scores[order]) <= bound + 1e-6]
            mine = got[got["query_row"] == a]
            assert [(v[0], s) for v, s in zip(mine["ids"], mine["score"], strict=True)] == [(ids[o], scores[o]) for o in order], i
            assert mine["own"].sum() == (a in order)
    assert sorted(np.concatenate(ann._leaves(x, 16)).tolist()) == list(range(len(x))) and max(map(len, ann._leaves(x, 16))) <= 16


def test_clusters_leave_leaves_out():
    """Well separated groups: most leaves fail the chi-square test, none of the nearest is lost."""
    rng = np.random.default_rng(8)
    x = np.repeat(10 * rng.standard_normal((40, 16)), 64, axis=0) + 0.05 * rng.standard_normal((2560, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = ann.build(x, 1.0, 1, 8)
    base = pd.DataFrame({"vector": list(x), "ids": [[i] for i in range(len(x))]})
    queries = pd.DataFrame({"vector": list(x[::20]), "query_row": range(0, len(x), 20), "query_id": range(0, len(x), 20), "bound": np.inf})
    seen = []
    whole, ann._products = ann._products, lambda a, b: seen.append(len(a)) or whole(a, b)
    try:
        got = ann._search(base, queries, index, 21, ann.chi_square_quantile(0.97, 8))
    finally:
        ann._products = whole
    want = np.sort(-(x[::20] @ x.T), axis=1)[:, :21]
    hits = sum((np.abs(g["score"].to_numpy() + w) < 1e-9).sum() for (_, g), w in zip(got.groupby("query_row"), want, strict=True))
    assert hits >= 0.95 * want.size and sum(seen) < 0.25 * len(queries) * len(x)
