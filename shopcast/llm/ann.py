"""Approximate nearest neighbours by inner product: stable projections under a kd-tree.

Vectors are lifted by one coordinate to equal length, so that the largest inner
product is the smallest Euclidean distance, and projected to ``dims`` Gaussian
(2-stable) coordinates: the squared projected distance over the squared
distance is chi-square with ``dims`` degrees of freedom.  A kd-tree over a
bounded sample of projections (``sample`` rows) gives cells; every vector is
indexed in its cell, cells over ``block`` rows are dealt into hashed blocks.

A query searches its own cell first.  In a task the block has a kd-tree of its
own, whose leaves come by increasing projected distance; their exact products are
verified until the chi-square test holds: with d the distance of the k-th found, a
vector projected beyond d * sqrt(q) is nearer than d with probability under
1 - ``confidence`` (q: the chi-square quantile).  That radius then selects the
further cells, searched the same way from the bound found so far.  Both rounds
are joins on (cell, block); queries are dealt so that no task holds more than one
block and ``chunk`` queries.

Equal vectors are indexed once, with their k + 1 smallest ids (more can never
be among k nearest).  Defined results: null, zero and non-finite vectors take
no part; vectors of another length are searched among their own; fewer
candidates than k give all; repeated ids are separate rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopcast.llm.common import cut


def chi_square_quantile(p: float, dims: int) -> float:
    """Quantile for an even number of degrees of freedom (finite series, bisection)."""
    half = dims // 2

    def below(x: float) -> float:
        term = total = 1.0
        for i in range(1, half):
            term *= x / 2 / i
            total += term
        return 1 - np.exp(-x / 2) * total
    low, high = 0.0, 100.0 * dims
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


@dataclass(frozen=True)
class Index:
    """Projection, lift and kd-tree (in level order: axis, split value; leaves are the cells)."""
    matrix: np.ndarray
    norm2: float
    axes: np.ndarray
    splits: np.ndarray
    levels: int

    def project(self, x: np.ndarray, query: bool) -> np.ndarray:
        lift = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.norm2 - (x * x).sum(axis=1), 0))
        return x @ self.matrix[:-1] + lift[:, None] * self.matrix[-1]

    def cell(self, y: np.ndarray) -> np.ndarray:
        node = np.zeros(len(y), np.int64)
        for _ in range(self.levels):
            node = 2 * node + 1 + (y[np.arange(len(y)), self.axes[node]] > self.splits[node])
        return node - (2 ** self.levels - 1)

    def reached(self, y: np.ndarray, radius: float) -> list[int]:
        """Cells that a ball around one projected query meets."""
        open_nodes = [(0, np.zeros(len(y)))]
        for _ in range(self.levels):
            below = []
            for node, gap in open_nodes:
                axis = self.axes[node]
                away = y[axis] - self.splits[node]
                for child, outside in ((2 * node + 1, away > 0), (2 * node + 2, away <= 0)):
                    far = gap
                    if outside:
                        far = gap.copy()
                        far[axis] = max(far[axis], abs(away))
                    if (far * far).sum() <= radius * radius:
                        below.append((child, far))
            open_nodes = below
        return [node - (2 ** self.levels - 1) for node, _ in open_nodes]


def build(sample: np.ndarray, norm2: float, cells: int, dims: int, seed: int = 11) -> Index:
    """kd-tree with the given number of cells at least, by medians of the widest axis."""
    matrix = np.random.default_rng(seed).standard_normal((sample.shape[1] + 1, dims))
    levels = max(0, int(np.ceil(np.log2(max(1, min(cells, len(sample)))))))
    blank = Index(matrix, norm2, np.zeros(0, np.int64), np.zeros(0), 0)
    y = blank.project(sample, False)
    axes, splits = np.zeros(2 ** levels - 1, np.int64), np.zeros(2 ** levels - 1)
    rows = {0: np.arange(len(y))}
    for node in range(2 ** levels - 1):
        own = y[rows.pop(node)] if len(rows[node]) else y[:1]
        axes[node] = axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
        splits[node] = np.median(own[:, axis])
        members = np.nonzero(_members(y, axes, splits, node))[0]
        right = y[members, axis] > splits[node]
        rows[2 * node + 1], rows[2 * node + 2] = members[~right], members[right]
    return Index(matrix, norm2, axes, splits, levels)


def _members(y: np.ndarray, axes: np.ndarray, splits: np.ndarray, node: int) -> np.ndarray:
    """Rows below a node."""
    keep = np.ones(len(y), bool)
    while node:
        parent, right = (node - 1) // 2, node % 2 == 0
        keep &= (y[:, axes[parent]] > splits[parent]) == right
        node = parent
    return keep


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row inner products in double precision, summed in order (equal for equal rows)."""
    return np.add.accumulate(a * b, axis=1)[:, -1]


def _leaves(y: np.ndarray, rows: int) -> list[np.ndarray]:
    """Positions by leaf of a kd-tree over one block: halves by the widest axis until a leaf has at most ``rows``."""
    open_nodes, leaves = [np.arange(len(y))], []
    while open_nodes:
        at = open_nodes.pop()
        if len(at) <= rows:
            leaves.append(np.sort(at))
            continue
        own = y[at]
        axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
        order = np.argpartition(own[:, axis], len(at) // 2)
        open_nodes += [at[order[:len(at) // 2]], at[order[len(at) // 2:]]]
    return leaves


def _merge(best: np.ndarray, which: np.ndarray, row: np.ndarray, hit: np.ndarray, score: np.ndarray) -> None:
    """Found (row, position, score) into the best of each row, in place; ties to the smaller position."""
    k = best.shape[1]
    changed = np.unique(row)
    rows = np.concatenate((np.repeat(changed, k), row))
    scores, hits = np.concatenate((best[changed].ravel(), score)), np.concatenate((which[changed].ravel(), hit))
    order = np.lexsort((hits, -scores, rows))
    rows, scores, hits = rows[order], scores[order], hits[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    kept = place < k
    best[rows[kept], place[kept]], which[rows[kept], place[kept]] = scores[kept], hits[kept]


def _search(base: pd.DataFrame, queries: pd.DataFrame, index: Index, k: int, quantile: float, leaf: int = 128) -> pd.DataFrame:
    """k nearest (distinct vectors) of each query in one block; none beyond the query's bound.

    Each query takes the leaves of the block's own kd-tree by projected distance, the next one in each
    round, until the chi-square test holds for all leaves that are left.  Queries that take the same leaf
    in a round are multiplied with it at once; what may be among the k nearest is verified by its exact product.
    """
    base = base.iloc[np.argsort([i[0] for i in base["ids"]], kind="stable")]      # ties go to the smaller position
    x, q = np.stack(base["vector"].to_numpy()), np.stack(queries["vector"].to_numpy())
    bound = queries["bound"].to_numpy(dtype=np.float64)      # squared distance of the k-th found before
    size = (q * q).sum(axis=1) + index.norm2
    slack = 1e-9 * size                                      # rounding of the products and distances
    py, qy = index.project(x, False), index.project(q, True)
    leaves = _leaves(py, leaf)
    gap = np.stack([(np.maximum(np.maximum(py[at].min(axis=0) - qy, qy - py[at].max(axis=0)), 0) ** 2).sum(axis=1) for at in leaves], axis=1)
    order = np.argsort(gap, axis=1, kind="stable")
    best = np.full((len(q), k), -np.inf)
    which = np.full((len(q), k), -1)
    active = np.arange(len(q))
    for turn in range(len(leaves)):
        within = np.minimum(bound[active], np.maximum(size[active] - 2 * best[active, -1], 0)) + slack[active]
        active = active[gap[active, order[active, turn]] <= within * quantile]
        if not len(active):
            break
        floor = np.maximum(best[:, -1], (size - bound) / 2) - slack
        taken = active[np.argsort(order[active, turn], kind="stable")]
        parts = np.split(taken, np.nonzero(np.diff(order[taken, turn]))[0] + 1)
        found = []
        for rows in parts:
            at = leaves[order[rows[0], turn]]
            i, j = np.nonzero(q[rows] @ x[at].T >= floor[rows][:, None])
            found.append((rows[i], at[j]))
        row, hit = (np.concatenate(side) for side in zip(*found, strict=True))
        if len(row):
            _merge(best, which, row, hit, _products(q[row], x[hit]))
    near_enough = size[:, None] - 2 * best <= (bound + slack)[:, None]            # what lies behind the k-th found is no answer
    row, col = np.nonzero((which >= 0) & near_enough)
    hit = which[row, col]
    same = (x[hit] == q[row]).all(axis=1)                    # the query's own vector: one of its rows is the query's
    return pd.DataFrame({"own": same, "query_row": queries["query_row"].to_numpy()[row], "query_id": queries["query_id"].to_numpy()[row],
                         "ids": base["ids"].to_numpy()[hit], "score": best[row, col]})


HITS = "query_row long, query_id long, ids array<long>, score double, own boolean"


def valid_vectors(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, vector as doubles) of the vectors that take part."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = (rows.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("vector")).filter("vec_id is not null")
            .filter(F.coalesce(finite, F.lit(False))).filter(F.exists("vector", lambda c: c != 0)))
    return kept


def nearest(rows: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = 20,
            dims: int = 8, confidence: float = 0.97, sample: int = 20000, cell_rows: int = 2048, block: int = 4096,
            chunk: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row where ``is_query`` holds (on vec_id).

    Vectors of each length are searched among their own; one index a length.
    """
    every = cut(valid_vectors(rows, vec_id, vector))
    lengths = sorted(r["n"] for r in every.select(F.size("vector").alias("n")).distinct().collect())
    found = [_nearest_of_one_length(every.filter(F.size("vector") == n), is_query, k, dims, confidence, sample, cell_rows, block, chunk)
             for n in lengths]
    nothing = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionByName, found) if found else nothing


def _nearest_of_one_length(base: DataFrame, is_query: Column, k: int, dims: int, confidence: float, sample: int, cell_rows: int, block: int,
                           chunk: int) -> DataFrame:
    """``nearest`` over valid vectors of one length, at least one."""
    # equal vectors: the k + 1 smallest ids; the rank limit trims each task's rows before they are shuffled
    by_id = Window.partitionBy("vector").orderBy("vec_id")
    distinct = cut(base.withColumn("n", F.row_number().over(by_id)).filter(F.col("n") <= k + 1)
                   .groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    facts = distinct.agg(F.count(F.lit(1)), F.max(F.aggregate("vector", F.lit(0.0), lambda a, c: a + c * c))).first()
    order = F.xxhash64("vector")
    share = min(1.0, 1.2 * sample / facts[0])
    drawn = distinct.filter(F.pmod(order, F.lit(1 << 30)) < int(share * (1 << 30))).select("vector").limit(sample).collect()
    drawn = drawn or distinct.select("vector").limit(1).collect()
    index = build(np.array([r["vector"] for r in drawn]), float(facts[1]), -(-facts[0] // cell_rows), dims)
    quantile = chi_square_quantile(confidence, dims)

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(cell=index.cell(index.project(np.stack(b["vector"].to_numpy()), False)))

    cells = distinct.mapInPandas(placed, "vector array<double>, ids array<long>, cell long")
    counts = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).select("cell", F.ceil(F.col("n") / block).alias("blocks"))
    indexed = cut(cells.join(counts, "cell").withColumn("block", F.pmod(order, F.col("blocks"))))
    queries = cut(base.filter(is_query).select(F.monotonically_increasing_id().alias("query_row"),
                                               F.col("vec_id").alias("query_id"), "vector"))

    def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                y = index.project(np.stack(b["vector"].to_numpy()), True)
                yield b.assign(cell=index.cell(y), bound=np.inf)

    def further(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                y = index.project(np.stack(b["vector"].to_numpy()), True)
                own = index.cell(y)
                reach = np.sqrt(np.minimum(b["bound"].to_numpy(), 1e300) * quantile)
                others = [[c for c in index.reached(p, r) if c != o] for p, r, o in zip(y, reach, own, strict=True)]
                yield b.assign(cell=others).explode("cell").dropna(subset=["cell"]).astype({"cell": "int64"})

    sizes = indexed.groupBy("cell", "block").count().select("cell", "block")
    shape = "query_row long, query_id long, vector array<double>, bound double, cell long"

    def searched(asked: DataFrame) -> DataFrame:
        asked = cut(asked.join(sizes, "cell"))          # a row per block of the cell
        deals = asked.groupBy("cell", "block").agg(F.ceil(F.count(F.lit(1)) / chunk).alias("deals"))
        left = asked.join(deals, ["cell", "block"]).withColumn("deal", F.pmod(F.xxhash64("query_row"), F.col("deals")))
        right = indexed.join(deals, ["cell", "block"]).withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1)))
        keys = ["cell", "block", "deal"]

        def one(b: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
            if not len(b) or not len(q):
                return pd.DataFrame({"query_row": [], "query_id": [], "ids": pd.Series([], dtype=object), "score": [], "own": pd.Series([], dtype=bool)})
            return _search(b, q, index, k + 1, quantile)
        return right.select(*keys, "vector", "ids").groupBy(*keys).cogroup(
            left.select(*[F.col(c).alias(c) for c in (*keys, "query_row", "query_id", "vector", "bound")]).groupBy(*keys)
        ).applyInPandas(one, HITS)

    def best(hits: DataFrame) -> DataFrame:
        """The k nearest single vectors of each query; only its own row is left out, not others of the same id."""
        at = F.when(F.col("own"), F.array_position("ids", F.col("query_id"))).otherwise(0).cast("int")
        others = F.when(at > 0, F.concat(F.slice("ids", F.lit(1), at - 1), F.slice("ids", at + 1, F.size("ids")))).otherwise(F.col("ids"))
        each = hits.select("query_row", "query_id", "score", F.explode(others).alias("vec_id"))
        w = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
        return each.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    first = cut(best(searched(queries.mapInPandas(home, shape))))
    kth = first.filter(F.col("rank") == k).select(F.col("query_row").alias("r"), F.col("score").alias("s"))
    size = F.aggregate("vector", F.lit(0.0), lambda a, c: a + c * c) + F.lit(float(facts[1]))
    asked = queries.join(kth, queries.query_row == kth.r, "left").select(
        "query_row", "query_id", "vector", F.coalesce(F.greatest(size - 2 * F.col("s"), F.lit(0.0)), F.lit(float("inf"))).alias("bound"))
    second = searched(asked.mapInPandas(further, shape))
    hits = first.select("query_row", "query_id", F.array("vec_id").alias("ids"), "score", F.lit(False).alias("own")).unionByName(second)
    return best(hits).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
