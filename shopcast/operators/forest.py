"""ML3's learner: a random forest whose trees are grown whole, each by one task, and never come to the driver.

Spark's own learner grows all trees in the driver, level by level, one pass over the rows for each few nodes; with
hundreds of full-depth trees both the passes and the driver's memory grow with rows times trees.  Here

* the thresholds of each feature (at most ``maxBins - 1``) come from weighted quantiles of all rows, merged from
  summaries of the partitions;
* rows become one byte a feature, and rows that agree in all of them, in label and in weight become one row with a
  count: the sum of n Poisson(1) draws is one Poisson(n) draw, so bootstraps keep their distribution;
* the table of such rows is dealt to every group of trees; a task grows its trees one after the other, all nodes of a
  level at once, and writes them as packed rows;
* scoring deals the different test rows to the groups of trees and adds up the votes, so no task holds all trees.

Meaning of the parameters, impurity, least rows of a leaf, feature subsets of a node, merging of sibling leaves
with one prediction and votes (weighted class shares of the leaf) are those of Spark's learner.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopcast.operators.ordering import few_rows
from shopcast.session import scratch_dir

#: MB that a task may need for its copy of the table and the growth of one tree.  A larger table is left to Spark's own learner.
TASK_MB = 512
#: Points of a feature's summary, and how many are gathered before it is made that small again.
POINTS, GATHERED = 4096, 65536
#: A gain below this is rounding.
LEAST_GAIN = 1e-12

Points = tuple[np.ndarray, np.ndarray]


# Thresholds

def merged(points: Points) -> Points:
    """Different values in order, each with its whole weight."""
    values, place = np.unique(points[0], return_inverse=True)
    return values, np.bincount(place, weights=points[1], minlength=len(values))


def summary(points: Points, size: int = POINTS) -> Points:
    """Some ``size`` of the values, each with the weight from the one before it: no rank moves by more than a share of 1 / size."""
    values, weights = merged(points)
    if len(values) <= size:
        return values, weights
    sums = np.cumsum(weights)
    at = np.unique(np.append(np.searchsorted(sums, (np.arange(size) + 0.5) / size * sums[-1]), len(values) - 1).clip(0, len(values) - 1))
    return values[at], np.diff(sums[at], prepend=0.0)


def thresholds(points: Points, most: int) -> list[float]:
    """Spark's split candidates: the middles between all neighbouring values, or those nearest to equal shares of the weight."""
    values, weights = points
    if len(values) - 1 <= most:
        return ((values[:-1] + values[1:]) / 2).tolist()
    sums, out = np.cumsum(weights).tolist(), []
    stride = target = sums[-1] / (most + 1)
    for i, (before, now) in enumerate(zip(sums, sums[1:], strict=False)):
        if abs(before - target) < abs(now - target):
            out.append(float(values[i] + values[i + 1]) / 2)
            target += stride
    return out


def matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long arrays of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def feature_thresholds(df: DataFrame, features: str, weight: Column, most: int) -> list[list[float]]:
    """Thresholds of every feature: summaries of the partitions, merged a feature at a time; the driver sees a row a feature."""
    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[Points]] = []
        size = 0
        for b in batches:
            x, w = matrix(b.column("x")), b.column("w").to_numpy(zero_copy_only=False)
            held = held or [[] for _ in range(x.shape[1])]
            for i, points in enumerate(held):
                known = ~np.isnan(x[:, i])
                points.append(merged((x[known, i], w[known])))
            size += len(x)
            if size >= GATHERED:
                held = [[summary(tuple(np.concatenate(p) for p in zip(*points, strict=True)))] for points in held]
                size = 0
        for i, points in enumerate(held):
            values, weights = summary(tuple(np.concatenate(p) for p in zip(*points, strict=True)))
            yield pa.RecordBatch.from_pydict({"f": pa.array([i], pa.int32()), "v": pa.array([values.tobytes()], pa.binary()),
                                              "w": pa.array([weights.tobytes()], pa.binary())})

    def cuts(table: pa.Table) -> pa.Table:
        points = merged(tuple(np.concatenate([np.frombuffer(p) for p in table.column(c).to_pylist()]) for c in "vw"))
        return pa.table({"f": table.column("f").slice(0, 1).cast(pa.int32()), "t": pa.array([thresholds(points, most)], pa.list_(pa.float64()))})

    parts = df.select(vector_to_array(F.col(features)).alias("x"), weight.alias("w")).mapInArrow(summaries, "f int, v binary, w binary")
    found = {r["f"]: list(r["t"]) for r in parts.groupBy("f").applyInArrow(cuts, "f int, t array<double>").collect()}
    return [found[i] for i in range(len(found))]


# Rows as bytes

def bins_of(features: str, cuts: list[list[float]]) -> Column:
    """One byte a feature: the number of its thresholds below the value (all of them for NaN)."""
    at = [np.array(c, dtype=float) for c in cuts]

    @F.arrow_udf("binary")
    def cut(x: pa.Array) -> pa.Array:
        values = matrix(x)
        bins = np.empty((len(values), len(at)), dtype=np.uint8)
        for i, c in enumerate(at if len(values) else []):
            bins[:, i] = np.searchsorted(c, values[:, i])
        return rows_of_bytes(bins)

    return cut(vector_to_array(F.col(features)))


def rows_of_bytes(bins: np.ndarray) -> pa.Array:
    n, width = bins.shape
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), n, [None, pa.py_buffer(np.ascontiguousarray(bins).tobytes())]).cast(pa.binary())


def bytes_of_rows(column: pa.Array, width: int) -> np.ndarray:
    _, ends, data = column.buffers()
    if not len(column):
        return np.empty((0, width), dtype=np.uint8)
    ends = np.frombuffer(ends, dtype=np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data, dtype=np.uint8)[ends[0]:ends[-1]].reshape(-1, width)


def ordered(bins: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """The order of the rows by their bytes, then by the other columns, the same whatever order they arrive in."""
    wide = np.zeros((len(bins), -(-bins.shape[1] // 8) * 8), dtype=np.uint8)
    wide[:, :bins.shape[1]] = bins
    return np.lexsort([*more[::-1], *wide.view(">u8").T[::-1]])


# One tree

def subsets(rng: np.random.Generator, nodes: int, features: int, size: int) -> np.ndarray:
    """``size`` different features for each node (Floyd's draw)."""
    out = np.empty((nodes, size), dtype=np.int64)
    for i, top in enumerate(range(features - size, features)):
        drawn = rng.integers(0, top + 1, nodes)
        out[:, i] = np.where((out[:, :i] == drawn[:, None]).any(axis=1), top, drawn)
    return out


def firsts(x: np.ndarray) -> np.ndarray:
    """Positions where a run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.empty(0, dtype=np.int64)


class Statistics:
    """How a row's draws count: draws a class with one weight a class, or else weights a class and the draws beside them.

    Statistics are lists of arrays, one array a class (and one of draws).
    """

    def __init__(self, y: np.ndarray, w: np.ndarray, classes: int):
        least, most = np.full(classes, np.inf), np.full(classes, -np.inf)
        np.minimum.at(least, y, w)
        np.maximum.at(most, y, w)
        self.classes, self.plain = classes, bool(np.all(least >= most))
        self.scale = np.where(np.isfinite(least), least, 0.0).tolist() if self.plain else [1.0] * classes

    def of_rows(self, y: np.ndarray, w: np.ndarray, draws: np.ndarray) -> list[np.ndarray]:
        worth = draws.astype(float) if self.plain else draws * w
        out = [np.where(y == k, worth, 0.0) for k in range(self.classes)]
        return out if self.plain else [*out, draws.astype(float)]

    def draws(self, stat: list[np.ndarray]) -> np.ndarray:
        return reduce(np.add, stat) if self.plain else stat[-1]

    def weights(self, stat: list[np.ndarray]) -> list[np.ndarray]:
        return [s * k if k != 1.0 else s for s, k in zip(stat, self.scale, strict=False)]

    def purity(self, stat: list[np.ndarray]) -> np.ndarray:
        """Sum of squared weights over their sum: the more, the less impure by Gini."""
        own = self.weights(stat)
        total = reduce(np.add, own)
        squares = reduce(np.add, [x * x for x in own])
        return np.divide(squares, total, out=np.zeros_like(total), where=total > 0)


def best_cuts(node: np.ndarray, bins: np.ndarray, stat: list[np.ndarray], total: list[np.ndarray], kind: Statistics, bits: int, least: int):
    """Of each node that has an allowed cut of one feature: (node, purity of both sides, cut, statistics of the left side).

    ``node`` never decreases, a bin has ``bits`` bits.  Only bins that a node's rows have are looked at: counted densely if that is
    little beside the rows, else by sorting.
    """
    cells, key = len(total[0]) << bits, (node << bits) | bins
    if cells <= 2 * len(key):
        sums = [np.bincount(key, weights=s, minlength=cells) for s in stat]
        at = np.flatnonzero(kind.draws(sums))
        left = [np.cumsum(s.take(at)) for s in sums]
    else:
        shift = int(len(key)).bit_length()
        packed = (key << shift) | np.arange(len(key))
        packed.sort()
        seen, place = packed >> shift, packed & ((1 << shift) - 1)
        ends = np.append(np.flatnonzero(seen[1:] != seen[:-1]), len(seen) - 1)
        at, left = seen.take(ends), [np.cumsum(s.take(place)).take(ends) for s in stat]
    owner = at >> bits
    left = [x - (np.cumsum(t) - t).take(owner) for x, t in zip(left, total, strict=True)]
    here = kind.draws(left)
    allowed = np.flatnonzero((here >= least) & (kind.draws(total).take(owner) - here >= max(least, 1)))
    owner, left = owner.take(allowed), [x.take(allowed) for x in left]
    starts = firsts(owner)
    if not len(starts):
        return owner, np.empty(0), owner, left
    score = kind.purity(left) + kind.purity([np.maximum(t.take(owner) - x, 0.0) for x, t in zip(left, total, strict=True)])
    best = np.maximum.reduceat(score, starts)
    top = np.flatnonzero(score == np.repeat(best, np.diff(starts, append=len(owner))))
    top = top.take(firsts(owner.take(top)))
    return owner.take(top), best, at.take(allowed.take(top)) & ((1 << bits) - 1), [x.take(top) for x in left]


def grow(bins: np.ndarray, y: np.ndarray, w: np.ndarray, count: np.ndarray, bits: int, size: int, depth: int, least: int,
         min_gain: float, rng: np.random.Generator, kind: Statistics):
    """One tree over rows with counts: (feature, cut, first child or 0, weights a class) of its nodes, level by level.

    The second child is the next node; a row goes to the first one if its bin is at most the cut.  ``bits`` hold a bin, ``size`` is
    the number of features looked at in a node.  Rows stay in the order of their nodes, and only those of nodes that may be split are kept.
    """
    features = bins.shape[1]
    draws = rng.poisson(count)
    keep = np.flatnonzero(draws)
    x = np.zeros((len(keep), -(-features // 8) * 8), dtype=np.uint8)
    x[:, :features] = bins[keep]
    x = x.view(np.uint64)
    stat = kind.of_rows(y[keep], w[keep], draws[keep])
    nodes = [np.array([s.sum()]) for s in stat]                     # statistics of this level's nodes, open ones or not
    to = np.zeros(len(keep), dtype=np.int64)                        # this level's node of each row
    levels, made = [], 1
    for level in range(depth + 1):
        weights, n = kind.weights(nodes[:kind.classes]), len(nodes[0])
        feature, cut, child = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.uint8), np.zeros(n, dtype=np.int64)
        levels.append((feature, cut, child, np.stack(weights)))
        is_open = (kind.draws(nodes) >= 2 * least) & (reduce(np.add, [(v > 0).astype(int) for v in weights]) > 1)
        of_open = np.flatnonzero(is_open)
        m = len(of_open)
        if level == depth or not m:
            break
        number = np.full(n + 1, -1)                                 # the last one is for rows of no node
        number[of_open] = np.arange(m)
        to = number.take(to)
        stay = np.flatnonzero(to >= 0)
        shift = int(len(to)).bit_length()
        packed = (to.take(stay) << shift) | stay
        packed.sort()
        node, place = packed >> shift, packed & ((1 << shift) - 1)
        x, stat, total = x.take(place, axis=0), [s.take(place) for s in stat], [t.take(of_open) for t in nodes]
        flat = x.view(np.uint8).reshape(-1)
        at = np.arange(len(node)) * (x.shape[1] * 8)
        chosen = subsets(rng, m, features, size)
        best, best_left = np.full(m, -np.inf), [np.zeros(m) for _ in total]
        best_feature, best_cut = np.zeros(m, dtype=np.int64), np.zeros(m, dtype=np.int64)
        for own in chosen.T:
            own = np.ascontiguousarray(own)
            who, score, c, left = best_cuts(node, flat.take(at + own.take(node)), stat, total, kind, bits, least)
            more = np.flatnonzero(score > best.take(who))
            who = who.take(more)
            best[who], best_cut[who], best_feature[who] = score.take(more), c.take(more), own.take(who)
            for held, new in zip(best_left, left, strict=True):
                held[who] = new.take(more)
        whole = reduce(np.add, kind.weights(total[:kind.classes]))
        gain = (best - kind.purity(total)) / np.maximum(whole, 1e-300)
        split = np.flatnonzero((gain > LEAST_GAIN) & (gain >= min_gain))
        if not len(split):
            break
        parents = of_open.take(split)
        feature[parents], cut[parents], child[parents] = best_feature.take(split), best_cut.take(split), made + 2 * np.arange(len(split))
        nodes = [np.empty(2 * len(split)) for _ in total]
        for new, held, t in zip(nodes, best_left, total, strict=True):
            new[0::2] = held.take(split)
            new[1::2] = t.take(split) - new[0::2]
        first = np.full(m, -1)
        first[split] = 2 * np.arange(len(split))
        first = first.take(node)
        right = flat.take(at + best_feature.take(node)) > best_cut.take(node)
        to = np.where(first >= 0, first + right, -1)
        made += 2 * len(split)
    return reduced(levels)


def reduced(levels: list[tuple[np.ndarray, ...]]):
    """The nodes of all levels in one; two leaves with one parent and one prediction are merged into it, from below upwards."""
    sizes = [len(f) for f, _, _, _ in levels]
    start = np.concatenate([[0], np.cumsum(sizes)])
    feature, cut, child = (np.concatenate([lv[i] for lv in levels]) for i in range(3))
    weights = np.concatenate([lv[3] for lv in levels], axis=1)
    says = weights.argmax(axis=0)
    for a, z in zip(start[-2::-1], start[:0:-1], strict=True):
        own = np.arange(a, z)[child[a:z] > 0]
        first = child[own]
        merge = (child[first] == 0) & (child[first + 1] == 0) & (says[first] == says[first + 1])
        child[own[merge]] = 0
        says[own[merge]] = says[first[merge]]
    alive = np.zeros(len(child), dtype=bool)
    alive[0] = True
    for a, z in zip(start[:-1], start[1:], strict=True):
        first = child[a:z][alive[a:z] & (child[a:z] > 0)]
        alive[first] = alive[first + 1] = True
    number = np.cumsum(alive) - 1
    child = np.where(child > 0, number[child], 0)[alive]
    return feature[alive], cut[alive], child, weights[:, alive]


def pack_tree(tree) -> tuple[bytes, bytes, bytes, bytes]:
    """Features, cuts, and children; class shares of the leaves only, whose child is minus (their number + 1)."""
    feature, cut, child, weights = tree
    leaf = child == 0
    child = np.where(leaf, -np.cumsum(leaf), child)
    total = weights[:, leaf].sum(axis=0)
    shares = np.divide(weights[:, leaf], total, out=np.zeros_like(weights[:, leaf]), where=total > 0)
    return feature.astype("<i4").tobytes(), cut.tobytes(), child.astype("<i4").tobytes(), np.ascontiguousarray(shares.T).tobytes()


def votes(bins: np.ndarray, tree: tuple[bytes, bytes, bytes, bytes], classes: int) -> np.ndarray:
    """Class shares of the leaf that each row comes to."""
    feature, cut, child, shares = (np.frombuffer(b, dtype=d) for b, d in zip(tree, ("<i4", "u1", "<i4", "<f8"), strict=True))
    flat, width = bins.reshape(-1), bins.shape[1]
    leaf = np.zeros(len(bins), dtype=np.int64)
    rows, at = np.arange(len(bins)), np.zeros(len(bins), dtype=np.int64)
    while len(rows):
        below = child[at]
        done = below < 0
        leaf[rows[done]] = -1 - below[done]
        rows, at, below = rows[~done], at[~done], below[~done]
        at = below + (flat[rows * width + feature[at]] > cut[at])
    return shares.reshape(-1, classes)[leaf]


# The estimator and its model

#: A tree as a row: bytes of ``pack_tree``.
TREE = ("feature", "cut", "child", "shares")


def many_valued(df: DataFrame, features: str) -> bool:
    """Whether the vectors' attributes name a categorical feature of more than two values."""
    attrs = df.schema[features].metadata.get("ml_attr", {}).get("attrs", {})
    return any(len(a.get("vals", ())) > 2 or a.get("num_vals", 0) > 2 for a in attrs.get("nominal", []))


def to_groups(df: DataFrame, groups: int) -> DataFrame:
    """Every row once for each group ``g``."""
    return df.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))


def dealt(batches: Iterator[pa.RecordBatch]) -> dict[int, list[dict]]:
    """The packed rows of a partition by group."""
    out: dict[int, list[dict]] = {}
    for b in batches:
        for row in b.to_pylist():
            out.setdefault(row["g"], []).append(row)
    return out


class TaskForest(RandomForestClassifier):
    """Spark's random forest classifier with its parameters, the trees grown in tasks.

    Spark's own learner takes over for what is not built here (another impurity, none or partial bootstraps, more than 256 bins,
    categorical features of many values, subsets other than ``sqrt``) and for a table of which a task cannot hold a copy.
    """

    def _fit(self, dataset: DataFrame):
        built = (self.getImpurity() == "gini" and self.getBootstrap() and self.getSubsamplingRate() == 1.0 and self.getMaxBins() <= 256
                 and self.getFeatureSubsetStrategy() == "sqrt" and self.getNumTrees() > 1 and self.getMinWeightFractionPerNode() == 0.0
                 and not self.isSet(self.thresholds) and not self.getLeafCol() and not many_valued(dataset, self.getFeaturesCol()))
        return (self._grown(dataset) if built else None) or super()._fit(dataset)

    def _grown(self, dataset: DataFrame) -> ForestModel | None:
        features, spark = self.getFeaturesCol(), dataset.sparkSession
        label = F.col(self.getLabelCol()).cast("int")
        weight = F.col(self.getWeightCol()).cast("double") if self.isSet(self.weightCol) and self.getWeightCol() else F.lit(1.0)
        valid = (label >= 0) & (label == F.col(self.getLabelCol())) & (weight >= 0)
        size = dataset.agg(F.max(label).alias("top"), F.count(F.lit(1)).alias("n"), F.count_if(valid).alias("valid")).first()
        if not size["n"] or size["valid"] < size["n"]:
            raise ValueError(f"a forest learns from rows with labels 0, 1, .. and weights of 0 or more; {size['valid']} of {size['n']} rows have them")
        classes = max(2, size["top"] + 1)
        cuts = feature_thresholds(dataset, features, weight, min(self.getMaxBins(), size["n"]) - 1)
        table = (dataset.select(bins_of(features, cuts).alias("bins"), label.alias("y"), weight.alias("w"))
                        .groupBy("bins", "y", "w").agg(F.count(F.lit(1)).alias("n")).checkpoint(eager=True))
        width = len(cuts)
        if table.count() * (3 * width + 24 * (classes + 4)) > TASK_MB * 2 ** 20:
            return None
        trees, seed = self.getNumTrees(), self.getSeed() % 2 ** 63
        groups = min(trees, 4 * spark.sparkContext.defaultParallelism)
        settings = (max(map(len, cuts)).bit_length(), math.ceil(math.sqrt(width)), self.getMaxDepth(), self.getMinInstancesPerNode(), self.getMinInfoGain())

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own = [b.column(c).to_numpy(zero_copy_only=False).astype(d) for c, d in (("y", "<i4"), ("w", "<f8"), ("n", "<i8"))]
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (bytes_of_rows(b.column("bins"), width), *own)], list("xywn"))

        def grow_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for g, parts in dealt(batches).items():
                x, y, w, n = (np.frombuffer(b"".join(p[c] for p in parts), dtype=d) for c, d in (("x", "u1"), ("y", "<i4"), ("w", "<f8"), ("n", "<i8")))
                x = x.reshape(-1, width)
                order = ordered(x, y, w)
                x, y, w, n = x[order], y[order], w[order], n[order]
                kind = Statistics(y, w, classes)
                for t in range(g, trees, groups):
                    rng = np.random.default_rng(np.random.SeedSequence(seed, spawn_key=(t,)))
                    tree = pack_tree(grow(x, y, w, n, *settings, rng, kind))
                    yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([t], pa.int32()), *[pa.array([b], pa.binary()) for b in tree]],
                                                     ["g", "tree", *TREE])

        packed = table.mapInArrow(pack, "x binary, y binary, w binary, n binary")
        path = scratch_dir(spark, "forest")
        (to_groups(packed, groups).repartitionById(groups, "g")
         .mapInArrow(grow_group, f"g int, tree int, {', '.join(f'{c} binary' for c in TREE)}").write.parquet(path))
        return self._copyValues(ForestModel()._set(path=path, cuts=json.dumps(cuts), classes=classes, trees=trees, groups=groups))


class ForestModel(Model, HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol, MLWritable, MLReadable):
    """A fitted forest: its trees lie in a table, a row a tree, and are read where rows are scored.

    ``transform`` adds votes, probabilities and prediction as Spark's model does.  Votes are found once for each different row and materialised.
    """

    path = Param(Params._dummy(), "path", "table of the trees", TypeConverters.toString)
    cuts = Param(Params._dummy(), "cuts", "JSON of the thresholds of each feature", TypeConverters.toString)
    classes = Param(Params._dummy(), "classes", "number of classes", TypeConverters.toInt)
    trees = Param(Params._dummy(), "trees", "number of trees", TypeConverters.toInt)
    groups = Param(Params._dummy(), "groups", "number of groups of trees", TypeConverters.toInt)

    @property
    def getNumTrees(self) -> int:
        return self.getOrDefault(self.trees)

    @property
    def numClasses(self) -> int:
        return self.getOrDefault(self.classes)

    def _transform(self, df: DataFrame) -> DataFrame:
        cuts, trees = json.loads(self.getOrDefault(self.cuts)), self.getNumTrees
        bins = bins_of(self.getFeaturesCol(), cuts)
        found = few_rows(self._votes(df.select(bins.alias("_bins")).distinct(), len(cuts)).checkpoint(eager=True))
        scored = df.withColumn("_bins", bins).join(found, "_bins")
        return (scored.withColumn(self.getRawPredictionCol(), array_to_vector("_votes"))
                      .withColumn(self.getProbabilityCol(), array_to_vector(F.transform("_votes", lambda v: v / F.lit(float(trees)))))
                      .withColumn(self.getPredictionCol(), (F.array_position("_votes", F.array_max("_votes")) - 1).cast("double"))
                      .drop("_bins", "_votes"))

    def _votes(self, rows: DataFrame, width: int) -> DataFrame:
        """(_bins, _votes): class shares of each different row, added up over all trees."""
        classes, groups = self.numClasses, self.getOrDefault(self.groups)

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = bytes_of_rows(b.column(0), width).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(x).digest()], pa.binary()), pa.array([x], pa.binary())], ["id", "x"])

        def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for g, parts in dealt(batches).items():
                grown = [tuple(p[c] for c in TREE) for p in sorted((p for p in parts if p["x"] is None), key=lambda p: p["tree"])]
                for p in parts:
                    if p["x"] is not None:
                        x = np.frombuffer(p["x"], dtype=np.uint8).reshape(-1, width)
                        own = sum(votes(x, tree, classes) for tree in grown)
                        yield pa.RecordBatch.from_arrays([pa.array([p["id"]], pa.binary()), pa.array([g], pa.int32()), pa.array([len(grown)], pa.int32()),
                                                          pa.array([p["x"] if g == 0 else None], pa.binary()), pa.array([own.tobytes()], pa.binary())],
                                                         ["id", "g", "trees", "x", "own"])

        def add_up(table: pa.Table) -> pa.Table:
            parts = sorted(table.to_pylist(), key=lambda p: p["g"])
            if sum(p["trees"] for p in parts) != trees:
                raise ValueError(f"votes of {sum(p['trees'] for p in parts)} trees, not of {trees}")
            total = sum(np.frombuffer(p["own"]).reshape(-1, classes) for p in parts)
            x = np.frombuffer(parts[0]["x"], dtype=np.uint8).reshape(-1, width)
            return pa.table({"_bins": rows_of_bytes(x), "_votes": pa.FixedSizeListArray.from_arrays(total.ravel(), classes).cast(pa.list_(pa.float64()))})

        trees, grown = self.getNumTrees, rows.sparkSession.read.parquet(self.getOrDefault(self.path))
        packed = to_groups(rows.sortWithinPartitions("_bins").mapInArrow(pack, "id binary, x binary"), groups)
        both = grown.unionByName(packed, allowMissingColumns=True).repartitionById(groups, "g")
        return (both.mapInArrow(vote, "id binary, g int, trees int, x binary, own binary")
                    .groupBy("id").applyInArrow(add_up, "_bins binary, _votes array<double>"))

    def write(self) -> MLWriter:
        return _ForestWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ForestReader()


class _ForestWriter(MLWriter):
    def __init__(self, model: ForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.sparkSession.read.parquet(self.model.getOrDefault(self.model.path)).write.parquet(f"{path}/trees")


class _ForestReader(MLReader):
    def load(self, path: str) -> ForestModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = ForestModel()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model._set(path=f"{path}/trees")
