"""ML3 with class weights per bootstrap.

A row's weight in bootstrap b is a Poisson(1) draw from md5(id, seed, b), so a
bootstrap is a projection: repeatable, without sampling on the driver and the
same in any engine.  Class weights are balanced within each bootstrap.  The trees
are Spark's own: one forest a bootstrap, without a bootstrap of its own, and
votes are averaged over the forests.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopcast.operators.ordering import few_rows

#: P(Poisson(1) <= k) for k = 0, 1, .. as far as doubles tell it from 1.
POISSON_CDF = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(12)]


def poisson_draw(id_col: str, seed: int, number: Column | int) -> Column:
    """Poisson(1) draw of a row in bootstrap ``number``: the first 52 bits of md5(id|seed|number) against the distribution."""
    number = F.lit(number) if isinstance(number, int) else number
    digest = F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(seed)), number.cast("string")))
    u = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2 ** 52))
    draw = F.lit(0)
    for c in POISSON_CDF:
        draw = draw + (u >= F.lit(c)).cast("int")
    return draw


def bootstraps(df: DataFrame, id_col: str, count: int, seed: int = 42) -> DataFrame:
    """Every row once a bootstrap it is drawn in, with columns ``bootstrap`` and ``times``."""
    numbered = df.withColumn("bootstrap", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    return numbered.withColumn("times", poisson_draw(id_col, seed, F.col("bootstrap"))).filter("times > 0")


def bootstrap_class_weights(df: DataFrame, label: str, id_col: str, count: int, seed: int = 42) -> DataFrame:
    """(bootstrap, label, n_class, weight): balanced weights n / (k n_c) of each bootstrap, draws counted as often as drawn."""
    counts = bootstraps(df.select(id_col, label), id_col, count, seed).groupBy("bootstrap", label).agg(F.sum("times").alias("n_class"))
    totals = counts.groupBy(F.col("bootstrap").alias("_b")).agg(F.sum("n_class").alias("_n"), F.count(F.lit(1)).alias("_k"))
    joined = counts.join(totals, F.col("bootstrap") == F.col("_b"))
    return joined.select("bootstrap", label, "n_class", (F.col("_n") / (F.col("_k") * F.col("n_class"))).alias("weight"))


def balanced_forest(train: DataFrame, id_col: str, label: str = "label", features: str = "features", trees: int = 650, depth: int = 30,
                    count: int = 10, seed: int = 42) -> list[RandomForestClassificationModel]:
    """``count`` forests of ``trees / count`` trees, each on one bootstrap with its own class weights.

    ``count = trees`` gives every tree a bootstrap of its own, one fit a tree; with fewer, trees of
    one bootstrap differ by their feature subsets only.

    Spark's learner has no least size of a node to split; two rows a leaf stand in for it, so a
    node of three rows, which a least size of four leaves whole, is still split where both sides hold two rows or more
    of weighted draws.
    """
    weights = few_rows(bootstrap_class_weights(train, label, id_col, count, seed).checkpoint(eager=True))
    out = []
    for b in range(count):
        own = weights.filter(F.col("bootstrap") == b).select(label, "weight")
        drawn = train.withColumn("times", poisson_draw(id_col, seed, b)).filter("times > 0")
        rows = drawn.drop("weight").join(own, label).withColumn("weight", F.col("weight") * F.col("times"))
        size = trees // count + (b < trees % count)
        if size:
            out.append(RandomForestClassifier(featuresCol=features, labelCol=label, weightCol="weight", numTrees=size, maxDepth=depth,
                                              minInstancesPerNode=2, featureSubsetStrategy="sqrt", bootstrap=False, seed=seed + b).fit(rows))
    return out


def forest_votes(models: list[RandomForestClassificationModel], df: DataFrame, out: str = "p1") -> DataFrame:
    """Mean P(class 1) over all trees of all forests."""
    total = sum(m.getNumTrees for m in models)
    score, rows = F.lit(0.0), df
    for i, m in enumerate(models):
        m = m.copy().setProbabilityCol(f"_p{i}").setRawPredictionCol(f"_r{i}").setPredictionCol(f"_y{i}")
        rows = m.transform(rows)
        score = score + vector_to_array(F.col(f"_p{i}"))[1] * F.lit(m.getNumTrees / total)
    return rows.withColumn(out, score).drop(*[f"_{x}{i}" for i in range(len(models)) for x in "pry"])
