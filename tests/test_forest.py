"""The forest grown in tasks: against plain search, against Spark's own learner, and as a stored model."""

import json

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from shopcast.operators import forest as W
from shopcast.operators import metrics as E
from shopcast.operators import models as M


@pytest.fixture(scope="module")
def rows(spark):
    """2,000 rows: a continuous, a skewed, a ten-valued, a binary and a constant feature, noisy labels, two class weights."""
    u = [F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1_000_003)) / 1_000_003 for i in range(5)]
    df = spark.range(2000).select("id", u[0].alias("a"), F.exp(4 * u[1]).alias("b"), F.floor(10 * u[2]).cast("double").alias("c"),
                                  (u[3] > 0.5).cast("double").alias("d"), F.lit(3.0).alias("e"), u[4].alias("noise"))
    df = df.withColumn("label", (F.col("a") + F.col("c") / 20 + F.col("d") / 4 + F.col("noise") > 1.4).cast("int"))
    df = df.withColumn("weight", F.when(F.col("label") == 1, 1.25).otherwise(0.75))
    return VectorAssembler(inputCols=list("abcde"), outputCol="features").transform(df).select("id", "label", "weight", "features").checkpoint()


def probabilities(model, df):
    return {r["id"]: r["p"] for r in model.transform(df).select("id", vector_to_array("probability")[1].alias("p")).collect()}


def test_trees_stay_out_of_the_driver(spark, rows):
    """The model is a table of trees; votes add up over groups; another order of the rows gives the same forest; a saved one scores alike."""
    model = M.forest(trees=37).fit(rows)
    trees = spark.read.parquet(model.getOrDefault(model.path))
    assert sorted(r[0] for r in trees.select("tree").collect()) == list(range(37)) and model.getNumTrees == 37
    out = model.transform(rows).select("id", vector_to_array("rawPrediction").alias("v"), vector_to_array("probability").alias("p"), "prediction").collect()
    assert len(out) == 2000 and all(sum(r["v"]) == pytest.approx(37) and sum(r["p"]) == pytest.approx(1) and r["prediction"] == (r["p"][1] > r["p"][0]) for r in out)
    got = {r["id"]: r["p"][1] for r in out}
    assert probabilities(M.forest(trees=37).fit(rows.repartition(5, "id")), rows) == got
    assert probabilities(M.forest(trees=37, seed=43).fit(rows), rows) != got


def test_same_forest_as_sparks_learner(rows):
    """The same thresholds, trees of the same size, and scores that differ as between two seeds of Spark's learner."""
    train, test = rows.filter("id % 4 > 0"), rows.filter("id % 4 = 0")
    model = M.forest(trees=60).fit(train)
    plain = RandomForestClassifier(weightCol="weight", numTrees=60, minInstancesPerNode=2, maxDepth=30, featureSubsetStrategy="sqrt", cacheNodeIds=True)
    theirs, again = plain.setSeed(1).fit(train), plain.setSeed(2).fit(train)
    cuts = json.loads(model.getOrDefault(model.cuts))
    used = [{n.split().threshold() for t in theirs.trees[:6] for n in inner(t._call_java("rootNode")) if n.split().featureIndex() == f} for f in range(5)]
    assert [len(c) for c in cuts] == [31, 31, 9, 1, 0] and all(used[f] and used[f] <= set(cuts[f]) for f in range(4)) and not used[4]
    nodes = train.sparkSession.read.parquet(model.getOrDefault(model.path)).select(F.avg(F.length("cut"))).first()[0]
    assert nodes == pytest.approx(np.mean([t.numNodes for t in theirs.trees]), rel=0.07)
    p, q, r = (np.array([v for _, v in sorted(probabilities(m, test).items())]) for m in (model, theirs, again))
    assert np.abs(p - q).mean() < 1.25 * np.abs(r - q).mean() and abs(p.mean() - q.mean()) < 0.02


def inner(node):
    if node.subtreeDepth():
        yield node
        yield from inner(node.leftChild())
        yield from inner(node.rightChild())


@pytest.mark.parametrize("plain", [True, False])
def test_cuts_of_all_nodes_against_plain_search(plain):
    """Counted densely and sorted: the best allowed cut of each node, for one weight a class and for any weights."""
    rng = np.random.default_rng(5)
    for nodes, bits, n in ((3, 2, 200), (40, 5, 200), (1, 1, 9), (50, 2, 60)):
        width = 2 ** bits
        node, bins, y = np.sort(rng.integers(0, nodes, n)), rng.integers(0, width, n), rng.integers(0, 3, n)
        w = np.array([0.5, 1.0, 2.0])[y] if plain else rng.choice([0.25, 0.5, 3.0], n)
        draws, kind = rng.integers(1, 4, n), W.Statistics(y, w, 3)
        assert kind.plain == plain
        stat = kind.of_rows(y, w, draws)
        total = [np.bincount(node, weights=s, minlength=nodes) for s in stat]
        who, score, at_bin, _ = W.best_cuts(node, bins, stat, total, kind, bits, 2)
        got, cut = dict(zip(who.tolist(), score.tolist(), strict=True)), dict(zip(who.tolist(), at_bin.tolist(), strict=True))
        for v in range(nodes):
            at, want = node == v, {}
            for c in range(width - 1):
                sides = [at & (bins <= c), at & (bins > c)]
                if min(draws[s].sum() for s in sides) >= 2:
                    want[c] = sum(sum((draws * w)[s & (y == k)].sum() ** 2 for k in range(3)) / (draws * w)[s].sum() for s in sides)
            assert (v in got) == bool(want)
            if want:
                assert got[v] == pytest.approx(max(want.values())) and want[cut[v]] == pytest.approx(got[v])


def test_rows_that_agree_count_as_often_as_they_are():
    """Draws of a row with count n are those of n rows; leaves hold two draws at least and no depth is exceeded."""
    x, y, n = np.array([[0], [1], [1]], dtype=np.uint8), np.array([0, 1, 0], dtype=np.int32), np.array([500, 400, 100])
    kind, sums = W.Statistics(y, np.ones(3), 2), []
    for t in range(200):
        feature, cut, child, weights = W.grow(x, y, np.ones(3), n, 1, 1, 30, 2, 0.0, np.random.default_rng(t), kind)
        assert child.tolist() == [1, 0, 0] and weights[:, 1:].sum() == weights[:, 0].sum()
        sums.append(weights[:, 2])
    assert np.mean(sums, axis=0) == pytest.approx([100, 400], rel=0.03) and np.var(sums, axis=0) == pytest.approx([100, 400], rel=0.4)
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 16, (500, 3)).astype(np.uint8), rng.integers(0, 2, 500)
    kind = W.Statistics(y, np.ones(500), 2)
    assert len(W.grow(x, y, np.ones(500), np.ones(500, dtype=int), 4, 2, 3, 2, 0.0, rng, kind)[0]) <= 15
    _, _, child, weights = W.grow(x, y, np.ones(500), np.ones(500, dtype=int), 4, 2, 30, 2, 0.0, rng, kind)
    assert weights[:, child == 0].sum(axis=0).min() >= 2
    says = weights.argmax(axis=0)
    first = child[child > 0]
    assert not ((child[first] == 0) & (child[first + 1] == 0) & (says[first] == says[first + 1])).any()


def test_summaries_keep_ranks():
    rng = np.random.default_rng(2)
    values = np.round(np.exp(3 * rng.normal(size=200_000)), 2)
    small = W.summary((values, np.ones(len(values))))
    assert len(small[0]) <= W.POINTS + 1 and small[1].sum() == len(values)
    ranks = [np.searchsorted(np.sort(values), W.thresholds(points, 31)) / len(values) for points in (small, W.merged((values, np.ones(len(values)))))]
    assert len(ranks[0]) == 31 and np.abs(ranks[0] - ranks[1]).max() < 0.002
    assert W.thresholds(W.merged((np.array([1.0, 2, 2, 5]), np.ones(4))), 31) == [1.5, 3.5] and W.thresholds(W.merged((np.array([]), np.array([]))), 31) == []


def test_saved_forest_and_odd_rows(spark, rows, tmp_path):
    """A saved forest in a pipeline scores alike; unseen values and NaN have a leaf; bad labels are an error; other settings are Spark's."""
    model = M.forest(trees=5, depth=6).fit(rows)
    PipelineModel([model]).write().overwrite().save(str(tmp_path / "m"))
    back = PipelineModel.load(str(tmp_path / "m"))
    assert probabilities(back, rows) == probabilities(model, rows) and back.stages[0].getNumTrees == 5
    odd = VectorAssembler(inputCols=list("abcde"), outputCol="features", handleInvalid="keep").transform(
        spark.createDataFrame([(0, -9.0, 1e9, float("nan"), 0.0, 3.0), (1, float("inf"), None, 4.0, 1.0, 7.0)], "id long, a double, b double, c double, d double, e double"))
    assert all(0 <= p <= 1 for p in probabilities(model, odd).values()) and len(probabilities(model, odd)) == 2
    assert model.transform(odd.filter("id > 5")).count() == 0
    for bad in (rows.withColumn("label", F.when(F.col("id") > 3, F.col("label"))), rows.withColumn("label", -F.col("label")),
                rows.withColumn("label", F.col("label") / 2), rows.filter("id < 0")):
        with pytest.raises(ValueError):
            M.forest(trees=5).fit(bad)
    assert isinstance(M.forest(trees=5, depth=3).setImpurity("entropy").fit(rows), RandomForestClassificationModel)


def test_too_large_a_table_is_left_to_sparks_learner(rows, monkeypatch):
    monkeypatch.setattr(W, "TASK_MB", 0)
    model = M.forest(trees=5, depth=3).fit(rows)
    assert isinstance(model, RandomForestClassificationModel)
    s = M.positive_probability(model.transform(rows)).select(F.col("p1").alias("score"), "label")
    assert E.curve_areas(E.score_counts(s).checkpoint()).first()["roc_auc"] > 0.7


def test_report_grows_its_forest_in_tasks(spark, monkeypatch):
    """module4_report without Spark's learner, whose passes over the rows took its time: all twelve rows, of one test set."""
    import __spark_entry__
    monkeypatch.setattr(RandomForestClassifier, "_fit", lambda *a: pytest.fail("Spark's learner"))
    out = __spark_entry__.queries()["module4_report"](spark, "/root/testdata/sf0.001").collect()
    assert len({(r["model"], r["class"]) for r in out}) == 12 and len({r["support"] for r in out if r["class"].endswith("avg")}) == 1


def test_session_forest_grows_in_tasks(spark, monkeypatch):
    """train_forest without Spark's learner: every test session is scored once, and better than by chance."""
    import __spark_entry__
    monkeypatch.setattr(RandomForestClassifier, "_fit", lambda *a: pytest.fail("Spark's learner"))
    r = __spark_entry__.queries()["train_forest"](spark, "/root/testdata/sf0.01").first()
    assert r["tn"] + r["fp"] + r["fn"] + r["tp"] == r["n_test"] == pytest.approx(0.2 * 4006, abs=1) and 0.6 < r["roc_auc"] < 1
