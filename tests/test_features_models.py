"""Feature estimators, model parity and small column behaviours."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from shopcast.functions.cleaning import map_binary
from shopcast.operators import features as FE
from shopcast.operators import models as M
from shopcast.operators.aggregates import histogram


def test_strict_label_map_raises(spark):
    df = spark.createDataFrame([("Yes",), ("No",), ("Maybe",)], "c string")
    with pytest.raises(Exception):
        df.select(map_binary("c")).collect()
    assert [r[0] for r in df.select(map_binary("c", strict=False)).collect()] == [1, 0, None]


def test_histogram_top_edge(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "probability double")
    bins = {r["bin"]: r["n"] for r in histogram(df, "probability", 40).collect()}
    assert bins == {0: 1, 20: 1, 39: 1}


def test_one_hot_unknown_and_null_are_zero(spark):
    train = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (3.0, "b")], "x double, c string")
    model = FE.column_transformer(["x"], ["c"]).fit(train)
    test = spark.createDataFrame([(1.0, "a"), (1.0, "zzz"), (1.0, None)], "x double, c string")
    vecs = [r[0] for r in model.transform(test).select(vector_to_array("features")).collect()]
    # x is scaled; the category part: 'a' -> one slot set, unknown -> zeros, null -> mode 'b'
    assert vecs[0][1:] == [1.0, 0.0]
    assert vecs[1][1:] == [0.0, 0.0]
    assert vecs[2][1:] == [0.0, 1.0]


def test_population_scaler(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    model = FE.PopulationScaler(inputCols=["x"]).fit(df)
    assert model.getOrDefault(model.stds)[0] == pytest.approx(np.std([1, 2, 3, 10]))


def _newton_weighted_l2(X, y, w, iters=50):
    """argmin sum_i w_i logloss_i + 0.5 * ||beta||^2 (intercept not penalised)."""
    Xb = np.hstack([X, np.ones((len(X), 1))])
    b = np.zeros(Xb.shape[1])
    pen = np.eye(Xb.shape[1])
    pen[-1, -1] = 0.0
    for _ in range(iters):
        p = 1 / (1 + np.exp(-Xb @ b))
        g = Xb.T @ (w * (p - y)) + pen @ b
        H = (Xb * (w * p * (1 - p))[:, None]).T @ Xb + pen
        b -= np.linalg.solve(H, g)
    return b


def test_logistic_parity_with_weighted_l2(spark):
    rng = np.random.default_rng(7)
    X = rng.normal(size=(400, 3))
    y = (X @ np.array([1.5, -2.0, 0.5]) + rng.normal(size=400) > 0.8).astype(int)
    rows = [(float(a), float(b), float(c), int(t)) for (a, b, c), t in zip(X, y)]
    df = M.with_class_weights(spark.createDataFrame(rows, "a double, b double, c double, label int"))
    from pyspark.ml.feature import VectorAssembler
    data = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)
    total_w = data.agg(F.sum("weight")).first()[0]
    lr = M.logistic(reg_param=1.0 / total_w, max_iter=500).setTol(1e-12).fit(data)
    w = np.array([r["weight"] for r in df.orderBy("a").collect()])
    pdf = df.orderBy("a").toPandas()
    ref = _newton_weighted_l2(pdf[["a", "b", "c"]].to_numpy(), pdf["label"].to_numpy(), w)
    got = np.append(lr.coefficients.toArray(), lr.intercept)
    assert np.allclose(got, ref, atol=1e-4)


def test_median_imputer_exact_and_approx(spark):
    df = spark.range(0, 1001).select(F.col("id").cast("double").alias("x"), (F.col("id") % 7).alias("y"))
    exact = FE.MedianImputer(inputCols=["x", "y"]).fit(df)
    approx = FE.MedianImputer(inputCols=["x", "y"], approxAccuracy=10000).fit(df)
    assert exact.getOrDefault(exact.values) == [500.0, 3.0]
    assert approx.getOrDefault(approx.values)[0] == pytest.approx(500.0, abs=2)
    filled = exact.transform(spark.createDataFrame([(None, None)], "x double, y long"))
    assert filled.first()["x"] == 500.0 and filled.first()["y"] == 3


def test_imputation_holds(spark):
    """Half medians in an int column, NaN like null, booleans as numbers, text by mode."""
    df = spark.createDataFrame([(1, 1.0, True, "b"), (2, float("nan"), None, "a"), (3, 3.0, True, None), (10, None, False, "b"), (None, 5.0, True, "b")],
                               "a int, b double, c boolean, d string")
    out = FE.ModeImputer(inputCols=["d"]).fit(df).transform(FE.MedianImputer(inputCols=["a", "b", "c"]).fit(df).transform(df))
    assert [tuple(r) for r in out.collect()] == [(1.0, 1.0, 1.0, "b"), (2.0, 3.0, 1.0, "a"), (3.0, 3.0, 1.0, "b"), (10.0, 3.0, 0.0, "b"), (2.5, 5.0, 1.0, "b")]
    num, cat = FE.split_by_type(df.schema)
    vec = FE.column_transformer(num, cat).fit(df).transform(df).select(vector_to_array("features")).collect()
    assert all(np.isfinite(r[0]).all() for r in vec)


def test_wide_text_columns_are_hashed(spark):
    df = spark.range(500).select(F.col("id").cast("double").alias("x"), F.concat(F.lit("v"), F.col("id")).alias("w"), (F.col("id") % 3).cast("string").alias("n"))
    assert FE.wide_categories(df, ["w", "n"], limit=100) == ["w"]
    model = FE.column_transformer(["x"], ["w", "n"], hashed=["w"], hash_size=64).fit(df)
    assert len(model.transform(df).first()["features"]) == 1 + 3 + 64


def test_weights_come_from_train_rows(spark):
    df = spark.createDataFrame([(0, "train"), (1, "train"), (1, "train"), (0, "test"), (0, "test")], "label int, split string")
    assert {r["label"]: r["weight"] for r in M.train_class_weights(df, "label").collect()} == {0: 1.5, 1: 0.75}


def test_bundle_decides_on_its_own(spark, tmp_path):
    from shopcast.plans.modules import bundle
    rows = [(i, float(i % 7), "ab"[i % 2], int(i % 7 > 3), "test" if i % 5 == 0 else "train") for i in range(200)]
    df = spark.createDataFrame(rows, "id int, x double, c string, y int, split string")
    b = bundle(df, "y", [], "id")
    M.save_bundle(b, str(tmp_path / "bundle"))
    back = M.load_bundle(str(tmp_path / "bundle"))
    assert (back.threshold, back.target, back.numeric, back.categorical, back.metrics["n_train"]) == (b.threshold, "y", ["x"], ["c"], 160)
    new = spark.createDataFrame([(1, "6", 9), (2, None, 9)], "id int, x string, probability_in int")     # wrong type, missing column c
    got = back.score(new).orderBy("id").collect()
    assert got[0]["prediction"] == 1 and got[0]["x"] == "6" and got[1]["probability"] is not None
    assert M.bundle_metadata(back).first()["features"] == "x,c"


def test_report_steps_over_a_saved_score_table(spark, tmp_path):
    """K2, K3, A18 and E10 on a saved table of model scores, against DuckDB."""
    import duckdb

    from shopcast.operators.metrics import kpi_strip
    from shopcast.operators.reports import top_filtered, top_n
    path = str(tmp_path / "scores")
    spark.range(400).select("id", (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).alias("p"), (F.col("id") % 5).cast("string").alias("cat"),
                            (F.col("id") % 3).cast("string").alias("plan")).write.parquet(path)
    s, con = spark.read.parquet(path), duckdb.connect()
    con.execute(f"create view s as select * from '{path}/*.parquet'")
    ask = lambda q: [tuple(r) for r in con.execute(q).fetchall()]
    assert [tuple(r) for r in top_n(s, "p", "id", 9).collect()] == ask("select * from s order by p desc, id limit 9")
    assert [tuple(r) for r in top_filtered(s, "p", "id", 7, "cat", "plan", 2, ["1"]).select("id", "p", "cat", "plan").collect()] == ask(
        "select * from s where cat in ('0', '1') and plan = '1' order by p desc, id limit 7")
    assert sorted((r["bin"], r["n"]) for r in histogram(s, "p", 40).collect()) == sorted(ask("select least(floor(p * 40), 39)::int, count(*) from s group by 1"))
    k = kpi_strip(s, 0.5, "p").first()
    assert (k["mean_probability"], k["predicted_rate"]) == pytest.approx(ask("select avg(p), avg((p >= 0.5)::int) from s")[0])


def test_learners_use_every_core(spark):
    """Rows that a shuffle left in one partition are spread before the fit; all of them arrive with their weights."""
    df = spark.range(400).select("id", (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 7 > 3).cast("int").alias("y"),
                                 F.when(F.col("id") % 5 == 0, "test").otherwise("train").alias("split")).coalesce(1)
    from shopcast.plans.modules import prepare
    p, cores = prepare(df, "y", [], "id"), spark.sparkContext.defaultParallelism
    assert p.train.rdd.getNumPartitions() >= cores and p.test.rdd.getNumPartitions() >= cores
    assert (p.n_train, p.train.count(), p.test.count()) == (320, 320, 80) and p.train.select("weight").distinct().count() == 2
    forest = M.forest()
    assert (forest.getNumTrees(), forest.getMaxDepth(), forest.getMinInstancesPerNode(), forest.getCacheNodeIds()) == (650, 30, 2, True)


def test_medians_of_all_columns_out_of_brackets(spark):
    """Constants, ties over the middle, infinities, nulls and NaN, even and odd counts, wide tables: against a plain median."""
    rng = np.random.default_rng(3)
    n = 30001
    cols = {"const": np.full(n, 7.0), "ties": rng.integers(0, 3, n).astype(float), "real": rng.normal(size=n), "skew": np.exp(5 * rng.normal(size=n)),
            "gap": np.where(np.arange(n) % 2 == 0, 1.0, 1e9), "inf": np.where(rng.random(n) < 0.6, np.inf, 1.0), "nan": np.where(rng.random(n) < 0.5, np.nan, rng.normal(size=n)),
            "none": np.full(n, np.nan)}
    import pandas as pd
    df = spark.createDataFrame(pd.DataFrame(cols)).repartition(4).checkpoint()
    for table, rows in ((df, slice(None)), (df.filter("const > 8"), slice(0, 0))):
        want = [None if not len(v := x[rows][~np.isnan(x[rows])]) else float(np.median(v)) for x in cols.values()]
        assert FE.exact_medians(table, list(cols)) == want
    assert FE.exact_medians(df, list(cols), slack=1e-3) == FE.exact_medians(df, list(cols), slack=0.6) == FE.exact_medians(df, list(cols))


def test_prepare_writes_stored_rows_once(spark, monkeypatch):
    """A materialised split table is not written again, and weights come with the vectors; a train row without label stays out."""
    from shopcast.plans.modules import prepare
    df = spark.range(300).select("id", (F.col("id") % 7).cast("double").alias("x"), F.when(F.col("id") != 1, (F.col("id") % 7 > 3).cast("int")).alias("y"),
                                 F.when(F.col("id") % 5 == 0, "test").otherwise("train").alias("split")).checkpoint()
    written, plain = [], type(df).checkpoint
    monkeypatch.setattr(type(df), "checkpoint", lambda self, *a, **k: written.append(self.columns) or plain(self, *a, **k))
    p = prepare(df, "y", [], "id", stored=True)
    assert [c for c in written if "x" in c] == [] and sum("features" in c for c in written) == 1
    assert p.n_train == p.train.count() == 239 and "weight" not in p.test.columns and p.train.filter("weight is null").isEmpty()
