"""Inferred types and formats, file order, exact rolling counts, Newton's fit, bootstraps, the stored transformer, data-driven bins."""

import datetime as dt
import random
import re

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from shopcast.operators import artefacts, bootstrap, features as FE, metrics as E, models as M, newton
from shopcast.operators.aggregates import histogram_nice
from shopcast.operators.windows import rolling_distinct
from shopcast.plans.modules import prepare
from shopcast.sources import inference, positions


def test_types_come_from_every_row(spark, tmp_path):
    rows = ["a,b,c,d,e,f,g,when", "1,1.5,true,x,NA,1,9223372036854775808,31/01/2020 10:00", "2,2,FALSE,,null,x,1,01/02/2020 11:30", "NA,.5e3,NA,1,,2,2,"]
    (tmp_path / "t.csv").write_text("\n".join(rows) + "\n")
    out = inference.read_csv_inferred(spark, str(tmp_path / "t.csv"))
    assert dict(out.dtypes) == {"a": "bigint", "b": "double", "c": "boolean", "d": "string", "e": "string", "f": "string", "g": "double", "when": "timestamp_ntz"}
    got = out.collect()
    assert [r["a"] for r in got] == [1, 2, None] and [r["c"] for r in got] == [True, False, None] and got[1]["when"] == dt.datetime(2020, 2, 1, 11, 30)
    late = spark.range(5000).select(F.when(F.col("id") == 4999, "odd").otherwise(F.col("id").cast("string")).alias("v"))
    assert inference.infer_types(late) == {"v": "string"} and inference.infer_types(late.filter("v <> 'odd'")) == {"v": "bigint"}
    assert inference.infer_types(late.limit(0)) == {"v": "string"}


@pytest.mark.parametrize("texts, fmt, unparsed", [
    (["01/02/2020", "13/02/2020", "x"], "d/M/yyyy", 1), (["01/02/2020", "02/13/2020", ""], "M/d/yyyy", 0), (["01/02/2020", "3/4/2020"], "M/d/yyyy", 0),
    (["2020-01-02 03:04:05", " 2020-01-02 03:04:06 "], "yyyy-MM-dd HH:mm:ss", 0), (["1.2.2020 3:04", None], "d.M.yyyy H:mm", 0), (["x", "y"], None, 2), ([None, ""], None, 0)])
def test_formats_by_evidence(spark, texts, fmt, unparsed):
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    typed, report = inference.parse_detected(df, ["v"])
    row = report.first()
    assert (row["format"], row["unparsed"]) == (fmt, unparsed) and typed.filter("v is not null").count() == row["parsed"]


ODD_TEXTS = ["01/02/2020", "1/2/2020 3:04", "13/02/2020 03:04:05", "+12345/01/02", "-0044/03/15", "2020-01-02t03:04:05", "2020-01-02T03:04:05", "20200102", "123451215", "+123451215", "1/2/2020 24:00", "1/2/2020 23:60", "30/2/2020", "0/1/2020", "001/002/2020", "+1/2/2020", "-1/2/2020 1:02:03",
             "2020-1-2", "1-2-2020 3:04", "1.2.2020 3:04:05", "1.2.2020  3:04", "99/99/2020", "1-URGENT", "a/b c:d", "", "7", "12345678", "123456789", "1/-2/2020", "2020/01/02 03:04:05 "]


def test_parse_is_tried_only_on_texts_of_its_layout(spark):
    """Every format reads what Spark's parser reads, and a text of another layout never reaches the parser."""
    df = spark.createDataFrame([(t,) for t in ODD_TEXTS], "v string")
    formats = [*inference.FORMATS, "dd MMM yyyy", "yyyy-MM-dd[ HH:mm]"]
    got = df.select("v", *[inference._parsed(F.col("v"), f).alias(f"p{i}") for i, f in enumerate(formats)],
                    *[F.try_to_timestamp("v", F.lit(f)).alias(f"q{i}") for i, f in enumerate(formats)])
    got = got.select("v", *[F.unix_micros(c).alias(c) for c in got.columns[1:]]).collect()         # years beyond Python's
    assert [(r["v"], f) for r in got for i, f in enumerate(formats) if r[f"p{i}"] != r[f"q{i}"]] == []
    shapes = {f: inference._shape(f) for f in inference.FORMATS}
    assert not any(re.match(s[0], "1-URGENT") or re.match(s[0], "4711") for s in shapes.values()) and inference._shape("dd MMM yyyy") is None


def test_types_take_one_aggregate_a_column(spark):
    """More types than one number has bits; a few aggregates a column instead of one a format."""
    df = spark.createDataFrame([("1", "01.02.2020", None), (" 2 ", "13.02.2020", "NA")], "a string, b string, c string")
    many = [*[f"yyyy/MM/dd HH:mm:ss '{'x' * i}'" for i in range(1, 70)], *inference.FORMATS]
    assert inference.infer_types(df) == inference.infer_types(df, formats=many) == {"a": "bigint", "b": "timestamp d.M.yyyy", "c": "string"}


def test_one_scan_finds_all_types(spark, tmp_path):
    spark.range(100).selectExpr("id a", "id * 0.5 b", "'x' c").write.option("header", True).csv(str(tmp_path / "c"))
    text = spark.read.option("header", True).csv(str(tmp_path / "c"))
    plan = inference.typed(text, inference.infer_types(text))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan


def test_file_order_without_a_key(spark, tmp_path):
    path = str(tmp_path / "p")
    for i in range(3):
        spark.createDataFrame([(f"k{j % 2}", None if (i, j) == (0, 0) else 10 * i + j) for j in range(5)], "k string, v int").coalesce(1).write.mode("append").parquet(path)
    placed = positions.read_positioned(spark, path)
    got = placed.orderBy("row_position").collect()
    assert [r["row_position"] for r in got] == list(range(15))
    assert len({r["v"] // 10 for r in got[1:5] if r["v"] is not None}) == 1                # files stay together
    firsts = {}
    for r in got:
        if r["v"] is not None:
            firsts.setdefault(r["k"], r["v"])
    assert {r["k"]: r["first_v"] for r in positions.first_in_order(placed, ["k"], ["v"]).collect()} == firsts
    split = positions.positional_split(placed, 0.8).collect()
    assert {r["row_position"] for r in split if r["split"] == "train"} == set(range(12))
    with pytest.raises(ValueError):
        positions.read_positioned(spark, path, out="v")


def test_rolling_distinct_counts_members_once(spark):
    random.seed(4)
    day = dt.date(2020, 1, 1)
    rows = [(random.choice("ab"), random.choice([1, 2, 3, None]), day + dt.timedelta(random.randrange(120))) for _ in range(200)] + [("hot", i, day) for i in range(50)]
    got = rolling_distinct(spark.createDataFrame(rows, "k string, m int, d date"), "k", "m", "d", 30).collect()
    want = {(k, d): len({m for x, m, e in rows if x == k and 0 <= (d - e).days < 30}) for k, _, d in rows}
    assert {(r["k"], r["d"]): r["members"] for r in got} == want and len(got) == len(want)


def test_newton_matches_the_library_fit(spark):
    random.seed(5)
    rows = [(x, z, int(random.random() < 1 / (1 + 2.7 ** -(1.5 * x - z)))) for x, z in ((random.gauss(0, 1), random.gauss(3, 10)) for _ in range(600))]
    df = M.with_class_weights(spark.createDataFrame(rows, "x double, z double, label int"))
    fit = newton.fit_logistic(df, ["x", "z"], "label", "weight")
    total = df.agg(F.sum("weight")).first()[0]
    lib = M.logistic(reg_param=1.0 / total).setTol(1e-12).fit(VectorAssembler(inputCols=["x", "z"], outputCol="features").transform(df))
    assert max(abs(a - b) for a, b in zip([*fit.coefficients, fit.intercept], [*lib.coefficients, lib.intercept])) < 1e-4 and fit.passes < 15
    separated = spark.createDataFrame([(float(i), int(i > 5)) for i in range(10)], "x double, label int")
    assert newton.fit_logistic(separated, ["x"]).coefficients[0] > 0
    with pytest.raises(ValueError):
        newton.fit_logistic(separated.union(spark.createDataFrame([(None, 1)], "x double, label int")), ["x"])
    with pytest.raises(ValueError):
        newton.fit_logistic(separated.limit(0), ["x"])


def test_bootstraps_are_poisson_and_balanced(spark):
    df = spark.range(4000).select("id", (F.col("id") % 10 == 0).cast("int").alias("label"), (F.col("id") % 10 * 0.1 + F.rand(3)).alias("x"))
    drawn = bootstrap.bootstraps(df, "id", 3)
    sizes = [r["n"] for r in drawn.groupBy("bootstrap").agg(F.sum("times").alias("n")).collect()]
    assert len(sizes) == 3 and all(abs(n - 4000) < 250 for n in sizes)
    mass = bootstrap.bootstrap_class_weights(df, "label", "id", 3).withColumn("m", F.col("n_class") * F.col("weight")).groupBy("bootstrap").agg(F.min("m"), F.max("m"))
    assert all(abs(r[1] - r[2]) < 1e-6 for r in mass.collect())
    rows = VectorAssembler(inputCols=["x"], outputCol="features").transform(df).withColumn("weight", F.lit(1.0)).checkpoint()
    train, test = rows.filter("id % 4 <> 0"), rows.filter("id % 4 = 0")
    models = bootstrap.balanced_forest(train, "id", trees=20, depth=5, count=20)
    assert [m.getNumTrees for m in bootstrap.balanced_forest(train, "id", trees=5, depth=2, count=2)] == [3, 2]
    votes = bootstrap.forest_votes(models, test).select("id", "label", F.col("p1").alias("score"))
    own = M.forest(trees=20, depth=5).fit(M.with_class_weights(train.drop("weight")))
    plain = M.positive_probability(own.transform(test)).select("id", "label", F.col("p1").alias("score"))
    aps = [E.average_precision(s).first()[0] for s in (votes, plain)]
    assert votes.agg(F.max("score")).first()[0] <= 1 and abs(aps[0] - aps[1]) < 0.02, aps


def test_transformer_refuses_another_shape(spark, tmp_path):
    df = spark.createDataFrame([(1.0, "a"), (3.0, "b"), (None, None)], "x double, c string")
    fitted = artefacts.Transformer(FE.column_transformer(["x"], ["c"]).fit(df), df.schema, ("x",), ("c",))
    artefacts.save_transformer(fitted, str(tmp_path / "t"))
    loaded = artefacts.load_transformer(str(tmp_path / "t"), df.schema)
    assert [r["features"] for r in loaded.transform(df).collect()] == [r["features"] for r in fitted.transform(df).collect()]
    for other in (df.drop("c"), df.withColumn("x", F.col("x").cast("string"))):
        with pytest.raises(ValueError, match="columns"):
            loaded.transform(other)
        with pytest.raises(ValueError, match="columns"):
            artefacts.load_transformer(str(tmp_path / "t"), other.schema)


def test_nice_bins(spark):
    df = spark.createDataFrame([(x,) for x in [0.0, 0.013, 0.5, 0.99, None, float("nan")]], "v double")
    got = histogram_nice(df, "v").orderBy("bin_lo").collect()
    assert sum(r["n"] for r in got) == 4 and len(got) <= 40 and abs(got[1]["bin_lo"] - got[0]["bin_lo"] - 0.05) < 1e-12
    assert [tuple(r) for r in histogram_nice(df.filter("v = 0.5"), "v").collect()] == [(0.0, 1.0, 1)]
    assert histogram_nice(df.limit(0), "v").collect() == []
    wide = histogram_nice(spark.range(-500, 12345).select(F.col("id").cast("double").alias("v")), "v").collect()
    assert len(wide) <= 40 and sum(r["n"] for r in wide) == 12845


def test_too_many_categories_are_an_error_unless_named(spark):
    df = spark.range(12000).select("id", F.col("id").cast("string").alias("c"), (F.col("id") % 2).alias("label"), F.lit("train").alias("split"), F.rand(1).alias("x"))
    with pytest.raises(ValueError, match="hashed"):
        prepare(df, "label", [], "id")
    assert prepare(df, "label", [], "id", hashed=["c"]).n_train == 12000


def test_modes_of_all_text_columns_in_one_pass(spark):
    df = spark.createDataFrame([("a", "y", 1), ("b", None, 2), ("a", "x", 2), (None, "x", None), ("b", "y", 1)], "s string, t string, n int")
    assert FE.mode_values(df, ["s", "t", "n"]) == ["a", "x", 1]
