"""Distributed ordering equals a global sort; splits keep exact sizes."""

import os
import re
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from shopcast.operators import ordering
from shopcast.operators.features import exact_median, mode_value
from shopcast.operators.splits import ordered_split, split_sides, stratified_split, temporal_split


def test_running_totals_equal_a_global_sort(spark):
    df = spark.range(0, 5000).select((F.col("id") % 997).cast("double").alias("k"), F.lit(1).alias("v"))
    counts = df.groupBy("k").agg(F.sum("v").alias("v"))
    got = {r["k"]: r["cum_v"] for r in ordering.running_totals(counts, "k", ["v"]).collect()}
    pdf = counts.toPandas().sort_values("k")
    pdf["cum"] = pdf["v"].cumsum()
    assert got == dict(zip(pdf["k"], pdf["cum"]))


@pytest.mark.parametrize("slack", [3e-4, 1e-9])
def test_rows_at_equals_a_global_sort(spark, slack):
    df = spark.range(0, 3000).select((F.col("id") % 50).alias("a"), (F.col("id") * 7 % 3000).alias("b"))
    rows = sorted((r["a"], r["b"]) for r in df.collect())
    for pos in (0, 1, 1499, 2999):
        hit = ordering.rows_at(df, [], ["a", "b"], pos / 3000, lambda n: F.lit(pos), slack=slack).first()
        assert hit["n"] == 3000 and (hit["first"]["k0"], hit["first"]["k1"]) == rows[pos]
    assert ordering.rows_at(df, [], ["a", "b"], 1.0, lambda n: n).first()["first"] is None


def test_rows_at_of_many_classes(spark):
    df = spark.range(0, 6000).select((F.col("id") % 700).alias("c"), F.concat(F.lit("k"), F.lpad(F.col("id"), 5, "0")).alias("t"))
    got = {r["c"]: r["first"]["k0"] for r in ordering.rows_at(df, ["c"], ["t"], 0.5, lambda n: F.floor(n / 2)).collect()}
    by = {}
    for r in df.collect():
        by.setdefault(r["c"], []).append(r["t"])
    assert got == {c: sorted(v)[len(v) // 2] for c, v in by.items()}


KEYS = {"string": "concat('p', id % 97, 'é', id)", "date": "date_add(date'1969-06-01', int(id % 900))",
        "timestamp_ntz": "timestamp_ntz'2024-03-31 01:00:00' + make_interval(0, 0, 0, 0, 0, int(id * 7 % 5000), 0)",
        "decimal": "cast(id * 1.37 as decimal(20, 2))", "double": "if(id % 5 = 0, double('inf'), if(id % 7 = 0, double('nan'), -id / 3.0))",
        "boolean": "id % 3 = 0", "timestamp": "timestamp_seconds(id * 86399)", "binary": "cast(concat('b', id * 31 % 997) as binary)"}


@pytest.mark.parametrize("kind", sorted(KEYS))
def test_ordered_split_takes_any_key_type(spark, kind):
    df = spark.range(0, 1000).select(F.expr(KEYS[kind]).alias("k"), "id").withColumn("k", F.when(F.col("id") % 11 != 0, F.col("k")))
    sp = ordered_split(df, ["k", "id"], 0.8)
    order = [(r["id"], r["split"]) for r in sp.orderBy(F.col("k").asc_nulls_last(), "id").collect()]
    assert [s for _, s in order] == ["train"] * 800 + ["test"] * 200


def test_text_keys_with_a_common_prefix_keep_a_narrow_bracket(spark):
    df = spark.range(0, 40000).select(F.concat(F.lit("https://shop.example/Ünits#"), F.lpad(F.col("id") * 7919 % 40000, 9, "0")).alias("k"))
    skip = ordering.common_prefix(df, "k")
    assert skip == len("https://shop.example/Ünits#0000".encode())
    assert df.select(ordering.sort_number(F.col("k"), df.schema["k"].dataType, skip)).distinct().count() == 40000
    got = ordering.rows_at(df, [], ["k"], 0.8, lambda n: F.floor(n * 0.8)).first()["first"]["k0"]
    assert got == sorted(r["k"] for r in df.collect())[32000]
    one = spark.createDataFrame([("same",)] * 3 + [(None,)], "k string")
    assert ordering.common_prefix(one, "k") == 4 and ordering.common_prefix(one.limit(0), "k") == 0
    assert ordering.rows_at(one, [], ["k"], 0.5, lambda n: F.lit(1)).first()["first"]["k0"] == "same"


@pytest.mark.parametrize("nulls", [0, 3, 9, 10])
@pytest.mark.parametrize("frac", [0.0, 0.5, 1.0])
def test_splits_with_null_keys(spark, nulls, frac):
    df = spark.range(0, 10).select(F.when(F.col("id") >= nulls, F.col("id") % 4).alias("k"), "id")
    rows = sorted(((r["k"] is None, r["k"] or 0), r["id"]) for r in df.collect())
    cut = rows[int(frac * 10)][0] if frac < 1 else (True, 1)
    timed = {r["id"]: r["split"] for r in temporal_split(df, "k", frac).collect()}
    assert timed == {i: "train" if k <= cut else "test" for k, i in rows}
    parted = {r["id"]: r["split"] for r in ordered_split(df, ["k", "id"], frac).collect()}
    assert parted == {i: "train" if p < int(frac * 10) else "test" for p, (_, i) in enumerate(rows)}
    for told, keys, with_cut in ((timed, ["k"], True), (parted, ["k", "id"], False)):
        sides = [{r["id"] for r in side.collect()} for side in split_sides(df, keys, frac, with_cut)]
        assert sides == [{i for i, s in told.items() if s == name} for name in ("train", "test")]


@pytest.mark.parametrize("order", [["k"], ["k", "id"]])
def test_each_side_is_a_range_that_reaches_the_scan(spark, tmp_path, order):
    path = str(tmp_path / "rows")
    spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("k"), "id").write.parquet(path)
    for with_cut in (False, True):
        for df, n, sign in zip(split_sides(spark.read.parquet(path), order, 0.8, with_cut), (800 + with_cut, 200 - with_cut), "<>", strict=True):
            scan = [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x][-1]
            assert re.search(rf"\(k#\d+L {sign}=? Subquery", scan.split("DataFilters")[1]) and "<=> true" not in scan, scan
            assert df.count() == n


def test_composite_split_does_not_depend_on_the_drivers_zone():
    code = ("import sys; sys.path.insert(0, '.'); from shopcast.session import get_session; s = get_session('local[2]', 4); "
            "import __spark_entry__ as e; q = e.queries()['composite_ordered_split'](s, '/root/testdata/sf0.001'); "
            "print('train', q.filter(\"split = 'train'\").count(), q.count())")
    out = {subprocess.run([sys.executable, "-c", code], env={**os.environ, "TZ": zone}, cwd=os.path.dirname(os.path.dirname(__file__)),
                          capture_output=True, text=True, timeout=300).stdout.split("train")[-1] for zone in ("UTC", "America/New_York")}
    assert out == {" 1200 1500\n"}


def test_ordered_split_exact(spark):
    df = spark.range(0, 1003).select((F.col("id") * 13 % 1003).alias("k"))
    sp = ordered_split(df, ["k"], 0.8)
    assert sp.filter("split = 'train'").count() == int(1003 * 0.8)
    assert sp.filter("split = 'train'").agg(F.max("k")).first()[0] < sp.filter("split = 'test'").agg(F.min("k")).first()[0]


def test_temporal_cutoff_tie_goes_to_train(spark):
    df = spark.createDataFrame([(1,), (2,), (2,), (2,), (3,)], "d int")
    sp = temporal_split(df, "d", 0.5)          # position 2 is a 2: every 2 is train
    assert sorted(r["d"] for r in sp.filter("split = 'train'").collect()) == [1, 2, 2, 2]


def test_stratified_shares(spark):
    df = spark.range(0, 700).select("id", (F.col("id") % 7 == 0).cast("int").alias("y"))
    sp = stratified_split(df, "y", "id", 0.2, 42)
    c = {(r["y"], r["split"]): r["count"] for r in sp.groupBy("y", "split").count().collect()}
    assert c[(1, "test")] == 20 and c[(0, "test")] == 120


def test_median_and_mode(spark):
    df = spark.createDataFrame([(1.0, "b"), (2.0, "a"), (3.0, "a"), (10.0, "b"), (None, None)], "x double, s string")
    assert exact_median(df, "x") == 2.5
    assert mode_value(df, "s") == "a"


def test_hashed_split_is_one_projection(spark):
    df = spark.range(0, 20000).select("id", (F.col("id") % 3 == 0).cast("int").alias("y"))
    sp = stratified_split(df, "y", "id", 0.2, 42, exact=False)
    share = sp.filter("split = 'test'").count() / 20000
    assert 0.18 < share < 0.22
    plan = sp._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_exact_medians_many_columns(spark):
    from shopcast.operators.features import exact_medians
    df = spark.createDataFrame([(1.0, 5, None), (2.0, 5, None), (3.0, 7, None), (10.0, 9, None)],
                               "a double, b int, c double")
    assert exact_medians(df, ["a", "b", "c"]) == [2.5, 6.0, None]


def test_running_totals_at_volume(spark):
    n = 250_000
    df = spark.range(0, n).select((F.col("id") * 3).alias("k"), F.lit(1).alias("v"))
    rt = ordering.running_totals(df, "k", ["v"])
    assert rt.filter(F.col("cum_v") != F.col("k") / 3 + 1).count() == 0
