"""Queries of feature preparation (FE1-FE7), models (ML2-ML4, IO5), file
sources/sinks (IO1-IO3, IO6) and the scoring stream (ST1)."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopcast.operators import features as FE
from shopcast.operators import models as M
from shopcast.operators import splits as S
from shopcast.operators.entities import customer_features, product_facts
from shopcast.plans.catalog import query, round_doubles
from shopcast.plans.queries_eval import metrics_record
from shopcast.plans.queries_m1 import m1_features
from shopcast.plans.sessions import M3_DROP, TARGET as M3_TARGET, sessions
from shopcast.session import scratch_dir
from shopcast.sources import files as IO
from shopcast.sources.adapters import web_events
from shopcast.sources.tables import load_table
from shopcast.streaming.scoring import start_scoring

PRODUCT_NUM = ["price", "discount_pct", "images_count", "description_length"]
PRODUCT_CAT = ["plan_id", "business_category_slug"]


@query("impute_median")
def q_impute_median(spark, sf):
    """FE2 fitted state: exact median of each numeric product column."""
    model = FE.MedianImputer(inputCols=PRODUCT_NUM).fit(product_facts(spark, sf).select(PRODUCT_NUM).checkpoint(eager=True))
    vals = model.getOrDefault(model.values)
    rows = [(c, float(v) if v is not None else None) for c, v in zip(PRODUCT_NUM, vals)]
    return round_doubles(spark.createDataFrame(rows, "feature string, median double"))


@query("impute_mode")
def q_impute_mode(spark, sf):
    """FE3 fitted state: most frequent value of each categorical product column."""
    model = FE.ModeImputer(inputCols=PRODUCT_CAT).fit(product_facts(spark, sf))
    vals = model.getOrDefault(model.values)
    return spark.createDataFrame(list(zip(PRODUCT_CAT, vals)), "feature string, mode string")


@query("standardize")
def q_standardize(spark, sf):
    p = product_facts(spark, sf).select("product_id", "price", "description_length")
    model = FE.PopulationScaler(inputCols=["price", "description_length"]).fit(p)
    return round_doubles(model.transform(p).select(
        "product_id", F.col("price").alias("price_z"), F.col("description_length").alias("description_length_z")))


@query("one_hot")
def q_one_hot(spark, sf):
    c = customer_features(spark, sf).select("customer_id", "preferred_payment_method")
    cats = FE.fitted_categories(c, "preferred_payment_method")
    return FE.one_hot_columns(c, "preferred_payment_method", cats, prefix="pay").drop("preferred_payment_method")


def _session_frame(spark, sf):
    s = sessions(web_events(spark, sf)).withColumn("label", F.col(M3_TARGET))
    # FE1: numeric vs categorical from the schema, ids and leakage excluded
    num, cat = FE.split_by_type(s.schema, exclude=[*M3_DROP, M3_TARGET, "label"])
    return s, num, cat


def _session_split(spark, sf):
    s, num, cat = _session_frame(spark, sf)
    return S.stratified_split(s.checkpoint(eager=True), "label", "ga_session_id", 0.2, 42).checkpoint(eager=True), num, cat


@query("feature_matrix")
def q_feature_matrix(spark, sf):
    """FE6 in full: the non-zero slots of every row, fitted on the train rows (FE7)."""
    sp, num, cat = _session_split(spark, sf)
    model = FE.column_transformer(num, cat).fit(sp.filter(F.col("split") == "train"))
    slots = F.posexplode(vector_to_array("features")).alias("slot", "value")
    return round_doubles(model.transform(sp).select("ga_session_id", "split", slots).filter("value <> 0"))


@query("impute_transform")
def q_impute_transform(spark, sf):
    """FE2 + FE4 + FE3 applied: nulls, NaN, a boolean and a text column of the orders, imputed and scaled."""
    o = load_table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey") % 10).alias("a"),
        F.when(F.col("o_orderkey") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice")).alias("b"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus") == "F").alias("c"),
        F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")).alias("d"))
    num = ["a", "b", "c"]
    filled = FE.MedianImputer(inputCols=num).fit(o).transform(o)
    moded = FE.ModeImputer(inputCols=["d"]).fit(filled).transform(filled)
    scaled = FE.PopulationScaler(inputCols=["b"]).fit(moded).transform(moded.withColumn("b_raw", F.col("b")))
    return round_doubles(scaled)


def _train_and_score(spark, sf, estimator):
    from shopcast.plans.modules import fit_and_score
    sp, _, _ = _session_split(spark, sf)
    return fit_and_score(sp, "label", [*M3_DROP, M3_TARGET], "ga_session_id", estimator, stored=True)


@query("train_logistic")
def q_train_logistic(spark, sf):
    return round_doubles(metrics_record(_train_and_score(spark, sf, "logistic")[1]))


@query("train_forest")
def q_train_forest(spark, sf):
    return round_doubles(metrics_record(_train_and_score(spark, sf, "forest")[1]))


# Coefficients of the fixed linear session scorer (ours).
LINEAR_COEFFICIENTS = {"events_count": 0.05, "pageviews_count": 0.10, "add_to_cart_count": 0.30,
                       "unique_items_viewed": 0.02, "is_mobile": -0.20, "bounce": -0.50}
LINEAR_INTERCEPT = -2.0


@query("score_linear")
def q_score_linear(spark, sf):
    s = sessions(web_events(spark, sf))
    p = M.linear_score(LINEAR_COEFFICIENTS, LINEAR_INTERCEPT)
    return round_doubles(s.select("ga_session_id", p.alias("probability"))
                          .withColumn("prediction", (F.col("probability") >= 0.5).cast("int")))


@query("model_roundtrip")
def q_model_roundtrip(spark, sf):
    """IO5: a saved and reloaded session model scores every session at its stored threshold."""
    model, scores, p = _train_and_score(spark, sf, "logistic")
    record = metrics_record(scores).first().asDict()
    path = scratch_dir(spark, "model")
    M.save_bundle(M.Bundle(model, record["threshold"], M3_TARGET, "logistic_regression", p.numeric, p.categorical, p.schema, record), path)
    s, _, _ = _session_frame(spark, sf)
    return round_doubles(M.load_bundle(path).score(s).select("ga_session_id", F.col("probability").alias("p1"), "prediction"))


@query("scan_parquet")
def q_scan_parquet(spark, sf):
    li = load_table(spark, sf, "lineitem")
    return (li.filter((F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")) & (F.col("l_discount") > 0.05))
              .select("l_orderkey", "l_partkey", "l_extendedprice"))


ORDERS_CSV_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in
                                  ("o_orderkey", "o_orderpriority", "o_totalprice", "o_orderdate")])


@query("scan_csv_na_tokens")
def q_scan_csv(spark, sf):
    from shopcast.functions.cleaning import parse_number, parse_timestamp
    o = load_table(spark, sf, "orders")
    text = F.when(F.col("o_orderstatus") == "P", F.lit("NA")).when(F.col("o_orderstatus") == "O", F.lit("null")) \
            .otherwise(F.col("o_orderpriority"))
    path = scratch_dir(spark, "orders-csv")
    IO.write_csv(o.select(F.col("o_orderkey").cast("string"), text.alias("o_orderpriority"),
                          F.col("o_totalprice").cast("string"), F.col("o_orderdate").cast("string")), path)
    back = IO.read_csv(spark, path, ORDERS_CSV_SCHEMA)
    return round_doubles(back.select(F.col("o_orderkey").cast("long"), "o_orderpriority",
                                     parse_number("o_totalprice").alias("o_totalprice"),
                                     parse_timestamp("o_orderdate").cast("timestamp_ntz").alias("o_orderdate")))


@query("sink_split_parquet")
def q_sink_split(spark, sf):
    f = S.temporal_split(m1_features(spark, sf), "date", 0.8)
    path = scratch_dir(spark, "m1-split")
    IO.write_split_parquet(f.select("stock_code", "date", "will_sell_next_7d", "split"), path)
    back = IO.read_split(spark, path)
    return round_doubles(back.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"),
                                                   F.avg("will_sell_next_7d").alias("positive_rate")))


@query("metrics_json")
def q_metrics_json(spark, sf):
    from shopcast.sources.adapters import scored
    path = scratch_dir(spark, "metrics")
    IO.write_metrics_json(round_doubles(metrics_record(scored(spark, sf))), path)
    back = spark.read.json(path)
    return back.select(*[F.col(c) for c in sorted(back.columns)])


PRODUCT_RECORD = T.StructType([
    T.StructField("product_id", T.LongType()), T.StructField("price", T.DoubleType()),
    T.StructField("discount_pct", T.DoubleType()), T.StructField("stock", T.IntegerType()),
    T.StructField("images_count", T.IntegerType()), T.StructField("description_length", T.IntegerType()),
    T.StructField("featured", T.IntegerType()), T.StructField("payment_settings_enabled", T.IntegerType()),
    T.StructField("plan_id", T.StringType()), T.StructField("business_category_slug", T.StringType()),
])


@query("score_stream")
def q_score_stream(spark, sf):
    inbox, out, ckpt = (scratch_dir(spark, n) for n in ("inbox", "stream-out", "stream-ckpt"))
    product_facts(spark, sf).write.mode("overwrite").parquet(inbox)
    q = start_scoring(spark, inbox, PRODUCT_RECORD, "sales", "product_id", out, ckpt,
                      available_now=True)
    q.awaitTermination()
    preds = spark.read.parquet(f"{out}/predictions")
    return preds.select("product_id", "probability", "prediction", "label", "threshold",
                        F.array_join("recommendations", "|").alias("recommendations"))
