"""Queries of the M2 (churn) and M4 (growth) chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from shopcast.operators import splits as S
from shopcast.operators.aggregates import rate_by_group
from shopcast.plans import churn, growth
from shopcast.plans.catalog import query, round_doubles
from shopcast.sources.tables import load_table


def _weeks(spark, sf):
    return growth.content_weeks(load_table(spark, sf, "events"))


@query("content_weeks")
def q_content_weeks(spark, sf):
    return round_doubles(_weeks(spark, sf))


@query("growth_split")
def q_growth_split(spark, sf):
    """M4: composite (store, week) 80/20 split, then the positive rate per split."""
    sp = S.ordered_split(_weeks(spark, sf), ["store_id", "week"], 0.8)
    return round_doubles(rate_by_group(sp, "split", [growth.TARGET]))


@query("churn_table")
def q_churn_table(spark, sf):
    return round_doubles(churn.churn_table(load_table(spark, sf, "orders"), load_table(spark, sf, "customer")))


@query("churn_split")
def q_churn_split(spark, sf):
    """M2: stratified 80/20 split by the churn label, class shares per split."""
    t = churn.churn_table(load_table(spark, sf, "orders"), load_table(spark, sf, "customer"))
    sp = S.stratified_split(t, churn.TARGET, "customer_id", 0.2, 42)
    return round_doubles(sp.groupBy("split", churn.TARGET).agg(F.count(F.lit(1)).alias("n_rows")))


def _m1_split(spark, sf):
    from shopcast.plans.queries_m1 import m1_features
    return S.temporal_split(m1_features(spark, sf).checkpoint(eager=True), "date", 0.8)


def _m1_exclude():
    from shopcast.plans.sales import M1_DROP, TARGET
    return TARGET, [c for c in M1_DROP if c != TARGET]


@query("module1_metrics")
def q_module1_metrics(spark, sf):
    """M1 training run: temporal split of the product-day table, balanced logistic, E9."""
    from shopcast.plans.modules import evaluate, fit_and_score
    target, exclude = _m1_exclude()
    _, scores, p = fit_and_score(_m1_split(spark, sf), target, exclude, "stock_code", stored=True)
    return round_doubles(evaluate(scores, p))


@query("module2_metrics")
def q_module2_metrics(spark, sf):
    """M2 training run: stratified split of the churn table, balanced logistic, E9."""
    from shopcast.plans.modules import evaluate, fit_and_score
    t = churn.churn_table(load_table(spark, sf, "orders"), load_table(spark, sf, "customer"))
    sp = S.stratified_split(t, churn.TARGET, "customer_id", 0.2, 42)
    _, scores, p = fit_and_score(sp, churn.TARGET, [], "customer_id", max_iter=3000)
    return round_doubles(evaluate(scores, p))


def _m4_split(spark, sf):
    sp = S.ordered_split(_weeks(spark, sf).checkpoint(eager=True), ["store_id", "week"], 0.8)
    return sp.withColumn("week_index", F.unix_date("week")).drop("week")


M4_EXCLUDE = [c for c in growth.M4_DROP if c != growth.TARGET]


@query("module4_champion")
def q_module4_champion(spark, sf):
    """M4 training run: (store, week) 80/20 split, logistic vs forest by AP (ML5, E4)."""
    from shopcast.plans.modules import champion, compare_models
    return round_doubles(champion(compare_models(_m4_split(spark, sf), growth.TARGET, M4_EXCLUDE, "store_id", stored=True)[0]))


@query("module4_report")
def q_module4_report(spark, sf):
    """M4 per-class reports of both models and the majority baseline (E8, ML6)."""
    from shopcast.plans.modules import compare_models
    return round_doubles(compare_models(_m4_split(spark, sf), growth.TARGET, M4_EXCLUDE, "store_id", stored=True)[1])


@query("train_class_weights")
def q_train_class_weights(spark, sf):
    """ML1 as training uses it: weights of the train rows of the M1 and M4 splits."""
    from shopcast.operators.models import train_class_weights
    m1 = train_class_weights(_m1_split(spark, sf), _m1_exclude()[0]).withColumnRenamed(_m1_exclude()[0], "label")
    m4 = train_class_weights(_m4_split(spark, sf), growth.TARGET).withColumnRenamed(growth.TARGET, "label")
    return round_doubles(m1.select(F.lit("m1").alias("module"), "*").unionByName(m4.select(F.lit("m4").alias("module"), "*")))


def _m1_bundle(spark, sf):
    from shopcast.operators.models import load_bundle, save_bundle
    from shopcast.plans.modules import bundle
    from shopcast.session import scratch_dir
    target, exclude = _m1_exclude()
    path = scratch_dir(spark, "m1-bundle")
    split = _m1_split(spark, sf)
    save_bundle(bundle(split, target, exclude, "stock_code", stored=True), path)
    return load_bundle(path), split


@query("bundle_metadata")
def q_bundle_metadata(spark, sf):
    """IO5: the record of a saved and reloaded M1 bundle."""
    from shopcast.operators.models import bundle_metadata
    return round_doubles(bundle_metadata(_m1_bundle(spark, sf)[0]))


@query("model_top_products")
def q_model_top_products(spark, sf):
    """ML4 + K2: the reloaded M1 bundle scores each product's last day, the 20 likeliest sellers first."""
    from pyspark.sql import Window

    from shopcast.operators.reports import top_n
    loaded, split = _m1_bundle(spark, sf)
    newest = Window.partitionBy("stock_code").orderBy(F.desc("date"))
    last = split.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n", "split")
    return round_doubles(top_n(loaded.score(last).select("stock_code", "date", "probability", "prediction"),
                               "probability", "stock_code", 20))
