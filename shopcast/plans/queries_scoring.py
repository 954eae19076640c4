"""Queries of the scorecards (R1-R12, T8), entity builders (X1-X5), request
handling (C14, C17-C20) and reports (K1-K3, A17, A18, E10) over entity tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopcast.functions.scorecards import (CARDS, DESIGN_PLAN_BONUS, SALES_PLAN_BONUS, UNKNOWN_PLAN_BONUS,
                                           confidence_band, plan_bonus)
from shopcast.operators import aggregates as A
from shopcast.operators import entities as X
from shopcast.operators import reports as K
from shopcast.operators.cleaning import align_columns, validate_split
from shopcast.operators.metrics import kpi_strip
from shopcast.operators.scoring import predict, prepare, score
from shopcast.plans.catalog import query, round_doubles
from shopcast.sources.tables import load_table

ENTITY = {
    "sales": (X.product_facts, "product_id"),
    "churn": (X.customer_features, "customer_id"),
    "design": (X.store_facts, "store_id"),
    "growth": (X.content_facts, "account_id"),
}


def scored_entities(spark, sf, kind):
    build, key = ENTITY[kind]
    ok, _ = prepare(build(spark, sf), kind)
    return score(ok, kind), key


def _register_entity(name, build):
    query(name)(lambda spark, sf: round_doubles(build(spark, sf)))


_register_entity("customer_features", X.customer_features)
_register_entity("product_facts", X.product_facts)
_register_entity("store_facts", X.store_facts)
_register_entity("content_facts", X.content_facts)


def _register_card(kind):
    def q_score(spark, sf):
        s, key = scored_entities(spark, sf, kind)
        return s.select(key, "probability", "prediction")

    def q_recommend(spark, sf):
        s, key = scored_entities(spark, sf, kind)
        return s.select(key, F.array_join("recommendations", "|").alias("recommendations"))

    def q_predict(spark, sf):
        build, key = ENTITY[kind]
        out, _ = predict(build(spark, sf), kind, key)
        return out.withColumn("recommendations", F.array_join("recommendations", "|"))

    query(f"score_{kind}")(q_score)
    query(f"recommend_{kind}")(q_recommend)
    query(f"predict_{kind}")(q_predict)


for _kind in ("sales", "churn", "design", "growth"):
    _register_card(_kind)


@query("confidence_band")
def q_confidence_band(spark, sf):
    s, key = scored_entities(spark, sf, "sales")
    return s.select(key, "probability", confidence_band().alias("confidence"))


@query("plan_bonus")
def q_plan_bonus(spark, sf):
    p = X.product_facts(spark, sf)
    return p.select("product_id", "plan_id",
                    plan_bonus("plan_id", SALES_PLAN_BONUS, UNKNOWN_PLAN_BONUS).alias("sales_plan_bonus"),
                    plan_bonus("plan_id", DESIGN_PLAN_BONUS, UNKNOWN_PLAN_BONUS).alias("design_plan_bonus"))


@query("apply_defaults")
def q_apply_defaults(spark, sf):
    ok, bad = prepare(X.customer_features(spark, sf), "churn")
    return round_doubles(ok.unionByName(bad.drop("errors")))


@query("validate_split")
def q_validate_split(spark, sf):
    ok, bad = prepare(X.customer_features(spark, sf), "churn")
    return (ok.select("customer_id", F.lit("valid").alias("status"), F.lit("").alias("errors"))
              .unionByName(bad.select("customer_id", F.lit("rejected").alias("status"),
                                      F.array_join("errors", "|").alias("errors"))))


@query("derive_total_spent")
def q_derive_total_spent(spark, sf):
    ok, _ = prepare(X.customer_features(spark, sf), "churn")
    return round_doubles(ok.select("customer_id",
                                   (F.col("total_orders_paid") * F.col("avg_order_value")).alias("total_spent"),
                                   F.lit(1).alias("registered")))


SALES_MODEL_SCHEMA = T.StructType([
    T.StructField("price", T.DoubleType()), T.StructField("discount_pct", T.DoubleType()),
    T.StructField("stock", T.IntegerType()), T.StructField("images_count", T.IntegerType()),
    T.StructField("description_length", T.IntegerType()), T.StructField("featured", T.IntegerType()),
    T.StructField("has_specifications", T.IntegerType()), T.StructField("plan_id", T.StringType()),
    T.StructField("business_category_slug", T.StringType()),
])


@query("align_columns")
def q_align_columns(spark, sf):
    return round_doubles(align_columns(X.product_facts(spark, sf), SALES_MODEL_SCHEMA))


@query("filter_isin")
def q_filter_isin(spark, sf):
    p = X.product_facts(spark, sf)
    return round_doubles(p.filter(F.col("plan_id").cast("string").isin("basic", "pro")))


@query("store_report")
def q_store_report(spark, sf):
    return round_doubles(K.store_report(spark, sf))


@query("top_products")
def q_top_products(spark, sf):
    s, key = scored_entities(spark, sf, "sales")
    return K.top_n(s.select(key, "probability", "prediction"), "probability", key, 20)


@query("top_risk_customers")
def q_top_risk(spark, sf):
    s, key = scored_entities(spark, sf, "churn")
    return K.top_n(s.select(key, "probability", "prediction"), "probability", key, 50)


@query("top_filtered")
def q_top_filtered(spark, sf):
    s, key = scored_entities(spark, sf, "sales")
    return K.top_filtered(s, "probability", key, 20, category="business_category_slug", plan="plan_id",
                          n_categories=3).select(key, "business_category_slug", "plan_id", "probability")


@query("top_filtered_plans")
def q_top_filtered_plans(spark, sf):
    """K3 with the plan filter."""
    s, key = scored_entities(spark, sf, "sales")
    return K.top_filtered(s, "probability", key, 20, category="business_category_slug", plan="plan_id",
                          n_categories=3, plans=["basic", "pro"]).select(key, "business_category_slug", "plan_id", "probability")


@query("validate_types")
def q_validate_types(spark, sf):
    """C19 on text requests: missing and ill-typed fields."""
    p = load_table(spark, sf, "part")
    text = p.select(F.col("p_partkey").alias("product_id"),
                    F.when(F.col("p_partkey") % 7 == 0, "n/a").when(F.col("p_partkey") % 11 == 0, F.lit(None))
                     .otherwise(F.col("p_retailprice").cast("string")).alias("price"),
                    F.when(F.col("p_partkey") % 5 == 0, "2.5").otherwise(F.col("p_size").cast("string")).alias("stock"))
    ok, bad = validate_split(text, ["price"], {"price": "double", "stock": "int"})
    return (ok.select("product_id", F.lit("").alias("errors"))
              .unionByName(bad.select("product_id", F.array_join("errors", "|").alias("errors"))))


@query("distinct_sorted")
def q_distinct_sorted(spark, sf):
    return A.distinct_sorted(X.product_facts(spark, sf), "business_category_slug")


@query("histogram_40")
def q_histogram(spark, sf):
    s, _ = scored_entities(spark, sf, "sales")
    return round_doubles(A.histogram(s, "probability", 40))


@query("kpi_strip")
def q_kpi_strip(spark, sf):
    s, _ = scored_entities(spark, sf, "sales")
    return round_doubles(kpi_strip(s, CARDS["sales"].threshold, "probability"))
