"""Entity feature builders X1-X5: operational tables -> scorecard inputs.

Every builder pre-aggregates the large table on its own key before joining the
entity table, so joins see one row per entity.  As-of dates are scalar
subqueries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopcast.functions.cleaning import money_mean

from shopcast.sources.adapters import PAYMENT_BY_SEGMENT, PLANS, pick
from shopcast.sources.tables import load_table


def _map(col: str, mapping: dict[str, str]) -> F.Column:
    expr = None
    for k, v in mapping.items():
        expr = F.when(F.col(col) == k, F.lit(v)) if expr is None else expr.when(F.col(col) == k, F.lit(v))
    return expr


def customer_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recency, paid orders, mean order value (thousands), cancellation share, visits."""
    orders = load_table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    asof = F.to_date(orders.select(F.max("o_orderdate")).scalar())
    per_cust = orders.groupBy("o_custkey").agg(
        F.max("o_orderdate").alias("last_order"),
        F.count_if(F.col("o_orderstatus") == "F").cast("int").alias("total_orders_paid"),
        (money_mean("o_totalprice") / F.lit(1000.0)).alias("avg_order_value"),
        F.avg(F.when(F.col("o_orderstatus") == "P", 1.0).otherwise(0.0)).alias("cancellation_rate"))
    events = load_table(spark, sf_dir, "events").select("user_id", "event_type")
    visits = (events.filter(F.col("event_type") == "view").groupBy("user_id")
                    .agg(F.count(F.lit(1)).cast("int").alias("profile_visits_count")))
    cust = load_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return (cust.join(per_cust, cust.c_custkey == per_cust.o_custkey, "left")
                .join(visits, cust.c_custkey == visits.user_id, "left")
                .select(F.col("c_custkey").alias("customer_id"),
                        F.datediff(asof, F.to_date("last_order")).alias("days_since_last_order"),
                        "total_orders_paid", "avg_order_value", "cancellation_rate", "profile_visits_count",
                        _map("c_mktsegment", PAYMENT_BY_SEGMENT).alias("preferred_payment_method")))


def supplier_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(supplier, part) pairs of the order lines with the largest discount.

    Shared by the store record and the store report, so a plan that needs
    both reuses one exchange.
    """
    li = load_table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_discount")
    return li.groupBy("l_suppkey", "l_partkey").agg(F.max("l_discount").alias("max_disc"))


def product_facts(spark: SparkSession, sf_dir: str, pairs: DataFrame | None = None) -> DataFrame:
    """Product record for the sales scorecard from part and its order lines.

    ``pairs`` may pass a materialised ``supplier_parts`` shared with other builders.
    """
    # distinct suppliers and the largest discount per part come from the
    # (supplier, part) aggregate the store record uses too: one line-table
    # aggregate serves products, stores and the store report
    per_part = (pairs if pairs is not None else supplier_parts(spark, sf_dir)).groupBy("l_partkey").agg(
        (F.max("max_disc") * F.lit(100.0)).alias("discount_pct"),
        F.count("l_suppkey").cast("int").alias("images_count"))
    part = load_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type",
                                                    "p_size", "p_retailprice")
    return (part.join(per_part, part.p_partkey == per_part.l_partkey, "left")
                .select(F.col("p_partkey").alias("product_id"),
                        (F.col("p_retailprice") / F.col("p_size")).alias("price"),
                        "discount_pct",
                        (F.pmod(F.col("p_size"), F.lit(20)) - 1).alias("stock"),
                        "images_count",
                        (F.length("p_name") * 40).alias("description_length"),
                        F.when(F.col("p_brand").endswith("1"), 1).otherwise(0).alias("featured"),
                        F.when(F.col("p_type") == "PROMO", 0).otherwise(1).alias("payment_settings_enabled"),
                        pick(F.col("p_partkey"), PLANS).alias("plan_id"),
                        F.lower("p_type").alias("business_category_slug")))


def store_facts(spark: SparkSession, sf_dir: str, pairs: DataFrame | None = None) -> DataFrame:
    """Store (supplier) record for the design scorecard.

    Lines collapse to (supplier, part) first; the store aggregate then sees one
    row per supplied product.
    """
    sp = pairs if pairs is not None else supplier_parts(spark, sf_dir)
    part = load_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    per_store = (sp.join(part, sp.l_partkey == part.p_partkey)
                   .groupBy("l_suppkey").agg(
                       F.count(F.lit(1)).cast("int").alias("total_products_active"),
                       F.avg(F.when(F.col("p_size") >= 10, 1.0).otherwise(0.0)).alias("products_with_image_pct"),
                       F.avg(F.when(F.length("p_name") >= 10, 1.0).otherwise(0.0)).alias("products_with_description_pct"),
                       F.avg(F.when(F.col("max_disc") >= 0.08, 1.0).otherwise(0.0)).alias("products_with_discount_pct"),
                       (F.avg("p_size") / F.lit(10.0)).alias("avg_images_per_product")))
    sup = load_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    return (sup.join(per_store, sup.s_suppkey == per_store.l_suppkey, "left")
               .select(F.col("s_suppkey").alias("store_id"),
                       F.when(F.col("s_acctbal") > 0, 1).otherwise(0).alias("payment_settings_enabled"),
                       F.when(F.col("s_acctbal") > 1000, 1).otherwise(0).alias("hero_has_cta"),
                       F.floor(F.col("s_nationkey") / 2).cast("int").alias("navigation_menu_items_count"),
                       "products_with_image_pct", "products_with_description_pct", "total_products_active",
                       "products_with_discount_pct", "avg_images_per_product",
                       pick(F.col("s_suppkey"), PLANS).alias("plan_id")))


def content_facts(spark: SparkSession, sf_dir: str, days: int = 30) -> DataFrame:
    """Content record per account (user) over the last ``days`` days.

    The mean gap between consecutive posts telescopes to (last - first) / (n - 1),
    so no per-user ordering is needed.
    """
    ev = load_table(spark, sf_dir, "events").select("user_id", "ts", "event_type", "value")
    latest = ev.select(F.max("ts")).scalar()
    recent = ev.filter(F.col("ts") > latest - F.expr(f"INTERVAL {days} DAYS"))
    t = F.col("event_type")
    post_ts = F.when(t == "click", F.col("ts"))      # timestamp_ntz: differences are zone-free
    g = recent.groupBy("user_id").agg(
        F.count_if(t == "click").cast("int").alias("posts_count_30d"),
        F.count_if(t == "view").cast("int").alias("stories_count_30d"),
        F.avg(F.when(t == "purchase", 1.0).otherwise(0.0)).alias("pct_posts_with_video"),
        (F.timestamp_diff("MICROSECOND", F.min(post_ts), F.max(post_ts)) / F.lit(86400e6)).alias("_span_days"),
        F.avg(F.when(t == "error", 1.0).otherwise(0.0)).alias("pct_1_2_star"),
        F.avg("value").alias("_mean_value"),
        F.count_if(t == "signup").alias("_signups"),
        F.count_if(t == "error").alias("_errors"),
        F.count_if(t == "purchase").alias("_purchases"))
    return g.select(
        F.col("user_id").alias("account_id"), "posts_count_30d", "stories_count_30d", "pct_posts_with_video",
        F.when(F.col("posts_count_30d") >= 2, F.col("_span_days") / (F.col("posts_count_30d") - 1))
         .alias("days_between_posts"),
        F.greatest(F.lit(1.0), F.least(F.lit(5.0), F.lit(5.5) - F.col("_mean_value") / F.lit(20.0))).alias("avg_rating"),
        "pct_1_2_star",
        (F.col("_mean_value") / F.lit(1000.0)).alias("post_engagement_rate"),
        F.when(F.col("_signups") > 0, 1).otherwise(0).alias("has_tiktok"),
        F.when(F.col("_errors") > F.col("_purchases"), 0).otherwise(1).alias("has_whatsapp"))
