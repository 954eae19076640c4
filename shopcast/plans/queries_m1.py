"""Queries of module 1 (sales): cleaning, product-day aggregate, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from shopcast.operators.windows import days_since_last, forward_sum, trailing_mean, trailing_sum
from shopcast.plans.catalog import query, round_doubles
from shopcast.plans.sales import features_from_daily, product_day, product_day_from_tables
from shopcast.sources.adapters import product_texts, sales_lines

K, D = "stock_code", "date"


def m1_daily(spark, sf):
    """Product-day table of the test tables: text attached per product after A1."""
    return product_day_from_tables(sales_lines(spark, sf, with_description=False), product_texts(spark, sf))


def m1_features(spark, sf, trim: bool = True):
    return features_from_daily(m1_daily(spark, sf), trim)


@query("product_day_agg")
def q_product_day_agg(spark, sf):
    return round_doubles(product_day(sales_lines(spark, sf)))


@query("rolling_sales")
def q_rolling_sales(spark, sf):
    d = m1_daily(spark, sf)
    return round_doubles(d.select(K, D,
                                  trailing_sum("sold_qty", 7, K, D).alias("product_sales_7d"),
                                  trailing_sum("sold_qty", 30, K, D).alias("product_sales_30d")))


@query("rolling_revenue")
def q_rolling_revenue(spark, sf):
    d = m1_daily(spark, sf)
    return round_doubles(d.select(K, D,
                                  trailing_sum("revenue", 7, K, D).alias("product_revenue_7d"),
                                  trailing_sum("revenue", 30, K, D).alias("product_revenue_30d")))


@query("rolling_buyers")
def q_rolling_buyers(spark, sf):
    d = m1_daily(spark, sf)
    return round_doubles(d.select(K, D, trailing_mean("unique_buyers", 30, K, D)
                                  .alias("product_unique_buyers_30d")))


@query("rolling_cancel_rate")
def q_rolling_cancel_rate(spark, sf):
    d = m1_features(spark, sf, trim=False)
    return round_doubles(d.select(K, D, "product_cancelled_rate_30d"))


@query("days_since_last_sale")
def q_days_since(spark, sf):
    d = m1_daily(spark, sf)
    return d.select(K, D, days_since_last(F.col("sold_qty") > 0, K, D).alias("product_last_sale_days_ago"))


@query("forward_sum")
def q_forward_sum(spark, sf):
    d = m1_daily(spark, sf)
    return round_doubles(d.select(K, D, forward_sum("sold_qty", 7, K, D).alias("sold_next_7d")))


@query("forward_label")
def q_forward_label(spark, sf):
    return round_doubles(m1_features(spark, sf))


@query("rolling_sales_calendar")
def q_rolling_sales_calendar(spark, sf):
    """W1 with calendar-day frames (the option beside the reference's row frames)."""
    d = m1_daily(spark, sf)
    return round_doubles(d.select(K, D,
                                  trailing_sum("sold_qty", 7, K, D, frame="calendar").alias("sales_7_days"),
                                  trailing_sum("sold_qty", 30, K, D, frame="calendar").alias("sales_30_days")))
