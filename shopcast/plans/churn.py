"""M2: orders -> customer table as of a cutoff with the forward churn label.

Features use orders up to the cutoff (X1 semantics); the label says whether
the customer places no order in the ``horizon`` days after it.  The cutoff is
the latest date minus ``horizon``, so every order is either a feature or a
label; both come from one conditional ``groupBy`` per customer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopcast.functions.cleaning import money_mean

from shopcast.operators.entities import _map
from shopcast.sources.adapters import PAYMENT_BY_SEGMENT

TARGET = "will_churn_30d"


def churn_table(orders: DataFrame, customers: DataFrame, horizon: int = 30) -> DataFrame:
    """Customers with at least one order up to the cutoff = max(order date) - ``horizon`` days."""
    latest = orders.select(F.max("o_orderdate")).scalar()
    cutoff = F.to_date(latest) - F.expr(f"INTERVAL {horizon} DAYS")
    past = F.to_date("o_orderdate") <= cutoff
    by = orders.groupBy("o_custkey").agg(
        F.max(F.when(past, F.to_date("o_orderdate"))).alias("last_order"),
        F.count_if(past & (F.col("o_orderstatus") == "F")).cast("int").alias("total_orders_paid"),
        (money_mean(F.when(past, F.col("o_totalprice"))) / F.lit(1000.0)).alias("avg_order_value"),
        F.avg(F.when(past, F.when(F.col("o_orderstatus") == "P", 1.0).otherwise(0.0))).alias("cancellation_rate"),
        F.count_if(~past).alias("_next")).filter(F.col("last_order").isNotNull())
    c = customers.select("c_custkey", "c_mktsegment", "c_acctbal")
    return (by.join(c, by.o_custkey == c.c_custkey)
              .select(F.col("o_custkey").alias("customer_id"),
                      F.datediff(cutoff, F.col("last_order")).alias("days_since_last_order"),
                      "total_orders_paid", "avg_order_value", "cancellation_rate",
                      F.col("c_acctbal").alias("account_balance"),
                      _map("c_mktsegment", PAYMENT_BY_SEGMENT).alias("preferred_payment_method"),
                      F.when(F.col("_next") == 0, 1).otherwise(0).alias(TARGET)))
