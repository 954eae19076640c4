"""Adapters: shape the driver tables into the raw tables the modules consume.

Each adapter is a lazy projection/join over the given tables, so its work grows
attributes (device, country, plan, ...) are deterministic functions of ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopcast.sources.tables import load_table

# Fixed values used by the adapters (our own choice of vocabulary).
DEVICES = ("desktop", "Mobile Safari", "mobile", None)          # by user_id % 4
COUNTRIES = ("US", "ES", "MX")                                 # by user_id % 3
PLANS = ("free", "basic", "pro", "enterprise", "gold")          # by key % 5
PAYMENT_BY_SEGMENT = {
    "AUTOMOBILE": "cash", "BUILDING": "card", "FURNITURE": "transfer",
    "HOUSEHOLD": "cash", "MACHINERY": "card",
}
EVENT_TYPE_MAP = {"view": "page_view", "click": "add_to_cart", "purchase": "purchase"}


def pick(key, values) -> F.Column:
    """values[key % len(values)] as a CASE expression."""
    m = F.pmod(key, F.lit(len(values)))
    expr = None
    for i, v in enumerate(values):
        lit = F.lit(v).cast("string")
        expr = F.when(m == i, lit) if expr is None else expr.when(m == i, lit)
    return expr


def product_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product descriptions: (stock_code, description) from part."""
    return load_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("stock_code"),
                                                    F.col("p_name").alias("description"))


def sales_lines(spark: SparkSession, sf_dir: str, with_description: bool = True) -> DataFrame:
    """Invoice lines (M1 raw): lineitem + order customer (+ part name).

    invoice_no gets a 'C' prefix for returned lines, whose quantity is negative.
    ``with_description=False`` leaves the text out (null) for plans that attach
    it per product after aggregating (see ``plans.sales.product_day_from_tables``).
    """
    li = load_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate")
    od = load_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    ret = F.col("l_returnflag") == "R"
    joined = li.join(od, li.l_orderkey == od.o_orderkey, "left")
    if with_description:
        pt = load_table(spark, sf_dir, "part").select("p_partkey", "p_name")
        joined = joined.join(pt, li.l_partkey == pt.p_partkey, "left")
    else:
        joined = joined.withColumn("p_name", F.lit(None).cast("string"))
    return (joined
              .select(
                  F.concat(F.when(ret, F.lit("C")).otherwise(F.lit("")),
                           F.col("l_orderkey").cast("string")).alias("invoice_no"),
                  F.col("l_partkey").alias("stock_code"),
                  F.col("p_name").alias("description"),
                  F.when(ret, -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("quantity"),
                  F.col("l_shipdate").alias("invoice_date"),
                  (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
                  F.col("o_custkey").alias("customer_id"),
              ))


def web_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web events (M3 raw): one session per user and day."""
    ev = load_table(spark, sf_dir, "events")
    t = F.col("event_type")
    mapped = None
    for src, dst in EVENT_TYPE_MAP.items():
        mapped = (F.when(t == src, F.lit(dst)) if mapped is None
                  else mapped.when(t == src, F.lit(dst)))
    mapped = mapped.otherwise(t)
    return ev.select(
        "event_id",
        (F.col("user_id") * 100000 + F.unix_date(F.to_date("ts"))).alias("ga_session_id"),
        "user_id",
        pick(F.col("user_id"), COUNTRIES).alias("country"),
        pick(F.col("user_id"), DEVICES).alias("device"),
        mapped.alias("type"),
        F.get_json_object("props", "$.k").cast("long").alias("item_id"),
        F.col("ts").alias("date"),
        "value",
    )


def scored(spark: SparkSession, sf_dir: str, label: str = "quality") -> DataFrame:
    """(id, score, label) table for the evaluation operators.

    score = round(n_chars / (n_chars + 1000), 4); label is ``quality`` or ``toxic``.
    """
    lb = load_table(spark, sf_dir, "labels").select("doc_id", label)
    dc = load_table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return (lb.join(dc, "doc_id")
              .select("doc_id",
                      (F.round(F.col("n_chars") / (F.col("n_chars") + F.lit(1000.0)) * F.lit(1e4))
                       / F.lit(1e4)).alias("score"),
                      F.col(label).cast("int").alias("label")))
