"""Queries of the preparation steps: sessions (A9-A13), parsing and cleaning
(C1-C15), calendar (T1-T4)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopcast.functions import cleaning as C
from shopcast.functions.calendar import calendar_columns
from shopcast.operators import aggregates as A
from shopcast.operators.cleaning import drop_if_present, drop_required_nulls, trim_incomplete_future, with_constants
from shopcast.plans.catalog import query, round_doubles
from shopcast.plans.queries_m1 import m1_daily, m1_features
from shopcast.plans.sales import M1_CONSTANTS, M1_DROP, clean_lines, product_day
from shopcast.plans.sessions import session_features, sessions
from shopcast.session import scratch_dir
from shopcast.sources import files as IO
from shopcast.sources.adapters import sales_lines, web_events
from shopcast.sources.tables import load_table


@query("session_rollup")
def q_session_rollup(spark, sf):
    return sessions(web_events(spark, sf))


@query("bounce_rate")
def q_bounce_rate(spark, sf):
    s = sessions(web_events(spark, sf))
    return round_doubles(s.groupBy("device").agg(F.count(F.lit(1)).alias("sessions"),
                                                 F.avg("bounce").alias("bounce_rate"),
                                                 F.avg("high_conversion_session").alias("conversion_rate")))


@query("event_flags")
def q_event_flags(spark, sf):
    return A.event_flags(web_events(spark, sf)).select("event_id", "is_purchase", "is_pageview", "is_add_to_cart")


@query("contains_ci")
def q_contains_ci(spark, sf):
    return web_events(spark, sf).select("event_id", "device", C.contains_ci("device", "mobile").alias("is_mobile"))


@query("drop_required_nulls")
def q_drop_required(spark, sf):
    return drop_required_nulls(web_events(spark, sf), ["device"]).select("event_id", "device", "type")


@query("fill_null_constants")
def q_fill_null(spark, sf):
    ev = web_events(spark, sf)
    return ev.select("event_id", C.fill_text("device").alias("device"), C.fill_id("item_id").alias("item_id"))


@query("parse_ts_coerce")
def q_parse_ts(spark, sf):
    o = load_table(spark, sf, "orders")
    text = F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).otherwise(F.col("o_orderdate").cast("string"))
    return o.select("o_orderkey", C.parse_timestamp(text).cast("timestamp_ntz").alias("order_ts"))


@query("parse_num_coerce")
def q_parse_num(spark, sf):
    li = load_table(spark, sf, "lineitem")
    text = (F.when(F.col("l_linestatus") == "O", F.concat(F.lit(" "), F.col("l_tax").cast("string"), F.lit(" ")))
             .otherwise(F.col("l_returnflag")))
    return li.select("l_orderkey", "l_linenumber", C.parse_number(text).alias("tax"))


@query("map_binary_label")
def q_map_binary(spark, sf):
    o = load_table(spark, sf, "orders")
    text = (F.when(F.col("o_orderstatus") == "F", "Yes").when(F.col("o_orderstatus") == "O", "No")
             .otherwise(F.col("o_orderstatus")))
    return o.select("o_orderkey", C.map_binary(text, strict=False).alias("label"))


@query("map_binary_strict")
def q_map_binary_strict(spark, sf):
    """C9 as the reference has it: an unmapped value is an error."""
    o = load_table(spark, sf, "orders").filter(F.col("o_orderstatus").isin("F", "O"))
    text = F.when(F.col("o_orderstatus") == "F", "Yes").otherwise("No")
    return o.select("o_orderkey", C.map_binary(text).alias("label"))


@query("csv_product_day")
def q_csv_product_day(spark, sf):
    """IO2 into C1-C7 and A1: the invoice lines as a CSV file, read as text, cleaned and aggregated."""
    lines = sales_lines(spark, sf)
    path = scratch_dir(spark, "lines-csv")
    IO.write_csv(lines.select([F.col(c).cast("string").alias(c) for c in lines.columns]), path)
    back = IO.read_csv(spark, path, T.StructType([T.StructField(c, T.StringType()) for c in lines.columns]))
    typed = back.withColumns({"stock_code": F.col("stock_code").try_cast("long")})
    return round_doubles(product_day(typed))


@query("flag_cancelled")
def q_flag_cancelled(spark, sf):
    return clean_lines(sales_lines(spark, sf)).select("invoice_no", "stock_code", "quantity", "is_cancel")


@query("line_total")
def q_line_total(spark, sf):
    return round_doubles(clean_lines(sales_lines(spark, sf)).select("invoice_no", "stock_code", "line_total"))


@query("floor_day")
def q_floor_day(spark, sf):
    return clean_lines(sales_lines(spark, sf)).select("invoice_no", "stock_code", "invoice_date", "date")


@query("avg_text_length")
def q_avg_text_length(spark, sf):
    return A.avg_text_length(clean_lines(sales_lines(spark, sf)), ["stock_code"], "description")


@query("calendar_features")
def q_calendar(spark, sf):
    o = load_table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"))
    return o.withColumns(calendar_columns("date"))


@query("constant_defaults")
def q_constants(spark, sf):
    d = m1_daily(spark, sf).select("stock_code", "date")
    return with_constants(d, M1_CONSTANTS)


@query("trim_incomplete_future")
def q_trim(spark, sf):
    return trim_incomplete_future(m1_daily(spark, sf).select("stock_code", "date"), "date", 7)


@query("feature_projection")
def q_feature_projection(spark, sf):
    return round_doubles(drop_if_present(m1_features(spark, sf), M1_DROP))


@query("session_feature_projection")
def q_session_features(spark, sf):
    """C11 for M3: the session table without ids and leakage columns (label kept)."""
    return session_features(web_events(spark, sf))
