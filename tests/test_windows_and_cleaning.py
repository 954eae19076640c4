"""Edge fixtures of FIXTURES.md section 4 for windows, aggregates and parsers."""

import datetime as dt

from pyspark.sql import functions as F

from shopcast.functions.cleaning import parse_number
from shopcast.operators.aggregates import session_rollup
from shopcast.operators.windows import forward_label, forward_sum, product_windows, trailing_sum
from shopcast.plans.sales import product_day_features


def _days(spark, qty, key="p"):
    d0 = dt.date(2024, 1, 1)
    rows = [(key, d0 + dt.timedelta(days=i), float(q)) for i, q in enumerate(qty)]
    return spark.createDataFrame(rows, "k string, d date, q double")


def test_forward_sum_row_semantics(spark):
    df = _days(spark, [1, 0, 0, 0, 0, 0, 0, 0, 0, 5])
    out = df.select("d", forward_sum("q", 7, "k", "d").alias("f"), forward_label("q", 7, "k", "d").alias("y")) \
        .orderBy("d").collect()
    assert [r["f"] for r in out] == [0, 0, 5, 5, 5, 5, 5, 5, 5, None]
    assert [r["y"] for r in out] == [0, 0, 1, 1, 1, 1, 1, 1, 1, 0]


def test_calendar_gap_is_row_window(spark):
    rows = [("p", dt.date(2024, 1, 1), 1.0), ("p", dt.date(2024, 1, 2), 2.0), ("p", dt.date(2024, 7, 19), 4.0)]
    df = spark.createDataFrame(rows, "k string, d date, q double")
    got = [r[0] for r in df.select(trailing_sum("q", 7, "k", "d")).orderBy(F.col("d")).collect()]
    assert sorted(got) == [1.0, 3.0, 7.0]


def _lines(spark, rows):
    return spark.createDataFrame(rows, "invoice_no string, stock_code long, description string, quantity double, "
                                       "invoice_date timestamp, unit_price double, customer_id long")


def test_one_row_product_and_never_sold(spark):
    t = dt.datetime(2024, 1, 1, 10)
    rows = [("1", 1, "abc", 3.0, t, 2.0, 7)] + \
           [("C2", 2, "xyz", -1.0, t + dt.timedelta(days=i), 2.0, None) for i in range(3)]
    f = {r["stock_code"]: r for r in product_day_features(_lines(spark, rows), trim=False).collect()}
    assert f[1]["will_sell_next_7d"] == 0 and f[1]["product_sales_7d"] == 3.0
    assert f[2]["sold_qty"] == 0.0 and f[2]["product_last_sale_days_ago"] == 999
    assert f[2]["cancelled_rows"] == 1 and f[2]["unique_buyers"] == 1   # null buyer -> -1 counts once


def test_null_session_and_device(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, None, 5, "US", None, "page_view", 1, t), (2, None, 5, "US", None, "purchase", 2, t),
            (3, 10, 6, None, None, "page_view", 3, t), (4, 10, 7, "ES", "MOBILE app", "purchase", 3, t)]
    ev = spark.createDataFrame(rows, "event_id long, ga_session_id long, user_id long, country string, "
                                     "device string, type string, item_id long, date timestamp")
    out = session_rollup(ev).collect()
    assert len(out) == 1
    r = out[0]
    assert (r["user_id"], r["country"], r["device"], r["is_mobile"]) == (6, "ES", "MOBILE app", 1)
    assert (r["events_count"], r["unique_items_viewed"], r["high_conversion_session"], r["bounce"]) == (2, 1, 1, 1)


def test_null_device_not_mobile(spark):
    t = dt.datetime(2024, 1, 1)
    ev = spark.createDataFrame([(1, 1, 1, "US", None, "page_view", 1, t)],
                               "event_id long, ga_session_id long, user_id long, country string, "
                               "device string, type string, item_id long, date timestamp")
    assert session_rollup(ev).first()["is_mobile"] == 0


def test_number_parsing(spark):
    df = spark.createDataFrame([(" ",), ("7.5 ",), ("NaN",), ("x",)], "s string")
    assert [r[0] for r in df.select(parse_number("s")).collect()] == [None, 7.5, None, None]


def test_windows_share_one_window_node(spark):
    df = _days(spark, [1, 2, 3]).withColumnsRenamed({"k": "stock_code", "d": "date", "q": "sold_qty"}) \
        .withColumns({"revenue": F.lit(1.0), "unique_buyers": F.lit(1), "cancelled_rows": F.lit(0),
                      "rows": F.lit(1)})
    plan = product_windows(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_calendar_frame_option(spark):
    rows = [("p", dt.date(2024, 1, 1), 1.0), ("p", dt.date(2024, 1, 2), 2.0), ("p", dt.date(2024, 7, 19), 4.0)]
    df = spark.createDataFrame(rows, "k string, d date, q double")
    got = df.select("d", trailing_sum("q", 7, "k", "d", frame="calendar").alias("s")).orderBy("d").collect()
    assert [r["s"] for r in got] == [1.0, 3.0, 4.0]
    fwd = df.select("d", forward_label("q", 7, "k", "d", frame="calendar").alias("y")).orderBy("d").collect()
    assert [r["y"] for r in fwd] == [1, 0, 0]


def test_drop_null_rows(spark):
    from shopcast.operators.cleaning import drop_null_rows
    df = spark.createDataFrame([(1, None), (2, 1.0)], "k int, v double")
    assert [r["k"] for r in drop_null_rows(df, "v").collect()] == [2]


def test_approx_buyers_drops_the_distinct_exchange(spark):
    from shopcast.plans.sales import product_day_from_tables
    from shopcast.sources.adapters import product_texts, sales_lines
    from conftest import SF001
    exact = product_day_from_tables(sales_lines(spark, SF001, with_description=False), product_texts(spark, SF001))
    approx = product_day_from_tables(sales_lines(spark, SF001, with_description=False), product_texts(spark, SF001),
                                     approx_buyers=True)
    count = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(stock_code")
    assert count(approx) == count(exact) - 1
    assert approx.count() == exact.count()
