"""M1: invoice lines -> product-day features with the 7-day forward label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopcast.functions.calendar import calendar_columns
from shopcast.functions.cleaning import fill_id, fill_text, floor_day, is_cancelled, parse_number
from shopcast.operators.aggregates import product_day_agg
from shopcast.operators.cleaning import drop_required_nulls, trim_incomplete_future, with_constants
from shopcast.operators.windows import product_windows

TARGET = "will_sell_next_7d"

# The constant product attributes the invoice data lacks.
M1_CONSTANTS = {
    "featured": 0,
    "images_count": 1,
    "has_specifications": 0,
    "discount_pct": 0.0,
    "stock": -1,
    "plan_id": "basic",
    "business_type_slug": "store",
    "business_category_slug": "retail",
    "payment_settings_enabled": 1,
    "has_whatsapp": 1,
}

# Columns that never enter the model (ids, leakage, raw sums) - C11.
M1_DROP = ["stock_code", "date", "sold_qty", "revenue", "cancelled_qty", "cancelled_rows",
           "rows", "unique_buyers", TARGET]


def clean_lines(lines: DataFrame) -> DataFrame:
    """C1-C7 on raw invoice lines (types coerced, bad rows dropped, flags added)."""
    typed = lines
    if dict(lines.dtypes).get("invoice_date") == "string":
        from shopcast.functions.cleaning import parse_timestamp
        typed = typed.withColumn("invoice_date", parse_timestamp("invoice_date"))
    typed = drop_required_nulls(typed, ["invoice_date", "stock_code", "invoice_no"])
    typed = typed.withColumns({
        "description": fill_text("description"),
        "customer_id": fill_id("customer_id"),
        "unit_price": parse_number("unit_price") if dict(lines.dtypes).get("unit_price") == "string"
        else F.nanvl(F.col("unit_price").cast("double"), F.lit(None).cast("double")),
        "quantity": parse_number("quantity") if dict(lines.dtypes).get("quantity") == "string"
        else F.nanvl(F.col("quantity").cast("double"), F.lit(None).cast("double")),
    })
    typed = drop_required_nulls(typed, ["unit_price", "quantity"])
    return typed.withColumns({
        "is_cancel": is_cancelled("invoice_no", "quantity"),
        "line_total": F.col("quantity") * F.col("unit_price"),
        "date": floor_day("invoice_date"),
    })


def product_day(lines: DataFrame, approx_buyers: bool = False) -> DataFrame:
    """A1 on cleaned lines (``approx_buyers``: HyperLogLog instead of an exact distinct count)."""
    return product_day_agg(clean_lines(lines), approx_buyers=approx_buyers)


DAILY_COLUMNS = ["stock_code", "date", "price", "description_length", "sold_qty", "revenue", "cancelled_qty",
                 "cancelled_rows", "rows", "unique_buyers"]


def product_day_from_tables(lines_without_text: DataFrame, texts: DataFrame,
                            approx_buyers: bool = False) -> DataFrame:
    """A1 when the description is a product attribute (one text per stock code).

    The mean text length of a product-day is then the product's text length,
    so the text joins the aggregated product-days instead of every raw line.
    That saves a shuffle of the line table when the text table is too big to
    broadcast, and the join's partitioning by product serves the window next.
    """
    daily = product_day_agg(clean_lines(lines_without_text), text=None, approx_buyers=approx_buyers)
    lengths = texts.select("stock_code", F.length("description").alias("_len"))
    return (daily.join(lengths, "stock_code", "left")
                 .withColumn("description_length", F.coalesce(F.col("_len"), F.lit(0)))
                 .select(*DAILY_COLUMNS))


def features_from_daily(daily: DataFrame, trim: bool = True) -> DataFrame:
    """W1-W7 -> T1-T4 -> C12 -> (C16, a no-op) -> C15 on a product-day table.

    The window runs over already-aggregated rows (at most one per product and
    day), so a product that owns a third of all lines still gives a bounded
    window partition.
    """
    # C16 (keep rows whose 30-row sum is not null) is a proven no-op here: the
    # frame always holds the current row and sold_qty is never null.  Leaving
    # it out of the plan lets Catalyst prune the window from passes that only
    # need the surviving rows (e.g. the per-date counts of the temporal split);
    # the oracle SQL keeps the filter, so the equivalence stays checked.
    feats = (product_windows(daily, target=TARGET)
             .withColumns(calendar_columns("date"))
             .transform(lambda d: with_constants(d, M1_CONSTANTS)))
    # The latest date of ``daily`` is the latest date of ``feats``, so the
    # trim's scalar subquery needs no window.
    return trim_incomplete_future(feats, "date", 7, dates_from=daily) if trim else feats


def product_day_features(lines: DataFrame, trim: bool = True, approx_buyers: bool = False) -> DataFrame:
    """Full M1 table from raw invoice lines (per-line text)."""
    return features_from_daily(product_day(lines, approx_buyers), trim)
