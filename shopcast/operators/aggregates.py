"""Aggregations A1-A18.

All are single ``groupBy().agg()`` plans, so Spark runs a partial aggregate on
the map side before the shuffle; hot keys collapse to one row per task before
they travel.  At most one DISTINCT column per aggregate keeps the plan free of
an Expand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopcast.functions.cleaning import contains_ci, equals_flag
from shopcast.functions.calendar import day_of_week


def product_day_agg(lines: DataFrame, key: str = "stock_code", date: str = "date",
                    price: str = "unit_price", qty: str = "quantity", total: str = "line_total",
                    text: str | None = "description", cancel: str = "is_cancel",
                    invoice: str = "invoice_no", buyer: str = "customer_id",
                    approx_buyers: bool = False) -> DataFrame:
    """One row per (product, day) with price, text length, sales and buyers.

    ``text=None`` skips A3 (for plans that attach a per-product text length later).
    """
    q, lt = F.col(qty), F.col(total)
    buyers = (F.approx_count_distinct(buyer) if approx_buyers else F.count_distinct(buyer))
    text_len = ([F.avg(F.length(text)).cast("int").alias("description_length")]   # A3 (truncates)
                if text else [])
    return lines.groupBy(key, date).agg(
        F.avg(price).alias("price"),                                             # A2
        *text_len,
        F.coalesce(F.sum(F.when(q > 0, q)), F.lit(0.0)).alias("sold_qty"),        # A4
        F.coalesce(F.sum(F.when(lt > 0, lt)), F.lit(0.0)).alias("revenue"),       # A4
        F.coalesce(F.sum(F.when(q < 0, -q)), F.lit(0.0)).alias("cancelled_qty"),  # A5
        F.count_if(F.col(cancel)).alias("cancelled_rows"),                       # A6
        F.count(invoice).alias("rows"),                                          # A7
        buyers.alias("unique_buyers"),                                           # A8
    )


def avg_text_length(df: DataFrame, keys: list[str], text: str, out: str = "description_length") -> DataFrame:
    """A3 alone: truncated mean character length per group."""
    return df.groupBy(*keys).agg(F.avg(F.length(text)).cast("int").alias(out))


def first_in_order(value: str, order: str) -> F.Column:
    """A10: first non-null value in ``order`` (deterministic ``first``)."""
    return F.min_by(F.col(value), F.when(F.col(value).isNotNull(), F.col(order)))


def event_flags(events: DataFrame, type_col: str = "type") -> DataFrame:
    """One-hot flags of the event kinds used by the session rollup."""
    return events.withColumns({
        "is_purchase": equals_flag(type_col, "purchase"),
        "is_pageview": equals_flag(type_col, "page_view"),
        "is_add_to_cart": equals_flag(type_col, "add_to_cart"),
    })


def session_rollup(events: DataFrame, session: str = "ga_session_id", order: str = "event_id",
                   target: str = "high_conversion_session") -> DataFrame:
    """A9-A13 + T1/T2 + C13: web events -> one row per session.

    Rows without a session id are dropped (a null group does not exist in the
    reference).  ``first`` is the first non-null value in ``order``.
    """
    ev = event_flags(events).filter(F.col(session).isNotNull())
    s = ev.groupBy(session).agg(
        first_in_order("user_id", order).alias("user_id"),
        first_in_order("country", order).alias("country"),
        first_in_order("device", order).alias("device"),
        F.count("type").alias("events_count"),
        F.sum("is_pageview").alias("pageviews_count"),
        F.sum("is_add_to_cart").alias("add_to_cart_count"),
        F.sum("is_purchase").alias("purchases"),
        F.count_distinct("item_id").alias("unique_items_viewed"),
        F.min("date").alias("session_date"),
    )
    return s.withColumns({
        target: (F.col("purchases") > 0).cast("int"),                 # A12
        "session_day_of_week": day_of_week("session_date"),
        "session_month": F.month("session_date"),
        "is_mobile": contains_ci("device", "mobile").cast("int"),       # C13
        "bounce": (F.col("pageviews_count") <= 1).cast("int"),          # A13
    })


def rate_by_group(df: DataFrame, group: str | None, cols: list[str]) -> DataFrame:
    """Rows and mean of label/prediction columns per group (or overall)."""
    aggs = [F.count(F.lit(1)).alias("n_rows")] + [F.avg(c).alias(f"mean_{c}") for c in cols]
    return df.groupBy(group).agg(*aggs) if group else df.agg(*aggs)


def majority_class(df: DataFrame, label: str = "label") -> DataFrame:
    """Most frequent label, ties -> the smaller label (one row)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.min_by(F.col(label), F.struct(-F.col("n"), F.col(label))).alias("majority_label"))


def distinct_sorted(df: DataFrame, c: str, out: str = "value") -> DataFrame:
    """Distinct text values of a column, sorted (a range sort over the distinct values)."""
    return df.select(F.col(c).cast("string").alias(out)).distinct().orderBy(out)


def histogram(df: DataFrame, p: str = "probability", bins: int = 40) -> DataFrame:
    """Counts on ``bins`` equal bins over [0, 1]; p = 1.0 goes to the last bin."""
    b = F.least(F.greatest(F.floor(F.col(p) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    return (df.filter(F.col(p).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
              .withColumns({"bin_lo": F.col("bin") / F.lit(float(bins)),
                            "bin_hi": (F.col("bin") + 1) / F.lit(float(bins))}))


def histogram_nice(df: DataFrame, value: str, most: int = 40) -> DataFrame:
    """A18 with edges from the data: (bin_lo, bin_hi, n) on steps of 1, 2 or 5 times a power of ten, at most ``most`` bins.

    One aggregation gives the range and so the step, a second one the counts; empty bins are
    listed, too.  Nulls and NaN are left out; one distinct value gives one bin of width 1.
    """
    x = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    own = df.select(x.alias("x")).filter(F.col("x").isNotNull() & (F.abs("x") != F.lit(float("inf"))))
    raw = (F.max("x") - F.min("x")) / F.lit(float(most - 1))
    ends = own.agg(F.min("x").alias("low"), F.max("x").alias("high"), raw.alias("raw"))
    power = F.pow(F.lit(10.0), F.floor(F.log10("raw")).cast("double"))
    lead = F.col("raw") / power
    step = F.when(F.col("raw") > 0, F.when(lead <= 1, 1.0).when(lead <= 2, 2.0).when(lead <= 5, 5.0).otherwise(10.0) * power).otherwise(1.0)
    shape = ends.select(step.alias("step"), "low", "high").select(
        "step", F.floor(F.col("low") / F.col("step")).alias("first"), F.floor(F.col("high") / F.col("step")).alias("last"))
    width = shape.select("step").scalar()
    counts = own.groupBy(F.floor(F.col("x") / width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    bins = shape.filter("first is not null").select("step", F.explode(F.sequence("first", "last")).alias("bin"))
    return bins.join(counts, "bin", "left").select((F.col("bin") * F.col("step")).alias("bin_lo"), ((F.col("bin") + 1) * F.col("step")).alias("bin_hi"),
                                                   F.coalesce("n", F.lit(0)).alias("n"))
