"""Window features W1-W7 over (product, date), in row semantics.

The reference's "7d"/"30d" windows count rows with activity, not calendar days,
so every frame is a ``rowsBetween``.  All frames share one partition/order spec,
hence one Window node.  The window runs after the (product, day) aggregation, so
a partition holds at most one row per day of a product: a product that owns a
third of all lines still yields a bounded partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopcast.functions.cleaning import clip


def _spec(key: str, order: str):
    return Window.partitionBy(key).orderBy(order)


def _frame(key: str, order: str, lo: int, hi: int, frame: str):
    """Row frame (the reference's semantics) or calendar frame over day numbers."""
    if frame == "rows":
        return _spec(key, order).rowsBetween(lo, hi)
    if frame == "calendar":
        return Window.partitionBy(key).orderBy(F.unix_date(F.col(order))).rangeBetween(lo, hi)
    raise ValueError(f"frame must be 'rows' or 'calendar', not {frame!r}")


def trailing_sum(c: str, n: int, key: str, order: str, frame: str = "rows") -> F.Column:
    """Sum over the last n rows (or n calendar days) including the current one."""
    return F.sum(c).over(_frame(key, order, -(n - 1), 0, frame))


def trailing_mean(c: str, n: int, key: str, order: str, frame: str = "rows") -> F.Column:
    """Mean over the last n rows (or days)."""
    return F.avg(c).over(_frame(key, order, -(n - 1), 0, frame))


def forward_sum(c: str, n: int, key: str, order: str, frame: str = "rows") -> F.Column:
    """Sum of the next n rows (t+1..t+n) or days; null when nothing follows."""
    return F.sum(c).over(_frame(key, order, 1, n, frame))


def forward_label(c: str, n: int, key: str, order: str, frame: str = "rows") -> F.Column:
    """1 when the next n rows (or days) sell anything; no future -> 0."""
    return (F.coalesce(forward_sum(c, n, key, order, frame), F.lit(0.0)) > 0).cast("int")


def days_since_last(flag_col: F.Column, key: str, order: str, missing: int = 999) -> F.Column:
    """Days since the last row where ``flag_col`` holds (forward fill), clipped 0..missing."""
    last = F.last(F.when(flag_col, F.col(order)), ignorenulls=True).over(
        _spec(key, order).rowsBetween(Window.unboundedPreceding, 0))
    return clip(F.coalesce(F.datediff(F.col(order), last), F.lit(missing)), 0, missing)


def product_windows(daily: DataFrame, key: str = "stock_code", order: str = "date",
                    target: str = "will_sell_next_7d", horizon: int = 7, frame: str = "rows") -> DataFrame:
    """W1-W7 on the product-day table (``frame="calendar"`` for day-based windows)."""
    canc = F.sum("cancelled_rows").over(_frame(key, order, -29, 0, frame))
    tot = F.sum("rows").over(_frame(key, order, -29, 0, frame))
    return daily.withColumns({
        "product_sales_7d": trailing_sum("sold_qty", 7, key, order, frame),
        "product_sales_30d": trailing_sum("sold_qty", 30, key, order, frame),
        "product_revenue_7d": trailing_sum("revenue", 7, key, order, frame),
        "product_revenue_30d": trailing_sum("revenue", 30, key, order, frame),
        "product_unique_buyers_30d": trailing_mean("unique_buyers", 30, key, order, frame),
        "product_cancelled_rate_30d": clip(canc / (tot + F.lit(1e-9)), 0.0, 1.0),
        "product_last_sale_days_ago": days_since_last(F.col("sold_qty") > 0, key, order),
        target: forward_label("sold_qty", horizon, key, order, frame),
    })


def rolling_distinct(lines: DataFrame, key: str, member: str, day: str, days: int = 30, out: str = "members") -> DataFrame:
    """W3 exactly: distinct members of each key over the last ``days`` calendar days, on every day the key has rows.

    A member's row counts from its day until the member's next day or until ``days`` have
    passed: +1 at the one, -1 at the other, and a running sum by key gives the count.  No
    range join and no set of members a row: the lines shuffle once by (key, member),
    as sets of days that partial aggregation has already joined; what follows has a few numbers a
    key and day, so a hot key is a window of its days.  Null members count as one.
    """
    own = lines.filter(F.col(key).isNotNull() & F.col(day).isNotNull())
    seen = own.groupBy(key, member).agg(F.sort_array(F.collect_set(day)).alias("_days"))
    each = seen.select(key, F.posexplode("_days").alias("_i", "_day"), "_days")
    until = F.least(F.date_add("_day", days), F.coalesce(F.get("_days", F.col("_i") + 1), F.date_add("_day", days)))
    events = each.select(key, F.explode(F.array(F.struct(F.col("_day").alias("d"), F.lit(1).alias("c"), F.lit(1).alias("own")),
                                                F.struct(until.alias("d"), F.lit(-1).alias("c"), F.lit(0).alias("own")))).alias("_e"))
    net = events.groupBy(key, F.col("_e.d").alias(day)).agg(F.sum("_e.c").alias("_c"), F.max("_e.own").alias("_own"))
    running = F.sum("_c").over(_spec(key, day).rowsBetween(Window.unboundedPreceding, 0))
    return net.withColumn(out, running).filter("_own = 1").select(key, day, out)
