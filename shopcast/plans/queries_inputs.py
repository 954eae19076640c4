"""Queries of inferred inputs (IO2, C1), file order (A10, S2), exact rolling buyers
(W3), Newton's logistic fit (ML2), bootstraps (ML3), the stored transformer (IO5) and data-driven bins (A18)."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopcast.operators import features as FE
from shopcast.operators.aggregates import histogram_nice
from shopcast.operators.artefacts import Transformer, load_transformer, save_transformer
from shopcast.operators.bootstrap import bootstrap_class_weights
from shopcast.operators.models import with_class_weights
from shopcast.operators.newton import coefficient_table, fit_logistic
from shopcast.operators.windows import rolling_distinct
from shopcast.plans.catalog import query, round_doubles
from shopcast.plans.sales import clean_lines
from shopcast.plans.sessions import TARGET, sessions
from shopcast.session import scratch_dir
from shopcast.sources import files as IO
from shopcast.sources import inference, positions
from shopcast.sources.adapters import sales_lines, web_events
from shopcast.sources.tables import load_table

# Features of the checkable fit (ours): counts and flags of a session without missing values.
NEWTON_FEATURES = ("events_count", "pageviews_count", "unique_items_viewed", "is_mobile", "bounce")
BOOTSTRAPS = 5


@query("logistic_newton")
def q_logistic_newton(spark, sf):
    """ML2: balanced penalised logistic of the session label by Newton steps, one aggregation each."""
    s = sessions(web_events(spark, sf)).select(F.col(TARGET).alias("label"), *NEWTON_FEATURES)
    rows = with_class_weights(s).checkpoint(eager=True)
    return round_doubles(coefficient_table(fit_logistic(rows, NEWTON_FEATURES, "label", "weight"), rows))


@query("rolling_distinct_buyers")
def q_rolling_distinct_buyers(spark, sf):
    """W3 exactly: distinct buyers of a product over the last 30 days, on each of its days."""
    lines = clean_lines(sales_lines(spark, sf, with_description=False))
    return rolling_distinct(lines, "stock_code", "customer_id", "date", 30, "distinct_buyers_30d")


@query("bootstrap_class_weights")
def q_bootstrap_class_weights(spark, sf):
    """ML3: class weights of each Poisson bootstrap of the sessions."""
    s = sessions(web_events(spark, sf)).select("ga_session_id", F.col(TARGET).alias("label"))
    return round_doubles(bootstrap_class_weights(s, "label", "ga_session_id", BOOTSTRAPS))


@query("feature_matrix_reloaded")
def q_feature_matrix_reloaded(spark, sf):
    """IO5: the transformer fitted on the train rows is stored, loaded against the table's columns and applied."""
    from shopcast.plans.queries_ml import _session_split
    sp, num, cat = _session_split(spark, sf)
    model = FE.column_transformer(num, cat).fit(sp.filter(F.col("split") == "train"))
    path = scratch_dir(spark, "transformer")
    save_transformer(Transformer(model, T.StructType([sp.schema[c] for c in (*num, *cat)]), tuple(num), tuple(cat)), path)
    loaded = load_transformer(path, sp.schema)
    slots = F.posexplode(vector_to_array("features")).alias("slot", "value")
    return round_doubles(loaded.transform(sp).select("ga_session_id", "split", slots).filter("value <> 0"))


@query("csv_inferred_schema")
def q_csv_inferred_schema(spark, sf):
    """IO2: the orders as a CSV file without types, with missing-value tokens, read back with the types that its values have."""
    o = load_table(spark, sf, "orders")
    token = F.when(F.col("o_orderstatus") == "P", F.lit("NA"))
    path = scratch_dir(spark, "orders-untyped")
    IO.write_csv(o.select("o_orderkey", token.otherwise(F.col("o_custkey").cast("string")).alias("o_custkey"),
                          token.otherwise(F.col("o_totalprice").cast("string")).alias("o_totalprice"),
                          F.date_format("o_orderdate", "M/d/yyyy H:mm").alias("o_orderdate"),
                          F.col("o_orderpriority"), (F.col("o_orderstatus") == "F").alias("filled")), path)
    return round_doubles(inference.read_csv_inferred(spark, path))


def _dated(spark, sf):
    """Order dates as text in three layouts; pending orders have a text that is no date."""
    o = load_table(spark, sf, "orders")
    odd = F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority"))
    layouts = {"iso": "yyyy-MM-dd'T'HH:mm:ss", "month_first": "MM/dd/yyyy HH:mm", "day_first": "dd/MM/yyyy"}
    return o.select("o_orderkey", *[odd.otherwise(F.date_format("o_orderdate", f)).alias(c) for c, f in layouts.items()]), list(layouts)


@query("parse_ts_detected")
def q_parse_ts_detected(spark, sf):
    """Timestamps in the layout that each whole column tells."""
    texts, columns = _dated(spark, sf)
    typed = inference.parse_detected(texts, columns)[0]
    return typed.select("o_orderkey", *[F.col(c).cast("timestamp_ntz").alias(c) for c in columns])


@query("parse_ts_report")
def q_parse_ts_report(spark, sf):
    """The layout found for each column, with the rows it reads and those it does not."""
    return inference.parse_detected(*_dated(spark, sf))[1]


@query("first_in_file_order")
def q_first_in_file_order(spark, sf):
    """A10: the first event type and value of each user in the order of the file."""
    ev = positions.read_positioned(spark, f"{sf}/events.parquet", ["user_id", "event_type", "value"])
    return round_doubles(positions.first_in_order(ev, ["user_id"], ["event_type", "value"]))


@query("positional_split")
def q_positional_split(spark, sf):
    """The first 80 % of the events in the order of the file are train."""
    ev = positions.read_positioned(spark, f"{sf}/events.parquet", ["event_id"])
    return positions.positional_split(ev, 0.8).select("event_id", "split")


@query("histogram_nice")
def q_histogram_nice(spark, sf):
    """Order totals on edges that follow from their range."""
    return round_doubles(histogram_nice(load_table(spark, sf, "orders"), "o_totalprice"))
