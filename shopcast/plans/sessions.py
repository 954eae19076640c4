"""M3: web events -> one row per session with the conversion label."""

from __future__ import annotations

from pyspark.sql import DataFrame

from shopcast.operators.aggregates import session_rollup
from shopcast.operators.cleaning import drop_if_present

TARGET = "high_conversion_session"
# Columns dropped before modelling (C11); add_to_cart_count stays a feature.
M3_DROP = ["purchases", "session_date", "ga_session_id", "user_id"]


def sessions(events: DataFrame) -> DataFrame:
    return session_rollup(events, target=TARGET)


def session_features(events: DataFrame) -> DataFrame:
    return drop_if_present(sessions(events), M3_DROP)
