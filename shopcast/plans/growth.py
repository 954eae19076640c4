"""M4: events -> store x week content table with the next-week growth label.

One row per (store, ISO week with activity).  "Next week" is the calendar
week after: ``lead`` gives the following active week of the store, and a
gap means no activity (0) next week.  The window is partitioned by store and
holds one row per active week, so a store with a third of all events still
gives a small partition.  The latest week has no next week yet and is dropped
(C15).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TARGET = "growth_next_week"
# Columns that never enter the model (C11).
M4_DROP = ["store_id", "profile_visits_next_week", "new_customers_next_week", TARGET]


def content_weeks(events: DataFrame, store: str = "user_id", ts: str = "ts", kind: str = "event_type",
                  value: str = "value") -> DataFrame:
    t = F.col(kind)
    weekly = (events.withColumn("week", F.to_date(F.date_trunc("week", F.col(ts))))
                    .groupBy(F.col(store).alias("store_id"), "week").agg(
                        F.count_if(t == "click").cast("int").alias("posts_count_week"),
                        F.count_if(t == "view").cast("int").alias("stories_count_week"),
                        F.avg(F.when(t == "purchase", 1.0).otherwise(0.0)).alias("pct_posts_with_video"),
                        F.avg(F.when(t == "error", 1.0).otherwise(0.0)).alias("pct_1_2_star"),
                        (F.avg(value) / F.lit(1000.0)).alias("post_engagement_rate"),
                        F.count(F.lit(1)).cast("int").alias("profile_visits"),
                        F.count_if(t == "signup").cast("int").alias("new_customers")))
    w = Window.partitionBy("store_id").orderBy("week")
    next_week = F.lead("week").over(w)
    follows = next_week == F.date_add(F.col("week"), 7)
    out = weekly.withColumns({
        "profile_visits_next_week": F.when(follows, F.lead("profile_visits").over(w)).otherwise(F.lit(0)),
        "new_customers_next_week": F.when(follows, F.lead("new_customers").over(w)).otherwise(F.lit(0)),
    }).withColumn(TARGET, (F.col("profile_visits_next_week") > F.col("profile_visits")).cast("int"))
    last_week = weekly.select(F.max("week")).scalar()
    return out.filter(F.col("week") < last_week)
