"""shopcast: predictive e-commerce analytics as Spark DataFrame transformations.

Layout
------
sources/    readers, sinks, model registry, adapters over the test tables
functions/  Column-level building blocks (cleaning, calendar, rule scorecards, advice)
operators/  DataFrame -> DataFrame operators (aggregates, windows, splits, features,
            models, metrics, reports, entity builders, table scoring)
plans/      end-to-end module chains and the query catalog used by the driver
streaming/  Structured Streaming scoring of entity records
"""

__all__ = ["session"]
