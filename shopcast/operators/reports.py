"""Reports K1-K3 and the store report X5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopcast.operators import entities as X
from shopcast.operators.scoring import prepare, score


def top_n(df: DataFrame, by: str, key: str, n: int) -> DataFrame:
    """K2: n rows with the highest ``by``; ``key`` breaks ties (TakeOrderedAndProject)."""
    return df.orderBy(F.col(by).desc(), F.col(key).asc()).limit(n)


def top_filtered(df: DataFrame, by: str, key: str, n: int, category: str, plan: str,
                 n_categories: int = 3, plans: list[str] | None = None) -> DataFrame:
    """K3: top n inside the first ``n_categories`` categories (sorted) and the chosen plans.

    The category list is a tiny ordered limit; it joins back as a broadcast
    semi join (at most ``n_categories`` rows).
    """
    cats = (df.select(F.col(category).cast("string").alias(category)).distinct()
              .orderBy(category).limit(n_categories))
    kept = df.join(F.broadcast(cats), category, "left_semi")
    if plans is not None:
        kept = kept.filter(F.col(plan).cast("string").isin(plans))
    return top_n(kept, by, key, n)


def store_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Design, sales and growth of each store in one record.

    Sales is the mean sales probability over the store's products (from the
    distinct (supplier, part) pairs of the order lines), growth is the content
    score of the account with the store's id.
    """
    # the (supplier, part) aggregate feeds the store record, the product record
    # and the store-product pairs: materialise it once (reliable checkpoint)
    # so the line table is scanned and shuffled once for the whole report
    shared = X.supplier_parts(spark, sf_dir).checkpoint(eager=True)
    ok_d, _ = prepare(X.store_facts(spark, sf_dir, shared), "design")
    design = score(ok_d, "design").select("store_id", F.col("probability").alias("design_probability"),
                                          F.col("prediction").alias("design_prediction"))
    ok_s, _ = prepare(X.product_facts(spark, sf_dir, shared), "sales")
    sales = score(ok_s, "sales").select("product_id", "probability")
    pairs = shared.select("l_suppkey", "l_partkey")
    sales_by_store = (pairs.join(sales, pairs.l_partkey == sales.product_id)
                           .groupBy(F.col("l_suppkey").alias("store_id"))
                           .agg(F.avg("probability").alias("sales_mean_probability"),
                                F.count(F.lit(1)).alias("products_scored")))
    ok_g, _ = prepare(X.content_facts(spark, sf_dir), "growth")
    growth = score(ok_g, "growth").select(F.col("account_id").alias("store_id"),
                                          F.col("probability").alias("growth_probability"),
                                          F.col("prediction").alias("growth_prediction"))
    return design.join(sales_by_store, "store_id", "left").join(growth, "store_id", "left")
