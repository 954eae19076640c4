"""Plan-shape regression tests: the shuffles the design promises at scale.

Broadcast joins are switched off so the plans are the ones a cluster gets for
large tables; AQE is off so the static plan is inspected.
"""

import re
import uuid

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SF001

QUERIES = entry.queries()


@pytest.fixture
def no_broadcast(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def _main_plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString().split("Subqueries")[0]


def test_flagship_shuffles(spark, no_broadcast):
    plan = _main_plan(QUERIES["forward_label"](spark, SF001))
    # lines + orders for the join, (product, day, customer), (product, day), product-days + part by product
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 6
    lines = [ln.strip() for ln in plan.splitlines()]
    w = next(i for i, ln in enumerate(lines) if "Window [" in ln)
    smj = next(i for i in range(w, len(lines)) if "SortMergeJoin" in lines[i])
    # the window reuses the product partitioning of the text join: no exchange in between
    assert not any("Exchange" in ln for ln in lines[w:smj])
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_splits_are_projections(spark, no_broadcast):
    base = len(re.findall(r"Exchange hashpartitioning",
                          _main_plan(spark.read.parquet(f"{SF001}/orders.parquet").select("o_orderkey"))))
    plan = _main_plan(QUERIES["composite_ordered_split"](spark, SF001))
    assert len(re.findall(r"Exchange", plan)) == base == 0


def test_scoring_is_one_stage_over_the_entities(spark, no_broadcast):
    from shopcast.operators.scoring import predict
    df = spark.createDataFrame([(10.0, 1)], "price double, id int")
    out, _ = predict(df, "sales", "id")
    plan = _main_plan(out)
    assert "Exchange" not in plan and "Python" not in plan


def test_store_report_reads_the_line_table_once(spark, no_broadcast):
    """The (supplier, part) aggregate is materialised once; the report plan no longer scans lines."""
    plan = _main_plan(QUERIES["store_report"](spark, SF001))
    assert "lineitem.parquet" not in plan


def _jobs(spark, run):
    group = f"jobs-{uuid.uuid4()}"
    spark.sparkContext.setJobGroup(group, "count")
    run()
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return n


def test_stratified_split_jobs_do_not_grow_with_classes(spark):
    from shopcast.operators.splits import stratified_split
    few, many = (spark.range(3000).select("id", (F.col("id") % k).alias("y")).checkpoint() for k in (2, 500))
    counts = [_jobs(spark, lambda d=d: stratified_split(d, "y", "id").write.format("noop").mode("overwrite").save()) for d in (few, many)]
    assert abs(counts[0] - counts[1]) <= 4 and max(counts) < 40


@pytest.mark.parametrize("name,limit", [("roc_auc", 1), ("pr_curve", 1), ("average_precision", 1), ("threshold_pr_f1", 1), ("impute_median", 3)])
def test_reads_of_the_raw_table(spark, name, limit, tmp_path):
    """How often a query scans its large table: counted in the plans that really ran."""
    table = {"impute_median": "part"}.get(name, "documents")
    view = tmp_path / "sf"
    view.mkdir()
    for t in ("documents", "labels", "part", "lineitem", "supplier"):
        (view / f"{t}.parquet").symlink_to(f"{SF001}/{t}.parquet")
    before = _scanned(spark, table)
    QUERIES[name](spark, str(view)).collect()
    assert 1 <= _scanned(spark, table) - before <= limit


def _scanned(spark, table):
    store = spark._jsparkSession.sharedState().statusStore()
    seen = store.executionsList()
    return sum(f"{table}.parquet" in seen.apply(i).physicalPlanDescription() for i in range(seen.size()))


def test_distinct_values_are_sorted(spark):
    from shopcast.operators.aggregates import distinct_sorted
    df = spark.createDataFrame([(x,) for x in "qwertyuiopasdfghjklq"], "c string")
    assert [r["value"] for r in distinct_sorted(df, "c").collect()] == sorted(set("qwertyuiopasdfghjkl"))


def test_churn_table_reads_orders_in_one_aggregate(spark, no_broadcast):
    plan = _main_plan(QUERIES["churn_table"](spark, SF001))
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 2      # orders by customer, customers for the join
    assert len(re.findall(r"HashAggregate\(keys=\[o_custkey", plan)) == 2
