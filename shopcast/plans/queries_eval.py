"""Queries of evaluation (E1-E10), splits (S1-S4), class statistics
and the aggregation-only model steps (ML1, ML5, ML6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shopcast.operators import metrics as E
from shopcast.operators import models as M
from shopcast.operators import splits as S
from shopcast.operators.aggregates import majority_class, rate_by_group
from shopcast.plans.catalog import query, round_doubles
from shopcast.plans.queries_m1 import m1_features
from shopcast.sources.adapters import scored
from shopcast.sources.tables import load_table


@query("confusion_matrix")
def q_confusion(spark, sf):
    return E.confusion(scored(spark, sf), 0.5)


@query("f1_accuracy")
def q_f1_accuracy(spark, sf):
    return round_doubles(E.with_rates(E.confusion(scored(spark, sf), 0.5)))


@query("threshold_grid_f1")
def q_grid(spark, sf):
    return round_doubles(E.threshold_grid_f1(scored(spark, sf)))


@query("threshold_grid_f1_toxic")
def q_grid_toxic(spark, sf):
    return round_doubles(E.threshold_grid_f1(scored(spark, sf, "toxic")))


@query("threshold_pr_f1")
def q_pr_f1(spark, sf):
    return round_doubles(E.threshold_pr_f1(scored(spark, sf)))


@query("threshold_pr_f1_toxic")
def q_pr_f1_toxic(spark, sf):
    return round_doubles(E.threshold_pr_f1(scored(spark, sf, "toxic")))


@query("pr_curve")
def q_pr_curve(spark, sf):
    return round_doubles(E.pr_curve(scored(spark, sf)))


@query("roc_auc")
def q_roc(spark, sf):
    return round_doubles(E.roc_auc(scored(spark, sf)))


@query("roc_auc_toxic")
def q_roc_toxic(spark, sf):
    return round_doubles(E.roc_auc(scored(spark, sf, "toxic")))


@query("average_precision")
def q_ap(spark, sf):
    return round_doubles(E.average_precision(scored(spark, sf)))


@query("classification_report")
def q_report(spark, sf):
    return round_doubles(E.classification_report(E.confusion(scored(spark, sf), 0.5)))


metrics_record = E.metrics_record


@query("metrics_record")
def q_metrics_record(spark, sf):
    return round_doubles(metrics_record(scored(spark, sf)))


@query("class_weights")
def q_class_weights(spark, sf):
    return round_doubles(M.class_weights(scored(spark, sf)))


@query("majority_class")
def q_majority(spark, sf):
    return majority_class(scored(spark, sf))


def champion_candidates(spark, sf):
    """Two scorers of the same labels: document length (priority 0) and the class prior (1)."""
    df = scored(spark, sf)
    prior = df.agg(F.avg(F.col("label").cast("double"))).scalar()

    def candidate(frame, name, priority):
        return E.average_precision(frame).select(F.lit(name).alias("model"),
                                                 F.col("average_precision").alias("pr_auc"),
                                                 F.lit(priority).alias("priority"))

    return (candidate(df, "text_length", 0)
            .unionByName(candidate(df.withColumn("score", prior), "class_prior", 1)))


@query("select_champion")
def q_champion(spark, sf):
    return round_doubles(M.select_champion(champion_candidates(spark, sf)))


@query("stratified_split")
def q_stratified(spark, sf):
    return S.stratified_split(scored(spark, sf), "label", "doc_id", 0.2, 42).select("doc_id", "label", "split")


@query("positive_rate_by_split")
def q_pos_rate(spark, sf):
    sp = S.stratified_split(scored(spark, sf), "label", "doc_id", 0.2, 42)
    return round_doubles(rate_by_group(sp, "split", ["label"]))


@query("baseline_majority")
def q_baseline(spark, sf):
    sp = S.stratified_split(scored(spark, sf), "label", "doc_id", 0.2, 42)
    pred = M.baseline_majority(sp.filter(F.col("split") == "train"), sp.filter(F.col("split") == "test"))
    return round_doubles(E.with_rates(E.confusion(pred, pred="prediction")))


@query("temporal_split")
def q_temporal(spark, sf):
    f = m1_features(spark, sf).select("stock_code", "date").checkpoint(eager=True)    # the lines are read once
    return S.temporal_split(f, "date", 0.8)


@query("ordered_split")
def q_ordered(spark, sf):
    o = load_table(spark, sf, "orders").select("o_orderkey")
    return S.ordered_split(o, ["o_orderkey"], 0.8)


@query("ordered_split_text")
def q_ordered_text(spark, sf):
    p = load_table(spark, sf, "part").select("p_name", "p_partkey")
    return S.ordered_split(p, ["p_name", "p_partkey"], 0.8)


@query("composite_ordered_split")
def q_composite(spark, sf):
    o = load_table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    return S.ordered_split(o, ["o_custkey", "o_orderdate", "o_orderkey"], 0.8)
