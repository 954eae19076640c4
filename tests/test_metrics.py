"""Metric goldens (published confusion matrices) and edge cases."""

import pytest

from shopcast.operators import metrics as E


@pytest.mark.parametrize("tn,fp,fn,tp,f1", [
    (73, 774, 51, 52710, 0.9922349287), (775, 260, 88, 286, 0.6217391304), (2284, 434, 88, 801, 0.7542372881)])
def test_published_f1(spark, tn, fp, fn, tp, f1):
    cm = spark.createDataFrame([(tn, fp, fn, tp)], "tn long, fp long, fn long, tp long")
    assert E.with_rates(cm).first()["f1"] == pytest.approx(f1, abs=1e-9)


def test_tied_scores_half_credit(spark):
    df = spark.createDataFrame([(0.5, 1), (0.5, 0)], "score double, label int")
    assert E.roc_auc(df).first()[0] == pytest.approx(0.5)


def test_no_positive(spark):
    df = spark.createDataFrame([(0.2, 0), (0.9, 0)], "score double, label int")
    assert E.roc_auc(df).first()[0] is None
    assert E.threshold_grid_f1(df).first()["f1"] == 0.0


def test_grid_boundaries(spark):
    df = spark.createDataFrame([(0.05, 1), (0.3, 1), (0.95, 1), (0.049, 0)], "score double, label int")
    g = {r["i"]: (r["tp"], r["fp"]) for r in E.threshold_grid(df).collect()}
    assert g[10] == (3, 0) and g[60] == (2, 0) and g[61] == (1, 0) and g[190] == (1, 0)


def test_average_precision_matches_definition(spark):
    rows = [(0.9, 1), (0.8, 0), (0.7, 1), (0.7, 0), (0.1, 1)]
    df = spark.createDataFrame(rows, "score double, label int")
    # thresholds 0.9: P=1 R=1/3 ; 0.7: P=2/4 R=2/3 ; 0.1: P=3/5 R=1
    expected = (1 / 3) * 1 + (1 / 3) * 0.5 + (1 / 3) * 0.6
    assert E.average_precision(df).first()[0] == pytest.approx(expected)
