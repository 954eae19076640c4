"""Evaluation E1-E10 as aggregations of (score, label).

Everything first collapses to one row per distinct score (map-side partial
aggregation), and curves use ``running_totals`` so that no step needs all
scores in one task.  The threshold grid (E3) collapses further to at most 182
grid cells, whose suffix sums run in one small window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopcast.operators.ordering import running_totals

GRID_LO, GRID_HI, GRID_DEN = 10, 190, 200     # thresholds i / 200 for i = 10..190 (0.05..0.95)


def _safe_div(a, b):
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def confusion(df: DataFrame, threshold: float = 0.5, score: str = "score",
              label: str = "label", pred: str | None = None) -> DataFrame:
    """One row tn, fp, fn, tp (prediction = score >= threshold, or a given column)."""
    p = F.col(pred) == 1 if pred else F.col(score) >= F.lit(threshold)
    y = F.col(label) == 1
    return df.agg(
        F.count_if(~p & ~y).alias("tn"), F.count_if(p & ~y).alias("fp"),
        F.count_if(~p & y).alias("fn"), F.count_if(p & y).alias("tp"))


def confusion_from_counts(counts: DataFrame, threshold) -> DataFrame:
    """E1 from the per-score count table (``threshold`` may be a Column)."""
    thr = threshold if isinstance(threshold, F.Column) else F.lit(threshold)
    p, q = F.col("score") >= thr, F.col("score") < thr
    return counts.agg(*[F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0)).cast("long").alias(name)
                        for name, cond, c in (("tn", q, "neg"), ("fp", p, "neg"),
                                              ("fn", q, "pos"), ("tp", p, "pos"))])


def with_rates(cm: DataFrame) -> DataFrame:
    """Precision, recall, F1 and accuracy from a confusion row (0 when undefined)."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    return cm.withColumns({
        "precision": _safe_div(tp, tp + fp),
        "recall": _safe_div(tp, tp + fn),
        "f1": _safe_div(2 * tp, 2 * tp + fp + fn),
        "accuracy": _safe_div(tp + tn, tp + tn + fp + fn),
    })


def score_counts(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """(score, pos, neg): positives and negatives per distinct score, null scores as one group.

    Every metric below can start from this table, which has one row per
    distinct score instead of one per scored row.
    """
    y = F.col(label) == 1
    return (df.groupBy(F.col(score).alias("score"))
              .agg(F.count_if(y).alias("pos"), F.count_if(~y).alias("neg")))


def curve(df: DataFrame, score: str = "score", label: str = "label", counts: DataFrame | None = None) -> DataFrame:
    """Per distinct score s: tp/fp of the rule score >= s, with totals P and N.

    The per-score table is materialised once, so the scored rows are read once.
    """
    if counts is None:
        counts = score_counts(df, score, label).checkpoint(eager=True)
    counts = counts.filter(F.col("score").isNotNull())
    score = "score"
    totals = counts.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    P, N = totals.select("P").scalar(), totals.select("N").scalar()
    rt = running_totals(counts, score, ["pos", "neg"])
    return rt.select(
        F.col(score).alias("threshold"), "pos", "neg",
        (P - F.col("cum_pos") + F.col("pos")).alias("tp"),
        (N - F.col("cum_neg") + F.col("neg")).alias("fp"),
        (F.col("cum_neg") - F.col("neg")).alias("neg_below"),
        P.alias("P"), N.alias("N"))


def pr_curve(df: DataFrame, score: str = "score", label: str = "label",
             counts: DataFrame | None = None) -> DataFrame:
    """E5: precision/recall per distinct threshold (recall 1 when there is no positive)."""
    c = curve(df, score, label, counts)
    tp, fp = F.col("tp").cast("double"), F.col("fp").cast("double")
    return c.select("threshold", "tp", "fp",
                    _safe_div(tp, tp + fp).alias("precision"),
                    F.when(F.col("P") > 0, tp / F.col("P")).otherwise(F.lit(1.0)).alias("recall"))


def threshold_pr_f1(df: DataFrame, score: str = "score", label: str = "label",
                    counts: DataFrame | None = None) -> DataFrame:
    """Threshold of max F1 (with 1e-9 in the denominator) over the PR curve.

    Ties go to the lowest threshold; an empty curve falls back to 0.5.
    """
    pr = pr_curve(df, score, label, counts).withColumn(
        "f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + F.lit(1e-9)))
    best = pr.agg(F.max_by(F.struct("threshold", "f1"), F.struct(F.col("f1"), -F.col("threshold"))).alias("b"))
    return best.select(F.coalesce(F.col("b.threshold"), F.lit(0.5)).alias("threshold"),
                       F.coalesce(F.col("b.f1"), F.lit(0.0)).alias("f1"))


def roc_auc(df: DataFrame, score: str = "score", label: str = "label",
            counts: DataFrame | None = None) -> DataFrame:
    """ROC-AUC by rank sums over distinct scores (ties count one half)."""
    c = curve(df, score, label, counts)
    s = c.agg(F.sum(F.col("pos") * (F.col("neg_below") + F.lit(0.5) * F.col("neg"))).alias("u"),
              F.first("P").alias("P"), F.first("N").alias("N"))
    return s.select(F.when((F.col("P") > 0) & (F.col("N") > 0),
                           F.col("u") / (F.col("P") * F.col("N"))).alias("roc_auc"))


def average_precision(df: DataFrame, score: str = "score", label: str = "label",
                      counts: DataFrame | None = None) -> DataFrame:
    """Step-wise average precision, sum over thresholds of dRecall * precision."""
    c = curve(df, score, label, counts)
    prec = F.col("tp") / (F.col("tp") + F.col("fp"))
    s = c.agg(F.sum(F.when(F.col("pos") > 0, F.col("pos") / F.col("P") * prec)).alias("ap"),
              F.first("P").alias("P"))
    return s.select(F.when(F.col("P") > 0, F.coalesce(F.col("ap"), F.lit(0.0))).alias("average_precision"))


def curve_areas(counts: DataFrame) -> DataFrame:
    """E6 and E7 together: (roc_auc, average_precision) from one curve over the per-score counts, in one aggregation."""
    c = curve(None, counts=counts)
    s = c.agg(F.sum(F.col("pos") * (F.col("neg_below") + F.lit(0.5) * F.col("neg"))).alias("u"),
              F.sum(F.when(F.col("pos") > 0, F.col("pos") / F.col("P") * (F.col("tp") / (F.col("tp") + F.col("fp"))))).alias("ap"),
              F.first("P").alias("P"), F.first("N").alias("N"))
    return s.select(F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("u") / (F.col("P") * F.col("N"))).alias("roc_auc"),
                    F.when(F.col("P") > 0, F.coalesce(F.col("ap"), F.lit(0.0))).alias("average_precision"))


def grid_cell(score: str) -> F.Column:
    """Largest grid index i with i/200 <= score, clipped to [9, 190] (9 = below the grid)."""
    s = F.col(score)
    b0 = F.floor(s * GRID_DEN)
    b = (F.when(s >= (b0 + 1) / F.lit(float(GRID_DEN)), b0 + 1)
          .when(s < b0 / F.lit(float(GRID_DEN)), b0 - 1).otherwise(b0))
    return F.least(F.greatest(b, F.lit(GRID_LO - 1)), F.lit(GRID_HI)).cast("int")


def threshold_grid(df: DataFrame, score: str = "score", label: str = "label",
                   counts: DataFrame | None = None) -> DataFrame:
    """F1 and counts for every grid threshold 0.05, 0.055, .., 0.95 (181 rows)."""
    if counts is None:
        y = F.col(label) == 1
        cells = (df.filter(F.col(score).isNotNull()).groupBy(grid_cell(score).alias("i"))
                   .agg(F.count_if(y).alias("pos"), F.count_if(~y).alias("neg")))
    else:
        cells = (counts.filter(F.col("score").isNotNull()).groupBy(grid_cell("score").alias("i"))
                       .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    spark = (df if df is not None else counts).sparkSession
    grid = spark.range(GRID_LO - 1, GRID_HI + 1).select(F.col("id").cast("int").alias("i"))
    g = grid.join(F.broadcast(cells), "i", "left").na.fill(0, ["pos", "neg"])
    # <= 182 rows: an unpartitioned window over a fixed-size grid.
    from_here = Window.orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, 0)
    g = g.withColumns({"tp": F.sum("pos").over(from_here), "fp": F.sum("neg").over(from_here),
                       "P": F.sum("pos").over(Window.partitionBy()), "N": F.sum("neg").over(Window.partitionBy())})
    g = g.filter(F.col("i") >= GRID_LO).withColumns({
        "threshold": F.col("i") / F.lit(float(GRID_DEN)),
        "fn": F.col("P") - F.col("tp"), "tn": F.col("N") - F.col("fp")})
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    return g.withColumn("f1", _safe_div(2 * tp, 2 * tp + fp + fn)).select(
        "i", "threshold", "f1", "tp", "fp", "fn", "tn")


def threshold_grid_f1(df: DataFrame, score: str = "score", label: str = "label",
                      counts: DataFrame | None = None) -> DataFrame:
    """Best grid threshold by F1; the first (lowest) threshold wins a tie."""
    g = threshold_grid(df, score, label, counts)
    best = g.agg(F.max_by(F.struct("threshold", "f1", "tp", "fp", "fn", "tn"),
                          F.struct(F.col("f1"), -F.col("i"))).alias("b"))
    return best.select("b.*")


def classification_report(cm: DataFrame) -> DataFrame:
    """Per-class precision/recall/F1/support plus macro and weighted means."""
    r = cm.select(*[F.col(c).cast("double").alias(c) for c in ("tn", "fp", "fn", "tp")])

    def block(name, tp, fp, fn):
        p, rc = _safe_div(tp, tp + fp), _safe_div(tp, tp + fn)
        return F.struct(F.lit(name).alias("class"), p.alias("precision"), rc.alias("recall"),
                        _safe_div(2 * p * rc, p + rc).alias("f1"), (tp + fn).alias("support"))

    c0 = block("0", F.col("tn"), F.col("fn"), F.col("fp"))
    c1 = block("1", F.col("tp"), F.col("fp"), F.col("fn"))
    rows = r.select(F.explode(F.array(c0, c1)).alias("r")).select("r.*")
    total = F.sum("support")
    summary = rows.agg(
        F.struct(F.lit("macro avg").alias("class"), F.avg("precision").alias("precision"),
                 F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), total.alias("support")).alias("m"),
        F.struct(F.lit("weighted avg").alias("class"),
                 _safe_div(F.sum(F.col("precision") * F.col("support")), total).alias("precision"),
                 _safe_div(F.sum(F.col("recall") * F.col("support")), total).alias("recall"),
                 _safe_div(F.sum(F.col("f1") * F.col("support")), total).alias("f1"),
                 total.alias("support")).alias("w"))
    tail = summary.select(F.explode(F.array("m", "w")).alias("r")).select("r.*")
    out = rows.unionByName(tail)
    return out.withColumn("support", F.col("support").cast("long"))


def metrics_record(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Grid F1 and threshold, ROC-AUC, average precision, confusion at the
    tuned threshold, rates and size, in one row.

    The raw rows are read once: they collapse to the per-score count table,
    which is checkpointed (lineage cut, reliable storage) and feeds every metric.
    """
    counts = score_counts(df, score, label).checkpoint(eager=True)
    best_row = threshold_grid_f1(None, counts=counts).first()     # one row of a 181-row grid
    thr = F.lit(best_row["threshold"])
    cm = confusion_from_counts(counts, thr)
    scored = counts.filter(F.col("score").isNotNull())
    n_all = counts.agg(F.sum(F.col("pos") + F.col("neg"))).scalar()
    areas = curve_areas(counts).first()                           # one row: the curve is built once for both areas
    return cm.select(
        thr.alias("threshold"), F.lit(best_row["f1"]).alias("f1_best"),
        F.lit(areas["roc_auc"]).cast("double").alias("roc_auc"), F.lit(areas["average_precision"]).cast("double").alias("pr_auc"),
        "tn", "fp", "fn", "tp",
        (counts.agg(F.sum("pos")).scalar() / n_all).alias("pos_rate_test"),
        (scored.agg(F.sum(F.when(F.col("score") >= thr, F.col("pos") + F.col("neg")))).scalar()
         / n_all).alias("pred_rate_test"),
        n_all.alias("n_test"))


def kpi_strip(df: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    """Threshold, mean probability and predicted-positive rate."""
    return df.agg(F.lit(threshold).alias("threshold"), F.avg(score).alias("mean_probability"),
                  F.avg((F.col(score) >= F.lit(threshold)).cast("double")).alias("predicted_rate"),
                  F.count(F.lit(1)).alias("n_rows"))
