"""Module runs: prepared table -> split -> fit -> tuned threshold -> metrics -> bundle.

The training steps of the four modules share one shape: type-driven column
transformer (FE1-FE6) and balanced class weights (ML1), both fitted on the
training rows only (FE7), a classifier (ML2/ML3), scores on the test rows
(ML4), then the evaluation record (E9) or, for M4, both models beside the
majority baseline and the champion by average precision (ML5) with its
PR-curve threshold (E4).  The split table is materialised because fitting reads
it many times; the transformed rows are, with their weights, because both M4 models start from
them; test scores are because several metric passes read them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopcast.operators import features as FE
from shopcast.operators import metrics as E
from shopcast.operators import models as M
from shopcast.operators.ordering import few_rows


@dataclass
class Prepared:
    """A fitted column transformer with the transformed train and test rows."""
    transformer: PipelineModel
    train: DataFrame
    test: DataFrame
    numeric: list[str]
    categorical: list[str]
    schema: str
    n_train: int


def prepare(split_table: DataFrame, label: str, exclude: Sequence[str], id_col: str, hashed: Sequence[str] = (),
            stored: bool = False) -> Prepared:
    """FE1-FE7 and ML1: everything is learned from rows with split ``train``.

    ``stored`` says that the table is a projection of materialised rows; any other is checkpointed first.
    Text columns named in ``hashed`` are hashed into slots; any other one with too many categories for one-hot slots is an error.
    """
    data = split_table.withColumn("label", F.col(label).cast("int"))
    data = data if stored else data.checkpoint(eager=True)
    num, cat = FE.split_by_type(data.schema, exclude=[*exclude, label, "label", "split", id_col])
    train = data.filter(F.col("split") == "train")
    wide = FE.wide_categories(train, [c for c in cat if c not in set(hashed)])
    if wide:
        raise ValueError(f"too many categories for one-hot slots in {', '.join(wide)}: exclude these columns or name them in hashed")
    transformer = FE.column_transformer(num, cat, hashed=hashed).fit(train)
    weights = M.class_weights(train).checkpoint(eager=True)
    vectors = transformer.transform(M.over_cores(data)).select(id_col, "split", "label", "features")
    ready = (vectors.join(few_rows(weights.drop("n_class")), "label", "left")
                    .select(id_col, "split", "label", "features", "weight").checkpoint(eager=True))
    known = weights.filter(F.col("label").isNotNull()).agg(F.coalesce(F.sum("n_class"), F.lit(0))).first()[0]
    train_rows = ready.filter((F.col("split") == "train") & F.col("label").isNotNull())
    shape = T.StructType([data.schema[c] for c in (*num, *cat)])
    return Prepared(transformer, train_rows, ready.filter(F.col("split") == "test").drop("weight"), num, cat, shape.json(), known)


def fit_classifier(p: Prepared, id_col: str, estimator: str = "logistic", max_iter: int = 2000):
    """(fitted classifier, test scores)."""
    total_w = p.train.agg(F.sum("weight")).first()[0]
    clf = (M.logistic(reg_param=1.0 / total_w, max_iter=max_iter) if estimator == "logistic" else M.forest()).fit(p.train)
    scored = M.positive_probability(clf.transform(p.test))
    return clf, scored.select(id_col, F.col("p1").alias("score"), "label").checkpoint(eager=True)


def fit_and_score(split_table: DataFrame, label: str, exclude: Sequence[str], id_col: str, estimator: str = "logistic",
                  max_iter: int = 2000, stored: bool = False):
    """Fit on split == 'train', score split == 'test'; returns (pipeline, test scores, prepared rows)."""
    p = prepare(split_table, label, exclude, id_col, stored=stored)
    clf, scores = fit_classifier(p, id_col, estimator, max_iter)
    return PipelineModel(stages=[*p.transformer.stages, clf]), scores, p


NAMES = {"logistic": "logistic_regression", "forest": "random_forest"}


def evaluate(scores: DataFrame, p: Prepared | None = None, estimator: str = "logistic") -> DataFrame:
    """E9 on test scores, with the run's sizes and the model's name if the run is given."""
    record = E.metrics_record(scores)
    if p is None:
        return record
    return record.withColumns({"n_train": F.lit(p.n_train).cast("long"),
                               "n_features_input": F.lit(len(p.numeric) + len(p.categorical)),
                               "model_name": F.lit(NAMES[estimator])})


def bundle(split_table: DataFrame, label: str, exclude: Sequence[str], id_col: str, stored: bool = False) -> M.Bundle:
    """IO5: fit, tune the threshold on the test rows, keep what scoring needs."""
    model, scores, p = fit_and_score(split_table, label, exclude, id_col, stored=stored)
    record = evaluate(scores, p).first().asDict()
    return M.Bundle(model, record["threshold"], label, record["model_name"], p.numeric, p.categorical, p.schema, record)


def compare_models(split_table: DataFrame, label: str, exclude: Sequence[str], id_col: str, stored: bool = False):
    """M4: logistic (threshold from the PR curve) and forest (0.5) on the same transformed rows.

    Returns (candidates, report): a row per model with AP, ROC-AUC and
    threshold; the per-class report (E8) of both and of the majority baseline.
    """
    p = prepare(split_table, label, exclude, id_col, stored=stored)
    _, lr_scores = fit_classifier(p, id_col, "logistic", max_iter=3000)
    _, rf_scores = fit_classifier(p, id_col, "forest")
    lr_counts, rf_counts = (E.score_counts(s).checkpoint(eager=True) for s in (lr_scores, rf_scores))
    lr_thr = E.threshold_pr_f1(None, counts=lr_counts).first()["threshold"]

    def row(counts, name, priority, thr):
        return E.curve_areas(counts).select(F.lit(name).alias("model"), F.col("average_precision").alias("pr_auc"),
                                            F.lit(priority).alias("priority"), "roc_auc", F.lit(thr).alias("threshold"))

    def report(cm, name):
        return E.classification_report(cm).select(F.lit(name).alias("model"), "*")

    candidates = row(lr_counts, NAMES["logistic"], 0, lr_thr).unionByName(row(rf_counts, NAMES["forest"], 1, 0.5))
    base = M.baseline_majority(p.train, p.test)
    reports = (report(E.confusion(lr_scores, lr_thr), NAMES["logistic"])
               .unionByName(report(E.confusion(rf_scores, 0.5), NAMES["forest"]))
               .unionByName(report(E.confusion(base, pred="prediction"), "majority_baseline")))
    return candidates, reports


def champion(candidates: DataFrame) -> DataFrame:
    """ML5: highest AP wins, the lower priority number on a tie."""
    best = candidates.agg(F.max_by(F.struct("model", "pr_auc", "roc_auc", "threshold"),
                                   F.struct(F.col("pr_auc"), -F.col("priority"))).alias("b"))
    return best.select("b.*")
