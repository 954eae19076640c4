"""Models ML1-ML6 and the model bundle IO5, on Spark ML.

Class weights, the majority baseline and the champion choice are plain
aggregations.  Logistic regression uses the parity settings of SURVEY ML2
(regParam = 1 / sum(w), no standardisation inside, balanced weights), the
forest the closest Spark ML settings to the reference's.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopcast.operators.cleaning import align_columns
from shopcast.operators.forest import TaskForest
from shopcast.operators.ordering import few_rows

#: MB of node statistics a task of Spark's own forest learner holds at once.
FOREST_MB = 512


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """ML1: balanced weight n / (k * n_c) per class (k = number of classes)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    total = counts.agg(F.sum("n_class"), F.count(F.lit(1)))
    n, k = total.select(F.col("sum(n_class)")).scalar(), total.select(F.col("count(1)")).scalar()
    return counts.withColumn("weight", n / (k * F.col("n_class")))


def with_class_weights(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """Attach ML1 weights of ``df`` itself to its rows; call it on training rows only (FE7).

    The class table is broadcast if its counted rows are few.
    """
    w = class_weights(df, label).select(label, F.col("weight").alias(out)).checkpoint(eager=True)
    return df.join(few_rows(w), label)


def train_class_weights(split_table: DataFrame, label: str, split: str = "split") -> DataFrame:
    """ML1 as training uses it: balanced weights of the rows with split ``train``."""
    return class_weights(split_table.filter(F.col(split) == "train"), label)


def linear_score(coefficients: dict[str, float], intercept: float) -> Column:
    """ML4 as an expression: 1 / (1 + exp(-(b0 + sum b_i x_i)))."""
    z = F.lit(float(intercept))
    for name, b in coefficients.items():
        z = z + F.lit(float(b)) * F.col(name).cast("double")
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def positive_probability(pred: DataFrame, prob_col: str = "probability", out: str = "p1") -> DataFrame:
    """ML4: P(class 1) from a Spark ML probability vector."""
    return pred.withColumn(out, vector_to_array(F.col(prob_col))[1])


def logistic(features_col: str = "features", label: str = "label", weight: str = "weight",
             reg_param: float = 0.0, max_iter: int = 2000) -> LogisticRegression:
    """ML2 estimator: L2, lbfgs, class weights."""
    return LogisticRegression(featuresCol=features_col, labelCol=label, weightCol=weight,
                              regParam=reg_param, elasticNetParam=0.0, standardization=False,
                              maxIter=max_iter, family="binomial")


def forest(features_col: str = "features", label: str = "label", weight: str = "weight",
           trees: int = 650, depth: int = 30, seed: int = 42) -> TaskForest:
    """ML3 estimator: 650 trees, at least 2 rows a leaf, depth as far as Spark goes (30).

    Trees grow in tasks and stay there.  ``maxMemoryInMB`` and ``cacheNodeIds`` are for Spark's own learner, which takes over for
    a table too large for a task: how many nodes a pass over the rows splits, and that each row keeps its node of every tree.
    """
    return TaskForest(featuresCol=features_col, labelCol=label, weightCol=weight,
                      numTrees=trees, minInstancesPerNode=2, maxDepth=depth, maxMemoryInMB=FOREST_MB,
                      cacheNodeIds=True, featureSubsetStrategy="sqrt", seed=seed)


def over_cores(df: DataFrame) -> DataFrame:
    """The (materialised) table in at least one partition a core: a learner passes over it many times, a task a partition.

    A small table comes out of a shuffle in one partition, and all trees would be grown by one core.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def fit_pipeline(train: DataFrame, stages: Sequence) -> PipelineModel:
    return Pipeline(stages=list(stages)).fit(train)


@dataclass
class Bundle:
    """IO5: a fitted pipeline with all it takes to decide on new rows."""
    model: PipelineModel
    threshold: float
    target: str
    model_name: str
    numeric: list[str]
    categorical: list[str]
    schema: str                                   # JSON of the input columns
    metrics: dict = field(default_factory=dict)

    def score(self, df: DataFrame) -> DataFrame:
        """ML4 + C17: align the columns, add probability and prediction at the stored threshold."""
        shape = T.StructType.fromJson(json.loads(self.schema))
        own = df.select(F.struct(*df.columns).alias("_row"), *df.columns)
        aligned = align_columns(own, T.StructType([*shape.fields, own.schema["_row"]]))
        scored = positive_probability(self.model.transform(aligned), out="probability")
        return scored.select("_row.*", "probability", (F.col("probability") >= self.threshold).cast("int").alias("prediction"))


def save_bundle(bundle: Bundle, path: str) -> None:
    """Pipeline and metadata side by side under ``path`` (overwrite)."""
    bundle.model.write().overwrite().save(f"{path}/pipeline")
    facts = {k: getattr(bundle, k) for k in Bundle.__dataclass_fields__ if k != "model"}
    spark = SparkSession.active()
    spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load_bundle(path: str) -> Bundle:
    facts = json.loads(SparkSession.active().read.text(f"{path}/metadata").first()[0])
    return Bundle(model=PipelineModel.load(f"{path}/pipeline"), **facts)


def bundle_metadata(bundle: Bundle) -> DataFrame:
    """The bundle's record as one row."""
    row = (bundle.model_name, bundle.target, bundle.threshold, len(bundle.numeric), len(bundle.categorical),
           ",".join([*bundle.numeric, *bundle.categorical]), bundle.metrics.get("n_train"), bundle.metrics.get("pr_auc"))
    return SparkSession.active().createDataFrame([row], "model_name string, target string, threshold double, n_numeric int, "
                                                 "n_categorical int, features string, n_train long, pr_auc double")


def select_champion(metrics: DataFrame, name: str = "model", score: str = "pr_auc",
                    priority: str = "priority") -> DataFrame:
    """ML5: highest score wins; on a tie the lower priority number (logistic = 0) wins."""
    return metrics.agg(F.max_by(F.col(name), F.struct(F.col(score), -F.col(priority))).alias("champion"),
                       F.max(score).alias(f"best_{score}"))


def baseline_majority(train: DataFrame, test: DataFrame, label: str = "label") -> DataFrame:
    """ML6: predict the train majority class (ties -> smaller label) on every test row."""
    from shopcast.operators.aggregates import majority_class
    maj = majority_class(train, label).select("majority_label").scalar()
    return test.withColumn("prediction", maj.cast("int"))
