"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text becomes eight transformed statistics.  Per class, Spark aggregates
mean and covariance of the labelled rows; the covariance is shrunk towards the
pooled one and factored once on the driver (8 x 8).  A score is the logistic
of the difference of the two log densities (Mahalanobis terms through the
cached factors, log determinants, class shares).

Defined results: null text counts as empty, and empty texts are scored like any other; rows with a null
label are not learned from; with labels of one class only every score is that
class (0.0 or 1.0), with none 0.5; repeated rows are scored one by one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopcast.llm.common import cut, fresh

STATISTICS = ("upper_share", "exclamation_share", "symbol_share", "sentence_mark_share",
              "word_length", "distinct_word_share", "compressibility", "short_word_share")
_SYMBOLS = np.frombuffer(b"#$%&*|=<>@^_~{}[]\\", np.uint8)
_SENTENCE = np.frombuffer(b".?,", np.uint8)


def statistics_of(raw: bytes, codec: zstandard.ZstdCompressor) -> list[float]:
    """The transformed statistics of one UTF-8 text, all of it."""
    n = max(len(raw), 1)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower = count[65:91].sum(), count[97:123].sum()
    words = raw.split()
    n_words = max(len(words), 1)
    return [
        float(np.sqrt(upper / max(upper + lower, 1))),
        float(np.sqrt(count[33] / n)),
        float(np.sqrt(count[_SYMBOLS].sum() / n)),
        float(np.sqrt(count[_SENTENCE].sum() / n)),
        float(np.log1p(len(raw) / n_words)),
        float(np.log((len(set(words)) + 1) / (len(words) + 1))),
        float(np.log((len(codec.compress(raw)) + 1) / (len(raw) + 1))),
        float(np.sqrt(sum(len(w) <= 3 for w in words) / n_words)),
    ]


def statistics(text: Column) -> Column:
    """array<double> of ``STATISTICS`` for a text column (Arrow batches, bounded by the session)."""
    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def run(texts: pa.Array) -> pa.Array:
        codec = zstandard.ZstdCompressor(level=1)
        return pa.array([statistics_of(x.as_buffer().to_pybytes(), codec) for x in texts],
                        pa.list_(pa.float64()))
    return run(F.coalesce(text, F.lit("")))


@dataclass(frozen=True)
class Discriminant:
    """Class means, inverse Cholesky factors and log constants; ``constant`` if a class is missing."""
    means: tuple = ()
    factors: tuple = ()
    offsets: tuple = ()
    constant: float | None = None

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        low, high = (off - 0.5 * (((x - mean) @ inv.T) ** 2).sum(axis=1)
                     for mean, inv, off in zip(self.means, self.factors, self.offsets, strict=True))
        return 1.0 / (1.0 + np.exp(-np.clip(high - low, -700, 700)))


def fit(labelled: DataFrame, stats: str, label: str, shrinkage: float = 0.6, ridge: float = 1e-3) -> Discriminant:
    """Fit on an array column and a 0/1 label: one aggregation of 8 means and 36 covariances per class."""
    d = len(STATISTICS)
    x = [F.col(stats)[i] for i in range(d)]
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    rows = (labelled.filter(F.col(label).isin(0, 1)).groupBy(F.col(label).cast("int").alias("k"))
            .agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(c) for c in x]).alias("mean"),
                 F.array(*[F.covar_pop(x[i], x[j]) for i, j in pairs]).alias("cov")).collect())
    by = {r["k"]: r for r in rows}
    if len(by) < 2:
        return Discriminant(constant=float(next(iter(by))) if by else 0.5)
    total = sum(r["n"] for r in rows)
    cov = {}
    for k, r in by.items():
        m = np.zeros((d, d))
        for (i, j), v in zip(pairs, r["cov"], strict=True):
            m[i, j] = m[j, i] = v
        cov[k] = m
    pooled = sum(cov[k] * by[k]["n"] / total for k in (0, 1))
    floor = ridge * np.diag(np.diag(pooled) + 1e-6)
    means, factors, offsets = [], [], []
    for k in (0, 1):
        factor = np.linalg.cholesky((1 - shrinkage) * cov[k] + shrinkage * pooled + floor)
        means.append(np.array(by[k]["mean"]))
        factors.append(np.linalg.inv(factor))
        offsets.append(float(np.log(by[k]["n"] / total) - np.log(np.diag(factor)).sum()))
    return Discriminant(tuple(means), tuple(factors), tuple(offsets))


def score(stats: Column, model: Discriminant) -> Column:
    """P(label = 1) for an array column of statistics."""
    @F.arrow_udf(T.DoubleType())
    def run(rows: pa.Array) -> pa.Array:
        x = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), len(STATISTICS))
        return pa.array(model.probability(x))
    return run(stats)


def classify(docs: DataFrame, labels: DataFrame, learn_from: Column, text: str = "text", doc_id: str = "doc_id",
             label: str = "quality", threshold: float = 0.7, shrinkage: float = 0.6) -> DataFrame:
    """(doc_id, score, predicted) for every row of ``docs``; learns from rows where ``learn_from`` holds.

    The text is read once: the statistics (64 bytes a row) are materialised and
    serve both the fit and the scores.  Only statistics and ids are shuffled.
    """
    key, stats = fresh([doc_id, label], "_key"), fresh([doc_id, label], "_stats")
    rows = cut(docs.select(F.col(doc_id), statistics(F.col(text)).alias(stats), learn_from.alias("_learn")))
    marks = labels.select(F.col(doc_id).alias(key), F.col(label))
    model = fit(rows.filter("_learn").join(marks, F.col(doc_id) == F.col(key)), stats, label, shrinkage)
    scored = rows.select(doc_id, score(F.col(stats), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
