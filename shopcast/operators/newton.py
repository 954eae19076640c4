"""ML2 as plain aggregations: penalised logistic regression by Newton steps.

Each iteration is one aggregation over the training rows: loss, gradient and
Hessian at the current coefficients.  Spark sends back one row of
1 + d + d (d + 1) / 2 sums, the small system is solved on the driver, and a step that
does not lower the loss is halved.  The objective is the sum of weighted log losses
plus half the squared norm of the coefficients (the intercept is free), the same as
``models.logistic`` with ``regParam = 1 / sum(w)``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LogisticFit:
    """Coefficients by feature, intercept, penalised loss and the number of aggregations it took."""
    features: tuple[str, ...]
    coefficients: tuple[float, ...]
    intercept: float
    loss: float
    passes: int

    def score(self) -> Column:
        """ML4 of this fit as an expression."""
        from shopcast.operators.models import linear_score
        return linear_score(dict(zip(self.features, self.coefficients, strict=True)), self.intercept)


def _sums(x: Sequence[Column], y: Column, w: Column, beta: np.ndarray) -> list[Column]:
    """Loss, gradient and upper triangle of the Hessian at ``beta`` (intercept first)."""
    z = F.lit(float(beta[0]))
    for b, c in zip(beta[1:], x[1:], strict=True):
        z = z + F.lit(float(b)) * c
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
    loss = w * (F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z))))
    curve = w * p * (F.lit(1.0) - p)
    return [F.sum(loss), *[F.sum(w * (p - y) * c) for c in x], *[F.sum(curve * a * b) for i, a in enumerate(x) for b in x[i:]]]


def fit_logistic(df: DataFrame, features: Sequence[str], label: str = "label", weight: str | None = None, penalty: float = 1.0,
                 max_iter: int = 50, tolerance: float = 1e-10) -> LogisticFit:
    """Fit on all rows of ``df`` (``weight``: one column, else 1); rows with a null among them are an error.

    The number of sums grows with the square of the features: meant for tens of them.
    """
    if df.isEmpty():
        raise ValueError("no rows to fit")
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in features]]
    y, w = F.col(label).cast("double"), F.col(weight).cast("double") if weight else F.lit(1.0)
    missing = df.agg(F.count_if(F.greatest(*[c.isNull().cast("int") for c in [*x, y, w]]) == 1)).first()[0]
    if missing:
        raise ValueError(f"{missing} rows have a null among features, label and weight: impute them first")
    n = len(x)
    ridge = np.diag([0.0] + [float(penalty)] * (n - 1))
    beta, best, step, passes = np.zeros(n), None, np.zeros(n), 0
    while passes < max_iter:
        row = df.agg(*[c.alias(f"s{i}") for i, c in enumerate(_sums(x, y, w, beta))]).first()
        passes += 1
        loss = row[0] + 0.5 * beta @ ridge @ beta
        if best is not None and loss > best + 1e-12 * abs(best):       # too far: half the step
            step = step / 2
            if np.max(np.abs(step)) < tolerance:
                beta = beta - step
                break
            beta = beta - step
            continue
        best = loss
        hessian = np.zeros((n, n))
        hessian[np.triu_indices(n)] = row[1 + n:]
        hessian = hessian + np.triu(hessian, 1).T + ridge
        step = np.linalg.lstsq(hessian, -(np.array(row[1:1 + n]) + ridge @ beta), rcond=None)[0]
        if np.max(np.abs(step)) < tolerance * (1 + np.max(np.abs(beta))):
            break
        beta = beta + step
    return LogisticFit(tuple(features), tuple(float(b) for b in beta[1:]), float(beta[0]), float(best), passes)


def coefficient_table(fit: LogisticFit, df: DataFrame) -> DataFrame:
    """(feature, coefficient), the intercept among them."""
    rows = [("(intercept)", fit.intercept), *zip(fit.features, fit.coefficients, strict=True)]
    return df.sparkSession.createDataFrame(rows, "feature string, coefficient double")
