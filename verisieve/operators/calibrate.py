"""L2-regularised logistic calibration on z-scored columns.

Statistics are one aggregate; the fit is Spark's own optimizer over distributed rows; prediction is a linear expression inlined in the
plan.  Missing and infinite values become 0 before centring.  The penalty is ``l2 * |w|^2`` on the mean loss, the intercept is free.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import EPS, clip, sigmoid

FORMAT, FORMAT_VERSION = "verisieve.calibrator", 1


def l2_of_c(c: float, n: int) -> float:
    """The penalty that matches an inverse strength ``c`` on a summed loss over n rows."""
    if c <= 0 or n <= 0:
        raise ValueError("c and n must be positive")
    return 1.0 / (2.0 * c * n)


def finite(name: str) -> Column:
    x = F.col(f"`{name}`").try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


@dataclass
class Calibrator:
    features: list[str]
    mean: list[float] = field(default_factory=list)
    std: list[float] = field(default_factory=list)
    intercept: float = 0.0
    weights: list[float] | None = None
    fallback: float = 0.5
    l2: float = 0.05
    status: str = "unfitted"

    def predict(self, df: DataFrame) -> Column:
        """Probability of label 1.  A frame without one of the features is refused; nothing is filled in for it."""
        lacking = [f for f in self.features if f not in df.columns]
        if lacking:
            raise ValueError(f"features are missing: {', '.join(lacking[:5])}")
        if self.weights is None:
            return F.lit(self.fallback)
        return clip(sigmoid(self.linear(df)), EPS, 1 - EPS)

    def linear(self, df: DataFrame) -> Column:
        """The log-odds before they are clipped."""
        z = F.lit(self.intercept)
        for f, m, s, w in zip(self.features, self.mean, self.std, self.weights or [], strict=True):
            if w:
                z = z + (F.coalesce(finite(f), F.lit(0.0)) - m) * (w / s)
        return z

    def ranked_weights(self) -> list[tuple[str, float]]:
        """Features by absolute weight, largest first, ties by name."""
        return sorted(zip(self.features, self.weights or [], strict=False), key=lambda x: (-abs(x[1]), x[0]))

    def state(self) -> dict:
        return {"format": FORMAT, "format_version": FORMAT_VERSION, **self.__dict__}

    @classmethod
    def of_state(cls, s: dict) -> Calibrator:
        if s.get("format") != FORMAT or s.get("format_version") != FORMAT_VERSION:
            raise ValueError("not a calibrator of this format")
        return cls(**{k: v for k, v in s.items() if k not in ("format", "format_version")})


def statistics(df: DataFrame, features: list[str], label: str) -> tuple[float, int, list[float], list[float]]:
    """Base rate, number of classes (2: more than one), means and deviations of the features: one aggregate."""
    y = F.col(f"`{label}`").cast("double")
    own = [F.avg(y).alias("y"), F.min(y.cast("int")).alias("a"), F.max(y.cast("int")).alias("b")]
    r = df.agg(*own, *(x for i, f in enumerate(features) for x in (F.avg(finite(f)).alias(f"m{i}"), F.stddev_pop(finite(f)).alias(f"s{i}")))).first()
    base = min(max(float(r["y"]), EPS), 1 - EPS) if r["y"] is not None else 0.5
    known = lambda v: v is not None and math.isfinite(v)
    mean = [float(r[f"m{i}"]) if known(r[f"m{i}"]) else 0.0 for i in range(len(features))]
    std = [float(r[f"s{i}"]) if known(r[f"s{i}"]) and r[f"s{i}"] > 1e-8 else 1.0 for i in range(len(features))]
    return base, 0 if r["a"] is None else 1 if r["a"] == r["b"] else 2, mean, std


def fit(df: DataFrame, features: list[str], label: str, l2: float = 0.05, max_iter: int = 200, tol: float = 1e-12) -> Calibrator:
    """By Spark's own optimizer (``newton.fit`` takes Newton steps).  One class only gives a constant: the base rate."""
    d = df.select(F.col(label).cast("double").alias("__y"), *(finite(f).alias(f) for f in features))
    base, classes, mean, std = statistics(d, features, "__y")
    if classes < 2:
        return Calibrator(features, fallback=base, l2=l2, status="single_class")
    z = d.select("__y", *(((F.coalesce(F.col(f"`{f}`"), F.lit(0.0)) - m) / s).alias(f"z{i}") for i, (f, m, s) in enumerate(zip(features, mean, std, strict=True))))
    rows = VectorAssembler(inputCols=[f"z{i}" for i in range(len(features))], outputCol="x").transform(z).select("__y", "x").persist()
    try:
        model = LogisticRegression(labelCol="__y", featuresCol="x", regParam=2 * l2, elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=tol).fit(rows)
    finally:
        rows.unpersist()
    status = "max_iter" if model.summary.totalIterations >= max_iter else "converged"
    return Calibrator(features, mean, std, float(model.intercept), [float(w) for w in model.coefficients], base, l2, status)


def constant_columns(df: DataFrame, names: list[str]) -> bool:
    """Whether all of the columns are constant (to 1e-12)."""
    r = df.agg(*((F.max(n) - F.min(n)).alias(n) for n in names)).first()
    return all(r[n] is None or r[n] <= 1e-12 for n in names)
