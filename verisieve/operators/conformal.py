"""Conformal p-values and step-up selection.

``accepted`` marks the responses that the procedure selects: high risk gives a small p-value, so these are the risky ones
(``flagged_risky`` says the same under a plainer name).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.durable import materialize
from .ordered import prefix_sums

PROCEDURES = ("BH", "BY")


def _by_score(calibration: DataFrame, test: DataFrame, score: str) -> tuple[DataFrame, int]:
    """(a row per distinct score: s, p_value, tests; number of calibration rows).  Both tables are read once."""
    side = lambda df, cal: df.select(F.col(score).cast("double").alias("s"), F.lit(cal).cast("long").alias("is_cal"))
    both = side(calibration, 1).unionByName(side(test, 0))
    held = materialize(both.groupBy("s").agg(F.sum("is_cal").alias("cal"), F.sum(1 - F.col("is_cal")).alias("tests")))
    n = held.agg(F.sum("cal")).first()[0] or 0
    if not n:
        raise ValueError("calibration scores are empty")
    c = prefix_sums(held.where("s is not null"), "s", ["cal"], descending=True)
    return c.select("s", ((F.col("cal_upto") + 1) / F.lit(float(n + 1))).alias("p_value"), "tests"), n


def _beside(test: DataFrame, by_score: DataFrame, score: str) -> DataFrame:
    p = by_score.select(F.col("s").alias("__s"), "p_value")
    return test.join(p, F.col(score).cast("double") == F.col("__s"), "left").drop("__s")


def p_values(calibration: DataFrame, test: DataFrame, score: str = "score") -> DataFrame:
    """``test`` with p_value = (1 + calibration scores at or above it) / (calibration rows + 1).

    The range join is a running count over distinct scores, highest first; scores then join back by value.
    """
    return _beside(test, _by_score(calibration, test, score)[0], score)


def harmonic(m: int) -> float:
    """1 + 1/2 + ... + 1/m, by the asymptotic series from 100,000 on (error below 1e-15)."""
    if m < 100_000:
        return sum(1.0 / i for i in range(1, m + 1))
    import math

    return math.log(m) + 0.5772156649015329 + 1 / (2 * m) - 1 / (12 * m * m)


def cut_of(counts: DataFrame, alpha: float, procedure: str) -> float | None:
    """The largest p-value that the procedure accepts; ``counts`` has a row per distinct p-value: p, n (tests)."""
    if procedure not in PROCEDURES:
        raise ValueError(f"procedure must be one of {PROCEDURES}")
    if not 0 < alpha < 1:
        raise ValueError("alpha must lie between 0 and 1")
    held = materialize(counts)
    m = held.agg(F.sum("n")).first()[0] or 0
    bound = alpha / (max(m, 1) * (harmonic(m) if procedure == "BY" else 1.0))
    c = prefix_sums(held, "p", ["n"])
    return c.agg(F.max(F.when(F.col("p") <= F.lit(bound) * F.col("n_upto"), F.col("p")))).first()[0]


def _accepted(df: DataFrame, p: str, cut: float | None) -> DataFrame:
    return df.withColumn("accepted", F.lit(False) if cut is None else F.coalesce(F.col(p) <= F.lit(cut), F.lit(False)))


def step_up(df: DataFrame, alpha: float = 0.1, procedure: str = "BY", p: str = "p_value") -> DataFrame:
    """Adds ``accepted``.  The rank of a tied block is that of its last member, which has the loosest bound."""
    counts = df.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    return _accepted(df, p, cut_of(counts, alpha, procedure))


def select(calibration: DataFrame, test: DataFrame, score: str = "score", alpha: float = 0.1, procedure: str = "BY") -> DataFrame:
    """p_values and step_up over one table of distinct scores: the inputs are read once for it, and ``test`` once more for the result."""
    by_score = materialize(_by_score(calibration, test, score)[0])
    counts = by_score.where("tests > 0").groupBy(F.col("p_value").alias("p")).agg(F.sum("tests").alias("n"))
    out = _accepted(_beside(test, by_score, score), "p_value", cut_of(counts, alpha, procedure))
    return out.withColumn("flagged_risky", F.col("accepted"))


def summary(selected: DataFrame, label: str | None = None, null_label: int = 1) -> DataFrame:
    """n_test, n_accepted, and with labels the share of ``null_label`` among the accepted (NULL if none is)."""
    n = F.sum(F.col("accepted").cast("long"))
    cols = [F.count(F.lit(1)).alias("n_test"), F.coalesce(n, F.lit(0)).alias("n_accepted")]
    if label:
        cols.append(F.try_divide(F.sum((F.col("accepted") & (F.col(label) == null_label)).cast("double")), n.cast("double")).alias("fdp"))
    return selected.agg(*cols)
