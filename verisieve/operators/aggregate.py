"""Claim risks to responses and images."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def claim_to_response_max(responses: DataFrame, claims: DataFrame, key: str, claim_key: str, score: str, default: float = 0.0) -> DataFrame:
    """Every response with ``risk_score``, the largest of its claims' scores and ``default``."""
    top = claims.groupBy(F.col(claim_key).alias("__k")).agg(F.max(score).alias("__top"))
    out = responses.join(top, F.col(key) == F.col("__k"), "left")
    return out.withColumn("risk_score", F.greatest(F.coalesce("__top", F.lit(default)), F.lit(default))).drop("__k", "__top")


def flag(df: DataFrame, score: str = "risk_score", threshold="threshold", default: float = 0.5) -> DataFrame:
    """Adds ``is_high_risk``: the unrounded score reaches the row's threshold, or the default where it has none."""
    t = F.coalesce(F.col(threshold), F.lit(default)) if isinstance(threshold, str) else F.lit(float(threshold))
    return df.withColumn("is_high_risk", F.col(score) >= t)


def image_level(df: DataFrame, image: str, score: str, label: str, default: float = 0.0) -> DataFrame:
    """image, score, label: maxima per image.  Negative scores stay; a score that is not finite becomes ``default``."""
    out = df.groupBy(image).agg(F.max(score).alias("score"), F.max(label).alias("label"))
    bad = F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf"))
    return out.withColumn("score", F.when(bad, F.lit(default)).otherwise(F.col("score")))
