"""Streaming use of the evidence scorer.

A record that carries its evidence columns is scored without state, by the same expressions as in batch, so the frame may be a stream.
Selection and metrics need a whole set and stay batch operators (or run per micro-batch).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evidence
from ..operators.calibrate import Calibrator


def score_stream(rows: DataFrame, calibrator: Calibrator, fill: dict[str, float], branch: str) -> DataFrame:
    """Adds ``risk``.  ``branch`` and ``fill`` were fitted in batch, so a record's result does not depend on its neighbours."""
    d = evidence.impute(evidence.all_layers(evidence.refuse_targets(rows), branch), fill, strict=False)
    return d.withColumn("risk", calibrator.predict(d))


def start(rows: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False):
    """Runs ``sink`` on each micro-batch, restarting where ``checkpoint`` says."""
    w = rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def windowed_alarm_rate(rows: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Share of flagged rows per window; rows later than the watermark are left out."""
    return rows.withWatermark(time, late).groupBy(F.window(time, width)).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("is_high_risk").cast("double")).alias("rate"))
