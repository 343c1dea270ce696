"""Helpers that several operators share: a durable hand-over between jobs, exact ranks without hot partitions, word patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.durable import discard, materialize, shared_dir  # noqa: F401  (operators take them from here)

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows that a sort within a hash bucket holds on average, at most.
BUCKET_ROWS = 250_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only; every other character stays."""
    return F.translate(col, _UPPER, _UPPER.lower())


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def salted_offsets(df: DataFrame, keys: list[str], order: list[str], rank: str, value: str | None = None, start: str | None = None, buckets: int | None = None) -> DataFrame:
    """Adds ``rank``, exact and gapless from 0 within ``keys`` in a fixed pseudorandom order, and ``start``, the sum of ``value`` before.

    A plain ``row_number`` puts a whole key in one task.  Here each key is cut into hash buckets; ranks within a bucket start at the
    number of rows in the buckets before it, so the largest sort holds a ``buckets``-th of the hottest key.  Their number grows with the
    table: no sort need hold more than about ``BUCKET_ROWS`` rows.  ``df`` is read several times: hand over a materialised table.
    ``keys`` hold no nulls; rows equal in ``order`` share a bucket and are interchangeable.
    """
    if buckets is None:
        buckets = max(256, -(-df.count() // BUCKET_ROWS))
    d = df.withColumn("__b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    by = [*keys, "__b"]
    sums = {rank: F.lit(1).cast("long")} | ({start: F.col(value).cast("long")} if value and start else {})
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = d.groupBy(*by).agg(*(F.sum(v).alias(f"__n_{k}") for k, v in sums.items()))
    starts = starts.select(*by, *(F.coalesce(F.sum(f"__n_{k}").over(before), F.lit(0)).alias(f"__s_{k}") for k in sums))
    inner = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumns({k: F.coalesce(F.sum(v).over(inner), F.lit(0)) for k, v in sums.items()})
    return d.join(starts, by).withColumns({k: F.col(k) + F.col(f"__s_{k}") for k in sums}).drop("__b", *(f"__s_{k}" for k in sums))
