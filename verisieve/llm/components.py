"""Connected components of an edge table by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


#: Copies of a node's row, so that the edges of a hub meet it in several tasks.
SALTS = 8


def _beside(e: DataFrame, m: DataFrame) -> DataFrame:
    """Each edge with its node's ``m``."""
    m = m.withColumn("s", F.explode(F.array(*(F.lit(i) for i in range(SALTS)))))
    return e.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(m.hint("merge"), ["u", "s"])


def _large(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    m = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return _beside(both.where("v > u"), m).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(e: DataFrame) -> DataFrame:
    m = e.groupBy("u").agg(F.min("v").alias("m"))
    other = _beside(e, m).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return other.union(m.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of ``edges`` (u long, v long; any direction, repeats and loops allowed).

    Each round writes its edges to the shared folder, so no plan grows and lost executors cost one round.  The edge count never grows;
    rounds are about the logarithm of the longest path.
    """
    low, high = F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")
    e = materialize(edges.where("u <> v").select(high, low).distinct())
    before = None
    while True:
        new = materialize(_small(_large(e)))
        discard(e)
        e = new
        r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        now = (r[0], r[1])
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
