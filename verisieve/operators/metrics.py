"""Evaluation metrics as aggregates: Brier, weighted AUROC, reliability curve, calibration error, paired clustered bootstrap."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.durable import materialize
from .ordered import prefix_sums, quantiles


def brier(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.agg(F.avg(F.pow(F.col(p) - F.col(y), F.lit(2.0))).alias("brier"))


def auroc(df: DataFrame, y: str, score: str, weight: str | None = None) -> DataFrame:
    """One row, ``auroc``: weighted share of positive-negative pairs in the right order, ties half; NULL with one class only."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    c = df.groupBy(F.col(score).cast("double").alias("s")).agg(F.sum(F.when(F.col(y) == 1, w).otherwise(0.0)).alias("pos"), F.sum(F.when(F.col(y) == 0, w).otherwise(0.0)).alias("neg"))
    c = prefix_sums(c.where("s is not null"), "s", ["neg"])
    won = F.sum(F.col("pos") * (F.col("neg_upto") - F.col("neg") * 0.5))
    return c.agg(F.try_divide(won, F.sum("pos") * F.sum("neg")).alias("auroc"))


def bin_edges(df: DataFrame, p: str, n_bins: int, strategy: str) -> list[float]:
    """Inner edges only."""
    if strategy == "uniform":
        return [float(x) for x in np.linspace(0.0, 1.0, n_bins + 1)[1:-1]]
    if strategy == "quantile":
        return sorted({float(x) for x in quantiles(df, p, [i / n_bins for i in range(1, n_bins)]) if x is not None})
    raise ValueError("strategy must be uniform or quantile")


def reliability_curve(df: DataFrame, y: str, p: str, n_bins: int = 15, strategy: str = "uniform") -> DataFrame:
    """bin, mean_predicted, observed, n of the bins that hold rows.  A value's bin is the number of inner edges at or below it."""
    edges = bin_edges(df, p, n_bins, strategy)
    at = F.size(F.filter(F.array(*(F.lit(e) for e in edges)), lambda e: e <= F.col(p))) if edges else F.lit(0)
    checked = F.when((F.col(p) < 0) | (F.col(p) > 1), F.raise_error(F.lit("probabilities must lie in [0, 1]"))).otherwise(at)
    return df.groupBy(checked.cast("int").alias("bin")).agg(F.avg(p).alias("mean_predicted"), F.avg(F.col(y).cast("double")).alias("observed"), F.count(F.lit(1)).alias("n"))


def ece(curve: DataFrame) -> DataFrame:
    return curve.agg((F.sum(F.col("n") * F.abs(F.col("observed") - F.col("mean_predicted"))) / F.sum("n")).alias("ece"))


def ece_grid(df: DataFrame, y: str, p: str, bins: tuple[int, ...] = (10, 15, 20), strategies: tuple[str, ...] = ("uniform", "quantile")) -> DataFrame:
    """strategy, n_bins, ece for every cell of the grid, in one pass over the rows."""
    asked = sorted({i / n for n in bins for i in range(1, n)}) if "quantile" in strategies else []
    at_q = dict(zip(asked, quantiles(df, p, asked), strict=True)) if asked else {}
    cells = []
    for s in strategies:
        for n in bins:
            edges = sorted({float(at_q[i / n]) for i in range(1, n) if at_q[i / n] is not None}) if s == "quantile" else bin_edges(df, p, n, s)
            at = F.size(F.filter(F.array(*(F.lit(e) for e in edges)), lambda e: e <= F.col(p))) if edges else F.lit(0)
            cells.append(F.struct(F.lit(s).alias("strategy"), F.lit(n).alias("n_bins"), at.alias("bin")))
    long = df.select(F.col(p).alias("__p"), F.col(y).cast("double").alias("__y"), F.array(*cells).alias("__c")).select("__p", "__y", F.explode("__c").alias("c"))
    per = long.groupBy("c.strategy", "c.n_bins", "c.bin").agg(F.abs(F.avg("__y") - F.avg("__p")).alias("gap"), F.count(F.lit(1)).alias("n"))
    return per.groupBy("strategy", "n_bins").agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"))


def calibration_gain(df: DataFrame, y: str, before: str, after: str, n_bins: int = 15, strategy: str = "uniform") -> DataFrame:
    """ece_before, ece_after, gain = (before - after) / before."""
    a = ece(reliability_curve(df, y, before, n_bins, strategy)).withColumnRenamed("ece", "ece_before")
    b = ece(reliability_curve(df, y, after, n_bins, strategy)).withColumnRenamed("ece", "ece_after")
    return a.join(b).withColumn("gain", F.try_divide(F.col("ece_before") - F.col("ece_after"), F.col("ece_before")))  # one row each


def gain_grid(df: DataFrame, y: str, before: str, control: str, after: str, bins: tuple[int, ...] = (5, 10, 15, 20), strategies: tuple[str, ...] = ("uniform", "quantile")) -> DataFrame:
    """strategy, n_bins, ece_before, ece_control, ece_after, gain, gain_over_control for each cell of the grid.

    ``control`` is the raw signal with a calibrator of its own: what is gained over it comes from the features, not from calibration.
    A gain over an error of 0 is null.
    """
    cells = None
    for name, p in (("before", before), ("control", control), ("after", after)):
        part = ece_grid(df, y, p, bins, strategies).withColumnRenamed("ece", f"ece_{name}")
        cells = part if cells is None else cells.join(part, ["strategy", "n_bins"])
    gain = lambda base: F.try_divide(F.col(base) - F.col("ece_after"), F.col(base))
    return cells.withColumns({"gain": gain("ece_before"), "gain_over_control": gain("ece_control")})


#: Images in a block whose draws share one generator, and rows that a task of the bootstrap holds at most on average.
BLOCK, TASK_ROWS = 1024, 1_000_000


#: Up to so many distinct scores, replicates are counted by blocks of images, each drawn once.
FEW = 256


def _totals(seed: int, replicate: int, images: int) -> tuple[np.ndarray, np.ndarray]:
    """Images of each block, and how many of all draws fall to it."""
    size = np.full(-(-images // BLOCK), BLOCK)
    size[-1] = images - BLOCK * (len(size) - 1)
    return size, np.random.default_rng([seed, replicate]).multinomial(images, size / images)


def _within(seed: int, replicate: int, block: int, size: int, total: int) -> np.ndarray:
    return np.pad(np.random.default_rng([seed, replicate, int(block) + 1]).multinomial(total, np.full(size, 1 / size)), (0, BLOCK - size))


def _draws(seed: int, replicate: int, images: int, blocks: np.ndarray) -> np.ndarray:
    """How often a replicate draws each image of the given blocks, one after another; all images' draws add up to their number.

    Draws are made in two steps, of totals per block and of images within a block, each by its own seed.  So any task can make those of the
    blocks it needs, and the counts are multinomial as a whole.
    """
    size, totals = _totals(seed, replicate, images)
    each = [_within(seed, replicate, b, size[b], totals[b]) for b in blocks]
    return np.concatenate(each) if each else np.zeros(0, dtype=np.int64)


def _by_blocks(long: DataFrame, scores: list[tuple[str, float]], n: int, total: int, replicates: int, seed: int) -> DataFrame:
    """side, part, r, pos, neg, won of every replicate over all rows, for few distinct scores (ordered by side and score).

    A task draws each of its blocks of images once for each of its replicates and adds up positives and negatives per score, a product of
    two matrices; sums of all tasks are then added per replicate.  ``long``: side, s, at, pos, neg.
    """
    spark, d = long.sparkSession, len(scores)
    blocks = -(-n // BLOCK)
    parts = max(min(16, blocks), -(-total // TASK_ROWS))
    shares = max(1, min(replicates, 64 // parts))
    numbers = spark.createDataFrame([(side, s, k) for k, (side, s) in enumerate(scores)], "side string, s double, k int")
    dealt = long.join(F.broadcast(numbers), ["side", "s"]).select((F.floor(F.col("at") / BLOCK) % parts).alias("part"), "at", "k", "pos", "neg")
    dealt = dealt.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))

    def count(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        share = int(key[1])
        rs = list(range(share, replicates, shares))
        size, _ = _totals(seed, 0, n)
        totals = np.array([_totals(seed, r, n)[1] for r in rs]).reshape(len(rs), len(size))
        base, got = np.zeros(2 * d), np.zeros((len(rs), 2 * d))
        for b, rows in pdf.groupby(pdf["at"] // BLOCK):
            m = np.zeros((BLOCK, 2 * d))
            at, k = rows["at"].to_numpy() % BLOCK, rows["k"].to_numpy()
            np.add.at(m, (at, k), rows["pos"].to_numpy())
            np.add.at(m, (at, d + k), rows["neg"].to_numpy())
            w = np.array([_within(seed, r, b, size[b], totals[i, b]) for i, r in enumerate(rs)], dtype=np.float64)
            base += m.sum(axis=0)
            got += w @ m
        own = [(-1, base)] if share == 0 else []
        return pd.DataFrame([(r, x.tolist()) for r, x in [*own, *zip(rs, got, strict=True)]], columns=["r", "x"])

    is_a = np.array([side == "a" for side, _ in scores], dtype=bool)

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r, xs in pdf.groupby("r")["x"]:
            x = np.sum(np.stack(xs.to_list()), axis=0)
            for side, own in (("a", is_a), ("b", ~is_a)):
                p, q = x[:d][own], x[d:][own]
                out.append((side, 0, r, p.sum(), q.sum(), float((p * (np.cumsum(q) - q / 2)).sum())))
        return pd.DataFrame(out, columns=["side", "part", "r", "pos", "neg", "won"])

    sums = dealt.groupBy("part", "share").applyInPandas(count, "r int, x array<double>")
    return sums.groupBy(F.pmod("r", F.lit(64)).alias("q")).applyInPandas(add, "side string, part int, r int, pos double, neg double, won double")


def paired_bootstrap(df: DataFrame, y: str, a: str, b: str, image: str, replicates: int = 5000, seed: int = 20260920) -> DataFrame:
    """delta (AUROC of a minus that of b), low, high (2.5 and 97.5 %), p_not_better, n_replicates.

    Whole images are resampled with replacement, as many as there are.  Rows are counted per (image, score) and dealt into ranges of
    scores; a task goes through all replicates for its range and returns, for each, weighted positives, negatives and pairs won inside the
    range.  Ranges are then put together by a running sum per replicate.  With up to ``FEW`` distinct scores tasks take blocks of images
    instead of ranges, each block drawn once, with the same draws.  Nothing is held whole, and draws depend on (seed, replicate,
    image) only.  Replicates with one class are left out; if none is left, or there are no rows, that is an error.
    """
    rows = df.select(F.col(y).cast("int").alias("y"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"), F.coalesce(F.col(image).cast("string"), F.lit("\0")).alias("i"))
    images = rows.select("i").distinct()
    images = materialize(images.withColumn("h", F.xxhash64("i")))
    n = images.count()
    if not n:
        raise ValueError("no rows to resample")
    # numbers 0..n-1: a rank by hash, and among equal hashes by name
    place = prefix_sums(images.groupBy("h").agg(F.count(F.lit(1)).alias("k")), "h", ["k"]).select("h", (F.col("k_upto") - F.col("k")).alias("base"))
    inside = Window.partitionBy("h").orderBy("i")
    numbered = images.join(place, "h").select("i", (F.col("base") + F.row_number().over(inside) - 1).alias("at"))
    pair = F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("a").alias("s")), F.struct(F.lit("b").alias("side"), F.col("b").alias("s"))))
    long = rows.select("i", "y", pair.alias("x")).groupBy("i", "x.side", "x.s").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    long = materialize(long.where("s is not null").join(numbered, "i"))
    total = long.count()
    seen = sorted((r.side, r.s) for r in long.select("side", "s").distinct().limit(FEW + 1).collect())
    if len(seen) <= FEW and not any(np.isnan(x) for _, x in seen):
        return _interval(_by_blocks(long, seen, n, total, replicates, seed))
    ranges = max(1, -(-total // (2 * TASK_ROWS)), min(32, -(-total // 4096)))
    cuts = long.groupBy("side").agg(F.array_distinct(F.percentile_approx("s", [i / ranges for i in range(1, ranges)] or [0.5], 10_000)).alias("cuts"))  # two rows
    part = F.size(F.filter("cuts", lambda c: c <= F.col("s"))) if ranges > 1 else F.lit(0)
    dealt = long.join(F.broadcast(cuts), "side").select("side", part.alias("part"), "s", "at", "pos", "neg")
    # replicates are shared out too, so that few ranges still fill a cluster
    shares = max(1, min(replicates, 64 // ranges))
    dealt = dealt.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    groups = ["side", "part", "share"]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        side, part, share = key
        pdf = pdf.sort_values(["s", "at"], kind="stable")
        s, at = pdf["s"].to_numpy(), pdf["at"].to_numpy()
        pos, neg = pdf["pos"].to_numpy(dtype=np.float64), pdf["neg"].to_numpy(dtype=np.float64)
        start = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        blocks, where = np.unique(at // BLOCK, return_inverse=True)
        where = where * BLOCK + at % BLOCK
        out = []
        for r in [*([-1] if share == 0 else []), *range(int(share), replicates, shares)]:
            if r < 0:
                w = np.ones(len(at))  # replicate -1 is the table itself
            else:
                w = _draws(seed, r, n, blocks)[where].astype(np.float64)
            p, q = np.add.reduceat(w * pos, start), np.add.reduceat(w * neg, start)
            out.append((side, int(part), r, p.sum(), q.sum(), float((p * (np.cumsum(q) - q / 2)).sum())))
        return pd.DataFrame(out, columns=["side", "part", "r", "pos", "neg", "won"])

    told = dealt.groupBy(*groups).applyInPandas(run, "side string, part int, r int, pos double, neg double, won double")
    below = Window.partitionBy("side", "r").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    told = told.withColumn("won", F.col("won") + F.col("pos") * F.coalesce(F.sum("neg").over(below), F.lit(0.0)))
    return _interval(told)


def _interval(told: DataFrame) -> DataFrame:
    auc = told.groupBy("side", "r").agg(F.try_divide(F.sum("won"), F.sum("pos") * F.sum("neg")).alias("auc"))
    sign = F.when(F.col("side") == "a", F.col("auc")).otherwise(-F.col("auc"))
    deltas = auc.groupBy("r").agg(F.when(F.count("auc") == 2, F.sum(sign)).alias("delta"))
    drawn = lambda x: F.when(F.col("r") >= 0, x)
    out = deltas.agg(
        F.max(F.when(F.col("r") < 0, F.col("delta"))).alias("delta"), F.percentile(drawn(F.col("delta")), 0.025).alias("low"), F.percentile(drawn(F.col("delta")), 0.975).alias("high"),
        F.avg(drawn((F.col("delta") <= 0).cast("double"))).alias("p_not_better"), F.count(drawn(F.col("delta"))).alias("n_replicates"),
    )
    none = F.raise_error(F.lit("no replicate holds both classes"))
    return out.withColumn("n_replicates", F.when(F.col("n_replicates") > 0, F.col("n_replicates")).otherwise(none.cast("bigint")))
