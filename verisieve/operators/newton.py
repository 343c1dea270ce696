"""The L2-regularised logistic fit by damped Newton steps over distributed rows.

Every pass is one job: each task adds up the loss, the gradient and the Hessian of its rows in Arrow batches, partial sums are added
``FAN`` at a time in a tree, and the driver gets at most ``FAN`` of them, whose size depends on the number of features alone.  The step is solved
there.  A whole step is tried together with its gradient and Hessian, so an accepted one costs one pass; a refused one costs a pass that
takes the loss of eight shorter steps at once.

Standardised rows are written once in the shared folder: every pass reads them, and a lost executor repeats its own tasks only.  Rows that
are many times as wide as what they are made of can be worked out anew in every pass instead (``written``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.durable import discard, materialize
from ..functions.scalars import EPS
from .calibrate import Calibrator, finite, statistics

#: Partial sums that are added at a time, rows of a block, and steps that a search tries at once.
FAN, BLOCK, TRIED = 16, 4096, 8

_SUMS = "part long, n long, loss double, gradient array<double>, hessian array<double>"
_ARROW = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("loss", pa.float64()), ("gradient", pa.list_(pa.float64())), ("hessian", pa.list_(pa.float64()))])


@dataclass
class Step:
    """One line of the fit's log: loss and largest gradient entry before the step, and its length (0: none was taken)."""

    iteration: int
    objective: float
    gradient: float
    length: float


@dataclass
class Fit:
    calibrator: Calibrator
    log: list[Step] = field(default_factory=list)


@dataclass
class Sums:
    n: int
    loss: float
    gradient: np.ndarray
    hessian: np.ndarray


def _blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows with a leading 1, labels)."""
    for b in batches:
        for i in range(0, b.num_rows, BLOCK):
            part = b.slice(i, BLOCK)
            x = part.column(1).flatten().to_numpy().reshape(-1, d)
            yield np.concatenate([np.ones((len(x), 1)), x], axis=1), part.column(0).to_numpy()


def _loss(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Negative log-likelihoods; the larger of two terms comes out of the logarithm, so no value overflows."""
    return np.logaddexp(0.0, z) - y[:, None] * z if z.ndim == 2 else np.logaddexp(0.0, z) - y * z


def _added(sums: DataFrame) -> DataFrame:
    """Partial sums added along a tree: ``FAN`` neighbours at a time until ``FAN`` are left."""

    def add(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")  # one order, one rounding
        total = lambda c: np.stack([np.asarray(v) for v in t.column(c).to_pylist()]).sum(axis=0)
        row = [t.column("part")[0].as_py() // FAN, sum(t.column("n").to_pylist()), math.fsum(t.column("loss").to_pylist()), total("gradient").tolist(), total("hessian").tolist()]
        return pa.table([pa.array([v], k) for v, k in zip(row, _ARROW.types, strict=True)], schema=_ARROW)

    n = sums.rdd.getNumPartitions()  # parts are numbered from 0
    while n > FAN:
        sums, n = sums.groupBy(F.floor(F.col("part") / FAN).alias("g")).applyInArrow(add, _SUMS), -(-n // FAN)
    return sums


def sums_at(rows: DataFrame, weights: np.ndarray, hessian: bool = True) -> Sums:
    """Sums over rows (y double, x array<double>) at ``weights``, the intercept first: loss, gradient and, unless left out, Hessian."""
    d = len(weights) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n, loss, g, h = 0, 0.0, np.zeros(d + 1), np.zeros((d + 1, d + 1))
        for x, y in _blocks(batches, d):
            z = x @ weights
            p = 0.5 * (1.0 + np.tanh(0.5 * z))
            n, loss = n + len(y), loss + float(_loss(z, y).sum())
            g += x.T @ (p - y)
            if hessian:
                h += (x * (p * (1.0 - p))[:, None]).T @ x
        row = [TaskContext.get().partitionId(), n, loss, g.tolist(), h.reshape(-1).tolist() if hessian else []]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, _ARROW.types, strict=True)], schema=_ARROW)

    got = sorted(_added(rows.select("y", "x").mapInArrow(run, _SUMS)).collect(), key=lambda r: r.part)  # FAN rows at most
    total = lambda name, size: np.sum([np.array(r[name]) for r in got], axis=0) if got else np.zeros(size)
    h = total("hessian", (d + 1) ** 2).reshape(d + 1, d + 1) if hessian else np.zeros((0, 0))
    return Sums(sum(r.n for r in got), math.fsum(r.loss for r in got), total("gradient", d + 1), h)


def losses_at(rows: DataFrame, weights: np.ndarray, step: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Summed losses at ``weights - t * step`` for each length t, in one pass."""
    d = len(weights) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(lengths)), 0
        for x, y in _blocks(batches, d):
            total += _loss((x @ weights)[:, None] - (x @ step)[:, None] * lengths, y).sum(axis=0)
            n += len(y)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(lengths))), pa.array(total)], ["i", "loss"])

    parts = rows.select("y", "x").mapInArrow(run, "i long, loss double").groupBy("i").agg(F.sum("loss").alias("loss"))
    return np.array([r.loss for r in sorted(parts.collect(), key=lambda r: r.i)])  # a row per length


def standardised(df: DataFrame, features: list[str], label: str, mean: list[float], std: list[float]) -> DataFrame:
    """y, x: missing and infinite values count 0 before centring.  A null label is refused."""
    z = [(F.coalesce(finite(f), F.lit(0.0)) - m) / s for f, m, s in zip(features, mean, std, strict=True)]
    y = F.col(f"`{label}`").cast("double")
    y = F.when(y.isNull(), F.raise_error(F.lit(f"{label} has null rows"))).otherwise(y)
    return df.select(y.cast("double").alias("y"), F.array(*z).alias("x"))


def fit(df: DataFrame, features: list[str], label: str, l2: float = 0.05, max_iter: int = 200, tol: float = 1e-9, written: bool = True, start: Calibrator | None = None, known: dict[str, tuple[float, float]] | None = None) -> Fit:
    """Minimises the mean loss plus ``l2 * |w|^2`` (intercept free) until no gradient entry reaches ``tol``.

    ``start`` is a fit to other features of the same rows: the steps begin at its weights for the features that both have.  ``known`` has mean and
    population deviation of each feature, if they have been taken.

    Status: ``converged``; ``no_decrease`` if no shorter step lowers the objective any more (the limit of rounding); ``max_iter``;
    ``single_class`` for labels of one class or none, which give their base rate.
    """
    base, classes, mean, std = statistics(df, [] if known else features, label)
    if known:
        mean, std = [known[f][0] for f in features], [known[f][1] if known[f][1] > 1e-8 else 1.0 for f in features]
    if classes < 2:
        return Fit(Calibrator(features, fallback=base, l2=l2, status="single_class"))
    rows = standardised(df, features, label, mean, std)
    rows = materialize(rows) if written else rows
    d = len(features)
    ridge = np.concatenate([[0.0], np.full(d, 2.0 * l2)])
    penalty = lambda w: l2 * float(w[1:] @ w[1:])
    w = np.concatenate([[math.log(base / (1.0 - base))], np.zeros(d)])
    if start is not None and start.weights is not None:
        known = dict(zip(start.features, zip(start.weights, start.mean, start.std, strict=True), strict=True))
        # weights for the means and deviations of this fit
        there = [known.get(f, (0.0, 0.0, 1.0)) for f in features]
        w = np.array([start.intercept + sum(v * (m - a) / b for m, (v, a, b) in zip(mean, there, strict=True)), *(v * s / b for s, (v, _, b) in zip(std, there, strict=True))])
    now, log, status = sums_at(rows, w), [], "max_iter"
    for i in range(max_iter):
        value, g = now.loss / now.n + penalty(w), now.gradient / now.n + ridge * w
        steep = float(np.abs(g).max())
        if steep < tol:
            status = "converged"
            log.append(Step(i + 1, value, steep, 0.0))
            break
        try:
            step = np.linalg.solve(now.hessian / now.n + np.diag(ridge) + 1e-10 * np.eye(d + 1), g)
        except np.linalg.LinAlgError:
            step = g
        enough = lambda t, v, g=g, step=step, value=value: v <= value - 1e-4 * t * float(g @ step) or v < value
        whole = sums_at(rows, w - step)
        length = 1.0 if enough(1.0, whole.loss / whole.n + penalty(w - step)) else 0.0
        tried = 1
        while not length and tried < 60:
            ts = 0.5 ** np.arange(tried, tried + TRIED)
            for t, loss in zip(ts, losses_at(rows, w, step, ts), strict=True):
                if enough(t, loss / now.n + penalty(w - t * step)):
                    length = float(t)
                    break
            tried += TRIED
        log.append(Step(i + 1, value, steep, length))
        if not length:
            status = "no_decrease"
            break
        w = w - length * step
        now = whole if length == 1.0 else sums_at(rows, w)
    discard(rows)
    return Fit(Calibrator(features, mean, std, float(w[0]), [float(v) for v in w[1:]], base, l2, status), log)


def objective(df: DataFrame, calibrator: Calibrator, label: str) -> DataFrame:
    """n, loss, objective of a calibrator on labelled rows: one aggregate, all built-ins."""
    z: Column = calibrator.linear(df)
    y = F.col(f"`{label}`").cast("double")
    loss = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - y * z
    penalty = calibrator.l2 * sum(w * w for w in calibrator.weights or [])
    out = df.select(loss.alias("l")).agg(F.count("l").alias("n"), F.avg("l").alias("loss"))
    return out.withColumn("objective", F.col("loss") + F.lit(penalty))


def derivatives(df: DataFrame, calibrator: Calibrator, label: str) -> DataFrame:
    """row, col, value of the objective's first and second derivatives at a calibrator's coefficients (0 is the intercept).

    First derivatives have ``col`` -1.  There are (d + 1) * (d + 2) rows, whatever the number of data rows.
    """
    c = calibrator
    w = np.array([c.intercept, *c.weights])
    ridge = np.concatenate([[0.0], np.full(len(c.features), 2.0 * c.l2)])
    s = sums_at(standardised(df, c.features, label, c.mean, c.std), w)
    n = max(s.n, 1)
    g, h = s.gradient / n + ridge * w, s.hessian / n + np.diag(ridge)
    rows = [(i, -1, float(v)) for i, v in enumerate(g)] + [(i, j, float(h[i, j])) for i in range(len(w)) for j in range(len(w))]
    return df.sparkSession.createDataFrame(rows, "row int, col int, value double")
