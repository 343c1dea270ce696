"""Moments and exact medians of many columns at once, for tables that are dear to work out: one pass each, added up in Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.durable import discard, materialize
from ..functions.scalars import num
from .ordered import at_medians, medians

#: Points that stand for the values of a task, batches that are held before they are drawn together, and half the share of ranks between pivots.
POINTS, HELD, PIVOT = 512, 32, 0.004

_PARTS = "i int, part long, n_rows long, n long, mean double, squares double, points array<double>"
_WHOLE = "i int, n_rows long, n long, mean double, squares double, low double, high double"


@dataclass
class Summary:
    """Rows, values that are not null, their mean and summed squared deviations, and two values on both sides of the median."""

    n_rows: int
    n: int
    mean: float
    squares: float
    low: float | None
    high: float | None

    @property
    def spread(self) -> float | None:
        """Sample deviation."""
        return math.sqrt(self.squares / (self.n - 1)) if self.n > 1 else None

    def filled(self, fill: float) -> tuple[float, float]:
        """Mean and population deviation with ``fill`` in place of nulls."""
        lacking = self.n_rows - self.n
        mean = (self.n * self.mean + lacking * fill) / self.n_rows
        squares = self.squares + self.n * (self.mean - mean) ** 2 + lacking * (fill - mean) ** 2
        return mean, math.sqrt(squares / self.n_rows)


def _columns(batch: pa.RecordBatch, d: int) -> np.ndarray:
    """A row per column; NaN for null."""
    return np.ascontiguousarray(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d).T)


def _drawn(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """``POINTS`` values of equal shares of the weight; none without values."""
    if not len(values):
        return values
    order = np.argsort(values, kind="stable")
    upto = np.cumsum(weights[order])
    return values[order][np.minimum(np.searchsorted(upto, (np.arange(POINTS) + 0.5) * upto[-1] / POINTS), len(values) - 1)]


def _joined(ns: np.ndarray, means: np.ndarray, squares: np.ndarray) -> tuple:
    """Number, mean and summed squared deviations of parts put together, along the first axis."""
    n = ns.sum(axis=0)
    mean = (ns * means).sum(axis=0) / np.maximum(n, 1)
    return n, mean, squares.sum(axis=0) + (ns * (means - mean) ** 2).sum(axis=0)


def summaries(df: DataFrame, names: list[str]) -> dict[str, Summary]:
    """A summary of each column, in one pass; the driver gets a row per column."""
    d = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n_rows, sums, held = 0, (np.zeros(d), np.zeros(d), np.zeros(d)), [[] for _ in range(d)]

        def draw() -> None:
            for i, parts in enumerate(held):
                if parts:
                    points = _drawn(np.concatenate([p for p, _ in parts]), np.concatenate([np.full(len(p), w / len(p)) for p, w in parts]))
                    held[i] = [(points, sum(w for _, w in parts))]

        for b in batches:
            if not b.num_rows:
                continue
            x = _columns(b, d)
            there = ~np.isnan(x)
            n = there.sum(axis=1)
            mean = np.where(there, x, 0.0).sum(axis=1) / np.maximum(n, 1)
            with np.errstate(invalid="ignore"):
                squares = np.where(there, x - mean[:, None], 0.0)
                sums = _joined(*(np.stack(p) for p in zip(sums, (n, mean, (squares * squares).sum(axis=1)), strict=True)))
            n_rows += b.num_rows
            x.sort(axis=1)  # NaN last
            for i in range(d):
                if n[i]:
                    held[i].append((x[i, ((np.arange(POINTS) + 0.5) * n[i] / POINTS).astype(int)] if n[i] > POINTS else x[i, : n[i]], float(n[i])))
            if len(held[0]) > HELD or max(map(len, held)) > HELD:
                draw()
        draw()
        if n_rows:
            part = TaskContext.get().partitionId()
            rows = [(i, part, n_rows, int(sums[0][i]), float(sums[1][i]), float(sums[2][i]), held[i][0][0].tolist() if held[i] else []) for i in range(d)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.float64())), 1))], ["i", "part", "n_rows", "n", "mean", "squares", "points"])

    def together(t: pa.Table) -> pa.Table:
        """One column: a row per task, with a bounded number of points."""
        t = t.sort_by("part")  # one order, one rounding
        ns = t.column("n").to_numpy().astype(float)
        with np.errstate(invalid="ignore"):
            n, mean, squares = _joined(ns, t.column("mean").to_numpy(), t.column("squares").to_numpy())
        points = [np.asarray(p, dtype=float) for p in t.column("points").to_pylist()]
        points = _drawn(np.concatenate(points), np.concatenate([np.full(len(p), k / max(len(p), 1)) for p, k in zip(points, ns, strict=True)]))
        at = lambda share: float(points[int(share * (len(points) - 1))]) if len(points) else None
        row = [t.column("i")[0].as_py(), sum(t.column("n_rows").to_pylist()), int(n), float(mean), float(squares), at(0.5 - PIVOT), at(0.5 + PIVOT + 1 / POINTS)]
        return pa.table([pa.array([v], k) for v, k in zip(row, (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.float64()), strict=True)], names=["i", "n_rows", "n", "mean", "squares", "low", "high"])

    x = df.select(F.array(*(num(c) for c in names)).alias("x"))
    got = {r.i: Summary(*r[1:]) for r in x.mapInArrow(run, _PARTS).groupBy("i").applyInArrow(together, _WHOLE).collect()}
    return {c: got.get(i, Summary(0, 0, 0.0, 0.0, None, None)) for i, c in enumerate(names)}


def exact_medians(df: DataFrame, known: dict[str, Summary]) -> dict[str, float]:
    """Median of each summarised column of ``df``, exact; none for a column without values.

    One pass counts the values below the lower pivot and takes out those from pivot to pivot, well under a hundredth; the rank of a
    median among those is known then.  A column whose median the pivots miss is sorted whole.
    """
    names = [c for c, s in known.items() if s.n]
    if not names:
        return {}
    d, low, high = len(names), [known[c].low for c in names], [known[c].high for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below = np.zeros(d, dtype=np.int64)
        for b in batches:
            x = _columns(b, d)
            for i in range(d):
                below[i] += int((x[i] < low[i]).sum())
                v, n = np.unique(x[i][(x[i] >= low[i]) & (x[i] <= high[i])], return_counts=True)
                if len(v):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), i), pa.int32()), pa.array(v, pa.float64()), pa.array(n, pa.int64())], ["i", "v", "n"])
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.nulls(d, pa.float64()), pa.array(below, pa.int64())], ["i", "v", "n"])

    x = df.select(F.array(*(num(c) for c in names)).alias("x"))
    counted = materialize(x.mapInArrow(run, "i int, v double, n long").groupBy("i", "v").agg(F.sum("n").alias("n")))
    below = {names[r.i]: r.n for r in counted.where("v is null").select("i", "n").collect()}  # a row per column
    held = counted.where("v is not null").select(F.element_at(F.array(*(F.lit(c) for c in names)), F.col("i") + 1).alias("name"), "v", "n")
    out, missed = at_medians(held, [(c, known[c].n, below.get(c, 0)) for c in names])
    got = {r["name"]: r["median"] for r in out.collect()}
    discard(counted)
    return got | ({r["name"]: r["median"] for r in medians(df.select(*(num(c).alias(c) for c in missed)), missed).collect()} if missed else {})
