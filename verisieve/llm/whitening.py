"""Embedding whitening by a one-sided Jacobi SVD of the factor that a blockwise QR leaves.

Entries become fixed-point integers first (``floor(scale * c)``), so counts, sums and distances from the mean are exact.  Each distinct
vector is fitted once.  Every task compresses its centred rows block by block to an upper triangle R (QR of R and the next block); the
triangles are merged ``MERGE`` at a time until one is left, with a size that depends on the dimension alone.  Plane rotations make
the columns of that R orthogonal, a round of disjoint pairs at a time; accumulated, they are the components, and the lengths of the columns
give the standard deviations without ever squaring the data's condition.

Vectors of different lengths are fitted apart, each length by itself.

Defined cases: a vector that is null or holds a null, a non-finite entry or one whose integer exceeds 62 bits is dropped; an empty vector
has no components; repeated rows are one vector of the fit and a result each; equal eigenvalues come in any order, the same for all rows; a
component without variance has null ``whitened``, and with no variance at all ``explained`` and ``identity_error`` are null; a squared distance that exceeds a long is null; null ids
stay null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: Rows of a QR block, triangles merged at a time, and sweeps of the rotations at most (about ten are needed).
BLOCK, MERGE, SWEEPS = 4096, 16, 60
#: Integers beyond this do not fit a long with room for the low and high parts of their sums.
LARGEST = float(1 << 62)


@dataclass
class Whitener:
    """Exact counts and sums of the fitted vectors of one length, components (columns) and standard deviations, falling."""

    n: int
    sums: list[int]
    components: np.ndarray
    deviations: np.ndarray

    @property
    def explained(self) -> np.ndarray:
        e = self.deviations**2
        return e / e.sum() if e.sum() > 0 else np.full(len(e), np.nan)

    def usable(self) -> np.ndarray:
        """Which components have variance beyond rounding."""
        s = self.deviations
        return s > (s[0] if len(s) else 0) * max(len(s), 1) * np.finfo(float).eps * 4

    def centred(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums)

    def whitened(self, x: np.ndarray, k: int) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            y = self.centred(x) @ self.components[:, :k] / self.deviations[:k]
        return np.where(self.usable()[:k], y, np.nan)

    def distance(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n * x - S)^2, exact; None beyond a long."""
        mean = np.array(self.sums, dtype=float)
        rough = ((self.n * x.astype(float) - mean) ** 2).sum(axis=1)
        safe = (rough < 2.0**60) & (np.abs(self.n * x.astype(float)).max(axis=1, initial=0) < 2.0**62)
        out: list[int | None] = [None] * len(x)
        if safe.any():
            d = self.n * x[safe] - np.array(self.sums, dtype=object).astype(np.int64) if max(map(abs, self.sums), default=0) < 1 << 62 else None
            if d is not None:
                for i, v in zip(np.flatnonzero(safe), (d * d).sum(axis=1), strict=True):
                    out[i] = int(v)
        for i in np.flatnonzero([o is None for o in out]):
            v = sum((self.n * int(a) - s) ** 2 for a, s in zip(x[i], self.sums, strict=True))
            out[i] = v if v < 1 << 63 else None
        return out


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n as doubles; the mean's whole part is taken off in integers."""
    whole = [s // n for s in sums]
    part = np.array([(s - w * n) / n for s, w in zip(sums, whole, strict=True)])
    if max(map(abs, whole), default=0) < 1 << 62 and (len(x) == 0 or np.abs(x).max(initial=0) < 1 << 62):
        return (x - np.array(whole, dtype=np.int64)).astype(float) - part
    return x.astype(float) - np.array([s / n for s in sums])


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values (falling) and right singular vectors (columns) of a square matrix by one-sided plane rotations.

    A round rotates disjoint pairs of columns, dealt as in a round-robin tournament; a sweep's rounds meet every pair once.
    """
    d = r.shape[1]
    m = d + d % 2
    a, v = np.zeros((m, m)), np.eye(m)
    a[: len(r), :d] = r
    scale = np.abs(a).max(initial=0)
    if scale > 0:
        a /= scale
    table = np.arange(m)
    for _ in range(SWEEPS):
        turned = False
        for _ in range(m - 1):
            p, q = table[: m // 2], table[::-1][: m // 2]
            x, y = a[:, p], a[:, q]
            alpha, beta, gamma = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            do = np.abs(gamma) > 1e-16 * np.sqrt(alpha * beta)
            if do.any():
                turned |= bool((np.abs(gamma[do]) > 1e-15 * np.sqrt(alpha[do] * beta[do])).any())
                with np.errstate(over="ignore"):  # columns of very different lengths turn by next to nothing
                    zeta = (beta - alpha) / (2 * np.where(do, gamma, 1.0))
                    t = np.where(do, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
                c = 1 / np.hypot(1.0, t)
                s = c * t
                for w in (a, v):
                    x, y = w[:, p].copy(), w[:, q].copy()
                    w[:, p], w[:, q] = c * x - s * y, s * x + c * y
            table = np.concatenate([table[:1], table[-1:], table[1:-1]])
        if not turned:
            break
    length = np.sqrt((a * a).sum(axis=0)) * scale
    order = np.argsort(-length, kind="stable")
    order = order[order < d] if d < m else order  # the column that was added has length 0 and takes part in no rotation
    return length[order], v[:d][:, order]


def fixed_point(vectors: DataFrame, key: str, vector: str, scale: int = 256) -> DataFrame:
    """id, x (array<long>) of the rows that take part."""
    v = F.transform(F.col(vector), lambda c: c.cast("double"))
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c * scale) >= LARGEST))
    x = F.transform(v, lambda c: F.floor(c * scale))
    return vectors.where(F.col(vector).isNotNull() & ~bad).select(F.col(key).cast("long").alias("id"), x.alias("x"))


def _stacked(b: pa.RecordBatch, column: str = "x") -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, rows of the batch, their vectors) for each dimension in a batch."""
    lists = b.column(b.schema.get_field_index(column))
    sizes = lists.value_lengths().to_numpy()
    flat, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield int(d), rows, flat[(offsets[rows][:, None] + np.arange(d))]


def totals(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """dimension -> count and exact sums.  Low and high halves are summed apart, so nothing overflows in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        seen: dict[int, list] = {}
        for b in batches:
            for d, rows, x in _stacked(b):
                low, high = (x & 0xFFFFFFFF).sum(axis=0), (x >> 32).sum(axis=0)
                have = seen.setdefault(d, [0, np.zeros(d, dtype=np.int64), np.zeros(d, dtype=np.int64)])
                seen[d] = [have[0] + len(rows), have[1] + low, have[2] + high]
        for d, (n, low, high) in seen.items():
            at = np.arange(-1, d)  # -1 carries the count
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d + 1, d)), pa.array(at), pa.array(np.concatenate([[n], low])), pa.array(np.concatenate([[0], high]))], ["dim", "at", "low", "high"])

    parts = fit.mapInArrow(run, "dim long, at long, low long, high long")
    wide = "decimal(38,0)"
    rows = parts.groupBy("dim", "at").agg(F.sum(F.col("low").cast(wide)).alias("low"), F.sum(F.col("high").cast(wide)).alias("high")).collect()  # a row per dimension
    out: dict[int, tuple[int, list[int]]] = {}
    for d in {r.dim for r in rows}:
        of = {r["at"]: int(r["low"]) + (int(r["high"]) << 32) for r in rows if r.dim == d}
        out[d] = of[-1], [of[i] for i in range(d)]
    return out


def _triangle(blocks: Iterator[np.ndarray], d: int) -> np.ndarray:
    r = np.zeros((0, d))
    for x in blocks:
        r = np.linalg.qr(np.concatenate([r, x]), mode="r")
    return r


def triangles(fit: DataFrame, of: dict[int, tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """dimension -> R of the centred rows: a triangle per task, merged ``MERGE`` at a time."""
    kind = "dim long, part long, r binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, now = TaskContext.get().partitionId(), {}
        for b in batches:
            for d, _, x in _stacked(b):
                if d:
                    now[d] = _triangle((x_ for x_ in [now.get(d, np.zeros((0, d))), *(centred(x[i : i + BLOCK], *of[d]) for i in range(0, len(x), BLOCK))]), d)
        yield pa.RecordBatch.from_arrays([pa.array(list(now), pa.int64()), pa.array([task] * len(now), pa.int64()), pa.array([r.tobytes() for r in now.values()], pa.binary())], ["dim", "part", "r"])

    def merge(key: tuple, rows: Iterator[pd.DataFrame] | pd.DataFrame) -> pd.DataFrame:
        d = int(key[0])
        r = _triangle((np.frombuffer(x).reshape(-1, d) for x in rows["r"]), d)
        return pd.DataFrame({"dim": [d], "part": [key[1]], "r": [r.tobytes()]})

    held = materialize(fit.mapInArrow(run, kind))
    while True:
        most = held.groupBy("dim").count().agg(F.max("count")).first()[0] or 0
        if most <= 1:
            break
        # tasks are numbered from 0, so a merge has at most MERGE triangles, and each round leaves a MERGE-th of the numbers
        merged = materialize(held.withColumn("part", F.floor(F.col("part") / MERGE)).groupBy("dim", "part").applyInPandas(merge, kind))
        discard(held)
        held = merged
    out = {int(r.dim): np.frombuffer(bytes(r.r)).reshape(-1, int(r.dim)) for r in held.collect()}  # one per dimension
    discard(held)
    return out


def fit(distinct: DataFrame) -> dict[int, Whitener]:
    """dimension -> whitener, from a written table of distinct vectors (``x``)."""
    of = totals(distinct.select("x"))
    out = {}
    for d, r in triangles(distinct.select("x"), of).items():
        s, w = jacobi(r)
        out[d] = Whitener(of[d][0], of[d][1], w, s / np.sqrt(of[d][0]))
    return out


def identity_errors(distinct: DataFrame, models: dict[int, Whitener], k: int) -> dict[int, float]:
    """dimension -> largest absolute entry of the covariance of the whitened fit list minus the identity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for d, _, x in _stacked(b):
                if d in models:
                    m = min(k, d, int(models[d].usable().sum()))
                    y = models[d].whitened(x, m)
                    have = sums.get(d, [np.zeros(m), np.zeros((m, m))])
                    sums[d] = [have[0] + y.sum(axis=0), have[1] + y.T @ y]
        rows = [(d, i, float(v)) for d, (a, c) in sums.items() for i, v in enumerate([*a, *c.reshape(-1)])]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["dim", "at", "v"])

    rows = distinct.select("x").mapInArrow(run, "dim long, at long, v double").groupBy("dim", "at").agg(F.sum("v").alias("v")).collect()  # k + k * k per dimension
    out = {}
    for d in {r.dim for r in rows}:
        v = np.array([r.v for r in sorted((r for r in rows if r.dim == d), key=lambda r: r["at"])])
        m = min(k, d, int(models[d].usable().sum()))
        mean, second = v[:m] / models[d].n, v[m:].reshape(m, m) / models[d].n
        out[int(d)] = float(np.abs(second - np.outer(mean, mean) - np.eye(m)).max()) if m else float("nan")
    return out


def whiten(vectors: DataFrame, k: int = 4, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """key, component (from 1), n, deviation, whitened, explained, identity_error: ``k`` rows for each vector, fewer if it is shorter."""
    rows = fixed_point(vectors, key, vector, scale)
    distinct = materialize(rows.groupBy("x").agg(F.lit(1).alias("one")).select("x"))
    models = fit(distinct)
    errors = identity_errors(distinct, models, k)
    discard(distinct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
        names = [key, "component", "n", "deviation", "whitened", "explained", "identity_error"]
        for b in batches:
            for d, at, x in _stacked(b):
                if d not in models:
                    continue
                m, w = min(k, d), models[d]
                ids = b.column(0).take(pa.array(np.repeat(at, m)))
                far = pa.array([v for v in w.distance(x) for _ in range(m)], pa.int64())
                real = lambda a: pa.array(np.asarray(a, dtype=float), pa.float64(), from_pandas=True)  # noqa: E731  (NaN becomes null)
                count = len(at)
                columns = [
                    ids, pa.array(np.tile(np.arange(1, m + 1), count), kinds[1]), pa.array(np.full(count * m, w.n), kinds[2]), far,
                    real(w.whitened(x, m).reshape(-1)), real(np.tile(w.explained[:m], count)), real(np.full(count * m, errors.get(d, np.nan))),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, f"`{key}` long, component int, n long, deviation long, whitened double, explained double, identity_error double")
