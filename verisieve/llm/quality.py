"""Document quality by a linear-chain conditional random field over lines.

Every line of a text gets a good/bad label from a two-state chain.  A line's features are character-class shares, word and repetition
statistics, and those of its two neighbours.  The chain is trained here, by limited-memory quasi-Newton steps on the conditional likelihood with a
ridge penalty, from labelled documents whose lines inherit the document's label.  A document's score is the average of its lines'
forward-backward marginals of ``good``, weighted by length (plus one, so empty lines count a little).

Fitting takes a bounded sample of documents: the ``sample`` labelled ids that come first in a hash order (4,000 by default), whatever their length.
It learns from all their lines.  Features are made by the executors and written once; each evaluation of the likelihood is a job whose tasks
add up their lines' losses and gradients, and the driver gets one vector of ``SUMS`` numbers a task.  A document of over ``even`` lines counts as
much as one of ``even`` lines, so that a few long ones do not outvote the rest.  A document of over ``MANY`` lines comes in runs of so many, each
line with its true neighbours; of such a document only the likelihood of the step from one run to the next is not there to learn from.
Scoring reads every whole text, in place, without a shuffle.

Defined cases: a null or empty text is one empty line and gets a score like any other; without labels of both classes every score is the
share of good labels (0.5 without any); labels that disagree on a document count as bad; of rows that repeat an id, one is learned from (the one
whose text has the smallest hash); repeated rows score alike; an empty table gives an
empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, partitions

SAMPLE = 4000
#: Lines that a longer document counts as.
EVEN = 128
#: Steps of the fit at most, the ridge, and tasks that make features (of the bounded sample).
STEPS, RIDGE, TASKS = 40, 1e-3, 64
#: Lines whose features are held at once, at most about twice as many.
MANY = 8192

_PUNCT = [c for c in range(33, 127) if not chr(c).isalnum()]
#: Class of each byte: 0 lower letter, 1 upper letter, 2 digit, 3 space, 4 other control, 5 byte of a longer character, then a class for each punctuation mark.
_CLASS = np.full(256, 5, dtype=np.int64)
_CLASS[:128] = 4
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[32] = 0, 1, 2, 3
for _i, _c in enumerate(_PUNCT):
    _CLASS[_c] = 6 + _i
CLASSES = 6 + len(_PUNCT)
OWN = CLASSES + 13
#: Weights of a line's features, and of the four moves; with the loss they are what a task adds up.
PARAMETERS = 3 * OWN + 3 + 4
SUMS = 1 + PARAMETERS
_CHUNK = 1 << 22


def _block(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Features of every line of ``data`` that its bytes alone give, and the lines' lengths in bytes."""
    a = np.frombuffer(data, dtype=np.uint8)
    line = np.zeros(len(a), dtype=np.int64)
    brk = a == 10
    np.cumsum(brk[:-1], out=line[1:]) if len(a) else None
    n = int(brk.sum()) + 1
    kind = _CLASS[a]
    keep = ~brk
    counts = np.bincount(line[keep] * CLASSES + kind[keep], minlength=n * CLASSES).reshape(n, CLASSES).astype(np.float64)
    length = counts.sum(axis=1)
    space = (a == 32) | (a == 9) | (a == 13) | brk
    before = np.concatenate(([True], space[:-1]))
    after = np.concatenate((space[1:], [True]))
    per = lambda mask: np.bincount(line[mask], minlength=n)
    starts = ~space & before
    words = np.maximum(per(starts), 1)
    mark = kind >= 6
    same = np.concatenate(([False], a[1:] == a[:-1]))
    f = np.empty((n, OWN))
    f[:, :CLASSES] = counts / np.maximum(length, 1)[:, None]
    c = CLASSES
    f[:, c] = np.log1p(length)
    f[:, c + 1] = np.log1p(words)
    f[:, c + 2] = np.minimum(length / words, 40) / 10
    f[:, c + 3] = per(~space & after & mark) / words
    f[:, c + 4] = per(same & mark) / words
    f[:, c + 5] = per(starts & (kind == 1)) / words
    f[:, c + 6] = per(~space & before & after) / words
    f[:, c + 7] = length == 0
    f[:, c + 8 :] = 0
    return f, length


def line_repeats(lines: list[str]) -> np.ndarray:
    """How many other lines of the text are equal to each."""
    seen: dict[str, int] = {}
    for x in lines:
        seen[x] = seen.get(x, 0) + 1
    return np.array([seen[x] - 1 for x in lines], dtype=np.float64)


def line_features(texts: list[str], repeats: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """features of all lines in order, their lengths, and the number of lines of each text.  ``repeats`` is given for parts of a text."""
    n_lines = np.array([t.count("\n") + 1 for t in texts], dtype=np.int64)
    f, length = _block("\n".join(texts).encode())
    repeat, told = np.zeros(len(f)) if repeats is None else repeats, []
    at = 0
    for t, n in zip(texts, n_lines, strict=True):
        lines = t.split("\n")
        if n > 1 and repeats is None:
            repeat[at : at + n] = line_repeats(lines)
        for x in lines:
            w = x.split(" ")
            told.append((len(w), len(set(w)), sum(map(eq, w, w[1:]))))
        at += n
    counts = np.array(told, dtype=np.float64)
    f[:, CLASSES + 10] = 1 - counts[:, 1] / counts[:, 0]
    f[:, CLASSES + 11] = np.minimum(counts[:, 2], 10)
    f[:, CLASSES + 12] = counts[:, 2] / counts[:, 0]
    f[:, CLASSES + 8] = np.minimum(repeat, 5)
    f[:, CLASSES + 9] = repeat > 0
    return f, length, n_lines


def with_neighbours(f: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
    """Own features, the line before's and the line after's (zeros at the ends of a text), two flags for the ends, and a constant."""
    ends = np.cumsum(n_lines)
    first, last = np.zeros(len(f), dtype=bool), np.zeros(len(f), dtype=bool)
    first[ends - n_lines] = True
    last[ends - 1] = True
    prev, nxt = np.roll(f, 1, axis=0), np.roll(f, -1, axis=0)
    prev[first], nxt[last] = 0, 0
    flags = np.stack([first, last, np.ones(len(f), dtype=bool)], axis=1).astype(f.dtype)
    return np.concatenate([f, prev, nxt, flags], axis=1)


@dataclass
class Chain:
    """A two-state chain: ``weights`` score the good state of a line, ``moves[i, j]`` the step from state i to j."""

    mean: np.ndarray
    std: np.ndarray
    weights: np.ndarray
    moves: np.ndarray
    constant: float | None = None

    def emissions(self, f: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
        return with_neighbours((f - self.mean) / self.std, n_lines) @ self.weights


def marginals(e: np.ndarray, n_lines: np.ndarray, moves: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward for all texts at once, by line number: P(good) of each line, expected moves (2 x 2), log normalizer of each text.

    ``weights`` (one a text) count in the expected moves.
    """
    order = np.argsort(-n_lines, kind="stable")
    n = n_lines[order]
    at0 = (np.cumsum(n_lines) - n_lines)[order]
    longest = int(n[0]) if len(n) else 0
    alpha = np.zeros((len(e), 2))
    beta = np.zeros((len(e), 2))
    alpha[at0, 1] = e[at0]
    for t in range(1, longest):
        i = at0[: np.searchsorted(-n, -t, side="left")] + t
        p = alpha[i - 1]
        alpha[i] = np.logaddexp(p[:, :1] + moves[0], p[:, 1:] + moves[1])
        alpha[i, 1] += e[i]
    for t in range(longest - 1, 0, -1):
        i = at0[: np.searchsorted(-n, -t, side="left")] + t
        q = beta[i].copy()
        q[:, 1] += e[i]
        beta[i - 1] = np.logaddexp(moves[:, 0] + q[:, :1], moves[:, 1] + q[:, 1:])
    last = at0 + n - 1
    z = np.logaddexp(alpha[last, 0], alpha[last, 1])
    zs = np.empty(len(n))
    zs[order] = z
    each = np.repeat(zs, n_lines)
    good = np.exp(np.clip(alpha[:, 1] + beta[:, 1] - each, -700, 0))
    second = np.ones(len(e), dtype=bool)
    second[at0] = False
    i = np.flatnonzero(second)
    pair = np.zeros((2, 2))
    w = np.repeat(np.ones(len(n)) if weights is None else weights, n_lines)[i]
    for x in (0, 1):
        for y in (0, 1):
            pair[x, y] = np.exp(np.clip(alpha[i - 1, x] + moves[x, y] + beta[i, y] + (e[i] if y else 0) - each[i], -700, 0)) @ w
    return good, pair, zs


@dataclass
class Runs:
    """Lines of several runs.  Lines that are not ``inner`` stand beside a run, there as neighbours only."""

    f: np.ndarray
    n_lines: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    inner: np.ndarray

    def likelihood(self, chain: Chain) -> np.ndarray:
        """Negative log-likelihood and its gradient, as sums over the runs by weight."""
        x = with_neighbours((self.f - chain.mean) / chain.std, self.n_lines)[self.inner]
        n = np.add.reduceat(self.inner.astype(np.int64), np.cumsum(self.n_lines) - self.n_lines)
        e = x @ chain.weights
        good, pair, z = marginals(e, n, chain.moves, self.weights)
        y, w = np.repeat(self.labels, n), np.repeat(self.weights, n)
        stays = np.diag([((n - 1) * self.weights)[self.labels == c].sum() for c in (0, 1)])
        loss = z @ self.weights - e @ (y * w) - (stays * chain.moves).sum()
        return np.concatenate([[loss], x.T @ ((good - y) * w), (pair - stays).ravel()])

    def moments(self) -> np.ndarray:
        """Weight of the inner lines, sums of their features and of the squares."""
        w, f = np.repeat(self.weights, self.n_lines)[self.inner], self.f[self.inner]
        return np.concatenate([[w.sum()], w @ f, w @ (f * f)])


def minimise(evaluate: Callable[[np.ndarray], tuple[float, np.ndarray]], size: int, steps: int, memory: int = 10) -> np.ndarray:
    """Limited-memory BFGS with backtracking, from zero."""
    p = np.zeros(size)
    value, g = evaluate(p)
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.abs(g).max() < 1e-6:
            break
        d, back = -g, []
        for s, y in reversed(kept):
            back.append((s @ d) / (s @ y))
            d = d - back[-1] * y
        if kept:
            s, y = kept[-1]
            d = d * (s @ y) / (y @ y)
        for (s, y), a in zip(kept, reversed(back), strict=True):
            d = d + (a - (y @ d) / (s @ y)) * s
        step = 1.0 if kept else min(1.0, 1 / np.abs(g).sum())
        for _ in range(30):
            q = p + step * d
            v, h = evaluate(q)
            if v <= value + 1e-4 * step * (g @ d):
                break
            step /= 2
        else:
            break
        s, y = q - p, h - g
        if s @ y > 1e-12 * (y @ y):
            kept = [*kept, (s, y)][-memory:]
        fell, p, value, g = value - v, q, v, h
        if fell <= 1e-6 * value:
            break
    return p


def descend(chain: Chain, total: Callable[[Chain], np.ndarray], count: float, steps: int, ridge: float) -> Chain:
    """The chain of the smallest mean loss plus penalty.  ``total`` adds up ``likelihood`` over all runs, ``count`` documents."""

    def at(p: np.ndarray) -> Chain:
        return Chain(chain.mean, chain.std, p[:-4], p[-4:].reshape(2, 2))

    def evaluate(p: np.ndarray) -> tuple[float, np.ndarray]:
        t = total(at(p)) / count
        return t[0] + ridge / 2 * p @ p, t[1:] + ridge * p

    return at(minimise(evaluate, PARAMETERS, steps))


def standardised(moments: np.ndarray, base: float) -> Chain:
    """A chain of zero weights with the mean and deviation of each feature."""
    mean = moments[1 : OWN + 1] / max(moments[0], 1e-300)
    std = np.sqrt(np.maximum(moments[OWN + 1 :] / max(moments[0], 1e-300) - mean**2, 0))
    return Chain(mean, np.where(std < 1e-6, 1.0, std), np.zeros(PARAMETERS - 4), np.zeros((2, 2)), base)


def train(f: np.ndarray, n_lines: np.ndarray, labels: np.ndarray, steps: int = STEPS, ridge: float = RIDGE, even: int = EVEN) -> Chain:
    """The fit on arrays: all lines of all texts, in order."""
    runs = Runs(f, n_lines, labels, np.minimum(1, even / np.maximum(n_lines, 1)), np.ones(len(f), dtype=bool))
    chain = standardised(runs.moments(), float(labels.mean()) if len(labels) else 0.5)
    return descend(chain, runs.likelihood, len(labels), steps, ridge) if len(set(labels.tolist())) > 1 else chain


def long_emissions(chain: Chain, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Emissions and lengths of the lines of one text, made ``MANY`` lines at a time."""
    lines = text.split("\n")
    repeats = line_repeats(lines)
    e, length = [], []
    for i in range(0, len(lines), MANY):
        low, high = max(0, i - 1), min(len(lines), i + MANY + 1)
        part = "\n".join(lines[low:high])
        f, size, n = line_features([part], repeats[low:high].copy())
        x = with_neighbours((f - chain.mean) / chain.std, n)
        if low:  # the first line of a part is not the text's
            x[0, 3 * OWN] = 0
        if high < len(lines):
            x[-1, 3 * OWN + 1] = 0
        to = slice(i - low, min(i + MANY, len(lines)) - low)
        e.append(x[to] @ chain.weights)
        length.append(size[to])
    return np.concatenate(e), np.concatenate(length)


def score_texts(chain: Chain, texts: list[str]) -> np.ndarray:
    if chain.constant is not None:
        return np.full(len(texts), chain.constant)
    if len(texts) == 1 and texts[0].count("\n") >= MANY:
        e, length = long_emissions(chain, texts[0])
        n_lines = np.array([len(e)], dtype=np.int64)
    else:
        f, length, n_lines = line_features(texts)
        e = chain.emissions(f, n_lines)
    good, _, _ = marginals(e, n_lines, chain.moves)
    starts = np.cumsum(n_lines) - n_lines
    w = length + 1
    return np.clip(np.add.reduceat(good * w, starts) / np.add.reduceat(w, starts), 0, 1)


def line_runs(rows: DataFrame, even: int = EVEN, run: int = MANY) -> DataFrame:
    """Features of every line of ``rows`` (k, y, t), in runs of up to ``run`` lines: k, y, weight (the document's), at (the run's first line),
    before and after (1 if the line beside it comes along), f."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, size = [], 0
            for k, y, t in zip(b["k"], b["y"], b["t"], strict=True):
                lines = (t if isinstance(t, str) else "").split("\n")
                repeats, n = line_repeats(lines), len(lines)
                for i in range(0, n, run):
                    j = min(n, i + run)
                    low, high = max(0, i - 1), min(n, j + 1)
                    f, _, _ = line_features(["\n".join(lines[low:high])], repeats[low:high].copy())
                    out.append((k, y, min(1.0, even / n), i, i - low, high - j, f.astype(np.float32).tobytes()))
                    size += high - low
                    if size >= MANY:
                        yield pd.DataFrame(out, columns=["k", "y", "weight", "at", "before", "after", "f"])
                        out, size = [], 0
            yield pd.DataFrame(out, columns=["k", "y", "weight", "at", "before", "after", "f"])

    return rows.mapInPandas(made, f"k {dict(rows.dtypes)['k']}, y int, weight double, at long, before int, after int, f binary")


def held_runs(batches: Iterator[pd.DataFrame]) -> Iterator[Runs]:
    """Rows of ``line_runs``, about ``MANY`` lines at a time."""

    def joined() -> Runs:
        f, y, w, before, after = zip(*held, strict=True)
        n = np.array([len(x) for x in f], dtype=np.int64)
        inner, ends = np.ones(int(n.sum()), dtype=bool), np.cumsum(n)
        inner[(ends - n)[np.array(before) == 1]] = False
        inner[ends[np.array(after) == 1] - 1] = False
        return Runs(np.concatenate(f).astype(np.float64), n, np.array(y, dtype=np.int64), np.array(w), inner)

    held: list[tuple] = []
    lines = 0
    for b in batches:
        for f, *others in zip(*(b[c] for c in ("f", "y", "weight", "before", "after")), strict=True):
            held.append((np.frombuffer(f, dtype=np.float32).reshape(-1, OWN), *others))
            lines += len(held[-1][0])
            if lines >= MANY:
                yield joined()
                held, lines = [], 0
    if held:
        yield joined()


def added(runs: DataFrame, part: Callable[[Runs], np.ndarray]) -> np.ndarray | float:
    """The sum of ``part`` over all runs; a task returns one vector."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [0.0]
        for r in held_runs(batches):
            parts = [parts[0] + part(r)]
        if isinstance(parts[0], np.ndarray):
            yield pd.DataFrame({"part": [parts[0].tobytes()]})

    got = runs.select("f", "y", "weight", "before", "after").mapInPandas(run, "part binary").collect()
    return sum(np.frombuffer(r[0]) for r in got)


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, even: int = EVEN, steps: int = STEPS,
) -> Chain:
    """``labels`` has key and label (0 or 1) of the rows that may be learned from."""
    few = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("k")).agg(F.min(label).cast("int").alias("y"))
    few = few.orderBy(F.xxhash64("k"), "k").limit(sample)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(few), "k")  # ``sample`` rows of two numbers
    rows = rows.groupBy("k").agg(F.min("y").alias("y"), F.min_by("t", F.xxhash64("t")).alias("t"))
    rows = rows.repartition(min(TASKS, partitions(docs.sparkSession)), "k").sortWithinPartitions("k")  # in order, so that sums come again
    runs = materialize(line_runs(rows, even))
    count = {r[0]: r[1] for r in runs.where("at = 0").groupBy("y").count().collect()}
    n = sum(count.values())
    base = count.get(1, 0) / n if n else 0.5
    if len(count) < 2:
        chain = Chain(np.zeros(OWN), np.ones(OWN), np.zeros(PARAMETERS - 4), np.zeros((2, 2)), base)
    else:
        start = standardised(added(runs, Runs.moments), base)
        chain = descend(start, lambda c: added(runs, lambda r: r.likelihood(c)), n, steps, RIDGE)
    discard(runs)
    return chain


def score(chain: Chain, text: Column) -> Column:
    """The score of each row's text; no shuffle, and other columns stay where they are."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            texts = [t if isinstance(t, str) else "" for t in b]
            got, i = np.zeros(len(texts)), 0
            while i < len(texts):  # slices of bounded size, a text at least
                j, size, lines = i + 1, len(texts[i]), texts[i].count("\n")
                while j < len(texts) and j < i + 256 and size + len(texts[j]) < _CHUNK:
                    lines += texts[j].count("\n") + 1
                    if lines >= MANY:
                        break
                    size += len(texts[j])
                    j += 1
                got[i:j] = score_texts(chain, texts[i:j])
                i = j
            yield pd.Series(got)

    return F.pandas_udf(run, "double")(text)
