"""Token counts under a unigram model, with dynamic programming shared along a trie.

A text is cut into pre-tokens that cover every byte of it: words (runs without ASCII white space, with the one space before them, if there
is one) and what is left of white-space runs.  Distinct pre-tokens are inserted in a trie and walked depth first, which is their sorted order:
the forward scores of a prefix stay on a stack while its children are visited, so each edge of the trie is scored once, however many pre-tokens
share it.  A terminal stores the token count of its pre-token; later occurrences are one look-up.  The pieces that can end at a place are
found by walking a second trie, of the vocabulary's pieces read backwards, so every piece counts, whatever its length.

The vocabulary is that of a public byte-level tokenizer (a ``.tiktoken`` file; its path is a parameter) and is not changed.  The model's
piece probabilities are estimated here: ``rounds`` times, all distinct pre-tokens of all texts are split under the current scores (at first
Zipf's law, ``-log(rank + 1)``), pieces are counted with the pre-tokens' frequencies, and a piece that occurs n times gets
``log((n + 1) / (total + pieces))``.  All single bytes are in, so every pre-token can be split.  Ties go to fewer tokens, then to the shorter
last piece.

Scale: pre-tokens are counted within tasks before the one shuffle, of distinct ones; the driver gets a row per piece of the vocabulary.  Counting
tokens shuffles nothing.  A worker keeps at most ``STORE`` counted pre-tokens of at most ``STORE_BYTES`` bytes, which bounds memory and changes no
result.

Defined cases: a null or empty text has 0 words and 0 tokens; one of white space has tokens and no words; repeated rows are counted alike, and
as often as they come; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

STORE, STORE_BYTES = 500_000, 64
PRE_TOKEN = re.compile(rb" ?[^\x09-\x0d\x20]+|[\x09-\x0d\x20]+(?![^\x09-\x0d\x20])|[\x09-\x0d\x20]+")
_END = -1
#: Of this Python worker: the model it counts with, its trie, and counted pre-tokens.
_KEPT: dict[bytes, tuple[dict, dict[bytes, int]]] = {}


def load_pieces(path: str) -> list[bytes]:
    """The vocabulary's pieces by rank."""
    with open(path, "rb") as f:
        ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    return [ranks[i] for i in sorted(ranks)]


def zipf(n: int) -> np.ndarray:
    return -np.log(np.arange(n) + 1.0)


def backward_trie(pieces: list[bytes], scores: np.ndarray) -> dict:
    """Nodes are dictionaries by byte; where a piece read backwards ends, ``_END`` holds (score, rank)."""
    root: dict = {}
    for rank, (piece, s) in enumerate(zip(pieces, scores.tolist(), strict=True)):
        node = root
        for b in reversed(piece):
            node = node.setdefault(b, {})
        node[_END] = (s, rank)
    return root


def walk(words: list[bytes], root: dict) -> Iterator[tuple[bytes, list[int], list[int], list[int]]]:
    """word, and by place in it: tokens up to there, where the last of them starts, and its rank.  Words come sorted; lists are reused."""
    best, count, start, rank = [0.0], [0], [0], [0]
    last = b""
    for w in sorted(words):
        shared, most = 0, min(len(w), len(last))
        while shared < most and w[shared] == last[shared]:
            shared += 1
        for x in (best, count, start, rank):
            del x[shared + 1 :]
        for i in range(shared, len(w)):
            node, top, n, at, piece = root, -math.inf, 0, 0, 0
            j = i
            while j >= 0:
                node = node.get(w[j])
                if node is None:
                    break
                end = node.get(_END)
                if end is not None:
                    c = best[j] + end[0]
                    if c > top or (c == top and count[j] < n - 1):
                        top, n, at, piece = c, count[j] + 1, j, end[1]
                j -= 1
            best.append(top)
            count.append(n)
            start.append(at)
            rank.append(piece)
        yield w, count, start, rank
        last = w


def count_words(words: list[bytes], root: dict) -> dict[bytes, int]:
    """Tokens of each distinct pre-token."""
    return {w: count[len(w)] for w, count, _, _ in walk(words, root)}


def count_pieces(words: list[bytes], times: list[int], root: dict, n: int) -> np.ndarray:
    """How often each piece occurs in the best splits."""
    often, out = dict(zip(words, times, strict=True)), [0] * n
    for w, _, start, rank in walk(words, root):
        k, i = often[w], len(w)
        while i:
            out[rank[i]] += k
            i = start[i]
    return np.array(out, dtype=np.int64)


def pre_token_counts(df: DataFrame, text: str) -> DataFrame:
    """w, n: the distinct pre-tokens of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: Counter[bytes] = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    told.update(PRE_TOKEN.findall(t.encode()))
                    if len(told) > STORE // 4:
                        yield pa.RecordBatch.from_arrays([pa.array(told.keys(), pa.binary()), pa.array(told.values(), pa.int64())], ["w", "n"])
                        told.clear()
        yield pa.RecordBatch.from_arrays([pa.array(told.keys(), pa.binary()), pa.array(told.values(), pa.int64())], ["w", "n"])

    return df.select(text).mapInArrow(run, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n"))


def fit_scores(df: DataFrame, pieces: list[bytes], text: str = "text", rounds: int = 2) -> np.ndarray:
    """Log probabilities of the pieces, by rank."""
    scores = zipf(len(pieces))
    if not rounds:
        return scores
    words = materialize(pre_token_counts(df, text))
    for _ in range(rounds):
        now = scores

        def run(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            root, total = backward_trie(pieces, now), np.zeros(len(pieces), dtype=np.int64)
            for b in batches:
                total += count_pieces(b.column(0).to_pylist(), b.column(1).to_pylist(), root, len(pieces))
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["rank", "n"])

        told = words.sortWithinPartitions("w").mapInArrow(run, "rank long, n long").groupBy("rank").agg(F.sum("n").alias("n"))
        n = np.zeros(len(pieces))
        for r in told.collect():  # a row per piece of the vocabulary at most
            n[r[0]] = r[1]
        scores = np.log((n + 1) / (n.sum() + len(pieces)))
    discard(words)
    return scores


def token_counts(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", rounds: int = 2) -> DataFrame:
    """key, n_words long, n_tokens long for every row."""
    pieces = load_pieces(vocabulary)
    scores = fit_scores(df, pieces, text, rounds)

    def kept() -> tuple[dict, dict[bytes, int]]:
        model = scores.tobytes()
        if model not in _KEPT:
            _KEPT.clear()
            _KEPT[model] = backward_trie(pieces, scores), {}
        return _KEPT[model]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, known = kept()
        for b in batches:
            n_words, n_tokens = [], []
            for t in b.column(1).to_pylist():
                data = t.encode() if t else b""
                words = PRE_TOKEN.findall(data)
                new = {w for w in words if w not in known}
                long: dict[bytes, int] = {}
                if new:
                    if len(known) + len(new) > STORE:
                        known.clear()
                        new = set(words)
                    for w, n in count_words(list(new), root).items():
                        (known if len(w) <= STORE_BYTES else long)[w] = n
                n_words.append(len(data.split()))
                n_tokens.append(sum(map(known.__getitem__, words)) if not long else sum(long[w] if w in long else known[w] for w in words))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], [key, "n_words", "n_tokens"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, n_words long, n_tokens long")
