"""Packing of token pieces into fixed-length sequences by length patterns.

Documents are tokenized whole; one longer than a sequence is cut into full pieces behind a first piece that may be shorter.  Then only
lengths matter.  Patterns of up to three lengths that fill a sequence exactly are enumerated, their repeat counts are fitted to the
histogram of lengths by non-negative least squares (block coordinate descent), rounded to counts that the
histogram allows, and what remains is packed best-fit, longest first, again by counts per length.  The plan has a few thousand entries
whatever the input, because lengths are bounded by the sequence; the driver sees the histogram only (a row per length).

Pieces find their place by an exact rank among the pieces of their length.  Ranks come from hash buckets, so a length that a third of all
pieces have does not meet in one task.  Tokenizing moves no text: each task returns a narrow row per piece, written once.

Defined cases: a null or empty text is one piece, the end token; equal rows are separate pieces; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, salted_offsets

#: How the tokenizer's file splits text before merging (a fixed value of that vocabulary).
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct words whose ids a worker keeps, and their characters; the store is cleared when either is full.
STORE, STORE_CHARS = 400_000, 1 << 25
#: Share of the fitted repeats that is used, rounded down.  The rest leaves best fit a mixture of lengths that it packs almost without gaps.
KEEP = 0.8


def byte_of_char() -> dict[str, int]:
    """How byte-level vocabularies write bytes: printable Latin-1 as itself, the others from U+0100 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


class WordTokenizer:
    """Ids of whole texts, word by word.

    The byte-level pre-tokenizer splits before a single space and around a single newline between other characters, and never joins ids
    across such a place.  So words there are encoded once, by ``tiktoken`` on the vocabulary in the ``tokenizers`` file (a tenth of the
    time on short strings), and looked up afterwards.  Texts with other white-space runs or with the special token's spelling are
    encoded whole by ``tokenizers``.  Tests compare the ids with those of ``tokenizers`` on whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        chars = byte_of_char()
        ranks = {bytes(chars[c] for c in w): i for w, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if all(c in chars for c in w)}
        self.merges = tiktoken.Encoding("bpe", pat_str=PRE_TOKENS, mergeable_ranks={k: v for k, v in ranks.items() if k.decode("latin-1") not in self.special}, special_tokens={})
        self.starts = np.zeros(max(ranks.values(), default=0) + 1, dtype=bool)  # ids that begin a word's key
        self.starts[[i for w, i in ranks.items() if w[:1] == b" " or w == b"\n"]] = True
        self.store: dict[str, bytes | None] = {}
        self.chars = 0

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        """Encodes new keys in one call.  Keys are words; one that begins with a newline follows that newline, any other a space."""
        keys = []
        self.chars += sum(map(len, words))
        for w in dict.fromkeys(words):
            rest = w[1:] if w[:1] == "\n" else w
            if not rest or rest[0].isspace() or "\x1c" <= rest[0] <= "\x1f" or rest[-1].isspace():
                self.store[w] = None
            else:
                keys.append(w)
        ids = self.merges.encode_to_numpy("".join([w if w[0] == "\n" else " " + w for w in keys]))
        at = np.flatnonzero(self.starts[ids])
        if len(at) != len(keys):
            self.store.update(dict.fromkeys(keys))
            return
        data, cuts = ids.astype("<u4").tobytes(), [*(4 * at).tolist(), 4 * len(ids)]
        self.store.update((w, data[i:j]) for w, i, j in zip(keys, cuts, cuts[1:], strict=False))

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a text."""
        if not text or any(x in text for x in self.special):
            return self.whole(text)
        store = self.store
        if len(store) > STORE or self.chars > STORE_CHARS:
            store.clear()
            self.chars = 0
        # the newline put in front makes the first word a line's first; its id is taken off again
        words = ("\n" + text).replace("\n", " \n").split(" ")
        del words[0]
        new = [w for w in words if w not in store]
        if new:
            self.learn(new)
        try:
            return b"".join(map(store.__getitem__, words))[4:]
        except TypeError:  # a None in the store
            return self.whole(text)


def pieces(docs: DataFrame, tokenizer: str, length: int = 1024, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, piece, start, length, ids_crc32; no shuffle."""
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordTokenizer(tokenizer)
        for b in batches:
            rows, out = [], []
            for i, t in enumerate(b.column(1)):
                ids = coder.encode(t.as_py() or "") + end
                n = len(ids) // 4
                start, stop, p = 0, n % length or min(n, length), 0
                while start < n:
                    rows.append(i)
                    out.append((p, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
                    start, stop, p = stop, stop + length, p + 1
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 4, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), *columns], [key, "piece", "start", "length", "ids_crc32"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, piece int, start long, length long, ids_crc32 long")


def patterns(counts: np.ndarray) -> np.ndarray:
    """Pairs and triples of lengths in use that sum to the sequence, as rows of three, zero-padded; ascending in a row."""
    size = len(counts) - 1
    used = np.flatnonzero(counts)
    used = used[(used > 0) & (used < size)]
    rows = []
    for a in used:
        b = used[(used >= a) & (2 * used <= size - a)]
        c = size - a - b
        ok = counts[c] > 0
        if ok.any():
            rows.append(np.stack([np.full(ok.sum(), a), b[ok], c[ok]], axis=1))
    half = used[2 * used <= size]
    half = half[counts[size - half] > 0]
    rows.append(np.stack([np.zeros_like(half), half, size - half], axis=1))
    return np.concatenate(rows) if rows else np.zeros((0, 3), dtype=np.int64)


def fit(found: np.ndarray, counts: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative least squares of pattern repeats against the histogram.

    Block coordinate descent: each round takes the patterns with the largest steps that share no length, moves each to its minimum
    (never below zero) and updates the residual.  It ends when no step reaches a quarter of a sequence.
    """
    size = len(counts)
    real = found > 0
    twice = (found[:, 0] == found[:, 1]) & real[:, 0], found[:, 1] == found[:, 2]
    norm = real.sum(axis=1) + 2.0 * (twice[0].astype(int) + twice[1]) + 2.0 * (twice[0] & twice[1])
    rest = counts.astype(np.float64)
    rest[0] = 0
    x = np.zeros(len(found))
    for _ in range(rounds):
        step = np.maximum(rest[found].sum(axis=1) / norm, -x)
        far = np.abs(step)
        top = np.argpartition(-far, min(4096, len(far) - 1))[:4096]
        top = top[np.argsort(-far[top], kind="stable")]
        if far[top[0]] < 0.25:
            break
        used = np.zeros(size, dtype=bool)
        take = []
        for i, ls in zip(top.tolist(), found[top].tolist(), strict=True):
            if far[i] < 0.25:
                break
            if not (used[ls[1]] or used[ls[2]] or used[ls[0]]):
                used[ls] = True
                used[0] = False
                take.append(i)
        x[take] += step[take]
        np.subtract.at(rest, found[take].ravel(), np.repeat(step[take], 3))
        rest[0] = 0
    return x


def best_fit(counts: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, by counts: (lengths of a sequence, how many such sequences)."""
    open_: dict[int, list[list]] = {}
    put = lambda have, n: open_.setdefault(size - sum(have), []).append([have, n]) if n else None
    for length in np.flatnonzero(counts)[::-1]:
        length, c = int(length), int(counts[length])
        while c:
            space = min((s for s, bins in open_.items() if s >= length and bins), default=None)
            if space is None:
                have, n, space = (), c, size
            else:
                have, n = open_[space].pop()
            q = min(space // length, c)
            m = min(n, c // q)
            put((*have, *[length] * q), m)
            if have:
                put(have, n - m)
            c -= m * q
    return [(have, n) for bins in open_.values() for have, n in bins]


def plan(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences), covering the histogram exactly."""
    counts = np.zeros(size + 1, dtype=np.int64)
    for k, v in histogram.items():
        counts[k] = v
    out: list[tuple[tuple[int, ...], int]] = [((size,), int(counts[size]))] if counts[size] else []
    counts[size] = 0
    found = patterns(counts)
    if len(found):
        x = fit(found, counts)
        x = np.floor(x * KEEP).astype(np.int64)
        for i in sorted(np.flatnonzero(x), key=lambda i: -x[i]):
            need: dict[int, int] = {}
            for v in found[i]:
                if v:
                    need[int(v)] = need.get(int(v), 0) + 1
            n = min(int(x[i]), *(int(counts[v]) // k for v, k in need.items()))
            if n:
                out.append((tuple(int(v) for v in found[i] if v), n))
                for v, k in need.items():
                    counts[v] -= n * k
    return out + best_fit(counts, size)


def places(packed: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """length -> rows of (first rank, first sequence, offset): where the pieces of that length go, by rank."""
    taken: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int]]] = {}
    first = 0
    for lengths, n in packed:
        offset = 0
        for v in lengths:
            rows.setdefault(v, []).append((taken.get(v, 0), first, offset))
            taken[v] = taken.get(v, 0) + n
            offset += v
        first += n
    return {v: np.asarray(r, dtype=np.int64) for v, r in rows.items()}


def pack(docs: DataFrame, tokenizer: str, length: int = 1024, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = materialize(pieces(docs, tokenizer, length, end_id, key, text))
    histogram = {int(r[0]): int(r[1]) for r in cut.groupBy("length").count().collect()}  # a row per length
    where = places(plan(histogram, length))
    ranked = salted_offsets(cut, ["length"], [key, "piece", "ids_crc32"], "rank")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sequence, offset = np.zeros(len(b), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
            for v, idx in b.groupby("length").indices.items():
                w, r = where[int(v)], b["rank"].to_numpy()[idx]
                at = np.searchsorted(w[:, 0], r, side="right") - 1
                sequence[idx], offset[idx] = w[at, 1] + r - w[at, 0], w[at, 2]
            yield b.assign(sequence_id=sequence, offset=offset).drop(columns="rank")

    columns = [key, "piece", "start", "length", "ids_crc32"]
    kinds = dict(cut.dtypes)
    return ranked.select(*columns, "rank").mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", sequence_id long, offset long")
