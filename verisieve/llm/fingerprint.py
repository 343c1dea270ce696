"""Document fingerprints: a quartile bucket digest of hashed byte triplets.

Byte triplets of a text (two zero bytes lead, so one-byte texts have one) are hashed into 256 buckets.  Each bucket's count becomes two
bits: how many of the three quartiles of all 256 counts lie below it.  The digest is the length class (two hex digits, eight classes per
doubling) and the 256 codes (128 hex digits).  Two digests differ by the sum of absolute code differences plus half the length class
difference, bounded by ``BOUND``, the difference expected of unrelated codes; likeness is ``1 - difference / BOUND``.

Equal texts have equal digests.  A null text counts as empty; an empty one has all codes 0 and length class 0.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions

BUCKETS = 256
BOUND = 1.25 * BUCKETS
_CHUNK = 1 << 22


def digests(texts: list[bytes]) -> np.ndarray:
    """One row per text: length class, then 256 codes, as uint8.  Works through bounded slices of the joined bytes."""
    counts = np.zeros((len(texts), BUCKETS), dtype=np.int64)
    for i, t in enumerate(texts):
        for at in range(0, len(t), _CHUNK):
            lead = b"\0\0" if at == 0 else t[at - 2 : at]
            a = np.frombuffer(lead + t[at : at + _CHUNK], dtype=np.uint8).astype(np.uint32)
            code = (a[:-2] | (a[1:-1] << np.uint32(8)) | (a[2:] << np.uint32(16))) * np.uint32(2654435761)
            counts[i] += np.bincount(code >> np.uint32(24), minlength=BUCKETS)
    ordered = np.sort(counts, axis=1)
    out = np.zeros((len(texts), BUCKETS + 1), dtype=np.uint8)
    for q in (64, 128, 192):
        out[:, 1:] += counts > ordered[:, q - 1 : q]
    out[:, 0] = [min(255, round(8 * math.log2(1 + len(t)))) for t in texts]
    return out


def encode(row: np.ndarray) -> str:
    c = row[1:].reshape(-1, 4)
    return f"{int(row[0]):02x}" + (c[:, 0] << 6 | c[:, 1] << 4 | c[:, 2] << 2 | c[:, 3]).astype(np.uint8).tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of two digest arrays; 1 is equal, 0 is as different as unrelated codes or more."""
    d = np.abs(a.astype(np.int16) - b.astype(np.int16))
    diff = d[:, 1:].sum(axis=1) + 0.5 * d[:, 0]
    return 1.0 - np.minimum(diff, BOUND) / BOUND


def likeness_of(x: str, y: str) -> float:
    """Likeness of two encoded digests."""
    return float(likeness(decode(x)[None, :], decode(y)[None, :])[0])


def decode(x: str) -> np.ndarray:
    b = np.frombuffer(bytes.fromhex(x), dtype=np.uint8)
    return np.concatenate([b[:1], np.stack([b[1:] >> 6, b[1:] >> 4 & 3, b[1:] >> 2 & 3, b[1:] & 3], axis=1).ravel()])


def fingerprint_texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fingerprint of each row; no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            t = [x.encode() if isinstance(x, str) else b"" for x in b[text]]
            yield pd.DataFrame({key: b[key], "fingerprint": [encode(r) for r in digests(t)]})

    kind = dict(df.dtypes)[key]
    return df.select(key, text).mapInPandas(run, f"`{key}` {kind}, fingerprint string")


def at_or_below(starts: list[int], k: Column) -> tuple[Column, Column]:
    """(index of the last of the sorted ``starts`` that is at or below ``k``, whether it equals it), in two steps of about a square root."""
    literal = lambda xs: F.array(*(F.lit(x).cast("long") for x in xs))
    width = max(1, math.isqrt(len(starts)))
    rows = [starts[i : i + width] for i in range(0, len(starts), width)]
    coarse, fine = literal([r[0] for r in rows]), F.array(*(literal(r) for r in rows))
    at = F.greatest(F.size(F.filter(coarse, lambda x: x <= k)), F.lit(1))
    row = F.element_at(fine, at)
    return (at - 1) * width + F.size(F.filter(row, lambda x: x <= k)) - 1, F.array_contains(row, k)


def with_next_bucket(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows dealt into key ranges, with the first row of each range copied to the end of the range before it (``__copy``), and the very
    first row to the end of the last.  Each range can then find every row's successor by itself.  Partitions come back sorted.

    Range starts are quantiles of the key, a bounded list: one per shuffle partition.
    """
    n = partitions(df.sparkSession)
    k = F.coalesce(F.col(key).cast("long"), F.lit(-(2**63)))
    d = df.withColumn("__k", k)
    cuts = sorted(set(d.agg(F.percentile_approx("__k", [i / n for i in range(n)], 10_000 * max(1, n // 500))).first()[0] or [0]))
    # approximate quantiles need not be keys: each range starts at its own smallest key (a row per range)
    near, _ = at_or_below(cuts, F.col("__k"))
    starts = sorted(r[1] for r in d.select(near.alias("r"), "__k").groupBy("r").agg(F.min("__k")).collect()) or [0]
    place, first = at_or_below(starts, F.col("__k"))
    d = d.withColumn("__range", place)
    own = F.struct(F.col("__range").alias("r"), F.lit(0).alias("c"))
    other = F.struct(F.when(F.col("__range") == 0, len(starts) - 1).otherwise(F.col("__range") - 1).alias("r"), F.lit(1).alias("c"))
    d = d.withColumn("__to", F.explode(F.when(first, F.array(own, other)).otherwise(F.array(own))))
    d = d.withColumns({"__range": F.col("__to.r").cast("int"), "__copy": F.col("__to.c")}).drop("__to")
    return d.repartitionById(n, F.col("__range")).sortWithinPartitions("__range", "__copy", "__k", *order).drop("__k")


def edited_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each document: its digest, that of its text with the last quarter of the code points replaced by the start of the next
    document's (ascending key, ties by text; the last is followed by the first), and the likenesses.  Texts are shuffled once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last row of the batch before: key, text, digest, range
        for batch in batches:
            b = dict(zip(batch.schema.names, batch.columns, strict=True))
            keys, texts = b[key].to_pylist(), b[text].to_pylist()
            own = digests([t.encode() for t in texts])
            ranges, copies = b["__range"].to_pylist(), b["__copy"].to_pylist()
            rows = [] if held is None else [held]
            rows += [(k, t, f, r) if not c else (None, t, f, r, True) for k, t, f, r, c in zip(keys, texts, own, ranges, copies, strict=True)]
            out, nexts = [], []
            for x, y in zip(rows, rows[1:], strict=False):
                if len(x) == 4:
                    if x[3] != y[3]:
                        raise AssertionError("a range ended without its successor")
                    out.append(x)
                    nexts.append(y)
            held = rows[-1] if rows and len(rows[-1]) == 4 else None
            if out:
                yield finish(out, nexts)
        if held is not None:
            raise AssertionError("a range ended without its successor")

    def finish(out: list[tuple], nexts: list[tuple]) -> pa.RecordBatch:
        edited = []
        for x, y in zip(out, nexts, strict=True):
            k = len(x[1]) // 4
            edited.append((x[1][: len(x[1]) - k] + y[1][:k]).encode())
        own, new, nxt = np.stack([x[2] for x in out]), digests(edited), np.stack([y[2] for y in nexts])
        return pa.RecordBatch.from_pydict(
            {
                key: pa.array([x[0] for x in out], pa.int64()),
                "n_chars": [len(x[1]) for x in out],
                "edited_sha256": [hashlib.sha256(e).hexdigest() for e in edited],
                "fingerprint": [encode(r) for r in own],
                "edited_fingerprint": [encode(r) for r in new],
                "near_edited": likeness(own, new),
                "near_next": likeness(own, nxt),
            }
        )

    rows = with_next_bucket(docs.select(F.col(key).cast("long").alias(key), F.coalesce(text, F.lit("")).alias(text)), key, [text])
    schema = f"`{key}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.mapInArrow(run, schema)
