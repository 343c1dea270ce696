"""MinHash near-dedup with HyperMinHash sketches.

1. Every whole text becomes its set of distinct five-word shingles (64-bit hashes), a digest of that set, and a sketch: shingles fall into
   buckets, a bucket keeps the leading-zero count and ten mantissa bits of its smallest hash.  Documents with equal sets are one class,
   stood for by one row, before anything else is compared.
2. Bands of compressed registers are looked up in one shuffle.  Each member of a band bucket is tied to the bucket's smallest member only,
   so a bucket of any size makes as many rows as it has members.  Connected ties give candidate clusters; every pair that shares a band
   is inside one cluster.
3. Within a cluster, pairs pass a size filter and the collision-corrected Jaccard estimate of their sketches, less a margin of six
   deviations; what passes is confirmed on the full sets.  A cluster of up to ``BLOCK`` units (a unit is a class, or ``UNIT`` shingles of a
   larger one) is one task's work.  In a larger one each class first meets the smallest class that it is tied to; those linked to the same
   one are a group already.  Then classes of different groups meet, as pairs of blocks, so no task holds a cluster and nothing is capped.
   Blocks of one group do not meet, so a large cluster of true copies costs its size times the classes that are not of its main groups;
   only a cluster that falls into many groups is quadratic, which is what it takes to lose no link.  A task returns a spanning forest of
   its links, not pairs.
4. Connected components of confirmed links, and of classes that share an id.

A pair at the threshold of 0.85 shares no band with probability 1e-9, at 0.8 with 8e-6 (64 bands of 8 registers); lower thresholds are
refused.  Sets of at most 75 shingles take true independent minima, larger ones one-permutation buckets (empty ones borrow along a fixed
random chain).  Sets of up to 75 that a set of 76 or more can link with at the threshold are in both tables (from 64 at 85 %, from 61 at
80 %), so no pair falls between.

Defined cases: a null or empty text, or one without words, has an empty set and is linked with nothing; fewer than five words are one
shingle; rows that repeat an id are one document to the graph, also if their texts differ; rows without an id take part by their texts,
are united with no other row for lacking one, and have a null component only if no row of their component has an id; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, materialize, partitions, salted_offsets
from .components import SALTS, components

SHINGLE = 5
ROWS, BANDS = 8, 64
REGISTERS = ROWS * BANDS
MANTISSA = 10
SMALL = 75
#: Units in a block, at least and at most (between them the root of the cluster's units), and shingles in a unit.
BLOCK, MOST = 64, 2048
UNIT = 2048
#: Words whose hashes a task keeps, and the longest word kept: together they bound the store in bytes.
STORE = 1_000_000
STORE_BYTES = 64

_U = np.uint64
_COEF = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (multiply and xor-shift)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_SEEDS = mixed(np.arange(1, REGISTERS + 1, dtype=np.uint64) * _COEF[0])
_CHAIN = (mixed(np.arange(128 * REGISTERS, dtype=np.uint64) + _COEF[1]) % _U(REGISTERS)).astype(np.int64).reshape(128, REGISTERS)
_BAND = mixed(np.arange(1, BANDS + 1, dtype=np.uint64) * _COEF[2])
_KIND = mixed(np.arange(2, dtype=np.uint64) + _COEF[4])


class WordHashes(dict):
    """Word -> 64-bit hash, computed when first asked for.  Long words are not kept."""

    def __missing__(self, w: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(w)
        if len(w) <= STORE_BYTES:
            self[w] = h
        return h


def shingles(words: list[bytes], store: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(store) > STORE:
        store.clear()
    h = np.fromiter(map(store.__getitem__, words), dtype=np.uint64, count=len(words))
    if len(h) < SHINGLE:
        return mixed((h * _COEF[: len(h)]).sum(dtype=np.uint64, keepdims=True) + _U(len(h)))
    n = len(h) - SHINGLE + 1
    s = h[:n] * _COEF[0]
    for i in range(1, SHINGLE):
        s += h[i : n + i] * _COEF[i]
    s = np.sort(mixed(s))
    return s[np.concatenate(([True], s[1:] != s[:-1]))]


def compressed(minima: np.ndarray) -> np.ndarray:
    """Registers of bucket minima: leading zeros (6 bits) and mantissa, never 0."""
    top = np.maximum(minima >> _U(11), _U(1)).astype(np.float64)  # 53 bits: exact
    lead = 53 - np.frexp(top)[1]
    shift = np.minimum(lead + 1, 63).astype(np.uint64)
    return ((np.minimum(lead, 61).astype(np.uint64) + _U(1)) << _U(MANTISSA) | (minima << shift) >> _U(64 - MANTISSA)).astype(np.uint16)


def raw_registers(s: np.ndarray) -> np.ndarray:
    """One-permutation registers, 0 where no shingle falls.  ``s`` is sorted, so buckets are runs."""
    out = np.zeros(REGISTERS, dtype=np.uint16)
    if len(s):
        bucket = ((s >> _U(32)) * _U(REGISTERS)) >> _U(32)
        at = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        out[bucket[at].astype(np.int64)] = compressed(np.minimum.reduceat(mixed(s + _COEF[3]), at))
    return out


def filled(raw: np.ndarray) -> np.ndarray:
    """Empty buckets borrow from the first bucket of a fixed random chain that has shingles."""
    out, full = raw.copy(), raw != 0
    todo = np.flatnonzero(~full)
    for row in _CHAIN:
        if not len(todo):
            return out
        to = row[todo]
        ok = full[to]
        out[todo[ok]] = raw[to[ok]]
        todo = todo[~ok]
    have = np.flatnonzero(full)
    out[todo] = raw[have[np.searchsorted(have, todo) % len(have)]]
    return out


def text_set(text: str | None, store: WordHashes) -> np.ndarray:
    return shingles(text.encode().lower().split() if text else [], store)


def digest_of(s: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None


def large_from(percent: int) -> int:
    """Size from which sets are in the table of larger sets: the smallest that links with a set which is too large for the other, 64 at most."""
    return min(64, -(-percent * (SMALL + 1) // 100))


def band_keys(s: np.ndarray, raw: np.ndarray, percent: int = 85) -> np.ndarray:
    out = []
    if 0 < len(s) <= SMALL:
        out.append((compressed(mixed(s[None, :] ^ _SEEDS[:, None]).min(axis=1)), _KIND[0]))
    if len(s) >= large_from(percent):
        out.append((filled(raw), _KIND[1]))
    keys = []
    for registers, kind in out:
        pair = registers.view(np.uint64).reshape(BANDS, 2)
        keys.append(mixed(mixed(pair[:, 0] + kind) + pair[:, 1] * _COEF[1] + _BAND))
    return np.concatenate(keys) if keys else np.zeros(0, dtype=np.uint64)


def sketches(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, mark (a hash of the text), n_shingles, digest (null for an empty set) and bands (array of long) of each row; no shuffle."""
    names = ["doc_id", "mark", "n_shingles", "digest", "bands"]
    kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = WordHashes()
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                out = []
                for t in part.column(2).to_pylist():
                    s = text_set(t, store)
                    out.append((len(s), digest_of(s), band_keys(s, raw_registers(s), percent).view(np.int64)))
                made = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *made], names)

    return docs.select("doc_id", "mark", "text").mapInArrow(run, "doc_id long, mark long, n_shingles long, digest binary, bands array<long>")


def full_sets(docs: DataFrame) -> DataFrame:
    """digest and shingles (binary) of each row's ``text``; a task reads a text that it meets again only once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, seen = WordHashes(), set()
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                digests, sets = [], []
                for t in part.column(0).to_pylist():
                    name = xxhash.xxh3_128_digest((t or "").encode())
                    if name in seen:
                        continue
                    s = text_set(t, store)
                    seen.add(name)
                    digests.append(digest_of(s))
                    sets.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(sets, pa.binary())], ["digest", "shingles"])

    return docs.select("text").mapInArrow(run, "digest binary, shingles binary")


def asked_texts(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose (doc_id, mark) ``asked`` has as (rep, mark).

    ``asked`` comes once for each salt, so that rows that share an id and a text, or have no id, meet it in several tasks.
    """
    salts = asked.distinct().withColumn("salt", F.explode(F.array(*(F.lit(i) for i in range(SALTS))))).withColumnRenamed("mark", "m")
    docs = docs.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))  # which copy a row meets is of no matter
    d = docs.alias("d").join(salts.alias("a"), F.expr("d.mark = a.m and d.salt = a.salt and d.doc_id <=> a.rep"), "left_semi")
    return d.select("doc_id", "text")


_CORRECTION: dict[tuple[int, int], float] = {}


def accidental(a: int, b: int) -> float:
    """Chance that two unrelated registers are equal, for sets of about 2**a and 2**b shingles in a bucket's share."""
    if (a, b) not in _CORRECTION:
        cells = np.arange((1 << MANTISSA) + 1) / (1 << MANTISSA)
        total = 0.0
        for lead in range(40):
            edge = (1 + cells) / 2.0 ** (lead + 1)
            p = [np.exp(-edge[:-1] * 2.0**x) - np.exp(-edge[1:] * 2.0**x) for x in (a, b)]
            total += float((p[0] * p[1]).sum())
        _CORRECTION[a, b] = total
    return _CORRECTION[a, b]


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on full sets."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def forest(ids: list[int], sets: list[np.ndarray], left: np.ndarray, group: np.ndarray, cross: bool, percent: int) -> list[tuple[int, int]]:
    """Links that connect what is linked: a spanning forest.  Members of one ``group`` are connected already.

    With ``cross``, only pairs of a left and a right member are compared.
    """
    size = np.array([len(s) for s in sets])
    order = np.lexsort((ids, size))
    size, side, group = size[order], left[order], group[order].copy()
    raws = np.stack([raw_registers(sets[i]) for i in order])
    full = raws != 0
    scale = np.round(np.log2(np.maximum(size / REGISTERS, 2.0**-20))).astype(int)
    out = []
    for i in range(1, len(order)):
        lo = int(np.searchsorted(100 * size[:i], percent * size[i], side="left"))  # sizes must be within the threshold of each other
        can = group[lo:i] != group[i]
        if cross:
            can &= side[lo:i] != side[i]
        js = np.flatnonzero(can) + lo
        if not len(js):
            continue
        either = (full[js] | full[i]).sum(axis=1)
        same = ((raws[js] == raws[i]) & full[i]).sum(axis=1)
        kinds, at = np.unique(scale[js], return_inverse=True)
        c = np.array([accidental(int(scale[i]), int(x)) for x in kinds])[at]
        estimate = (same / either - c) / (1 - c)
        margin = 6 * np.sqrt(0.1275 / either) + 0.02
        ok = estimate >= percent / 100 - margin
        for j in js[ok][np.argsort(-estimate[ok], kind="stable")]:
            if group[j] != group[i] and linked(sets[order[i]], sets[order[j]], percent):
                out.append((ids[order[i]], ids[order[j]]))
                group[group == group[j]] = group[i]
    return out


def confirmed(pairs: DataFrame, percent: int) -> DataFrame:
    """u, v links from rows (cluster, a, b, left, node, grp, shingles): those of one (cluster, a, b) meet in one task.

    Where a and b differ, left members meet right ones only.
    """
    keys = ["cluster", "a", "b"]
    m = pairs.select(*keys, "left", "node", "grp", "shingles")
    m = m.repartition(partitions(pairs.sparkSession) * 2, *keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        now = None

        def links() -> list[tuple[int, int]]:
            if len(held) < 2:
                return []
            ids, sets, left, group = zip(*held, strict=True)
            return forest(list(ids), [np.frombuffer(x, dtype=np.uint64) for x in sets], np.array(left), np.array(group), now[1] != now[2], percent)

        for b in batches:
            out = []
            for c, x, y, left, node, g, s in zip(*(b[n] for n in (*keys, "left", "node", "grp", "shingles")), strict=True):
                if (c, x, y) != now:
                    out += links()
                    held, now = [], (c, x, y)
                held.append((node, s, left, g))
            yield pd.DataFrame(out, columns=["u", "v"], dtype="int64")
        yield pd.DataFrame(links(), columns=["u", "v"], dtype="int64")

    return m.mapInPandas(run, "u long, v long")


def stars(ties: DataFrame, members: DataFrame, sets: DataFrame) -> DataFrame:
    """Nodes of large clusters, each beside the smallest node that it is tied to, in chunks of about ``BLOCK`` nodes with a copy of that
    hub in each."""
    large = members.groupBy("cluster").agg(F.sum("weight").alias("w")).where(F.col("w") > BLOCK).select("cluster")
    large = materialize(members.join(large, "cluster").select("node"))
    near = materialize(ties.join(large, F.col("u") == F.col("node"), "left_semi").groupBy("u").agg(F.min("v").alias("hub")))
    sets = sets.join(large, "node", "left_semi").dropDuplicates(["node"])
    hubs = near.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("chunks"))
    own = near.join(hubs, "hub").select(F.col("hub").alias("cluster"), F.pmod(F.xxhash64("u"), "chunks").alias("b"), F.col("u").alias("node"), F.lit(False).alias("left"))
    head = hubs.select(F.col("hub").alias("cluster"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("b"), F.col("hub").alias("node"), F.lit(True).alias("left"))
    return own.unionByName(head).join(sets, "node").withColumns({"a": F.lit(-1).cast("long"), "grp": F.col("node")})


def block_pairs(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of blocks within a cluster.  ``members``: cluster, node, grp, weight (units).

    A group of a block or more has blocks of its own, which need not meet each other; smaller groups share mixed blocks.  Blocks of a
    cluster are numbered pool by pool, so the blocks that a member must meet are one or two runs of numbers.
    """
    size = members.groupBy("cluster", "grp").agg(F.sum("weight").alias("w"))
    width = F.greatest(F.lit(BLOCK), F.least(F.lit(MOST), F.ceil(F.sqrt(F.sum("w"))))).cast("long").alias("width")
    several = size.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), width).where("n > 1").select("cluster", "width")
    pool = size.join(several, "cluster").select("cluster", "grp", F.when(F.col("w") >= F.col("width"), F.col("grp")).otherwise(-1).alias("pool"), "w", "width")
    m = materialize(members.join(pool.select("cluster", "grp", "pool"), ["cluster", "grp"]))
    by = pool.groupBy("cluster", "pool", "width").agg(F.ceil(F.sum("w") / F.col("width")).cast("long").alias("n"))
    up = Window.partitionBy("cluster").orderBy("pool").rowsBetween(Window.unboundedPreceding, -1)  # a row per pool
    by = by.withColumns({"first": F.coalesce(F.sum("n").over(up), F.lit(0)), "all": F.sum("n").over(Window.partitionBy("cluster"))})
    m = salted_offsets(m, ["cluster", "pool"], ["node"], "rank", "weight", "start").join(by, ["cluster", "pool"])
    run = lambda x, y: F.when(y >= x, F.sequence(x, y)).otherwise(F.array().cast("array<bigint>"))
    zero = F.lit(0).cast("long")
    apart = F.concat(run(zero, F.col("first") - 1), run(F.col("first") + F.col("n"), F.col("all") - 1))
    m = m.withColumn("block", F.col("first") + F.floor(F.col("start") / F.col("width")).cast("long"))
    m = m.withColumn("o", F.explode(F.when(F.col("pool") == -1, run(zero, F.col("all") - 1)).otherwise(apart)))
    m = m.select("cluster", F.least("block", "o").alias("a"), F.greatest("block", "o").alias("b"), (F.col("block") <= F.col("o")).alias("left"), "node", "grp")
    return m.join(sets.dropDuplicates(["node"]), "node")


def shared_ids(d: DataFrame, classes: DataFrame) -> DataFrame:
    """u, v: classes that rows with one id belong to, each tied to the smallest."""
    h = F.xxhash64("digest")
    several = d.where("doc_id is not null and digest is not null").groupBy("doc_id").agg(F.min(h).alias("lo"), F.max(h).alias("hi")).where("lo <> hi").select("doc_id")
    held = d.select("doc_id", "digest").join(several, "doc_id").join(classes.select("digest", "node"), "digest").select("doc_id", "node").distinct()
    least = held.groupBy("doc_id").agg(F.min("node").alias("v"))
    return held.join(least, "doc_id").where("node <> v").select(F.col("node").alias("u"), "v")


def near_duplicates(docs: DataFrame, percent: int = 85, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id, kept."""
    if not 80 <= percent <= 100:
        raise ValueError("percent must lie between 80 and 100: the bands are made for that")
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    d = materialize(sketches(docs, percent).withColumn("row", F.monotonically_increasing_id()))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "mark")).alias("k")
    some = d.where("digest is not null")
    classes = some.groupBy("digest").agg(first, F.first("n_shingles").alias("size"), F.count(F.lit(1)).alias("n"))
    classes = materialize(classes.select("digest", F.col("k.row").alias("node"), F.col("k.doc_id").alias("rep"), F.col("k.mark").alias("mark"), "size", "n"))
    # the few rows that are copies leave, so that bands of the many others need not move; bands are read twice and written once
    copies = some.select("digest", "row").join(classes.where("n > 1").select("digest", "node"), "digest").where("row <> node").select("row")
    copies = materialize(copies)
    rows = some.select("row", "bands").join(copies, "row", "left_anti").select(F.col("row").alias("node"), F.explode("bands").alias("band"))
    hubs = rows.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("far")).where("far > hub").select("band", "hub")
    ties = materialize(rows.join(hubs, "band").where("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v")).distinct())
    discard(copies)
    clusters = materialize(components(ties))
    members = clusters.join(classes, "node").select(F.col("component").alias("cluster"), "node", "digest", "rep", "mark", F.ceil(F.greatest("size", F.lit(1)) / UNIT).cast("long").alias("weight"))
    members = materialize(members)
    sets = full_sets(asked_texts(docs, members.select("rep", "mark")))
    sets = materialize(sets.join(members.select("digest", "node"), "digest").select("node", "shingles"))  # a text comes again from other tasks
    near = materialize(confirmed(stars(ties, members, sets), percent))
    # a star's link joins its hub and a node: the smaller of the two is the hub
    hub = near.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("grp"))
    grouped = materialize(members.select("cluster", "node", "weight").join(hub, "node", "left").withColumn("grp", F.coalesce("grp", "node")))
    links = materialize(confirmed(block_pairs(grouped, sets), percent))
    found = materialize(components(near.unionByName(links).unionByName(shared_ids(d, classes))))
    label = classes.join(found, "node").groupBy("component").agg(F.min("rep").alias("least"))
    named = found.join(label, "component").select("node", "least")
    final = classes.join(named, "node", "left").select("digest", F.coalesce("least", "rep").alias("component_id"))
    out = d.select("doc_id", "n_shingles", "digest").join(final, "digest", "left")
    out = out.select(F.col("doc_id").alias(key), "n_shingles", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    out = materialize(out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id"))))
    for t in (d, classes, ties, clusters, members, sets, near, grouped, links, found):
        discard(t)
    return out
