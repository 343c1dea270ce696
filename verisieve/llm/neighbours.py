"""Approximate nearest neighbours along shifted space-filling curves.

Vectors are scaled to length one and projected on a few random directions, others for each curve (together they are orthogonal as far as
the dimension allows); each coordinate is shifted, squashed to a grid and the grid cell becomes its index on a Hilbert curve, with 14 bits
a direction, so that a tight group still lies in many cells; what shares a cell is ordered by a hash, another one on each curve.  Every
curve orders all vectors; Spark range-partitions that order, of narrow keys only, and turns it into exact positions, which are cut into
blocks.  A query looks at the blocks around its own on every curve; what it finds there is ranked by the cosine of the original vectors, in
double precision, and the curves' lists are merged.

Blocks have equal size whatever the keys, so equal or crowded vectors cannot make a large one.  Equal vectors are indexed once, with their
smallest ids and how often each comes; the answer names each of them.  Queries, not vectors, are copied to neighbouring blocks, and each task returns ``k`` rows
per query and block, and one more for each vector that an asked id has.

The window is ``share`` of all rows, ``least`` rows if that is more: vectors without structure (cosines of near neighbours far below 1)
need a share, and then work per query grows with the table.  Clustered vectors do with far less: set ``share`` to 0 and ``least`` to a
fixed number of rows.

Vectors that are null, zero, or hold null or non-finite components, and rows without an id, take no part.  Vectors of different lengths
are never compared: each length is searched by itself.  Components of any magnitude are scaled before they are squared.  Rows that repeat
an id and its vector are one query; as candidates they are separate rows; a row is no candidate of its own id.  Fewer candidates than ``k``
are all returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, materialize, partitions

CURVES, DIRECTIONS = 8, 4
#: Bits a direction: 4 x 14 bits fit a long.
BITS = 14
#: Copies of an asked vector's answer, so that the rows of one asked many times meet it in several tasks.
SALTS = 8


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index of each grid cell (a row of unsigned coordinates below 2**bits) on the Hilbert curve: Skilling's transform (2004), by column."""
    x = cells.T.astype(np.uint32)
    n, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        low = np.uint32(q - 1)
        for i in range(n):
            high = (x[i] & np.uint32(q)) != 0
            swap = np.where(high, np.uint32(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = top
    while q > 1:
        flip ^= np.where((x[n - 1] & np.uint32(q)) != 0, np.uint32(q - 1), np.uint32(0))
        q >>= 1
    x ^= flip
    key = np.zeros(x.shape[1], dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> np.uint32(b) & np.uint32(1))
    return key


@lru_cache(maxsize=64)
def directions(size: int, curve: int, seed: int) -> np.ndarray:
    """Orthonormal directions of a curve; as many curves as fit share one rotation, so that theirs are orthogonal too."""
    d = min(DIRECTIONS, size)
    per = max(1, min(size, CURVES * d) // d)
    rng = np.random.default_rng([seed, size, curve // per])
    rotation = np.linalg.qr(rng.normal(size=(size, per * d)))[0]
    return rotation[:, curve % per * d : (curve % per + 1) * d]


def curve_key(unit: np.ndarray, curve: int, seed: int) -> np.ndarray:
    """The vectors' places on a curve."""
    size = unit.shape[1]
    to = directions(size, curve, seed)
    shift = np.random.default_rng([seed, size, curve, 1]).uniform(-0.5, 0.5, size=to.shape[1])
    z = unit @ to * np.sqrt(size) + shift
    cells = (1 / (1 + np.exp(-1.702 * z)) * (1 << BITS)).astype(np.int64)
    return hilbert(np.clip(cells, 0, (1 << BITS) - 1), BITS)


def unit_rows(vectors: list[np.ndarray]) -> np.ndarray:
    """Vectors of one length as rows of length one.  The largest component comes to 1 first, so squares neither overflow nor vanish."""
    x = np.stack(vectors).astype(np.float64)
    x /= np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """id, v of the rows that take part."""
    v = F.col(vector)
    if dict(df.dtypes)[vector] not in ("array<float>", "array<double>"):
        v = v.cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    d = df.where(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)).select(F.col(key).cast("long").alias("id"), v.alias("v"))
    return d.where(F.col("id").isNotNull()).select("id", "v", F.xxhash64("v").alias("a"), F.xxhash64(F.lit(1), "v").alias("b"))


def distinct_vectors(rows: DataFrame, query: str, k: int) -> tuple[DataFrame, int]:
    """kid (a number of its own), a, b (a 128-bit hash of the vector), ids (its k + 1 smallest different ones, with how often each comes, ``k``
    at most), rep (the smallest), asks; and the largest number of different vectors that share an asked id.

    Repeats are counted first and lists cut within salts, so a vector or an id that a third of all rows have is no large group.
    """
    few = materialize(rows.groupBy("a", "b", "id").agg(F.count(F.lit(1)).alias("n")).withColumn("q", F.expr(query)))
    part = Window.partitionBy("a", "b", F.pmod(F.xxhash64("id"), F.lit(64)))
    cut = few.withColumns({"asks": F.max("q").over(part), "r": F.row_number().over(part.orderBy("id"))}).where(F.col("r") <= k + 1)
    named = F.slice(F.sort_array(F.collect_list(F.struct("id", F.least("n", F.lit(k)).cast("int").alias("n")))), 1, k + 1)
    kinds = cut.groupBy("a", "b").agg(named.alias("ids"), F.coalesce(F.max("asks"), F.lit(False)).alias("asks"))
    kinds = materialize(kinds.withColumns({"kid": F.monotonically_increasing_id(), "rep": F.element_at("ids", 1).id}))
    most = few.where("q").groupBy("id").count().agg(F.max("count")).first()[0] or 1
    discard(few)
    return kinds, int(most)


def positions(index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``index`` (dim, curve, kid; range-partitioned and sorted) with ``pos``, the exact rank along each curve, and ``n``, the rows on it.

    Row numbers are kept by writing the index, which is also returned.
    """
    held = materialize(index.withColumn("m", F.monotonically_increasing_id()))
    part, at = F.shiftright("m", 33), F.col("m").bitwiseAND(F.lit((1 << 33) - 1))
    counts = held.groupBy("dim", "curve", part.alias("part")).agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("k"))
    every = Window.partitionBy("dim", "curve")  # a row per partition and curve
    before = every.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("dim", "curve", "part", F.sum("k").over(every).alias("n"), (F.coalesce(F.sum("k").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    placed = held.withColumns({"part": part, "at": at}).join(counts, ["dim", "curve", "part"])
    return held, placed.select("dim", "curve", "kid", "n", (F.col("at") + F.col("shift")).alias("pos"))


def search(
    vectors: DataFrame, query: str, k: int = 5, key: str = "vec_id", vector: str = "embedding",
    share: float = 0.1, least: int = 160, block: int = 1024, seed: int = 7,
) -> DataFrame:
    """query_id, rank, neighbour, score: the k nearest found for each row whose id (``id`` in the predicate ``query``) is asked."""
    spark = vectors.sparkSession
    rows = usable(vectors, key, vector)
    kinds, most = distinct_vectors(rows, query, k)
    best_kinds = k + most  # vectors that only the asked id has are no candidates: so many more are kept
    reps = kinds.select(F.col("rep").alias("id"), "a", "b", "kid", "rep", "asks")
    one = materialize(rows.join(reps, ["id", "a", "b"]).select("kid", "rep", "asks", "v").dropDuplicates(["kid"]))

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for size, part in b.groupby(b["v"].map(len)):
                x = unit_rows(list(part["v"]))
                for c in range(CURVES):
                    yield pd.DataFrame({"dim": size, "curve": c, "key": curve_key(x, c, seed), "kid": part["kid"].to_numpy()})

    index = one.select("kid", "v").mapInPandas(keyed, "dim int, curve int, key long, kid long")
    order = ["dim", "curve", "key", F.xxhash64("curve", "kid"), "kid"]  # what shares a cell comes in another order on each curve
    index = index.repartitionByRange(partitions(spark) * 2, *order).sortWithinPartitions(*order).select("dim", "curve", "kid")
    held, placed = positions(index)
    half = F.ceil(F.greatest(F.lit(float(least)), F.lit(float(share)) * F.col("n")) / 2)
    rows_of = F.least(F.lit(block), F.greatest(F.lit(1), F.ceil(half / 2)))
    placed = placed.withColumns({"width": rows_of.cast("long"), "reach": F.ceil(half / rows_of).cast("long")})
    own, last = F.floor(F.col("pos") / F.col("width")).cast("long"), F.floor((F.col("n") - 1) / F.col("width")).cast("long")
    placed = placed.select("dim", "curve", "kid", own.alias("own"), F.greatest(own - F.col("reach"), F.lit(0)).alias("lo"), F.least(own + F.col("reach"), last).alias("hi"))
    there = F.array(F.struct(F.col("own").alias("block"), F.lit(0).alias("role")))
    asked_at = F.transform(F.sequence("lo", "hi"), lambda x: F.struct(x.alias("block"), F.lit(1).alias("role")))
    met = placed.join(one, "kid").withColumn("to", F.explode(F.when(F.col("asks"), F.concat(there, asked_at)).otherwise(there)))
    groups = ["dim", "curve", "block"]
    met = met.select("dim", "curve", "to.block", "to.role", "kid", "rep", "v").repartition(partitions(spark) * 2, *groups)
    met = met.sortWithinPartitions(*groups, "role", "rep", "kid")

    def ranked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, kids, names, vs, base = None, [], [], [], None
        for b in batches:
            out: list[tuple] = []
            for (*at, role), part in b.groupby([*groups, "role"], sort=False):
                if at != now:
                    now, kids, names, vs, base = at, [], [], [], None
                if role == 0:
                    kids += list(part["kid"])
                    names += list(part["rep"])
                    vs += list(part["v"])
                    continue
                if not kids:
                    continue
                if base is None:
                    base, kid, name = unit_rows(vs), np.asarray(kids), np.asarray(names)
                for start in range(0, len(part), 256):
                    q, qid = unit_rows(list(part["v"].iloc[start : start + 256])), part["kid"].iloc[start : start + 256].to_numpy()
                    rough = q @ base.T
                    m = min(best_kinds, len(kid))
                    floor = -np.partition(-rough, m - 1, axis=1)[:, m - 1] - 1e-9  # all ties stay
                    for i in range(len(q)):
                        js = np.flatnonzero(rough[i] >= floor[i])
                        s = (base[js] * q[i]).sum(axis=1)
                        first = np.lexsort((name[js], -s))[:best_kinds]
                        out += [(int(qid[i]), int(kid[js[f]]), int(name[js[f]]), float(s[f])) for f in first]
            yield pd.DataFrame(out, columns=["query", "kid", "rep", "score"]).astype({"query": "int64", "kid": "int64", "rep": "int64", "score": "float64"})

    found = met.mapInPandas(ranked, "query long, kid long, rep long, score double")
    found = found.groupBy("query", "kid").agg(F.max("score").alias("score"), F.first("rep").alias("rep"))
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "rep")
    found = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= best_kinds)
    named = found.join(kinds.select("kid", "ids"), "kid").groupBy("query").agg(F.collect_list(F.struct("score", "ids")).alias("f"))  # k and a few at most
    lists = kinds.where("asks").join(named, F.col("kid") == F.col("query")).select("a", "b", "f")
    lists = lists.withColumn("salt", F.explode(F.array(*(F.lit(i) for i in range(SALTS)))))
    asked = rows.where(query).select(F.col("id").alias("query_id"), "a", "b").distinct().withColumn("salt", F.pmod(F.xxhash64("query_id"), F.lit(SALTS)).cast("int"))
    pairs = asked.join(lists, ["a", "b", "salt"]).select("query_id", "a", "b", F.explode("f").alias("f"))
    pairs = pairs.select("query_id", "a", "b", "f.score", F.explode("f.ids").alias("c")).where("c.id <> query_id")
    pairs = pairs.select("query_id", "a", "b", "score", F.explode(F.array_repeat("c.id", F.col("c.n"))).alias("neighbour"))
    final = Window.partitionBy("query_id", "a", "b").orderBy(F.col("score").desc(), "neighbour")
    out = pairs.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", "neighbour", "score")
    out = materialize(out)
    for t in (kinds, one, held):
        discard(t)
    return out
