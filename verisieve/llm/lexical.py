"""Ranked lexical search: a hierarchical max tree over document ranges per term, searched best first.

``build`` cuts the table into shards of consecutive rows (within a task, without moving a text) and writes, for each term of a shard, a
tree: level 0 has the documents that hold the term with their impacts, level 1 the largest impact in each range of ``FAN`` documents, level
2 in each range of ``FAN`` ranges, and the root the largest of the shard.  An impact is a term's part of a score without the term's weight.

``search`` reads the trees of the queries' terms only.  The roots bound what a shard can give a query; the most promising shards of each
query are searched first, and their ``k``-th score then rules out every shard whose bound is below it.  Within a shard the node with the
highest summed bound is opened first; the search ends when that bound is below the ``k``-th score so far.  Nodes whose bound equals it are
opened too, because a document with an equal score and a smaller key may be there.

Score of a document: the sum over the query's distinct terms of ``w * ((1000000000 * tf) div (1000 * tf + 8 * m))`` in 64-bit integers, with
``w = floor(1000 * ln((2N + 2) / (2 df + 1)))`` and ``m = 100 - 90 + (90 * n * N) div L``: N documents that hold a term at all, L their terms with repeats, n
those of the document.  Weights are never below zero, so the bounds hold.

Shards are bounded in documents and in postings, so a task's memory does not depend on the table or on long texts; a term that all
documents hold has a bounded tree in each shard.  Only written tables are handed over, so a lost executor costs its tasks.

Defined cases: a null or empty text, and one without terms, is no document; a very long text counts whole; repeated rows are separate
documents; equal scores go by ascending key, null keys last, and of rows with one key any may come first; every row of the queries is a query of its own, one
without terms or without a matching document has no result; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, discard, materialize

#: A term is a run of ASCII letters and digits and of all characters beyond ASCII (the pattern on UTF-8 bytes, and on characters).
TERM_BYTES = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Children of a node, as a power of two; levels below the root; a shard's largest number of documents (what the levels hold) and postings.
BITS, LEVELS = 6, 3
FAN = 1 << BITS
DOCUMENTS, POSTINGS = 1 << 16, 2_000_000
#: Shards of a query that are searched before the others are ruled out; queries that a task searches in one shard.
PROBE, BLOCK = 2, 1024

_TREE = "shard long, term string, df int, top int, sizes array<int>, nodes array<int>, maxima array<int>, keys array<long>"
_ARROW = pa.schema([
    ("shard", pa.int64()), ("term", pa.string()), ("df", pa.int32()), ("top", pa.int32()),
    ("sizes", pa.list_(pa.int32())), ("nodes", pa.list_(pa.int32())), ("maxima", pa.list_(pa.int32())), ("keys", pa.list_(pa.int64())),
])


@dataclass
class Index:
    """``trees`` is a written table: a row per term and shard, and one per shard without a term that holds the documents' keys."""

    trees: DataFrame
    documents: int
    length: int

    def discard(self) -> None:
        discard(self.trees)


def terms_of(text: str | None) -> Counter:
    return Counter(TERM_BYTES.findall((text or "").encode().lower()))


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    m = 100 - 90 + (90 * n.astype(np.int64) * documents) // length
    return (1_000_000_000 * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + 8 * m)


def _lists(sizes: np.ndarray, values: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(sizes) + 1, dtype=np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


class Shard:
    """Postings of consecutive documents, turned into trees when the shard is full."""

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.terms: list[np.ndarray] = []
        self.tfs: list[np.ndarray] = []
        self.held: list[int] = []  # distinct terms of each document
        self.lengths: list[int] = []
        self.keys: list[int | None] = []
        self.postings = 0

    def add(self, key: int | None, counts: Counter) -> None:
        numbers = self.numbers
        self.terms.append(np.fromiter((numbers.setdefault(t, len(numbers)) for t in counts), np.int32, len(counts)))
        tf = np.fromiter(counts.values(), np.int64, len(counts))
        self.tfs.append(tf)
        self.held.append(len(counts))
        self.lengths.append(int(tf.sum()))
        self.keys.append(key)
        self.postings += len(counts)

    def full(self) -> bool:
        return len(self.keys) >= DOCUMENTS or self.postings >= POSTINGS

    def rows(self, shard: int, documents: int, length: int) -> Iterator[pa.RecordBatch]:
        term = np.concatenate(self.terms)
        doc = np.repeat(np.arange(len(self.keys), dtype=np.int32), self.held)
        value = impacts(np.concatenate(self.tfs), np.repeat(np.array(self.lengths), self.held), documents, length).astype(np.int32)
        order = np.argsort(term, kind="stable")
        term, node, value = term[order], doc[order], value[order]
        levels = [(term, node, value)]
        for _ in range(LEVELS - 1):
            node = node >> BITS
            first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (node[1:] != node[:-1])]))
            term, node, value = term[first], node[first], np.maximum.reduceat(value, first)
            levels.append((term, node, value))
        n = len(self.numbers)
        top = np.maximum.reduceat(value, np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])))
        sizes = np.stack([np.bincount(t, minlength=n) for t, _, _ in levels], axis=1).astype(np.int32)
        by_term = np.argsort(np.concatenate([t for t, _, _ in levels]), kind="stable")  # a term's levels come one behind the other
        nodes, maxima = (np.concatenate([level[i] for level in levels])[by_term] for i in (1, 2))
        words = list(self.numbers)
        step = 20_000  # terms a batch
        ends = np.concatenate([[0], np.cumsum(sizes.sum(axis=1))])
        for i in range(0, n, step):
            j, at = min(n, i + step), slice(i, min(n, i + step))
            part = slice(ends[i], ends[j])
            per = sizes[at].sum(axis=1)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(j - i, shard)), pa.array([w.decode() for w in words[at]], pa.string()), pa.array(sizes[at, 0]), pa.array(top[at]),
                _lists(np.full(j - i, LEVELS), sizes[at].reshape(-1)), _lists(per, nodes[part]), _lists(per, maxima[part]), pa.nulls(j - i, pa.list_(pa.int64())),
            ], schema=_ARROW)
        none = [pa.nulls(1, t) for t in (_ARROW.field(i).type for i in range(1, 7))]
        yield pa.RecordBatch.from_arrays([pa.array([shard]), *none, pa.array([self.keys], pa.list_(pa.int64()))], schema=_ARROW)


def build(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    """The index of all rows.  Two readings of the texts: one for the counts over the table, one for the trees; no shuffle of either."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = pc.count_substring_regex(pc.fill_null(b.column(0), ""), TERM)
            yield pa.RecordBatch.from_arrays([pa.array([pc.sum(pc.greater(n, 0)).as_py() or 0], pa.int64()), pa.array([pc.sum(n).as_py() or 0], pa.int64())], ["d", "l"])

    total = docs.select(F.col(text).alias("text")).mapInArrow(counted, "d long, l long").agg(F.sum("d").alias("d"), F.sum("l").alias("l")).first()
    documents, length = int(total["d"] or 0), int(total["l"] or 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, shard = TaskContext.get().partitionId() << 32, Shard()
        for b in batches:
            for k, t in zip(b.column(0), b.column(1), strict=True):
                counts = terms_of(t.as_py())
                if counts:
                    shard.add(k.as_py(), counts)
                if shard.full():
                    yield from shard.rows(number, documents, length)
                    number, shard = number + 1, Shard()
        if shard.keys:
            yield from shard.rows(number, documents, length)

    named = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return Index(materialize(named.mapInArrow(run, _TREE)), documents, length)


def query_terms(queries: DataFrame, key: str, text: str) -> DataFrame:
    """q (a number of its own), key, term: each query's terms once."""
    found = F.array_distinct(F.regexp_extract_all(ascii_lower(F.col(text)), F.lit(TERM), F.lit(0)))
    named = queries.select(F.col(key).alias("key"), found.alias("t")).withColumn("q", F.monotonically_increasing_id())
    return named.select("q", "key", F.explode("t").alias("term"))


class Forest:
    """The trees of a shard's terms, regrouped by node: a node's children, over all terms, lie together."""

    def __init__(self, rows: pa.Table):
        term = rows.column("term_no").to_numpy()
        sizes = np.stack(rows.column("sizes").to_pylist()).astype(np.int64) if len(rows) else np.zeros((0, LEVELS), dtype=np.int64)
        flat = [pa.concat_arrays(rows.column(c).chunks).flatten().to_numpy() if len(rows) else np.zeros(0, dtype=np.int32) for c in ("nodes", "maxima")]
        self.terms, local = np.unique(term, return_inverse=True)
        level = np.repeat(np.tile(np.arange(LEVELS), len(rows)), sizes.reshape(-1))
        owner = np.repeat(local, sizes.sum(axis=1))
        self.levels = []
        for i in range(LEVELS):
            mine = level == i
            node, value, own = flat[0][mine], flat[1][mine].astype(np.int64), owner[mine]
            order = np.argsort(node, kind="stable")
            node = node[order]
            parents = np.arange((int(node[-1]) >> BITS) + 2) if len(node) else np.arange(1)
            self.levels.append((np.searchsorted(node >> BITS, parents), node & (FAN - 1), own[order], value[order]))

    def children(self, level: int, node: int, weights: np.ndarray) -> np.ndarray:
        """Bounds of the ``FAN`` children of a node at ``level``: of documents, their scores."""
        cuts, child, owner, value = self.levels[level - 1]
        at = slice(cuts[node], cuts[node + 1])
        out = np.zeros(FAN, dtype=np.int64)
        np.add.at(out, child[at], weights[owner[at]] * value[at])
        return out

    def best(self, terms: np.ndarray, weights: np.ndarray, keys: np.ndarray, last: np.ndarray, k: int, floor: int) -> list[tuple[int, int]]:
        """(document, score) of the ``k`` best with scores of ``floor`` or more, above 0."""
        w = np.zeros(len(self.terms), dtype=np.int64)
        at = np.searchsorted(self.terms, terms)
        w[at] = weights
        found: list[tuple[int, bool, int, int]] = []  # (-score, null key, key, document), best first
        heap = [(0, LEVELS, 0)]
        while heap:
            bound, level, node = heapq.heappop(heap)
            if level < LEVELS and -bound < floor:
                break
            bounds = self.children(level, node, w)
            for i in np.flatnonzero(bounds >= max(floor, 1)):
                s, at = int(bounds[i]), (node << BITS) + int(i)
                if level > 1:
                    heapq.heappush(heap, (-s, level - 1, at))
                else:
                    found.append((-s, bool(last[at]), int(keys[at]), at))
            if level == 1:
                found = sorted(found)[:k]
                if len(found) == k:
                    floor = max(floor, -found[-1][0])
        return [(f[3], -f[0]) for f in found]


_FOUND = "q long, doc long, score long"


def _searched(trees: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """q, doc, score, of the ``k`` best documents for each pair (q, terms, weights, shard, floor)."""
    pairs = pairs.withColumns({"at": F.col("shard"), "asked": F.floor(F.col("q") / BLOCK)}).drop("shard")
    there = trees.join(pairs.select(F.col("at").alias("shard"), F.col("asked").alias("block")).distinct(), "shard")

    def run(trees_: pa.Table, asked: pa.Table) -> pa.Table:
        q, doc, score = [], [], []
        if len(asked) and len(trees_):
            isdocs = trees_.column("term_no").is_null()
            keys_ = trees_.filter(isdocs).column("keys")[0].values
            last = keys_.is_null().to_numpy(zero_copy_only=False)
            keys = keys_.fill_null(0).to_numpy(zero_copy_only=False)
            forest = Forest(trees_.filter(pc.invert(isdocs)))
            for row in asked.select(["q", "floor", "terms", "weights"]).to_batches():
                for qi, fl, ts, ws in zip(*row.columns, strict=True):
                    t, w = ts.values.to_numpy(), ws.values.to_numpy()
                    here = np.isin(t, forest.terms)
                    for d, s in forest.best(t[here], w[here], keys, last, k, fl.as_py()):
                        q.append(qi.as_py())
                        doc.append(None if last[d] else int(keys[d]))
                        score.append(s)
        return pa.table([pa.array(q, pa.int64()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())], ["q", "doc", "score"])

    return there.groupBy("shard", "block").cogroup(pairs.groupBy("at", "asked")).applyInArrow(run, _FOUND)


def _weight(documents: int, df: Column) -> Column:
    ratio = F.lit(2.0 * documents + 2.0) / (2.0 * df + 1.0)
    return F.floor(F.lit(1000.0) * F.log(ratio)).cast("long")


def search(index: Index, queries: DataFrame, k: int = 10, key: str = "doc_id", query_key: str = "item_id", text: str = "text") -> DataFrame:
    """query_key, rank (from 1), key, score: the ``k`` best documents of each query, best first."""
    names = materialize(query_terms(queries, query_key, text))
    numbers = materialize(names.select("term").distinct().withColumn("term_no", F.monotonically_increasing_id()))
    held = index.trees.where("term is not null").join(numbers, "term").select("shard", "term_no", "df", "top", "sizes", "nodes", "maxima", "keys")
    keys = index.trees.where("term is null").select("shard", F.lit(None).cast("long").alias("term_no"), "df", "top", "sizes", "nodes", "maxima", "keys")
    trees = materialize(held.unionByName(keys))
    roots = trees.where("term_no is not null").select("shard", "term_no", "df", "top")
    weights = roots.groupBy("term_no").agg(F.sum("df").alias("df")).select("term_no", _weight(index.documents, F.col("df")).alias("w"))
    asked = materialize(names.join(numbers, "term").join(weights, "term_no").select("q", "term_no", "w"))
    lists = asked.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("term_no", "w"))).alias("t"))
    lists = lists.select("q", F.col("t.term_no").alias("terms"), F.col("t.w").alias("weights"))
    bounds = roots.join(asked, "term_no").groupBy("q", "shard").agg(F.sum(F.col("w") * F.col("top")).alias("bound")).where("bound > 0")
    bounds = materialize(bounds.withColumn("turn", F.row_number().over(Window.partitionBy("q").orderBy(F.col("bound").desc(), "shard"))))
    probes = bounds.where(F.col("turn") <= PROBE).withColumn("floor", F.lit(0).cast("long"))
    first = materialize(_searched(trees, probes.join(lists, "q").select("q", "terms", "weights", "shard", "floor"), k))
    best = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last())
    floors = first.withColumn("r", F.row_number().over(best)).where(F.col("r") == k).select("q", F.col("score").alias("floor"))
    rest = bounds.where(F.col("turn") > PROBE).join(floors, "q", "left").withColumn("floor", F.coalesce("floor", F.lit(0))).where("bound >= floor")
    second = _searched(trees, rest.join(lists, "q").select("q", "terms", "weights", "shard", "floor"), k)
    found = first.unionByName(second).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    named = found.join(names.select("q", "key").distinct(), "q")
    out = materialize(named.select(F.col("key").alias(query_key), "rank", F.col("doc").alias(key), "score"))
    for t in (names, numbers, trees, asked, bounds, first):
        discard(t)
    return out
