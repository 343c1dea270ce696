"""Mixing sources to target weights, with DataFrame operations only.

Each source's documents, in a fixed pseudorandom order, form one row of words that is cut into blocks of ``block`` words.  A source takes
as many slots as its target has blocks.  Its slots are drawn onto output shards multinomially (each slot's shard is a seeded hash), which
gives the source counts of every output shard; the slots of a shard then map through a per-source pseudorandom permutation of block
indices (a swap-or-not shuffle, another one for each pass over the source) and join the blocks by index.  Totals per source are fixed
before the draw, so a source misses its target by about one block at most, and no block is taken more than twice.

Scale: texts are read once and never shuffled.  What moves is one narrow row per document, block and slot; a hot source is cut into hash
buckets for its prefix sums, and slots and blocks join by (source, index), which spreads any source evenly.

Defined cases: a null text has size 0 and takes 0; a null source is a source of its own, last in order; equal rows are told apart by
their rank and both returned; an empty table gives an empty result; other columns are ignored.  Draws depend on content and seed only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, materialize, partitions, salted_offsets

ROUNDS = 12
#: Slots in an output shard on average, and in a row before it is spread.
SHARD_SLOTS = 4096
CHUNK = 1024


def sizes(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", tell: Column | None = None) -> DataFrame:
    """One narrow row per document: doc_id, source, size in words, a hash of the text (or ``tell``) that tells rows of one id apart."""
    t = F.coalesce(F.col(text), F.lit(""))
    h = F.xxhash64(t) if tell is None else tell
    return docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), F.regexp_count(t, F.lit(WORD)).cast("long").alias("size"), h.alias("h"))


def targets(sized: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, sid, source_size, target.  Sources are few against documents; the windows run over one row per source.

    A target stops at ``most`` times its source; what exceeds goes to the others by weight.  In ascending order of cap per weight the
    stopped sources come first, and one pass finds them.
    """
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    s = s.withColumn("w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.col("sid") % len(weights) + 1))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    every = Window.partitionBy()
    up = Window.orderBy((F.col("cap") / F.col("w")).asc(), "sid").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(every) * F.lit(float(share))
    left = total - F.coalesce(F.sum("cap").over(up), F.lit(0.0))
    open_w = F.sum("w").over(every) - F.coalesce(F.sum("w").over(up), F.lit(0.0))
    s = s.withColumns({"total": total, "stops": F.col("cap") * open_w <= F.col("w") * left})
    kept = F.col("total") - F.sum(F.when(F.col("stops"), F.col("cap")).otherwise(0.0)).over(every)
    by = kept / F.sum(F.when(F.col("stops"), 0.0).otherwise(F.col("w"))).over(every)
    return s.select("source", "sid", "source_size", F.when(F.col("stops"), F.col("cap")).otherwise(F.col("w") * by).alias("target"))


def permuted(x: Column, n: Column, *salt: Column) -> Column:
    """A pseudorandom permutation of 0..n-1 at x (swap-or-not: in each round x may swap with its mirror image about a seeded point)."""

    def step(v: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(r, *salt), n) - v, n)
        return F.when(F.xxhash64(F.greatest(v, mirror), r, *salt) % 2 == 0, mirror).otherwise(v)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x.cast("long"), step)


def plan(sources: DataFrame, block: int, seed: int) -> DataFrame:
    """shard, slot, sid, pass_no, idx: which block of which source each slot of each output shard takes."""
    n = F.ceil(F.col("source_size") / block).cast("long")
    s = sources.where("source_size > 0").select("sid", n.alias("n"), F.least(2 * n, F.round(F.col("target") / F.col("source_size") * n).cast("long")).alias("slots"))
    every = Window.partitionBy()
    s = s.withColumn("shards", F.ceil(F.sum("slots").over(every) / SHARD_SLOTS).cast("long")).where("slots > 0")

    def spread(df: DataFrame, count: str, *by: str) -> DataFrame:
        """A row for each of 0..count-1, through chunks, so that no task makes a hot source's rows alone."""
        c = df.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / CHUNK)))).repartition(partitions(df.sparkSession), *by, "c")
        return c.withColumn("k", F.explode(F.sequence(F.col("c") * CHUNK, F.least(F.col(count), (F.col("c") + 1) * CHUNK) - 1))).drop("c")

    drawn = spread(s, "slots", "sid").select("sid", "n", F.pmod(F.xxhash64(F.lit(seed), "sid", "k"), "shards").alias("shard"))
    counts = drawn.groupBy("sid", "n", "shard").agg(F.count(F.lit(1)).alias("m"))
    before = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = materialize(counts).withColumn("first", F.coalesce(F.sum("m").over(before), F.lit(0)))
    at = spread(counts, "m", "sid", "shard").withColumn("slot_of_source", F.col("first") + F.col("k"))
    p = F.floor(F.col("slot_of_source") / F.col("n")).cast("long")
    idx = permuted(F.col("slot_of_source") % F.col("n"), F.col("n"), F.lit(seed), F.col("sid"), p)
    return at.select("shard", F.col("k").alias("slot"), "sid", p.alias("pass_no"), idx.alias("idx"))


def placed(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Each document with its place in its source: sid, rank, start (words before it)."""
    d = sized.join(sources.withColumnRenamed("source", "__src"), F.col("source").eqNullSafe(F.col("__src"))).drop("__src")
    return salted_offsets(materialize(d), ["sid"], ["doc_id", "h"], "rank", "size", "start")


def mix(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = 64, seed: int = 17, tell: Column | None = None,
) -> DataFrame:
    """doc_id, source, size, source_size, target, h, taken (words), runs: array of (pass_no, from, to) of word ranges that the mix takes."""
    sized = materialize(sizes(docs, key, text, source, tell))
    sources = materialize(targets(sized, weights, share, most))
    slots = plan(sources, block, seed).select("sid", "idx", "pass_no")
    by_block = slots.groupBy("sid", "idx").agg(F.collect_list("pass_no").alias("passes"))  # two at most
    named = ["doc_id", "source", "size", "source_size", "target", "h"]
    none = F.array().cast("array<struct<pass_no:bigint,low:bigint,high:bigint>>")
    d = placed(sized.where("size > 0"), sources)
    end = F.col("start") + F.col("size")
    first = F.floor(F.col("start") / block).cast("long")
    pieces = d.withColumn("idx", F.explode(F.sequence(first, F.floor((end - 1) / block).cast("long"))))
    low = F.greatest(F.col("start"), F.col("idx") * block) - F.col("start")
    high = F.least(end, (F.col("idx") + 1) * block) - F.col("start")
    pieces = pieces.withColumns({"low": low, "high": F.greatest(high, low)})
    met = pieces.join(by_block.hint("merge"), ["sid", "idx"], "left")  # its size is that of the slots, which the planner cannot see
    runs = F.transform("passes", lambda p: F.struct(p.alias("pass_no"), F.col("low").alias("low"), F.col("high").alias("high")))
    met = met.withColumns({"words": (F.col("high") - F.col("low")) * F.greatest(F.size("passes"), F.lit(0)), "runs": F.coalesce(runs, none)})
    out = met.groupBy("sid", "rank", *named).agg(F.sum("words").alias("taken"), F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs")).drop("sid", "rank")
    # documents without words have no place in the row of words
    rest = sized.where("size = 0").join(sources.withColumnRenamed("source", "__src"), F.col("source").eqNullSafe(F.col("__src")))
    return out.unionByName(rest.select(*named, F.lit(0).cast("long").alias("taken"), none.alias("runs")))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus, with the columns of ``docs``: a row for each document and pass that takes any of it, its text the words taken in
    that pass, its ``n_chars`` the new length.  A pass that takes the whole document keeps its text unchanged.

    Rows that are equal in every column have a run list each, and each list makes its own rows of the one text they share.
    """
    tell = F.xxhash64(*docs.columns)
    m = mix(docs, tell=tell, **options).where("taken > 0").select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), "size", F.explode(F.array(F.lit(0), F.lit(1))).alias("p"), "runs")
    m = m.withColumn("runs", F.filter("runs", lambda r: r.pass_no == F.col("p"))).where(F.size("runs") > 0)
    whole = F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r.high - r.low) == F.col("size")
    m = m.select("__id", "__h", F.when(whole, F.array()).otherwise(F.col("runs")).alias("__runs"))
    d = docs.withColumn("__h0", tell).dropDuplicates(["doc_id", "__h0"])
    j = d.join(m, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__h0") == F.col("__h")))
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))
    j = j.withColumn("__words", F.when(F.size("__runs") > 0, words))
    taken = F.array_join(F.flatten(F.transform("__runs", lambda r: F.slice(F.col("__words"), (r.low + 1).cast("int"), (r.high - r.low).cast("int")))), " ")
    j = j.withColumn("text", F.when(F.size("__runs") > 0, taken).otherwise(F.col("text"))).withColumn("n_chars", F.length("text").cast("long"))
    return j.select(*docs.columns)
