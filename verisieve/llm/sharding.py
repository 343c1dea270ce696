"""Sharding by balanced label propagation, with DataFrame operations only.

Documents with equal texts are linked.  Shards start as a pseudorandom deal with counts at most one apart.  In every round each group of
linked documents names its target shards (those that hold most of it; as many as its size needs) and its members elsewhere ask to move
there.  Moves are granted as exchanges between two shards only: asker against asker first, then asker against documents that have no
link, under the quota that both sides allow.  So counts stay exactly as dealt in every round while cut links fall.

A group is known by its digest, and what propagates is a count per (group, shard), never a pair of members: a group with a third of all
rows is 40 counts.  Ranks that decide who moves are cut into hash buckets, and the quota table has a row per pair of shards.

Law ``rows``: counts are at most one apart.  Defined cases: a null text is 0 bytes and is equal to no text but another null or the empty
one; repeated rows are separate members of one group; an empty table gives an empty result; fewer rows than shards leave shards empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, materialize, salted_offsets


#: Copies of a group's target row.
SALTS = 16


def narrow(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).alias("doc_id"), (F.octet_length(t) + 16).cast("long").alias("size"), F.crc32(F.encode(t, "utf-8")).cast("long").alias("text_crc32"), F.md5(F.encode(t, "utf-8")).alias("group"))


def dealt(rows: DataFrame, shards: int) -> DataFrame:
    """A pseudorandom deal: the rank of a hash, modulo the shards."""
    d = salted_offsets(rows.withColumn("all", F.lit(0)), ["all"], ["doc_id", "group"], "rank")
    return d.select(*rows.columns, F.col("rank").alias("row"), (F.col("rank") % shards).cast("int").alias("shard"))


def wishes(state: DataFrame, shards: int, capacity: int) -> DataFrame:
    """Adds ``want``: a target shard of the row's group, null if the row has no link; equal to ``shard`` if it need not move."""
    held = state.groupBy("group", "shard").agg(F.count(F.lit(1)).alias("n"))
    # (group, shard) counts: 40 rows a group at most
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.xxhash64("group", "shard").alias("t"), "shard")))
    group = held.groupBy("group").agg(F.sum("n").alias("n"), order.alias("o")).where("n > 1")
    need = F.least(F.size("o"), F.ceil(F.col("n") / capacity).cast("int"))
    group = group.select("group", F.transform(F.slice("o", 1, need), lambda x: x.shard).alias("targets"))
    # a group's row is copied per salt, so that a hot group's members meet it in several tasks
    group = group.withColumn("salt", F.explode(F.array(*(F.lit(i) for i in range(SALTS)))))
    j = state.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(group.hint("merge"), ["group", "salt"], "left").drop("salt")
    pick = F.element_at("targets", (F.pmod(F.xxhash64("row"), F.size("targets")) + 1).cast("int"))
    return j.withColumn("want", F.when(F.array_contains("targets", F.col("shard")), F.col("shard")).otherwise(pick)).drop("targets")


def exchange(state: DataFrame, shards: int) -> DataFrame:
    """One round of granted exchanges.  ``state`` has row, group, shard, want (materialised)."""
    grid = state.sparkSession.range(shards * shards).select((F.col("id") / shards).cast("int").alias("s"), (F.col("id") % shards).cast("int").alias("d"))
    asks = state.where("want <> shard").groupBy(F.col("shard").alias("s"), F.col("want").alias("d")).agg(F.count(F.lit(1)).alias("p"))
    free = state.where("want is null").groupBy(F.col("shard").alias("d")).agg(F.count(F.lit(1)).alias("f"))
    back = asks.select(F.col("d").alias("s"), F.col("s").alias("d"), F.col("p").alias("q"))
    # shards² rows: quotas of every pair of shards
    quota = grid.join(asks, ["s", "d"], "left").join(back, ["s", "d"], "left").join(free, "d", "left").na.fill(0)
    quota = quota.withColumn("swap", F.least("p", "q")).withColumn("rest", F.col("p") - F.col("swap"))
    before = Window.partitionBy("d").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    used = F.least(F.col("f"), F.coalesce(F.sum("rest").over(before), F.lit(0)))
    quota = quota.withColumn("low", used).withColumn("take", F.least(F.col("rest"), F.col("f") - F.col("low")))
    quota = materialize(quota.select("s", "d", (F.col("swap") + F.col("take")).alias("go"), "low", (F.col("low") + F.col("take")).alias("high")))
    # who goes: the first of a pseudorandom order within (shard, want)
    ranked = salted_offsets(state.withColumn("w", F.coalesce("want", F.lit(-1))), ["shard", "w"], ["row"], "k", buckets=64)
    goes = F.broadcast(quota.select(F.col("s").alias("shard"), F.col("d").alias("w"), "go"))  # shards² rows
    to = quota.where("high > low").groupBy(F.col("d").alias("shard")).agg(F.collect_list(F.struct("low", "high", "s")).alias("out"))
    r = ranked.join(goes, ["shard", "w"], "left").join(F.broadcast(to), "shard", "left")  # to: a row per shard
    freed = F.try_element_at(F.filter("out", lambda x: (x.low <= F.col("k")) & (F.col("k") < x.high)), F.lit(1)).s
    new = F.when((F.col("w") >= 0) & (F.col("w") != F.col("shard")) & (F.col("k") < F.col("go")), F.col("w")).when(F.col("w") < 0, F.coalesce(freed, F.col("shard"))).otherwise(F.col("shard"))
    return r.select("row", "group", new.cast("int").alias("shard"))


def assign(docs: DataFrame, shards: int = 40, rounds: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, group, shard, slot."""
    rows = materialize(narrow(docs, key, text))
    full = materialize(dealt(rows, shards))
    state = full.select("row", "group", "shard")
    capacity = max(1, full.count() // shards)
    for _ in range(rounds):
        asked = materialize(wishes(state, shards, capacity))
        moved = materialize(exchange(asked, shards))
        discard(asked)
        discard(state)
        state = moved
    slots = salted_offsets(state, ["shard"], ["row"], "slot")
    return full.drop("shard", "group").join(slots.select("row", "group", "shard", "slot"), "row").drop("row")
