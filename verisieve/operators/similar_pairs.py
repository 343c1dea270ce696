"""Sequence similarity on distinct pairs, with upper bounds that spare most comparisons where only the largest is asked for.

The ratio is twice the number of matching characters over both lengths.  No more characters can match than the shorter text has, nor than
the texts share as multisets, so both give bounds from above; they are built-in expressions.  Block matching, the costly Python step, runs
once for each distinct pair of a table of pairs, and for the largest of many candidates only on those that can still reach it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import similarities, similarity
from ..functions.text import find_all


def length_bound(a: Column, b: Column) -> Column:
    """2 * shorter / (both lengths); two empty texts are equal."""
    x, y = F.length(F.coalesce(a, F.lit(""))), F.length(F.coalesce(b, F.lit("")))
    return F.when(x + y == 0, 1.0).otherwise(2.0 * F.least(x, y) / F.greatest(x + y, F.lit(1)))


def multiset_bound(a: Column, b: Column) -> Column:
    """2 * characters shared, with repeats / (both lengths)."""
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    x, y = F.length(a), F.length(b)
    times = lambda t, c: F.length(t) - F.length(F.replace(t, c, F.lit("")))
    kinds = F.array_distinct(find_all(a, r"(?s)."))
    shared = F.aggregate(F.transform(kinds, lambda c: F.least(times(a, c), times(b, c))), F.lit(0), lambda s, n: s + n)
    return F.when(x + y == 0, 1.0).otherwise(2.0 * shared / F.greatest(x + y, F.lit(1)))


def bound(a: Column, b: Column) -> Column:
    """No ratio of the pair is above it."""
    return F.least(length_bound(a, b), multiset_bound(a, b))


def similarity_pairs(df: DataFrame, left: str, right: str, name: str = "similarity") -> DataFrame:
    """``df`` with the ratio of each row's pair.  Each distinct pair is compared once in the table; equal texts are 1 without a comparison.

    A null text counts as empty.
    """
    a, b = F.coalesce(F.col(left), F.lit("")), F.coalesce(F.col(right), F.lit(""))
    d = df.withColumns({"__a": a, "__b": b})
    pairs = d.where("__a <> __b").select("__a", "__b").distinct().withColumn("__s", similarity(F.col("__a"), F.col("__b")))
    return d.join(pairs, ["__a", "__b"], "left").withColumn(name, F.coalesce("__s", F.lit(1.0))).drop("__a", "__b", "__s")


def _bounds(text: Column, candidates: Column) -> Column:
    """``bound`` of a text with each candidate; the characters of the text are counted once."""
    times = lambda t, c: F.length(t) - F.length(F.replace(t, c, F.lit("")))
    kinds = F.transform(F.array_distinct(find_all(text, r"(?s).")), lambda c: F.struct(c.alias("c"), times(text, c).alias("n")))

    def one(k: Column, c: Column) -> Column:
        both = F.length(text) + F.length(c)
        shared = F.aggregate(k, F.lit(0), lambda s, x: s + F.least(x.n, times(c, x.c)))
        return F.when(both == 0, 1.0).otherwise(2.0 * F.least(shared, F.length(text), F.length(c)) / F.greatest(both, F.lit(1)))

    # an array of one element: inside the inner lambda, the counts would be made anew for each candidate
    return F.element_at(F.transform(F.array(kinds), lambda k: F.transform(candidates, lambda c: one(k, c))), 1)


def best_similarity(df: DataFrame, key: list[str], text: str, candidates: str) -> DataFrame:
    """key, best, position, n_candidates, n_compared: the largest ratio of a text with an array of candidates, the first of equal ones.

    Without a candidate ``best`` is 0 and ``position`` null.  Per row the candidate with the largest bound is compared first; then those
    whose bound is above that ratio, or equal to it at an earlier position.  ``n_compared`` counts these.  ``key`` tells rows apart.

    A row holds all that its answer needs, so nothing is shuffled or written: pairs as rows of their own, in tables and joins, took some forty
    times the input.  A pair that several rows of one Arrow batch have is compared once.
    """
    none = F.array().cast("array<string>")
    d = df.select(*key, F.coalesce(F.col(text), F.lit("")).alias("__t"), F.coalesce(F.transform(candidates, lambda c: F.coalesce(c, F.lit(""))), none).alias("__c"))
    d = d.withColumn("__b", _bounds(F.col("__t"), F.col("__c")))
    d = d.withColumn("__p", F.array_position("__b", F.array_max("__b")).cast("int"))  # from 1; null without candidates
    d = d.withColumn("__s", similarity(F.col("__t"), F.try_element_at("__c", F.col("__p"))))
    b, s, p = F.col("__b"), F.col("__s"), F.col("__p")
    left = lambda i: (F.get(b, i) > s) | ((F.get(b, i) == s) & (i + 1 < p))
    others = F.filter(F.sequence(F.lit(0), F.size("__c") - 1), lambda i: (i + 1 != p) & left(i))
    d = d.withColumn("__i", F.when(F.size("__c") > 0, others).otherwise(F.array().cast("array<int>")))
    d = d.withColumn("__r", similarities(F.col("__t"), F.transform("__i", lambda i: F.get("__c", i))))
    met = F.transform(F.arrays_zip("__i", "__r"), lambda x: F.struct((-x["__r"]).alias("s"), x["__i"].alias("pos")))
    lead = F.array(F.struct((-s).alias("s"), (p - 1).alias("pos")))
    d = d.withColumn("__best", F.when(p.isNotNull(), F.array_min(F.concat(lead, met))))
    n = F.when(p.isNotNull(), F.size("__i") + 1).otherwise(0)
    return d.select(
        *key, F.coalesce(-F.col("__best.s"), F.lit(0.0)).alias("best"), F.col("__best.pos").alias("position"), F.size("__c").cast("long").alias("n_candidates"), n.cast("long").alias("n_compared")
    )
