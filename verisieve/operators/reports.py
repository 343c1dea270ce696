"""Comparisons of tables and summaries of labelled sets: differences by cell, match rates by field, reproduction, counts with warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _beside(a: DataFrame, b: DataFrame, keys: list[str], names: list[str], how: str) -> DataFrame:
    """Rows of two tables with one key side by side: a row per key and field, values as a and b."""
    side = lambda df, x: df.select(*keys, F.struct(*(F.col(f"`{n}`").alias(n) for n in names)).alias(x))
    return side(a, "__a").join(side(b, "__b"), keys, how)


def max_abs_difference(a: DataFrame, b: DataFrame, key: str, names: list[str]) -> DataFrame:
    """name, n (both present), n_one_sided, max_abs_diff and the key of that cell (the smallest of several) for each column.

    Keys of one table only are left out; one pass over the join, whatever the number of columns.
    """
    cell = lambda n: F.struct(F.lit(n).alias("name"), F.col(f"__a.`{n}`").cast("double").alias("a"), F.col(f"__b.`{n}`").cast("double").alias("b"))
    long = _beside(a, b, [key], names, "inner").select(F.col(key).alias("key"), F.explode(F.array(*(cell(n) for n in names))).alias("x")).select("key", "x.*")
    gap = F.abs(F.col("a") - F.col("b"))
    worst = F.min(F.when(gap.isNotNull(), F.struct((-gap).alias("gap"), "key"))).alias("worst")
    out = long.groupBy("name").agg(F.count(gap).alias("n"), F.count_if(F.col("a").isNull() != F.col("b").isNull()).alias("n_one_sided"), worst)
    return out.select("name", "n", "n_one_sided", (-F.col("worst.gap")).alias("max_abs_diff"), F.col("worst.key").alias("key"))


def _same(a: Column, b: Column, kind: str, tolerance: float) -> Column:
    if kind in ("double", "float"):
        return F.coalesce(F.abs(a - b) <= tolerance, F.lit(False)) | a.eqNullSafe(b)
    return a.eqNullSafe(b)


def field_matches(a: DataFrame, b: DataFrame, keys: list[str], names: list[str], tolerance: float = 1e-12) -> DataFrame:
    """name, n (keys in both tables), n_equal, rate, only_a, only_b (keys of one table) for each field; doubles match within the tolerance."""
    kinds = dict(a.dtypes)
    d = _beside(a, b, keys, names, "full")
    both = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    cell = lambda n: F.struct(F.lit(n).alias("name"), (both & _same(F.col(f"__a.`{n}`"), F.col(f"__b.`{n}`"), kinds[n], tolerance)).alias("equal"))
    d = d.select(both.alias("both"), F.col("__b").isNull().alias("a_only"), F.col("__a").isNull().alias("b_only"), F.explode(F.array(*(cell(n) for n in names))).alias("x"))
    out = d.groupBy("x.name").agg(F.count_if("both").alias("n"), F.count_if("x.equal").alias("n_equal"), F.count_if("a_only").alias("only_a"), F.count_if("b_only").alias("only_b"))
    return out.withColumn("rate", F.try_divide(F.col("n_equal").cast("double"), F.col("n").cast("double")))


def reproduction(measured: DataFrame, stored: DataFrame, keys: list[str], value: str, tolerance: float = 1e-5) -> DataFrame:
    """keys, measured, stored, delta, reproduced: whether stored figures come out again.  A figure of one side is not reproduced."""
    m, s = measured.select(*keys, F.col(value).alias("measured")), stored.select(*keys, F.col(value).alias("stored"))
    d = m.join(s, keys, "full").withColumn("delta", F.col("measured") - F.col("stored"))
    return d.withColumn("reproduced", F.coalesce(F.abs("delta") <= tolerance, F.lit(False)))


def labelled_summary(df: DataFrame, label: str = "failed", group: str = "image", few: int = 300, enough: int = 1200) -> DataFrame:
    """n_rows, n_failed, n_groups, share_failed and warnings: what a labelled set is too thin for."""
    n, k = F.col("n_rows"), F.col("n_failed")
    out = df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(F.col(label).cast("long")), F.lit(0).cast("long")).alias("n_failed"), F.countDistinct(F.col(group)).alias("n_groups"))
    out = out.withColumn("share_failed", F.try_divide(k.cast("double"), n.cast("double")))
    tests = [
        (n < few, f"fewer than {few} rows: too few to fit on"),
        ((n >= few) & (n < enough), f"fewer than {enough} rows: more would still help"),
        ((k == 0) | (k == n), "one class only"),
        (F.col("n_groups") * 2 < n, "groups repeat: rows are not independent"),
    ]
    return out.withColumn("warnings", F.array_join(F.filter(F.array(*(F.when(t, F.lit(w)) for t, w in tests)), lambda x: x.isNotNull()), "|"))


def methods_of(*tables: DataFrame, method: str = "method") -> DataFrame:
    """The methods that any of the tables names."""
    out = tables[0].select(method)
    for t in tables[1:]:
        out = out.union(t.select(method))
    return out.distinct()


def first_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows in an order that tells rows apart: examples for a report."""
    return df.orderBy(*order).limit(n)


def candidate_beside_baselines(candidate: DataFrame, baselines: DataFrame, key: str = "response_id", score: str = "score", method: str = "method") -> DataFrame:
    """method, key, candidate, baseline: scores of the same responses; a method with a score that is not finite is left out whole."""
    finite = ~(F.col(score).isNull() | F.isnan(score) | (F.abs(score) == float("inf")))
    good = baselines.groupBy(method).agg(F.bool_and(finite).alias("ok")).where("ok").select(method)
    b = baselines.join(good, method).select(method, key, F.col(score).alias("baseline"))
    return b.join(candidate.select(key, F.col(score).alias("candidate")), key).select(method, key, "candidate", "baseline")


def sample_rows(df: DataFrame, keys: list[str], n: int, seed: int = 0) -> DataFrame:
    """n rows for a reader's eye, in a seeded hash order of keys that tell rows apart: the same whatever the partitions."""
    return df.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(n)


def difference_examples(a: DataFrame, b: DataFrame, keys: list[str], names: list[str], n: int = 3, tolerance: float = 1e-12) -> DataFrame:
    """name, n_compared, n_equal, rate, examples of each field: counters, and the n smallest keys whose values differ with both values as text.

    Keys of one table only are left out.  Each task keeps n rows per field before the shuffle, so a field that differs everywhere is no
    large group.
    """
    kinds = dict(a.dtypes)
    at = F.struct(*(F.col(k).alias(k) for k in keys))
    cell = lambda c: F.struct(F.lit(c).alias("name"), _same(F.col(f"__a.`{c}`"), F.col(f"__b.`{c}`"), kinds[c], tolerance).alias("equal"), F.col(f"__a.`{c}`").cast("string").alias("a"), F.col(f"__b.`{c}`").cast("string").alias("b"))
    long = _beside(a, b, keys, names, "inner").select(at.alias("key"), F.explode(F.array(*(cell(c) for c in names))).alias("x")).select("key", "x.*")
    counts = long.groupBy("name").agg(F.count(F.lit(1)).alias("n_compared"), F.count_if("equal").alias("n_equal"))
    turn = F.row_number().over(Window.partitionBy("name").orderBy("key"))
    few = long.where(~F.col("equal")).withColumn("turn", turn).where(F.col("turn") <= n)
    few = few.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("key", "a", "b"))).alias("examples"))
    out = counts.join(few, "name", "left").withColumn("rate", F.col("n_equal") / F.col("n_compared").cast("double"))
    return out.select("name", "n_compared", "n_equal", "rate", "examples")


def verify_decomposition(stored: DataFrame, mine: DataFrame, rules: str, model: str, fields: list[str], n: int = 3) -> tuple[DataFrame, DataFrame]:
    """(counts, fields): stored claims of the rules' path against recomputed ones.

    ``stored``: sample_id, claim_id, decomposition_method and the fields; ``mine``: sample_id, claim_pos and the fields.  Responses whose claims all
    come from the model are skipped and counted; mixed ones are counted, and their rules' claims compared.  Claims stand side by side in the
    order of ``claim_id`` as text; responses with another number of claims are counted, with the n smallest as examples, and not compared.
    """
    own = F.col("decomposition_method") == rules
    per = stored.groupBy("sample_id").agg(F.count_distinct("decomposition_method").alias("paths"), F.bool_and(F.col("decomposition_method") == model).alias("by_model"), F.count_if(own).alias("k"))
    size = mine.groupBy("sample_id").agg(F.count(F.lit(1)).alias("have"))
    per = per.join(size, "sample_id", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    compared, uneven = F.col("k") > 0, (F.col("k") > 0) & (F.col("k") != F.col("have"))
    lost = per.where(uneven).orderBy("sample_id").limit(n).agg(F.array_sort(F.collect_list("sample_id")).alias("uneven_examples"))
    counts = per.agg(
        F.count(F.lit(1)).alias("n_responses"), F.count_if("by_model").alias("n_model_only"), F.count_if(F.col("paths") > 1).alias("n_mixed"),
        F.count_if(compared).alias("n_compared"), F.count_if(uneven).alias("n_uneven"),
    ).crossJoin(lost)  # fmt: skip  (one row each)
    even = per.where(compared & ~uneven).select("sample_id")
    order = F.row_number().over(Window.partitionBy("sample_id").orderBy("claim_id"))  # a response's claims: a handful
    kept = stored.where(own).join(even, "sample_id").select("sample_id", order.alias("claim_pos"), *fields)
    return counts, difference_examples(mine.select("sample_id", "claim_pos", *fields), kept, ["sample_id", "claim_pos"], fields, n)
