"""Running sums and exact quantiles over a whole table, without a single-partition window.

Values are collapsed to one row per distinct value first.  Those rows are cut into ranges at approximate quantiles; a running sum is the
sum inside the range plus the totals of the ranges before it, a table with a row per range.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.durable import materialize

RANGES = 64


def _ranges(df: DataFrame) -> int:
    """Ranges that a table is cut into: more on a cluster that is set up for more partitions."""
    return max(RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def prefix_sums(df: DataFrame, order: str, sums: list[str], descending: bool = False, by: str | None = None) -> DataFrame:
    """Adds ``<c>_upto`` for each column of ``sums``: its sum over all rows up to and with this one, within ``by`` if given.

    ``order`` is unique (within ``by``) and not null.  ``df`` is read several times.
    """
    n = _ranges(df)
    key = F.col(order).desc() if descending else F.col(order).asc()
    cuts = F.percentile_approx(order, [i / n for i in range(1, n)], 10_000)
    if by is None:
        got = sorted(set(df.agg(cuts).first()[0] or []))
        d = df.withColumn("__cuts", F.array(*(F.lit(x) for x in got)) if got else F.array().cast("array<double>"))
    else:
        d = df.join(df.groupBy(by).agg(F.array_sort(F.array_distinct(cuts)).alias("__cuts")), by)  # a row per ``by``
    part = F.coalesce(F.size(F.filter("__cuts", lambda c: c <= F.col(order))), F.lit(0))
    d = d.withColumn("__part", -part if descending else part).drop("__cuts")
    groups = [*([by] if by else []), "__part"]
    before = (Window.partitionBy(by) if by else Window.partitionBy()).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    totals = d.groupBy(*groups).agg(*(F.sum(c).alias(c) for c in sums))
    totals = totals.select(*groups, *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__b_{c}") for c in sums))
    inside = Window.partitionBy(*groups).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({f"{c}_upto": F.sum(c).over(inside) for c in sums}).join(totals, groups)
    return d.withColumns({f"{c}_upto": F.col(f"{c}_upto") + F.col(f"__b_{c}") for c in sums}).drop("__part", *(f"__b_{c}" for c in sums))


def quantiles(df: DataFrame, value: str, qs: list[float]) -> list[float | None]:
    """Exact quantiles with linear interpolation, for a handful of ``qs``; NULL values are skipped.  One pass over ``df``."""
    held = materialize(df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n")))
    total = held.agg(F.sum("n")).first()[0] or 0
    if not total:
        return [None] * len(qs)
    c = prefix_sums(held, "v", ["n"])
    ranks = [((total - 1) * q) for q in qs]
    wanted = sorted({int(r) for r in ranks} | {min(int(r) + 1, total - 1) for r in ranks})
    # each wanted rank falls to one value: the first with more rows up to it
    hit = F.filter(F.lit(wanted), lambda r: (r < F.col("n_upto")) & (r >= F.col("n_upto") - F.col("n")))
    at = {r[0]: r[1] for r in c.select(F.explode(hit).alias("rank"), "v").collect()}  # two rows per quantile
    return [at[int(r)] + (at[min(int(r) + 1, total - 1)] - at[int(r)]) * (r - int(r)) for r in ranks]


#: Half the share of ranks between the two pivots of a median, and the accuracy that they are asked for with.
PIVOT, ACCURACY = 0.002, 1000
#: Aggregates in one job over the rows.
JOB = 32


def medians(df: DataFrame, names: list[str]) -> DataFrame:
    """name, median of the non-null values of each column, exact.

    Two values near the median are taken from a sketch of all rows; the rows below, at and between them are counted, and only the values
    between, well under a hundredth of the rows, are sorted.  A column whose median the pivots miss is sorted whole.
    """
    spark, names = df.sparkSession, list(dict.fromkeys(names))
    col = {n: F.col(f"`{n}`").cast("double") for n in names}
    near = _row(df, [F.percentile_approx(col[n], [0.5 - PIVOT, 0.5 + PIVOT], ACCURACY) for n in names])
    pivots = {n: x for n, x in zip(names, near, strict=True) if x is not None}  # a column without values has no median
    if not pivots:
        return spark.createDataFrame([], "name string, median double")
    kinds = lambda v, p: (v.isNotNull(), v < p[0], v == p[0], v == p[1])
    told = _row(df, [F.count_if(k) for n, p in pivots.items() for k in kinds(col[n], p)])
    done, between = [], []
    for i, (n, (a, b)) in enumerate(pivots.items()):
        total, below, at_a, at_b = told[4 * i : 4 * i + 4]
        done.append((n, total, below, a, at_a, b, at_b if b != a else 0))
        if a < b:
            between.append(n)
    # value and number of rows; what is between the pivots is counted per value, the pivots themselves are known
    known = [(n, v, k) for n, _, _, a, at_a, b, at_b in done for v, k in ((a, at_a), (b, at_b)) if k]
    inside = {n: (col[n] > pivots[n][0]) & (col[n] < pivots[n][1]) for n in between}
    counted = _table(spark, known, [("name", pa.string()), ("v", pa.float64()), ("n", pa.int64())])
    if inside:  # no filter on the rows: pushed below the layers of a deep plan, it would repeat their expressions
        counted = counted.unionByName(_counted(df, {n: F.when(x, col[n]) for n, x in inside.items()}))
    held = materialize(counted)
    out, whole = at_medians(held, [d[:3] for d in done])
    if whole:
        held = materialize(_counted(df, {n: col[n] for n in whole}))
        ranks = held.groupBy("name").agg(F.sum("n").alias("total")).withColumn("below", F.lit(0).cast("long"))
        out = out.unionByName(_at_ranks(held, ranks))
    return out


def at_medians(held: DataFrame, known: list[tuple[str, int, int]]) -> tuple[DataFrame, list[str]]:
    """(name, median) by values next to each other (name, v, n), and the names whose medians are not among them.

    ``known`` has a name, how many values it has, and how many of them are below those of ``held``.
    """
    got = held.groupBy("name").agg(F.sum("n").alias("inside"))
    ranks = _table(held.sparkSession, known, [("name", pa.string()), ("total", pa.int64()), ("below", pa.int64())]).join(F.broadcast(got), "name", "left").fillna(0, ["inside"])  # a row per column
    missed = (F.col("below") > F.floor((F.col("total") - 1) / 2)) | (F.col("below") + F.col("inside") <= F.floor(F.col("total") / 2))
    whole = [r[0] for r in ranks.where(missed).select("name").collect()]
    return _at_ranks(held.where(~F.col("name").isin(whole)) if whole else held, ranks), whole


def _row(df: DataFrame, aggregates: list) -> list:
    """The values of many aggregates, some in each job: all in one are methods too long for the JVM to compile."""
    return [v for i in range(0, len(aggregates), JOB) for v in df.agg(*(a.alias(f"a{j}") for j, a in enumerate(aggregates[i : i + JOB]))).first()]


def _table(spark: SparkSession, rows: list[tuple], kinds: list[tuple[str, pa.DataType]]) -> DataFrame:
    """A small table without Python tasks."""
    return spark.createDataFrame(pa.table([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], schema=pa.schema(kinds)))


def _counted(df: DataFrame, values: dict) -> DataFrame:
    """name, v, n: how often each column holds each value that is not null."""
    names, out = list(values), None
    for at in range(0, len(names), JOB):
        some = names[at : at + JOB]
        long = df.select(F.posexplode(F.array(*(values[n] for n in some))).alias("i", "v")).where(F.col("v").isNotNull())
        part = long.groupBy("i", "v").agg(F.count(F.lit(1)).alias("n")).select(F.element_at(F.array(*(F.lit(n) for n in some)), F.col("i") + 1).alias("name"), "v", "n")
        out = part if out is None else out.unionByName(part)
    return out


def _at_ranks(held: DataFrame, ranks: DataFrame) -> DataFrame:
    """name, median: of columns with ``total`` values, of which ``below`` are smaller than all of ``held`` (name, v, n)."""
    c = prefix_sums(held, "v", ["n"], by="name").join(F.broadcast(ranks.select("name", "total", "below")), "name")  # a row per column
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    pick = lambda r: F.min(F.when(F.col("n_upto") + F.col("below") > r, F.col("v")))
    return c.groupBy("name").agg(((pick(low) + pick(high)) / 2).alias("median"))
