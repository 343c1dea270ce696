"""Rules of an evidence bundle, evaluated on Spark: one aggregate for each table, and anti-joins between tables.

A bundle has ``claims`` (split, response_idx, features, label, is_score_train), ``responses`` (split, response_idx, response_id, image, y,
statistics of resampled answers) and ``baselines`` (split, method, response_id, score).  Each rule counts the rows that break it and keeps one of
them as an example, so the whole report is a row per rule whatever the size of the tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .errors import InputError

SPLITS = ("dev", "test")
#: Columns that every bundle has, by table.
COLUMNS = {
    "claims": ["split", "response_idx", "label", "is_score_train"],
    "responses": ["split", "response_id", "image", "y"],
    "baselines": ["split", "method", "response_id", "score"],
}


class BundleError(InputError):
    """A bundle that breaks a rule."""


@dataclass(frozen=True)
class Rule:
    """A condition that breaks the rule, on rows of one table."""

    name: str
    table: str
    broken: Column
    example: str


def _not_finite(c: str) -> Column:
    x = F.col(f"`{c}`")
    return F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(False))


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def row_rules(tables: dict[str, DataFrame]) -> list[Rule]:
    """Rules that look at one row: known splits, labels, masks, keys, finite and complete numbers."""
    out = []
    for name, df in tables.items():
        key = {"claims": "response_idx", "responses": "response_id", "baselines": "response_id"}.get(name)
        if key is None:
            continue
        numbers = [c for c, t in df.dtypes if t in ("double", "float") and not (name == "baselines" and c == "score")]
        out += [
            Rule(f"{name}: split is dev or test", name, ~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False)), key),
            Rule(f"{name}: {key} is there", name, F.col(key).isNull(), key),
            Rule(f"{name}: numbers are finite", name, _any([_not_finite(c) for c in numbers]), key),
            Rule(f"{name}: numbers are there", name, _any([F.col(f"`{c}`").isNull() for c in numbers]), key),
        ]
        if name == "claims":
            dev = F.col("split") == "dev"
            out += [
                Rule("claims: development labels are 0 or 1", name, dev & ~F.coalesce(F.col("label").cast("double").isin(0.0, 1.0), F.lit(False)), key),
                Rule("claims: development rows are for training or not", name, dev & F.col("is_score_train").isNull(), key),
            ]
        if name == "responses":
            out.append(Rule("responses: y is 0 or 1", name, ~F.coalesce(F.col("y").cast("double").isin(0.0, 1.0), F.lit(False)), key))
            out.append(Rule("responses: an image is named", name, F.coalesce(F.col("image").cast("string"), F.lit("")) == "", key))
        if name == "baselines":
            out.append(Rule("baselines: a method is named", name, F.coalesce(F.col("method"), F.lit("")) == "", key))
    return out


def _row_report(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """rule, n_broken, example of one table's rules: a single aggregate, then a row per rule."""
    marks = [F.struct(F.count_if(r.broken).alias("n"), F.min(F.when(r.broken, F.col(r.example).cast("string"))).alias("example")).alias(f"r{i}") for i, r in enumerate(rules)]
    one = df.agg(*marks)
    rows = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.col(f"r{i}.n").alias("n_broken"), F.col(f"r{i}.example").alias("example")) for i, r in enumerate(rules)))
    return one.select(F.explode(rows).alias("x")).select("x.*")


def _counted(rule: str, bad: DataFrame, example: Column) -> DataFrame:
    return bad.agg(F.count(F.lit(1)).alias("n_broken"), F.min(example.cast("string")).alias("example")).select(F.lit(rule).alias("rule"), "n_broken", "example")


def _at_least_one(rule: str, found: DataFrame) -> DataFrame:
    n = found.limit(1).agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.lit(rule).alias("rule"), (F.col("n") == 0).cast("long").alias("n_broken"), F.lit(None).cast("string").alias("example"))


def table_rules(tables: dict[str, DataFrame]) -> list[DataFrame]:
    """Rules between rows and between tables: training rows of both kinds, unique keys, claims and baselines of known responses, whole baselines."""
    out = []
    claims, responses, baselines = (tables.get(n) for n in ("claims", "responses", "baselines"))
    if claims is not None:
        dev = claims.where("split = 'dev'")
        out.append(_at_least_one("claims: some development rows are for training", dev.where("is_score_train")))
        out.append(_at_least_one("claims: some development rows are not for training", dev.where("not is_score_train")))
    if responses is not None:
        twice = responses.groupBy("split", "response_id").count().where("count > 1")
        out.append(_counted("responses: ids are unique in a split", twice, F.col("response_id")))
    if claims is not None and responses is not None and "response_idx" in responses.columns:
        lost = claims.join(responses.select("split", "response_idx"), ["split", "response_idx"], "left_anti")
        out.append(_counted("claims: each belongs to a response", lost, F.col("response_idx")))
    if baselines is not None and responses is not None:
        lost = baselines.join(responses.select("split", "response_id"), ["split", "response_id"], "left_anti")
        out.append(_counted("baselines: each belongs to a response", lost, F.col("response_id")))
        size = responses.groupBy("split").agg(F.count(F.lit(1)).alias("want"))
        have = baselines.groupBy("split", "method").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("response_id").alias("have"))
        uneven = have.join(size, "split").where("have <> want or rows <> want")
        out.append(_counted("baselines: a method scores every response once", uneven, F.col("method")))
    return out


def validate(tables: dict[str, DataFrame]) -> DataFrame:
    """rule, n_broken, example: a row per rule of the tables that are there."""
    for name, want in COLUMNS.items():
        if name in tables:
            lacking = [c for c in want if c not in tables[name].columns]
            if lacking:
                raise BundleError(f"{name} lacks {', '.join(lacking)}")
    rules = row_rules(tables)
    parts = [_row_report(df, mine) for n, df in tables.items() if (mine := [r for r in rules if r.table == n])] + table_rules(tables)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def require_valid(tables: dict[str, DataFrame]) -> None:
    """An error that names every broken rule, how often it is broken, and an example."""
    bad = validate(tables).where("n_broken > 0").orderBy("rule").collect()  # a row per rule at most
    if bad:
        raise BundleError("; ".join(f"{r.rule} ({r.n_broken} rows" + (f", such as {r.example})" if r.example is not None else ")") for r in bad))
