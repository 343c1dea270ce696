"""Readers and writers: JSON lines with quarantine, evidence CSVs, Parquet bundles with a checked manifest, scorer files, path scrubbing."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.durable import materialize
from ..operators.evidence import TARGETS, left_join_first, lookup_last
from ..operators.features import gold_label, vqa_label
from . import bundles
from .bundles import BundleError
from .digests import sha256  # noqa: F401  (a reader's name for it)
from .errors import InputError

DEV_SCHEMA = "question string, answer string, image string, failed int, `group` string"
SOURCE_SCHEMA = "question string, answer string, image string, gold string, answers array<string>"
REQUEST_SCHEMA = "question string, answer string, image string, threshold double, return_claims boolean"
EVIDENCE_TABLES = ("features", "claims", "direct", "mechanical")


def require_path(spark: SparkSession, path: str, what: str) -> str:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        raise InputError(f"{what} not found: {path}")
    return path


def missing_paths(spark: SparkSession, paths: list[str]) -> list[str]:
    """Absent inputs; an absent input is neither a pass nor a failure (exit status 2)."""
    out = []
    for p in paths:
        try:
            require_path(spark, p, "input")
        except InputError:
            out.append(p)
    return out


def read_lines(spark: SparkSession, path: str, schema: str, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined lines) of JSON lines.  A byte-order mark and blank lines are dropped; a line is quarantined if it is no
    JSON object or lacks a required field."""
    text = spark.read.text(require_path(spark, path, "JSON lines")).select(F.input_file_name().alias("file"), "value")
    good, bad = _parsed(text, schema, required)
    return good.select("r.*"), bad.select("file", "value")


def _parsed(text: DataFrame, schema: str, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Lines with the record in ``r``, and lines that hold none."""
    text = text.withColumn("value", F.regexp_replace("value", "^\ufeff", "")).where(F.trim("value") != "")
    d = text.withColumn("r", F.from_json("value", schema, {"mode": "PERMISSIVE"})).withColumn("object", F.from_json("value", "map<string,string>"))
    ok = F.col("object").isNotNull()
    for c in required:
        ok = ok & F.col(f"r.`{c}`").isNotNull()
    ok = F.coalesce(ok, F.lit(False))
    return d.where(ok), d.where(~ok)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1), value of text files.  A line's number is its partition's first number plus its place there, counted once."""
    held = materialize(spark.read.text(path).select(F.input_file_name().alias("file"), "value").withColumn("m", F.monotonically_increasing_id()))
    part = F.shiftright("m", 33)
    # a partition may hold several files, and a file several partitions: count per (file, partition)
    counts = held.groupBy("file", part.alias("part")).agg(F.min("m").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    d = held.withColumn("part", part).join(counts, ["file", "part"])
    return d.select("file", (F.col("m") - F.col("first") + F.col("base") + 1).alias("line"), "value")


def read_dev(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """The labelled set; ``response_id`` is made of file and line, so it does not depend on partitions.

    With ``strict`` a malformed line, or no row at all, is an error that names the first bad line.
    """
    lines = numbered_lines(spark, require_path(spark, path, "JSON lines"))
    good, bad = _parsed(lines, DEV_SCHEMA, ["question", "answer", "image", "failed"])
    if strict:
        row = bad.orderBy("file", "line").first()
        if row is not None:
            raise InputError(f"{path}, line {row['line']}: not a usable record: {row['value'][:80]}")
        if good.isEmpty():
            raise InputError(f"{path}: no records")
    return good.select("r.*", F.concat_ws("#", F.regexp_extract("file", "[^/]*$", 0), "line").alias("response_id"))


def read_labelled(spark: SparkSession, path: str, threshold: float = 0.5) -> DataFrame:
    """question, answer, image, failed, score of a labelling source: ``gold`` is a string or a list, or ``answers`` lists annotators' answers.

    A record with neither, or without question, answer and image, is refused.
    """
    lines = numbered_lines(spark, require_path(spark, path, "JSON lines"))
    good, bad = _parsed(lines, "question string, answer string, image string, answers array<string>", ["question", "answer", "image"])
    raw = F.get_json_object("value", "$.gold")
    listed = F.from_json(raw, "array<string>")
    gold = F.when(raw.isNotNull(), F.when(raw.startswith("[") & listed.isNotNull(), listed).otherwise(F.array(raw)))
    d = good.withColumn("gold", gold)
    lost = bad.select("file", "line", "value").unionByName(d.where("gold is null and r.answers is null").select("file", "line", "value")).orderBy("file", "line").first()
    if lost is not None:
        raise InputError(f"{path}, line {lost['line']}: not a usable record: {lost['value'][:80]}")
    d = d.select("r.*", "gold")
    by_vote, by_gold = vqa_label(F.col("answer"), F.col("answers"), threshold), gold_label(F.col("answer"), F.col("gold"), threshold)
    pick = lambda i: F.when(F.col("gold").isNotNull(), by_gold[i]).otherwise(by_vote[i])
    return d.select("question", "answer", "image", pick(0).alias("failed"), pick(1).alias("score"))


def read_provider_dev(spark: SparkSession, path: str) -> DataFrame:
    """The labelled set for a real provider: the first record must have every key; later ones may lack some (they are NULL)."""
    lines = numbered_lines(spark, require_path(spark, path, "JSON lines")).where(F.trim("value") != "")
    first = lines.orderBy("file", "line").first()
    keys = spark.createDataFrame([(first["value"] if first else "{}",)], "v string").select(F.json_object_keys("v")).first()[0] or []
    lacking = [k for k in ("question", "answer", "image", "failed") if k not in keys]
    if lacking:
        raise InputError(f"{path}: the first record lacks {', '.join(lacking)}")
    return lines.select(F.from_json("value", DEV_SCHEMA).alias("r")).select("r.*")


def write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_csv_without_targets(spark: SparkSession, path: str, schema: str | None = None, keep_empty: bool = False) -> DataFrame:
    """All columns as text unless a schema is given; a table with a target column is refused.  ``keep_empty``: empty text stays text."""
    r = spark.read.option("header", True).option("escape", '"').option("multiLine", True)
    r = r.option("nullValue", "\0").option("emptyValue", "") if keep_empty else r
    df = (r.schema(schema) if schema else r).csv(require_path(spark, path, "evidence table"))
    bad = [c for c in df.columns if c in TARGETS]
    if bad:
        raise InputError(f"{path} holds target columns: {', '.join(bad)}")
    return df.fillna("") if keep_empty else df


def read_evidence(spark: SparkSession, folder: str, split: str, suffix: str = ".csv.gz") -> DataFrame:
    """The four evidence tables of a split, joined on unit_id: first row of each key on the right, clashing names suffixed, image looked up (last row wins).

    First and last are by file name, then by record within the file.  A file whose records may hold line ends is never split, so a
    record's number in its task rises in the file's order, and the result depends neither on partitions nor on the order of listing.
    """
    paths = {t: f"{folder}/{split}_{t}{suffix}" for t in EVIDENCE_TABLES}
    gone = missing_paths(spark, list(paths.values()))
    if gone:
        raise InputError(f"evidence tables are absent: {', '.join(gone)}")
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("record"))

    def at(t: str, **kw) -> DataFrame:
        d = read_csv_without_targets(spark, paths[t], **kw)
        return d.select("*", place.alias("row_pos"))

    claims = at("claims")
    base = left_join_first(at("features"), claims.drop("image") if "image" in claims.columns else claims, "unit_id", "row_pos", "_claims")
    base = left_join_first(base, at("direct"), "unit_id", "row_pos", "_direct")
    base = left_join_first(base, at("mechanical", keep_empty=True), "unit_id", "row_pos", "_mechanical")
    return lookup_last(base, claims, "unit_id", "image", "row_pos") if "image" in claims.columns else base


def write_bundle(tables: dict[str, DataFrame], folder: str) -> None:
    """One Parquet table per grain, and a manifest with the columns, row counts and a digest of each; tables that break a rule are refused."""
    spark = next(iter(tables.values())).sparkSession
    bundles.require_valid(tables)
    rows = []
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        (w.partitionBy("split") if "split" in df.columns else w).parquet(f"{folder}/{name}")
        rows.append((name, ",".join(df.columns), *_digest(spark.read.parquet(f"{folder}/{name}"))))
    spark.createDataFrame(rows, "name string, columns string, n long, digest string").coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")


def _digest(df: DataFrame) -> tuple[int, str]:
    """Row count and an order-free digest."""
    r = df.select(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)").alias("h")).agg(F.count(F.lit(1)), F.coalesce(F.sum("h"), F.lit(0).cast("decimal(38,0)"))).first()
    return int(r[0]), str(r[1])


def read_bundle(spark: SparkSession, folder: str, verify: bool = True) -> dict[str, DataFrame]:
    """The tables of a bundle.  With ``verify``, digests must match the manifest and no rule of ``bundles`` may be broken."""
    require_path(spark, f"{folder}/manifest", "manifest")
    out = {}
    for m in spark.read.json(f"{folder}/manifest").collect():  # a row per table
        df = spark.read.parquet(f"{folder}/{m['name']}")
        if verify and _digest(df) != (m["n"], m["digest"]):
            raise BundleError(f"{m['name']} does not match its manifest")
        out[m["name"]] = df
    if verify:
        bundles.require_valid(out)
    return out


def select_columns(df: DataFrame, names: list[str]) -> DataFrame:
    lacking = [n for n in names if n not in df.columns]
    if lacking:
        raise KeyError(lacking[0])
    return df.select(*names)


def export_without_targets(df: DataFrame, path: str) -> list[str]:
    """Writes gzipped CSV without target columns and says which were dropped."""
    dropped = [c for c in df.columns if c in TARGETS]
    df.drop(*dropped).write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)
    return dropped


def describe_bundle(tables: dict[str, DataFrame]) -> DataFrame:
    """table, split, n_rows, n_columns of a bundle's tables: a row per table and split."""
    out = None
    for name, df in sorted(tables.items()):
        by = F.col("split") if "split" in df.columns else F.lit(None).cast("string")
        part = df.groupBy(by.alias("split")).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table"), "split", "n_rows", F.lit(len(df.columns)).alias("n_columns"))
        out = part if out is None else out.unionByName(part)
    return out


def bundle_of(claims: DataFrame, responses: DataFrame, baselines: DataFrame, features: list[str]) -> dict[str, DataFrame]:
    """Tables of a bundle from scored evidence: claims with their features, responses with labels, baselines of known responses only."""
    known = responses.select("split", "response_id").distinct()
    return {
        "claims": claims.select("split", "response_idx", *features, "label", "is_score_train"),
        "responses": responses,
        "baselines": baselines.join(known, ["split", "response_id"], "left_semi").select("split", "method", "response_id", "score"),
    }


def write_reports(tables: dict[str, DataFrame], folder: str) -> None:
    """Small result tables, each as one CSV file, and a manifest of their columns, rows and digests."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        write_report(df, f"{folder}/{name}")
    rows = [(name, ",".join(df.columns), *_digest(spark.read.option("header", True).csv(f"{folder}/{name}"))) for name, df in tables.items()]
    spark.createDataFrame(rows, "name string, columns string, n long, digest string").coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")


def write_report(df: DataFrame, path: str) -> None:
    """A small result table as one CSV file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


_ABSOLUTE = re.compile(r"^(/|[A-Za-z]:[\\/]|\\\\)")


def is_absolute(text: object) -> bool:
    """POSIX, drive-letter and UNC paths."""
    return isinstance(text, str) and bool(_ABSOLUTE.match(text))


def relative(text: str, roots: list[str]) -> str:
    """The path below the longest root that holds it, else its last part; slashes run forward."""
    t = text.replace("\\", "/")
    for r in sorted((r.replace("\\", "/").rstrip("/") for r in roots), key=len, reverse=True):
        if t == r:
            return "."
        if t.startswith(r + "/"):
            return t[len(r) + 1 :]
    return t.rstrip("/").rsplit("/", 1)[-1]


def scrub(value, roots: list[str]):
    """A JSON value with absolute paths made relative; doing it twice changes nothing more."""
    if isinstance(value, dict):
        return {k: scrub(v, roots) for k, v in value.items()}
    if isinstance(value, list):
        return [scrub(v, roots) for v in value]
    return relative(value, roots) if is_absolute(value) else value


def scrub_file(path: str, roots: list[str] | None = None, check: bool = False) -> bool:
    """Rewrites a manifest; with ``check`` only says whether it would change."""
    with open(path, encoding="utf-8") as f:
        before = json.load(f)
    after = scrub(before, roots or [os.path.dirname(os.path.abspath(path))])
    if after != before and not check:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(after, f, indent=2, ensure_ascii=False)
    return after != before
