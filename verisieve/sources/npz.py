"""Arrays in ``.npz`` containers as a Spark data source, and the import of an evidence bundle that was written so.

``spark.read.format("npz").option("member", "dev_matrix").load(path)`` gives ``row`` and ``value``: a scalar for a vector, an array for a matrix.
A member that is stored uncompressed is cut into slices of rows, each read by its own task from its own place in the file; a deflated
one has no places to begin at and is read as one stream, in batches.  Arrays of objects are refused before anything is read: they would need unpickling.

Files are opened by ``pyarrow.fs``.
"""

from __future__ import annotations

import json
import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .bundles import BundleError
from .digests import digest, open_file

#: Bytes of a slice, and of a batch within it.
SLICE, BATCH = 32 << 20, 1 << 20

#: The arrays that a bundle must hold (fixed names of the format).
SPLIT_ARRAYS = ("matrix", "claim_response_index", "response_ids", "response_y", "response_images", "mvr")
REQUIRED = (
    *(f"{split}_{name}" for split in ("dev", "test") for name in SPLIT_ARRAYS),
    "dev_claim_labels", "dev_claim_train_mask", "lm_names", "mechanical_names", "mvr_names", "baseline_names", "baseline_dev", "baseline_test", "seed",
)


@dataclass
class Header:
    """Where a member's numbers are: type, shape, place of the first byte in the file (None if the member is deflated)."""

    dtype: np.dtype
    shape: tuple[int, ...]
    start: int | None
    name: str

    @property
    def rows(self) -> int:
        return self.shape[0] if self.shape else 1

    @property
    def width(self) -> int:
        """Numbers of a row."""
        return int(np.prod(self.shape[1:], dtype=np.int64)) if len(self.shape) > 1 else 1

    @property
    def kind(self) -> str:
        kinds = {"b": "boolean", "i": "long", "u": "long", "f": "double", "U": "string", "S": "string"}
        if self.dtype.kind not in kinds:
            raise BundleError(f"{self.name} holds {'objects, which would need unpickling' if self.dtype.hasobject else f'values of type {self.dtype}'}")
        one = kinds[self.dtype.kind]
        return one if len(self.shape) < 2 else f"array<{one}>"


def header(f: pa.NativeFile, member: str) -> Header:
    with zipfile.ZipFile(f) as z:
        name = member if member in z.namelist() else f"{member}.npy"
        if name not in z.namelist():
            raise BundleError(f"the container holds no array {member}")
        info = z.getinfo(name)
        with z.open(name) as m:
            version = np.lib.format.read_magic(m)
            read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
            shape, fortran, dtype = read(m)
            inner = m.tell()
        if fortran and len(shape) > 1:
            raise BundleError(f"{member} is stored by columns")
    start = None
    if info.compress_type == zipfile.ZIP_STORED:
        f.seek(info.header_offset + 26)
        name_size, extra_size = struct.unpack("<HH", f.read(4))
        start = info.header_offset + 30 + name_size + extra_size + inner
    return Header(dtype, shape, start, member)


def members(path: str) -> list[str]:
    with open_file(path) as f, zipfile.ZipFile(f) as z:
        return [n.removesuffix(".npy") for n in z.namelist()]


def _values(raw: bytes, h: Header) -> pa.Array:
    a = np.frombuffer(raw, dtype=h.dtype)
    if h.dtype.kind in "iub":
        a = a.astype(bool if h.dtype.kind == "b" else np.int64)
    elif h.dtype.kind == "f":
        a = a.astype(np.float64)
    elif h.dtype.kind == "S":
        a = np.char.decode(a, "utf-8")
    flat = pa.array(a.tolist() if h.dtype.kind in "US" else a)
    if len(h.shape) < 2:
        return flat
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(a) + 1, h.width, dtype=np.int32) if h.width else np.zeros(1, dtype=np.int32)), flat)


@dataclass
class Rows(InputPartition):
    first: int
    last: int


class Reader(DataSourceReader):
    def __init__(self, path: str, member: str, slice_bytes: int):
        self.path, self.member, self.slice_bytes = path, member, slice_bytes

    def partitions(self) -> list[Rows]:
        with open_file(self.path) as f:
            h = header(f, self.member)
        if h.start is None:
            return [Rows(0, h.rows)]
        step = max(1, self.slice_bytes // max(1, h.dtype.itemsize * h.width))
        return [Rows(i, min(h.rows, i + step)) for i in range(0, h.rows, step)] or [Rows(0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        with open_file(self.path) as f:
            h = header(f, self.member)
            size = h.dtype.itemsize * h.width
            step = max(1, BATCH // max(1, size))
            stream = None
            if h.start is None:
                stream = zipfile.ZipFile(f).open(self.member if self.member.endswith(".npy") else f"{self.member}.npy")
                version = np.lib.format.read_magic(stream)
                (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(stream)
            else:
                f.seek(h.start + partition.first * size)
            for i in range(partition.first, partition.last, step):
                j = min(partition.last, i + step)
                raw = (stream or f).read((j - i) * size)
                if len(raw) != (j - i) * size:
                    raise BundleError(f"{self.member} ends too early")
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, j)), _values(raw, h)], ["row", "value"])


class NpzSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        with open_file(self.options["path"]) as f:
            return f"row long, value {header(f, self.options['member']).kind}"

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], self.options["member"], int(self.options.get("slice_bytes", SLICE)))


def read_array(spark: SparkSession, path: str, member: str, slice_bytes: int = SLICE) -> DataFrame:
    """row, value of an array."""
    spark.dataSource.register(NpzSource)
    return spark.read.format("npz").option("member", member).option("slice_bytes", slice_bytes).load(path)


def _few(spark: SparkSession, path: str, member: str) -> list:
    """A short array of names."""
    return [r.value for r in read_array(spark, path, member).orderBy("row").collect()]


def _beside(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Arrays of one length side by side, joined by row."""
    for o in others:
        first = first.join(o, "row", "left")
    return first


def import_bundle(spark: SparkSession, path: str, manifest: str) -> dict[str, DataFrame]:
    """claims, responses and baselines of a container, by its names of columns; nothing is read before the hash in the manifest matches.

    The result has the tables of ``bundles``: write it with ``write_bundle``, which holds it against the rules.
    """
    with open_file(manifest) as f:
        expected = json.loads(f.read()).get("bundle_sha256")
    if expected and digest(path) != expected:
        raise BundleError(f"{path} does not match the hash in its manifest")
    lacking = sorted(set(REQUIRED) - set(members(path)))
    if lacking:
        raise BundleError(f"{path} lacks the arrays {', '.join(lacking)}")
    array = lambda name, alias: read_array(spark, path, name).select("row", F.col("value").alias(alias))
    names = {n: [str(x) for x in _few(spark, path, f"{n}_names")] for n in ("lm", "mechanical", "mvr", "baseline")}
    features = [*names["lm"], *names["mechanical"]]
    _same_lengths(path, len(features), len(names["mvr"]), len(names["baseline"]))
    claims, responses, baselines = [], [], []
    for split in ("dev", "test"):
        columns = [F.col("m")[i].alias(n) for i, n in enumerate(features)]
        c = _beside(array(f"{split}_matrix", "m"), array(f"{split}_claim_response_index", "response_idx"))
        if split == "dev":
            c = _beside(c, array("dev_claim_labels", "label"), array("dev_claim_train_mask", "is_score_train"))
        else:
            c = c.withColumns({"label": F.lit(None).cast("long"), "is_score_train": F.lit(None).cast("boolean")})
        claims.append(c.select(F.lit(split).alias("split"), "response_idx", *columns, F.col("label").cast("long"), F.col("is_score_train").cast("boolean")))
        r = _beside(array(f"{split}_response_ids", "response_id"), array(f"{split}_response_images", "image"), array(f"{split}_response_y", "y"), array(f"{split}_mvr", "v"))
        told = [F.col("v")[i].alias(n) for i, n in enumerate(names["mvr"])]
        responses.append(r.select(F.lit(split).alias("split"), F.col("row").alias("response_idx"), F.col("response_id").cast("string"), F.col("image").cast("string"), F.col("y").cast("long"), *told))
        b = array(f"baseline_{split}", "s").select(F.col("row").alias("m"), F.posexplode("s").alias("at", "score"))
        b = b.withColumn("method", F.element_at(F.array(*(F.lit(n) for n in names["baseline"])), (F.col("m") + 1).cast("int")))
        ids = array(f"{split}_response_ids", "response_id").withColumnRenamed("row", "at")
        baselines.append(b.join(ids, "at").select(F.lit(split).alias("split"), "method", F.col("response_id").cast("string"), "score"))
    return {n: a.unionByName(b) for n, (a, b) in {"claims": claims, "responses": responses, "baselines": baselines}.items()}


def _same_lengths(path: str, features: int, mvr: int, baselines: int) -> None:
    """Shapes that must agree, from the headers alone."""
    with open_file(path) as f:
        of = {n: header(f, n).shape for n in REQUIRED}
    for split in ("dev", "test"):
        claims, responses = of[f"{split}_matrix"][0], of[f"{split}_response_y"][0]
        want = {f"{split}_matrix": (claims, features), f"{split}_claim_response_index": (claims,), f"{split}_mvr": (responses, mvr), f"{split}_response_ids": (responses,), f"{split}_response_images": (responses,), f"baseline_{split}": (baselines, responses)}
        if split == "dev":
            want |= {"dev_claim_labels": (claims,), "dev_claim_train_mask": (claims,)}
        for name, shape in want.items():
            if of[name] != shape:
                raise BundleError(f"{name} has shape {of[name]}, not {shape}")
