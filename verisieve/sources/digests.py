"""SHA-256 of files, streamed on executors: a row per file, and never a file in a row."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession

#: Bytes read at a time (the bound of a task's memory).
CHUNK = 1 << 20


def open_file(path: str) -> pa.NativeFile:
    """A file that can be sought, on any store that ``pyarrow.fs`` knows."""
    path = unquote(path) if path.startswith("file:") else path  # Hadoop writes local names as addresses
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    fs, p = pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    return fs.open_input_file(p)


def digest(path: str, chunk: int = CHUNK) -> str:
    h = hashlib.sha256()
    with open_file(path) as f:
        while block := f.read(chunk):
            h.update(block)
    return h.hexdigest()


def sha256(spark: SparkSession, path: str, tasks: int | None = None) -> DataFrame:
    """path, length, sha256 of each file under ``path``, empty ones too.

    Spark lists the files (its index of a read holds their names, not their contents) and they are dealt to tasks; a digest is sequential,
    so a file is one task's work.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.column(0).to_pylist():
                with open_file(p) as f:
                    n = f.size()
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([n]), pa.array([digest(p)])], ["path", "length", "sha256"])

    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).inputFiles()
    dealt = spark.createDataFrame([(n,) for n in names], "path string").repartition(tasks or spark.sparkContext.defaultParallelism)
    return dealt.mapInArrow(run, "path string, length long, sha256 string")
