"""Token ids in binary files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

Documents are tokenized once and their ids counted over the whole table; ids are then numbered by falling frequency, so the commonest 256
take one byte.  A rank takes one to four bytes; its length is a two-bit code.  A document's codes come first, four to a control byte, its
data bytes behind them, and a decoder looks a control byte's four lengths and places up in tables of 256 rows.

Layout of a folder: ``ranks.u32`` (ids by rank, little-endian, one entry for each id in use, so never longer than the vocabulary),
``part-*.vtok`` and ``manifest.json``.  A part file is ``MAGIC``, the documents' bytes back to back, and an index: keys (int64), a byte for
each key that is null, numbers of ids (int64), ends of the documents' bytes (int64), the number of documents, the place of the index and
``MAGIC`` again.  So each document can be read by itself, and a part can be cut anywhere between two documents.

Writing and reading are a Spark data source (``token_files``).  Each task writes a file under a name of its attempt; the manifest, written at
commit, names those of successful attempts in order, so lost executors leave nothing that is read.  Documents are range-partitioned by
(key, hash of the bytes): a key that many rows share is cut into several parts.  Files are opened by ``pyarrow.fs``, so the folder may be
on any store that it knows.

Defined cases: a null or empty text is the end id alone; documents come in ascending order of the key, null keys first; rows that share a
key come in the order of their bytes' hash and bytes, equal rows are separate; a very long text is one document; an empty table writes no
part and reads as no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import discard, materialize, partitions, shared_dir
from .packing import WordTokenizer

MAGIC = b"VSTOKEN1"
#: Bytes of documents that a task reads at a time, and that a read partition holds (a longer document is read whole).
SLICE, SPLIT = 1 << 20, 64 << 20
#: Documents that are coded together.
ROWS = 256

# tables by control byte: the lengths of its four numbers, where each starts, and all of them together
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1
STARTS = np.cumsum(LENGTHS, axis=1) - LENGTHS
TOTAL = LENGTHS.sum(axis=1)
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], dtype=np.uint32)


def encode(ranks: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Each document's control bytes and data bytes; ``ranks`` holds the documents' numbers one behind the other, ``counts`` how many each has."""
    ranks = np.ascontiguousarray(ranks, dtype="<u4")
    codes = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    quads = -(-counts // 4)
    ends = np.cumsum(quads)
    padded = np.zeros(4 * int(quads.sum()), dtype=np.uint8)
    padded[np.arange(len(ranks)) + np.repeat(4 * (ends - quads) - (np.cumsum(counts) - counts), counts)] = codes
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(axis=1, dtype=np.uint8).tobytes()
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) <= codes[:, None]].tobytes()
    sizes = np.concatenate([[0], np.cumsum(codes, dtype=np.int64) + np.arange(1, len(codes) + 1)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
    begins = [0, *ends.tolist()]
    return [control[begins[i] : begins[i + 1]] + data[sizes[i] : sizes[i + 1]] for i in range(len(counts))]


def decode(coded: bytes, begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of the documents that begin at ``begins`` in ``coded``, one document behind the other, as unsigned 32-bit."""
    raw = np.frombuffer(coded, dtype=np.uint8)
    quads = -(-counts // 4)
    ends = np.cumsum(quads)
    control = raw[np.arange(int(quads.sum())) + np.repeat(begins - (ends - quads), quads)]
    total = TOTAL[control]
    before = np.cumsum(total) - total
    first = np.concatenate([before, [0]])[np.minimum(ends - quads, len(before))]  # of a document's first control byte
    base = before + np.repeat(begins + quads - first, quads)
    inside = np.arange(4 * len(control)) - np.repeat(4 * (ends - quads), 4 * quads) < np.repeat(counts, 4 * quads)
    at = (base[:, None] + STARTS[control]).reshape(-1)[inside]
    padded = np.concatenate([raw, np.zeros(4, dtype=np.uint8)])
    word = padded[at].astype(np.uint32)
    for i in (1, 2, 3):
        word |= padded[at + i].astype(np.uint32) << np.uint32(8 * i)
    return word & MASKS[LENGTHS[control].reshape(-1)[inside]]


def _open(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def _write(path: str, data: bytes) -> None:
    fs, p = _open(path)
    fs.create_dir(p.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(p + ".new") as f:
        f.write(data)
    fs.move(p + ".new", p)


def _read(path: str) -> bytes:
    fs, p = _open(path)
    with fs.open_input_stream(p) as f:
        return f.read()


@dataclass
class Part(WriterCommitMessage):
    task: int
    name: str | None
    documents: int
    ids: int


class Writer(DataSourceArrowWriter):
    """Rows (key long, wide boolean, ids binary), already in order; the folder's ``ranks.u32`` numbers the ids."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        name = f"part-{task:06d}-{uuid.uuid4().hex}.vtok"
        keys, nulls, counts, ends, at, out = [], [], [], [], 0, None
        for b in iterator:
            if b.num_rows == 0:
                continue
            if out is None:
                ranked = np.frombuffer(_read(f"{self.path}/ranks.u32"), dtype="<u4")
                rank = np.zeros(int(ranked.max(initial=0)) + 1, dtype="<u4")
                rank[ranked] = np.arange(len(ranked))
                fs, p = _open(f"{self.path}/{name}")
                fs.create_dir(p.rsplit("/", 1)[0], recursive=True)
                out = fs.open_output_stream(p)
                out.write(MAGIC)
            key = b.column(b.schema.get_field_index("key"))
            for i in range(0, b.num_rows, ROWS):
                ids = list(_unpacked(b.slice(i, ROWS)))
                n = np.array([len(a) for a in ids])
                coded = encode(rank[np.concatenate(ids)], n)
                out.write(b"".join(coded))
                counts.append(n)
                ends.append(at + np.cumsum([len(c) for c in coded]))
                at = int(ends[-1][-1])
            keys.append(key.fill_null(0).to_numpy(zero_copy_only=False))
            nulls.append(key.is_null().to_numpy(zero_copy_only=False))
        if out is None:
            return Part(task, None, 0, 0)
        counts_ = np.concatenate(counts)
        for a, kind in ((keys, "<i8"), (nulls, "u1"), (counts, "<i8"), (ends, "<i8")):
            out.write(np.concatenate(a).astype(kind).tobytes())
        out.write(struct.pack("<QQ", len(counts_), len(MAGIC) + at) + MAGIC)
        out.close()
        return Part(task, name, len(counts_), int(counts_.sum()))

    def commit(self, messages: list[Part | None]) -> None:
        parts = sorted((m for m in messages if m is not None and m.name), key=lambda m: m.task)  # a row per task
        _write(f"{self.path}/manifest.json", json.dumps([[m.name, m.documents, m.ids] for m in parts]).encode())

    def abort(self, messages: list[Part | None]) -> None:
        for m in messages:
            if m is not None and m.name:
                fs, p = _open(f"{self.path}/{m.name}")
                fs.delete_file(p)


@dataclass
class Slice(InputPartition):
    name: str | None
    first: int
    last: int
    start: int


def part_index(f: pa.NativeFile) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """keys, nulls, counts and ends of a part file."""
    tail = struct.calcsize("<QQ") + len(MAGIC)
    f.seek(f.size() - tail)
    raw = f.read(tail)
    n, at = struct.unpack("<QQ", raw[:16])
    f.seek(0)
    if raw[16:] != MAGIC or f.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a token file")
    f.seek(at)
    raw, out, i = f.read(25 * n), [], 0
    for kind, width in (("<i8", 8), ("u1", 1), ("<i8", 8), ("<i8", 8)):
        out.append(np.frombuffer(raw, dtype=kind, count=n, offset=i))
        i += width * n
    return tuple(out)


class Reader(DataSourceReader):
    """Rows (key, start, n_tokens, ids); ids are little-endian unsigned 32-bit, as ``tokens`` unpacks them."""

    def __init__(self, path: str, schema: pa.Schema):
        self.path, self.schema = path, schema

    def partitions(self) -> list[Slice]:
        out, start = [], 0
        for name, _, ids in json.loads(_read(f"{self.path}/manifest.json")):
            fs, p = _open(f"{self.path}/{name}")
            size = fs.get_file_info(p).size
            pieces = -(-size // SPLIT)
            out += [Slice(name, i, pieces, start) for i in range(pieces)]
            start += ids
        return out or [Slice(None, 0, 1, 0)]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        if partition.name is None:
            return
        ids_of = np.frombuffer(_read(f"{self.path}/ranks.u32"), dtype="<u4")
        fs, p = _open(f"{self.path}/{partition.name}")
        with fs.open_input_file(p) as f:
            keys, nulls, counts, ends = part_index(f)
            starts = partition.start + np.cumsum(counts) - counts
            begins = np.concatenate([[0], ends[:-1]])
            # a slice holds the documents that begin in it
            lo, hi = np.searchsorted(begins, [partition.first * SPLIT, (partition.first + 1) * SPLIT])
            if partition.first + 1 == partition.last:
                hi = len(keys)
            while lo < hi:
                stop = min(hi, max(lo + 1, int(np.searchsorted(ends, begins[lo] + SLICE, side="right"))))
                f.seek(len(MAGIC) + int(begins[lo]))
                raw = f.read(int(ends[stop - 1] - begins[lo]))
                at = slice(lo, stop)
                flat = ids_of[decode(raw, begins[at] - begins[lo], counts[at])].tobytes()
                cuts = [0, *(4 * np.cumsum(counts[at])).tolist()]
                ids = [flat[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]
                columns = [pa.array(keys[at], pa.int64(), mask=nulls[at].astype(bool)), pa.array(starts[at], pa.int64()), pa.array(counts[at], pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema=self.schema)
                lo = stop


class TokenFiles(DataSource):
    """``spark.read.format("token_files").load(folder)`` and the write side that ``write_ids`` uses."""

    @classmethod
    def name(cls) -> str:
        return "token_files"

    def schema(self) -> str:
        return "key long, start long, n_tokens long, ids binary"

    def reader(self, schema) -> Reader:
        names = [("key", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())]
        return Reader(self.options["path"], pa.schema(names))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"])


def tokens(ids):
    """The ids of a row as array<long>."""
    from pyspark.sql.functions import pandas_udf

    return pandas_udf(lambda s: s.map(lambda b: np.frombuffer(b, dtype="<u4").astype(np.int64)), "array<long>")(ids)


def _unpacked(b: pa.RecordBatch) -> Iterator[np.ndarray]:
    for wide, ids in zip(b.column(b.schema.get_field_index("wide")), b.column(b.schema.get_field_index("ids")), strict=True):
        yield np.frombuffer(ids.as_buffer(), dtype="<u4" if wide.as_py() else "<u2")


_IDS = "key long, wide boolean, ids binary, id long, n long"
_ARROW = pa.schema([("key", pa.int64()), ("wide", pa.bool_()), ("ids", pa.binary()), ("id", pa.int64()), ("n", pa.int64())])


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, key: str, text: str) -> DataFrame:
    """key, wide, ids of the documents (two bytes an id while all ids fit them, else four); and rows (id, n) with each task's counts of ids.

    No shuffle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordTokenizer(tokenizer)
        kind = "<u2" if max(coder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
        end = np.asarray([end_id], dtype="<u4").tobytes()
        n = np.zeros(0, dtype=np.int64)
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                part = b.slice(i, ROWS)
                coded = [coder.encode(t.as_py() or "") + end for t in part.column(1)]
                flat = np.frombuffer(b"".join(coded), dtype="<u4")
                c = np.bincount(flat, minlength=len(n))
                c[: len(n)] += n
                n = c
                data, width = flat.astype(kind).tobytes(), 2 if kind == "<u2" else 4
                offsets = np.concatenate([[0], np.cumsum([len(x) // 4 * width for x in coded])]).tolist()
                ids = pa.array([data[x:y] for x, y in zip(offsets, offsets[1:], strict=False)], pa.binary())
                none = pa.nulls(part.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([width == 4] * part.num_rows), ids, none, none], schema=_ARROW)
        used = np.flatnonzero(n)
        none = [pa.nulls(len(used), t) for t in _ARROW.types[:3]]
        yield pa.RecordBatch.from_arrays([*none, pa.array(used, pa.int64()), pa.array(n[used], pa.int64())], schema=_ARROW)

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, _IDS)


def write_ids(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2, key: str = "doc_id", text: str = "text") -> None:
    """Writes the documents' ids to ``folder``, a new one."""
    spark = docs.sparkSession
    held = materialize(tokenized(docs, tokenizer, end_id, key, text), compression="zstd")
    by_rank = held.where("id is not null").groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "id").select("id").toArrow()  # the vocabulary at most
    _write(f"{folder}/ranks.u32", by_rank.column(0).to_numpy().astype("<u4").tobytes())
    order = ["key", F.xxhash64("ids")]  # without the ids: the driver samples what ranges are cut by
    ids = held.where("id is null").select("key", "wide", "ids")
    out = ids.repartitionByRange(partitions(spark) * 2, *order).sortWithinPartitions(*order, "ids")
    spark.dataSource.register(TokenFiles)
    out.write.format("token_files").mode("append").save(folder)
    discard(held)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """key, start (ids of all documents before it), n_tokens, ids."""
    spark.dataSource.register(TokenFiles)
    return spark.read.format("token_files").load(folder)


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/verisieve/{uuid.uuid4().hex}.tokens"
