"""Token files: the coding, round trips against the tokenizers library, order, nulls, repeats, the empty table and lost attempts."""

from __future__ import annotations

import json
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verisieve.llm import token_files as tf
from verisieve.llm.queries import tokenizer_file

FILE = "byte_bpe_50k.json"


NUMBER = st.one_of(st.integers(0, 300), st.integers(65530, 65540), st.integers(2**24 - 2, 2**24 + 2), st.integers(0, 2**32 - 1))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(NUMBER, max_size=20), max_size=9), st.integers(0, 5))
def test_coding_round_trip(documents, junk):
    counts = np.array([len(d) for d in documents], dtype=np.int64)
    coded = tf.encode(np.array([x for d in documents for x in d], dtype="<u4"), counts)
    for d, c in zip(documents, coded, strict=True):
        assert len(c) == -(-len(d) // 4) + sum(1 + (x > 0xFF) + (x > 0xFFFF) + (x > 0xFFFFFF) for x in d)
    raw = b"\xff" * junk + b"".join(coded)
    begins = junk + np.cumsum([0, *(len(c) for c in coded)], dtype=np.int64)[:-1]
    assert tf.decode(raw, begins, counts).tolist() == [x for d in documents for x in d]


def plain(rows):
    """(doc_id, ids) in ascending order of doc_id, nulls first, by the tokenizers library on whole texts."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file(FILE))
    ids = [(r[0], [*t.encode(r[1] or "", add_special_tokens=False).ids, 2]) for r in rows]
    return sorted(ids, key=lambda r: (r[0] is not None, r[0] or 0))


def write(spark, docs):
    folder = tf.new_folder(spark)
    tf.write_ids(docs, tokenizer_file(FILE), folder)
    return folder


def test_files_hold_what_the_library_gives(spark, docs, rows):
    got = tf.read_ids(spark, write(spark, docs)).orderBy("start").collect()
    want = plain(rows)
    assert [r.key for r in got] == [k for k, _ in want]
    start, seen = 0, []
    for r in got:
        ids = np.frombuffer(bytes(r.ids), dtype="<u4")
        assert (r.start, r.n_tokens) == (start, len(ids))
        start += len(ids)
        seen.append((r.key, ids.tolist()))
    assert sorted(seen) == sorted(want)


def test_ranks_fall_with_frequency(spark, docs, rows):
    folder = write(spark, docs)
    ranks = np.frombuffer(tf._read(f"{folder}/ranks.u32"), dtype="<u4")
    n = np.bincount(np.concatenate([ids for _, ids in plain(rows)]))
    assert sorted(ranks.tolist()) == np.flatnonzero(n).tolist()
    assert all(n[a] > n[b] or (n[a] == n[b] and a < b) for a, b in zip(ranks, ranks[1:], strict=False))


def test_null_keys_and_a_hot_key(spark):
    rows = [(None, "b a"), (None, None), *((7, f"text {i}") for i in range(60)), (3, "x <|endoftext|> y"), (3, ""), (8, "end")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("other"))
    folder = write(spark, d)
    got = tf.read_ids(spark, folder).orderBy("start").collect()
    assert [r.key for r in got] == [None] * 2 + [3] * 2 + [7] * 60 + [8]
    assert sorted(np.frombuffer(bytes(r.ids), "<u4").tolist() for r in got) == sorted(i for _, i in plain(rows))
    parts = [p for p in json.loads(tf._read(f"{folder}/manifest.json"))]
    assert len(parts) > 1 and max(p[1] for p in parts) < 60  # the hot key is in several parts


def test_slices_cut_between_documents(spark, docs, rows, monkeypatch):
    folder = write(spark, docs)
    reader = tf.TokenFiles({"path": folder}).reader(None)
    whole = [b for p in reader.partitions() for b in reader.read(p)]
    monkeypatch.setattr(tf, "SPLIT", 997)
    monkeypatch.setattr(tf, "SLICE", 301)
    cut = [b for p in reader.partitions() for b in reader.read(p)]
    assert len(reader.partitions()) > 20
    rows_of = lambda bs: [r for b in bs for r in b.to_pylist()]
    assert rows_of(cut) == rows_of(whole) and len(rows_of(cut)) == len(rows)


def test_empty_table(spark, empty):
    assert tf.read_ids(spark, write(spark, empty)).collect() == []


def test_parts_of_failed_attempts_are_not_read(spark, docs, rows):
    folder = write(spark, docs)
    name = json.loads(tf._read(f"{folder}/manifest.json"))[0][0]
    tf._write(f"{folder}/part-000000-lost.vtok", tf._read(f"{folder}/{name}"))
    assert tf.read_ids(spark, folder).count() == len(rows)


def test_a_file_of_another_kind_is_refused(spark, docs):
    folder = write(spark, docs)
    name = json.loads(tf._read(f"{folder}/manifest.json"))[0][0]
    tf._write(f"{folder}/{name}", b"not such a file, but long enough to look for its index")
    with pytest.raises(Exception, match="not a token file"):
        tf.read_ids(spark, folder).count()


def test_tokens_and_crc(spark, docs):
    d = tf.read_ids(spark, write(spark, docs)).select("ids", tf.tokens("ids").alias("t"), F.crc32("ids").alias("c"))
    for r in d.collect():
        assert zlib.crc32(np.array(r.t, dtype="<u4").tobytes()) == r.c


def test_ranges_are_cut_without_the_ids(spark, docs, monkeypatch):
    """What ranges are cut by is sampled to the driver: keys and hashes, never documents."""
    from pyspark.sql.classic.dataframe import DataFrame

    asked, own = [], DataFrame.repartitionByRange
    monkeypatch.setattr(DataFrame, "repartitionByRange", lambda self, n, *cols: asked.append((self, cols)) or own(self, n, *cols))
    write(spark, docs)
    assert asked and all("binary" not in dict(df.select(*cols).dtypes).values() for df, cols in asked)
