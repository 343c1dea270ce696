"""Images in a stream are read once, restarts included."""

from __future__ import annotations

import time
import uuid
from datetime import timedelta
from pathlib import Path

import pytest

from verisieve.streaming import reading, score

SCHEMA = "response_id long, image string, question string"


def loader(folder):
    def load():
        def read(image):
            (Path(folder) / uuid.uuid4().hex).write_text(image)
            return [(f"text of {image}", 0.5), (None, 1.0), (image.upper(), 1.0)]

        return read

    return load


def run(spark, tmp_path, name="a", **kw):
    out = []
    stream = reading.read_images(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), loader(str(tmp_path / "reads")), **kw)
    assert stream.columns == ["response_id", "image", "question", "boxes"]
    query = score.start(stream, lambda b, _: out.extend(b.collect()), str(tmp_path / f"checkpoint-{name}"), once=True)
    assert query.awaitTermination(120)
    assert query.exception() is None
    return out


@pytest.fixture
def store(spark):
    keys = ("spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.noDataMicroBatches.enabled", "spark.sql.shuffle.partitions")
    before = {k: spark.conf.get(k) for k in keys}
    reading.prepare(spark)
    spark.conf.set(keys[2], "2")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def put(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def test_each_image_is_read_once_across_batches_and_restarts(spark, tmp_path, store):
    (tmp_path / "reads").mkdir()
    put(spark, tmp_path, [(i, f"img{i % 3}", None if i == 4 else f'q "{i}"\n') for i in range(9)])
    put(spark, tmp_path, [(9 + i, f"img{i % 4}", "again") for i in range(8)] + [(50, None, "no image")])
    got = run(spark, tmp_path)
    put(spark, tmp_path, [(100 + i, f"img{i}", "later") for i in range(5)])
    later = run(spark, tmp_path)  # the query starts anew from its checkpoint
    assert sorted(r.response_id for r in got) == [*range(17), 50] and sorted(r.response_id for r in later) == [100, 101, 102, 103, 104]
    for r in [*got, *later]:
        want = [] if r.image is None else [(f"text of {r.image}", 0.5), (r.image.upper(), 1.0)]
        assert [tuple(b) for b in r.boxes] == want
        assert r.question == (None if r.response_id == 4 else f'q "{r.response_id}"\n' if r.response_id < 9 else r.question)
    reads = sorted(p.read_text() for p in (tmp_path / "reads").iterdir())
    assert reads == [f"img{i}" for i in range(5)]


def test_entries_expire(spark, tmp_path, store):
    (tmp_path / "reads").mkdir()
    put(spark, tmp_path, [(1, "img", "q")])
    run(spark, tmp_path, keep=timedelta(milliseconds=1))
    time.sleep(1.1)
    put(spark, tmp_path, [(2, "img", "q")])
    assert [r.response_id for r in run(spark, tmp_path, keep=timedelta(milliseconds=1))] == [2]
    assert len(list((tmp_path / "reads").iterdir())) == 2
    with pytest.raises(ValueError):
        reading.read_images(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), loader("x"), salts=0)
