"""Text boxes of images in a stream: each image is read once, across micro-batches and restarts, until its entry expires.

The memo is keyed state: what a reader found in an image is kept with the query's checkpoint, so a restarted query knows it, and expires
``keep`` after it was written, so state does not grow with all images ever seen.  Rows are dealt by image; an image that very many rows
have can be dealt to ``salts`` tasks, each of which reads it once.

The state store must be RocksDB, without empty micro-batches (``prepare`` sets both for the session).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.features import BOX_TYPE

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: image -> [(text, score), ...]
ImageReader = Callable[[str], list[tuple[str, float]]]


def prepare(spark: SparkSession) -> None:
    """Settings of the session.  Entries expire when they are looked up, so no micro-batches without rows are needed: with them, a query that
    takes what is there and ends (``availableNow``) would never end."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")


class _ReadOnce(StatefulProcessor):
    """Rows of one image: the boxes come from state, or from the reader, which is loaded once a task and only if it is needed."""

    def __init__(self, load_reader: Callable[[], ImageReader], keep_ms: int):
        self.load_reader, self.keep_ms, self.reader = load_reader, keep_ms, None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("boxes", StructType([StructField("boxes", StringType())]), self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  (names that Spark calls)
        boxes = self.known.get()[0] if self.known.exists() else None
        for b in rows:
            if len(b) == 0:
                continue
            if boxes is None:
                image = key[0]
                if image is None or image != image:
                    boxes = "[]"
                else:
                    self.reader = self.reader or self.load_reader()
                    boxes = json.dumps([{"text": str(t), "score": float(s)} for t, s in self.reader(image) if t is not None])
                    self.known.update((boxes,))
            yield pd.DataFrame({"record": b["record"], "found": boxes})

    def close(self) -> None:
        pass


def read_images(rows: DataFrame, load_reader: Callable[[], ImageReader], keep: timedelta = timedelta(days=7), salts: int = 1) -> DataFrame:
    """Adds ``boxes`` to a stream by its column ``image``; all other columns pass through as they are.  A null image has no boxes."""
    if salts < 1:
        raise ValueError("salts must be at least 1")
    schema = rows.schema  # names inside begin with a letter: the frames that the processor gets rename others
    d = rows.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns)), {"ignoreNullFields": "false"}).alias("record"), F.col("image").cast("string").alias("memo_image"))
    d = d.withColumn("memo_salt", F.pmod(F.xxhash64("record"), F.lit(salts)))
    out = StructType([StructField("record", StringType()), StructField("found", StringType())])
    processor = _ReadOnce(load_reader, int(keep.total_seconds() * 1000))
    read = d.groupBy("memo_image", "memo_salt").transformWithStateInPandas(processor, out, "Append", "ProcessingTime")
    own = F.from_json("record", schema)
    return read.select(own.alias("r"), F.from_json("found", BOX_TYPE).alias("boxes")).select("r.*", "boxes")
