"""A durable memo of costly answers: what a model or a reader said is written once and never asked again.

``Memo.get`` looks wanted keys up in a table in the shared folder, computes only those that are not there, appends them, and reads all of
them back.  Spark commits an append as a whole, so a run that dies leaves nothing half-written; with ``rounds`` above 1 the missing keys are
computed and committed part by part, and a later run goes on behind the last part.  Whoever reads the result reads the table: a plan that is
evaluated twice, or a lost executor, asks nothing again.

Within a round the keys are dealt to tasks by image and hash and sorted, so prompts of an image come together and a task that is run again meets the same rows in the same order, with
the same number of its own: a model that is seeded by ``task_seed`` answers as before.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: model(image, prompts, sample) -> [(text, mean token probability), ...]
Model = Callable[[str, list[str], bool], list[tuple[str, float]]]

#: Parts into which the prompts of an image that very many rows have are dealt.
SALTS = 16
REPLY = "key string, text string, confidence double"


class Memo:
    """Answers by a string ``key``, in Parquet parts below ``folder``."""

    def __init__(self, folder: str, schema: str, rounds: int = 1):
        if rounds < 1:
            raise ValueError("rounds must be at least 1")
        self.folder, self.schema, self.rounds = folder, schema, rounds

    def known(self, spark: SparkSession) -> DataFrame:
        p = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(self.folder)

    def get(self, wanted: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Answers for the distinct keys of ``wanted`` (``key`` and what ``compute`` needs)."""
        spark = wanted.sparkSession
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        for i in range(self.rounds):
            part = wanted.where(F.pmod(F.xxhash64("key"), F.lit(self.rounds)) == i) if self.rounds > 1 else wanted
            missing = part.dropDuplicates(["key"]).join(self.known(spark).select("key"), "key", "left_anti")
            by = ["image"] if "image" in missing.columns else []
            dealt = missing.repartition(tasks, *by, F.pmod(F.xxhash64("key"), F.lit(SALTS))).sortWithinPartitions(*by, "key")
            compute(dealt).write.mode("append").parquet(self.folder)
        return self.known(spark).join(wanted.select("key").distinct(), "key", "left_semi")


def task_seed(seed: int) -> int:
    """The seed of this task: the same whenever it is run again."""
    from pyspark import TaskContext

    context = TaskContext.get()
    return seed + (context.partitionId() if context else 0)


def asked(load_model: Callable[..., Model], seed: int = 0, profile: ResourceProfile | None = None) -> Callable[[DataFrame], DataFrame]:
    """Runs a model over rows (key, image, prompt, sample): loaded once a task, prompts of one image and kind in one call.

    ``load_model`` takes the task's seed if it has a parameter for it.  ``profile`` asks the cluster for what the stage needs (GPUs, memory).
    """
    seeded = len(inspect.signature(load_model).parameters) > 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for b in batches:
            if len(b) == 0:
                continue
            if model is None:
                model = load_model(task_seed(seed)) if seeded else load_model()
            text, sure = [None] * len(b), [0.0] * len(b)
            for (image, sample), rows in b.groupby(["image", "sample"], sort=False, dropna=False).indices.items():
                image = None if image is None or image != image else image
                got = model(image, list(b["prompt"].iloc[rows]), bool(sample))
                if len(got) != len(rows):
                    raise ValueError(f"the model gave {len(got)} replies to {len(rows)} prompts")
                for i, (t, c) in zip(rows, got, strict=True):
                    text[i], sure[i] = str(t), float(c)
            yield pd.DataFrame({"key": b["key"], "text": text, "confidence": sure})

    return lambda rows: rows.select("key", "image", "prompt", "sample").mapInPandas(run, REPLY, profile=profile)
