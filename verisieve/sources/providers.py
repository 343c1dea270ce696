"""Evidence providers: where views, direct checks, text boxes and resampled answers come from.

A provider maps DataFrames to DataFrames.  ``MockProvider`` is deterministic and built of Column expressions.  ``ModelProvider`` runs a
vision-language model through ``mapInPandas``: the model loads once per task, prompts of an image are asked together, and every reply is
written once (``replies.Memo``), so no plan that is evaluated again and no lost executor asks a second time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.resource import ResourceProfile
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.durable import shared_dir
from ..functions.scalars import clip, hash01
from ..functions.similarity import containment_similarity
from ..functions.text import ALIGN_STOPWORDS, find_all, once, parse_support
from ..operators.decompose import check_prompt
from ..operators.features import BOX_TYPE, VIEWS
from .replies import REPLY, Memo, Model, asked

DIRECT_TYPE = "struct<support:double,contradiction:double,evidence_present:double,uncertainty:double,ocr_read_support:double,number_check_support:double,visual_evidence_support:double,evidence_phrase:string>"


#: Kinds that the name of a provider's class tells (fixed values).
NAMED_KINDS = ("mock", "llava", "rapidocr")


def kind_of(provider: object | None) -> str:
    """Where a scorer's evidence came from: ``none`` without a provider, else the ``kind`` that it declares, else a known kind in the name of its
    class, else ``custom``.  Providers of one's own need not derive from ``EvidenceProvider``."""
    if provider is None:
        return "none"
    declared = getattr(provider, "kind", None)
    if declared and isinstance(declared, str):
        return declared
    return next((k for k in NAMED_KINDS if k in type(provider).__name__.lower()), "custom")


class EvidenceProvider:
    """Adds evidence columns; claims have question, answer, image, claim_text, claim_type."""

    #: Says whether evidence is real or a stand-in; see ``kind_of``.
    kind: str | None = None

    def boxes(self, responses: DataFrame) -> DataFrame:
        """Adds ``boxes`` by ``image``."""
        raise NotImplementedError

    def evidence(self, claims: DataFrame) -> DataFrame:
        """Adds ``views`` and ``direct``."""
        raise NotImplementedError

    def samples(self, responses: DataFrame, k: int) -> DataFrame:
        """Adds ``samples``."""
        raise NotImplementedError

    def completions(self, responses: DataFrame) -> DataFrame:
        """Adds ``completion``, a model's claim list as text, or NULL."""
        return responses.withColumn("completion", F.lit(None).cast("string"))


def _words(x: Column) -> Column:
    return F.filter(F.array_distinct(find_all(F.lower(F.coalesce(x, F.lit(""))), "[a-z0-9]+")), lambda w: ~w.isin(ALIGN_STOPWORDS))


class MockProvider(EvidenceProvider):
    kind = "mock"

    def __init__(self, name: str = "mock", image_text: str | None = None, pool: list[str] | None = None):
        self.name, self.image_text, self.pool = name, image_text, pool

    def boxes(self, responses: DataFrame) -> DataFrame:
        """Parts of the image's text (the image name, unless one text is set), cut at semicolons and newlines."""
        text = F.lit(self.image_text) if self.image_text else F.coalesce(F.col("image"), F.lit(""))
        parts = F.filter(F.transform(F.split(text, r"[;\n]"), lambda p: F.trim(p)), lambda p: p != "")
        return responses.withColumn("boxes", F.transform(parts, lambda p: F.struct(p.alias("text"), F.lit(1.0).alias("score"))).cast(BOX_TYPE))

    def evidence(self, claims: DataFrame) -> DataFrame:
        q, a, c, t = (F.coalesce(F.col(x), F.lit("")) for x in ("question", "answer", "claim_text", "claim_type"))
        d = claims.withColumn("__own", _words(c))
        own, overlap, hit = F.col("__own"), F.col("__overlap"), F.col("__hit")
        n = F.greatest(F.size(own), F.lit(1))
        joined = F.lower(F.array_join(F.col("boxes.text"), " "))
        found = once(joined, lambda j: F.size(F.filter(own, lambda w: j.contains(w))))
        # own words are distinct and hold no stop words: those that the answer has between other signs are counted
        spaced = F.concat(F.lit(" "), F.regexp_replace(F.lower(a), "[^a-z0-9]+", " "), F.lit(" "))
        shared = once(spaced, lambda s: F.size(F.filter(own, lambda w: s.contains(F.concat(F.lit(" "), w, F.lit(" "))))))
        d = d.withColumns({"__overlap": shared / n, "__hit": found / n})

        def view(name: str) -> Column:
            j = hash01(F.lit(self.name), F.lit(name), q, a, c)
            s = lambda j: clip(F.lit(0.35) + 0.5 * overlap + 0.15 * (j - 0.5))
            full = lambda j, s: F.struct(F.lit(name).alias("view"), s.alias("support"), clip(F.lit(0.6) + 0.3 * (j - 0.5)).alias("confidence"), a.alias("evidence"), clip(1.0 - s).alias("uncertainty"))
            return once(j, lambda j: once(s(j), lambda s: full(j, s)))

        s = clip(F.lit(0.25) + 0.6 * hit + 0.15 * (hash01(F.lit(self.name), F.lit("direct"), t, c) - 0.5))
        check = once(s, lambda s: F.struct(
            s.alias("support"), clip(F.lit(0.55) - 0.5 * hit).alias("contradiction"), F.when(F.size("boxes") > 0, 1.0).otherwise(0.0).alias("evidence_present"), clip(1.0 - s).alias("uncertainty"),
            hit.alias("ocr_read_support"), hit.alias("number_check_support"), clip(F.lit(0.3) + 0.5 * hit).alias("visual_evidence_support"), F.array_join(F.slice(F.col("boxes.text"), 1, 2), " ").alias("evidence_phrase"),
        ))
        return d.withColumns({"views": F.array(*(view(v) for v in VIEWS)), "direct": check.cast(DIRECT_TYPE)}).drop("__own", "__overlap", "__hit")

    def samples(self, responses: DataFrame, k: int) -> DataFrame:
        if k < 1:
            raise ValueError("k must be at least 1")
        if self.pool:
            return responses.withColumn("samples", F.array(*(F.lit(x) for x in [*self.pool, *[self.pool[-1]] * k][:k])))
        return responses.withColumn("samples", F.array_repeat(F.coalesce(F.col("question"), F.lit("")), k))


class ModelProvider(EvidenceProvider):
    """``load_model`` and ``load_reader`` are called once per task and return a ``Model`` and an image reader (image -> [(text, score)]).

    ``load_model`` may take a seed; it gets ``seed`` plus the number of its task.  Replies are kept below ``store`` (default: a folder in the shared
    one, for this provider's life); with a ``store`` of one's own a run that died goes on where it was, after the last of ``rounds`` commits.
    ``profile`` is the resource profile of the stages that ask.
    """

    kind = "model"

    def __init__(
        self, load_model: Callable[..., Model], load_reader: Callable[[], Callable[[str], list[tuple[str, float]]]] | None = None,
        store: str | None = None, seed: int = 0, rounds: int = 1, profile: ResourceProfile | None = None,
    ):
        self.load_model, self.load_reader, self.store = load_model, load_reader, store
        self.seed, self.rounds, self.profile = seed, rounds, profile

    def memo(self, spark: SparkSession, name: str, schema: str) -> Memo:
        if self.store is None:
            self.store = f"{shared_dir(spark)}/verisieve/{uuid.uuid4().hex}.replies"
        return Memo(f"{self.store}/{name}", schema, self.rounds)

    def boxes(self, responses: DataFrame) -> DataFrame:
        """Each distinct image is read once."""
        if self.load_reader is None:
            return responses.withColumn("boxes", F.array().cast(BOX_TYPE))
        load = self.load_reader

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            read = None
            for b in batches:
                read = read or load()
                found = [[{"text": str(t), "score": float(s)} for t, s in read(i) if t is not None] for i in b["key"]]
                yield pd.DataFrame({"key": b["key"], "boxes": found})

        schema = f"key string, boxes {BOX_TYPE}"
        images = responses.select(F.col("image").alias("key")).where("key is not null")
        seen = self.memo(responses.sparkSession, "images", schema).get(images, lambda d: d.mapInPandas(run, schema, profile=self.profile))
        return responses.join(seen.withColumnRenamed("key", "image"), "image", "left").withColumn("boxes", F.coalesce("boxes", F.array().cast(BOX_TYPE)))

    def ask(self, df: DataFrame, prompts: Column, sample: bool = False) -> DataFrame:
        """Adds ``replies``: array of (text, confidence) for an array of prompts.

        A prompt about an image is asked once, whatever rows have it; a sampled one once for each row's ids and place.
        """
        ids = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("response_id", "claim_pos") if c in df.columns] if sample else []
        image = F.coalesce(F.col("image").cast("string"), F.lit("\0"))
        d = df.withColumn("__prompts", prompts)
        key = lambda p, n: F.sha2(F.concat_ws("\x1f", image, p, *([*ids, n.cast("string")] if sample else [])), 256)
        d = d.withColumn("__keys", F.transform("__prompts", key))
        one = F.explode(F.arrays_zip("__keys", "__prompts")).alias("x")
        wanted = d.select("image", one).select(F.col("x.__keys").alias("key"), "image", F.col("x.__prompts").alias("prompt"), F.lit(sample).alias("sample"))
        got = self.memo(df.sparkSession, "samples" if sample else "replies", REPLY).get(wanted, asked(self.load_model, self.seed, self.profile))
        row = F.sha2(F.concat_ws("", "__keys"), 256)
        long = d.select(row.alias("__row"), "__keys").dropDuplicates(["__row"]).select("__row", F.posexplode("__keys").alias("n", "key"))
        told = long.join(got, "key").groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("n", "text", "confidence"))).alias("r"))
        told = told.select("__row", F.transform("r", lambda x: F.struct(x.text.alias("text"), x.confidence.alias("confidence"))).alias("replies"))
        return d.withColumn("__row", row).join(told, "__row", "left").drop("__row", "__keys", "__prompts")

    def evidence(self, claims: DataFrame) -> DataFrame:
        q, c = F.col("question"), F.col("claim_text")
        about = lambda head: F.concat(F.lit(head), F.coalesce(q, F.lit("")))
        prompts = F.array(
            about("Answer from the image in a short phrase. "),
            about("Say in a short phrase what the image shows that answers this. "),
            about("Without relying on any earlier answer, reply in a short phrase. "),
            F.concat(F.lit("Does the image support this? Reply yes or no. "), c),
            check_prompt(c, F.col("claim_type")),
            F.lit("Write down all text that is visible in the image."),
            F.concat(F.lit("Are the numbers in this right for the image? Reply yes or no. "), c),
        )
        d = self.ask(claims, prompts)
        r = lambda i: F.element_at("replies", i)
        seen = lambda i, name: F.struct(F.lit(name).alias("view"), containment_similarity(r(i).text, c).alias("support"), r(i).confidence.alias("confidence"), r(i).text.alias("evidence"), (1.0 - containment_similarity(r(i).text, c)).alias("uncertainty"))
        m, s, number = parse_support(r(4).text), parse_support(r(5).text), parse_support(r(7).text)
        match = F.struct(F.lit("answer_match").alias("view"), m.alias("support"), F.when(m == 0.5, 0.5).otherwise(r(4).confidence).alias("confidence"), r(4).text.alias("evidence"), F.when(m == 0.5, 1.0).otherwise(0.0).alias("uncertainty"))
        check = F.struct(
            s.alias("support"), F.when(s == 0.5, 0.5).otherwise(1.0 - s).alias("contradiction"), F.when(F.trim(r(5).text) != "", 1.0).otherwise(0.0).alias("evidence_present"), F.when(s == 0.5, 1.0).otherwise(0.0).alias("uncertainty"),
            containment_similarity(r(6).text, c).alias("ocr_read_support"), number.alias("number_check_support"), s.alias("visual_evidence_support"), F.trim(r(5).text).alias("evidence_phrase"),
        )
        return d.withColumns({"views": F.array(seen(1, "independent"), seen(2, "visual"), seen(3, "minus_claim"), match), "direct": check.cast(DIRECT_TYPE)}).drop("replies")

    def samples(self, responses: DataFrame, k: int) -> DataFrame:
        if k < 1:
            raise ValueError("k must be at least 1")
        prompt = F.concat(F.lit("Reply in a short phrase. "), F.coalesce(F.col("question"), F.lit("")))
        d = self.ask(responses, F.array_repeat(prompt, k), sample=True)
        return d.withColumn("samples", F.transform("replies", lambda r: F.trim(r.text))).drop("replies")

    def completions(self, responses: DataFrame) -> DataFrame:
        from ..operators.decompose import decomposition_prompt

        d = self.ask(responses, F.array(decomposition_prompt(F.col("question"), F.col("answer"))))
        return d.withColumn("completion", F.element_at("replies", 1).text).drop("replies")
