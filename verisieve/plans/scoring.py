"""Fit and score: responses to claims, evidence, 48 features, claim risk, response risk, optional fusion with resampling statistics."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.durable import discard, materialize
from ..functions.scalars import bround6
from ..operators import calibrate, decompose, features
from ..operators.aggregate import claim_to_response_max
from ..operators.calibrate import Calibrator
from ..sources.providers import EvidenceProvider, kind_of

FORMAT, FORMAT_VERSION = "verisieve.scorer", 1


@dataclass(frozen=True)
class Config:
    threshold: float = 0.5
    k: int = 0
    max_claims: int = decompose.MAX_CLAIMS
    l2: float = 0.05
    fusion_l2: float = 0.02
    version: str = "1"
    #: What the fusion head is fitted on: "calibrated" evidence as it is scored, or the uncalibrated "prior".
    fuse_on: str = "calibrated"
    #: Which number must be positive for a fusion head to stand: its "weight" on evidence, or its "intercept".
    guard: str = "weight"

    @classmethod
    def of(cls, d: dict) -> Config:
        return cls(**{k: v for k, v in d.items() if k in cls.__dataclass_fields__})


@dataclass
class Scorer:
    config: Config = field(default_factory=Config)
    calibrator: Calibrator | None = None
    fusion: Calibrator | None = None
    provider_kind: str = "unknown"
    warnings: list[str] = field(default_factory=list)

    def save(self, path: str) -> None:
        state = {"format": FORMAT, "format_version": FORMAT_VERSION, "config": asdict(self.config), "features": features.LIVE, "provider_kind": self.provider_kind, "warnings": self.warnings}
        state |= {n: c.state() if (c := getattr(self, n)) else None for n in ("calibrator", "fusion")}
        with open(path, "w", encoding="utf-8") as f:
            json.dump(state, f, allow_nan=False, indent=1)

    @classmethod
    def load(cls, path: str) -> Scorer:
        with open(path, encoding="utf-8") as f:
            s = json.load(f)
        if s.get("format") != FORMAT or s.get("format_version") != FORMAT_VERSION:
            raise ValueError("not a scorer of this format")
        if s.get("features") != features.LIVE:
            raise ValueError("the scorer was fitted on another feature list")
        notes = list(s.get("warnings") or [])
        if not s.get("provider_kind"):
            notes.append("the scorer does not say which evidence it was fitted on")
        return cls(Config.of(s["config"]), *(Calibrator.of_state(s[n]) if s.get(n) else None for n in ("calibrator", "fusion")), s.get("provider_kind") or "unknown", notes)


def claim_rows(responses: DataFrame, provider: EvidenceProvider, config: Config, keep: Sequence[str] = ()) -> DataFrame:
    """A row per claim with its 48 features.  ``responses``: response_id, question, answer, image, and what claims ``keep`` of their response."""
    asked = provider.completions(responses)
    claims = decompose.hybrid_claims(asked, "completion", max_claims=config.max_claims)
    read = provider.boxes(responses.select("response_id", "image", *keep))
    claims = claims.join(read, "response_id")
    return features.assemble(provider.evidence(claims))


#: What ``fit`` and ``score`` read of claims.
CLAIM_COLUMNS = ["response_id", "claim_pos", "claim_id", "claim_text", "claim_type", "claim_set_validation_errors", *features.LIVE]


def written_claims(responses: DataFrame, provider: EvidenceProvider, config: Config) -> DataFrame:
    """``claim_rows`` written once, for a ``fit`` and a ``score`` of the same responses; with their label, if ``responses`` have ``failed``."""
    keep = [c for c in responses.columns if c == "failed"]
    return materialize(claim_rows(responses, provider, config, keep).select(*CLAIM_COLUMNS, *keep))


def with_risk(claims: DataFrame, scorer: Scorer) -> DataFrame:
    risk = scorer.calibrator.predict(claims) if scorer.calibrator else features.prior(claims)
    return claims.withColumn("risk", risk)


def resampling(responses: DataFrame, provider: EvidenceProvider, k: int) -> DataFrame:
    d = provider.samples(provider.boxes(responses.select("response_id", "image", "question")), k)
    return features.resampled(d.withColumn("box_texts", F.col("boxes.text")), k=k).select("response_id", *features.RESAMPLED)


def written_resampling(responses: DataFrame, provider: EvidenceProvider, config: Config) -> DataFrame:
    """``resampling`` written once, for a ``fit`` and a ``score`` of the same responses."""
    return materialize(resampling(responses, provider, config.k))


def score(responses: DataFrame, provider: EvidenceProvider, scorer: Scorer, return_claims: bool = True, rows: DataFrame | None = None, drawn: DataFrame | None = None) -> DataFrame:
    """response_id, risk_score, is_high_risk, calibrated_confidence, threshold, num_claims, claims, feature_dim, channels, warnings, version.

    A row's own ``threshold`` column, if there is one, goes before the scorer's.  ``rows``, ``drawn``: the responses' ``written_claims`` and ``written_resampling``, if there are any.
    """
    c = scorer.config
    claims = with_risk(claim_rows(responses, provider, c) if rows is None else rows, scorer)
    item = F.struct("claim_pos", "claim_id", "claim_text", "claim_type", F.col("risk").alias("risk"))
    per = claims.groupBy("response_id").agg(
        F.max("risk").alias("top"), F.count(F.lit(1)).alias("num_claims"), F.array_sort(F.collect_list(item)).alias("cs"), F.first("claim_set_validation_errors").alias("errors")
    )
    keep = ["response_id", *(["threshold"] if "threshold" in responses.columns else [])]
    out = responses.select(*keep).join(per, "response_id", "left").withColumn("evidence_score", F.greatest(F.coalesce("top", F.lit(0.0)), F.lit(0.0)))
    names = ["evidence_score"]
    final = F.col("evidence_score")
    notes = list(scorer.warnings) + ([] if scorer.calibrator else ["the scorer is not fitted: scores are an uncalibrated prior"])
    if c.k:
        out = out.join(resampling(responses, provider, c.k) if drawn is None else drawn, "response_id")
        names += features.RESAMPLED
        if scorer.fusion and scorer.fusion.weights:
            out = out.withColumn("fused_score", scorer.fusion.predict(out))
            final = F.col("fused_score")
            names.append("fused_score")
        else:
            notes.append("no fusion head is fitted: the evidence score is returned")
    limit = F.coalesce(F.col("threshold"), F.lit(c.threshold)) if "threshold" in responses.columns else F.lit(c.threshold)
    shown = F.transform("cs", lambda x: F.struct(x.claim_id.alias("claim_id"), x.claim_text.alias("claim_text"), x.claim_type.alias("claim_type"), x.risk.alias("risk")))
    empty = F.array().cast("array<struct<claim_id:string,claim_text:string,claim_type:string,risk:double>>")
    said = F.filter(F.array(*(F.lit(n) for n in notes), F.when(F.coalesce("errors", F.lit("")) != "", F.concat(F.lit("claim set: "), "errors"))), lambda x: x.isNotNull())
    return out.select(
        "response_id", bround6(final).alias("risk_score"), (final >= limit).alias("is_high_risk"), bround6(1.0 - bround6(final)).alias("calibrated_confidence"), limit.alias("threshold"),
        F.coalesce("num_claims", F.lit(0)).alias("num_claims"), (F.coalesce(shown, empty) if return_claims else empty).alias("claims"), F.lit(len(features.LIVE)).alias("feature_dim"),
        F.map_from_arrays(F.array(*(F.lit(n) for n in names)), F.array(*(bround6(F.col(n)) for n in names))).alias("channels"), said.alias("warnings"), F.lit(c.version).alias("version"),
    )


def fit(dev: DataFrame, provider: EvidenceProvider, config: Config | None = None, rows: DataFrame | None = None, drawn: DataFrame | None = None) -> Scorer:
    """``dev``: response_id, question, answer, image, failed (1 = wrong).  A response's label goes to each of its claims.

    ``rows``, ``drawn``: the ``written_claims`` and ``written_resampling`` of ``dev`` or of more responses, if there are any; else claims are written
    here for the time of the fit.  Labels are joined to ``rows`` that have none; ``rows`` with labels must be those of ``dev``.
    """
    config = config or Config()
    out = Scorer(config, provider_kind=kind_of(provider))
    own = written_claims(dev.select("response_id", "question", "answer", "image", "failed"), provider, config) if rows is None else None  # written: a lost executor repeats no evidence
    claims = own if rows is None else rows if "failed" in rows.columns else rows.join(dev.select("response_id", "failed"), "response_id")
    try:
        n = dev.select("response_id").join(claims.select("response_id"), "response_id", "left_anti").count()
        if n:
            out.warnings.append(f"{n} responses have no claims: they take no part in the fit")
        out.calibrator = calibrate.fit(claims, features.LIVE, "failed", config.l2)
        if out.calibrator.weights is None:
            out.warnings.append("the labels have one class only: scores are its base rate")
        if config.k:
            risk = with_risk(claims, out if config.fuse_on == "calibrated" else Scorer(config))
            r = claim_to_response_max(dev.select("response_id", "failed"), risk.select(F.col("response_id").alias("rid"), "risk"), "response_id", "rid", "risk").withColumnRenamed("risk_score", "evidence_score")
            r = materialize(r.join(resampling(dev, provider, config.k) if drawn is None else drawn, "response_id"))
            if calibrate.constant_columns(r, features.RESAMPLED):
                out.warnings.append("resampling statistics are constant: no fusion head is fitted")
            else:
                head = calibrate.fit(r, ["evidence_score", *features.RESAMPLED], "failed", config.fusion_l2)
                value = None if head.weights is None else head.intercept if config.guard == "intercept" else head.weights[0]
                if value is None or value <= 0:
                    out.warnings.append("the fusion head would turn the evidence round: it is not used")
                else:
                    out.fusion = head
            discard(r)
    finally:
        if own is not None:
            discard(own)
    if out.provider_kind == "mock":
        out.warnings.append("fitted on mock evidence")
    return out
