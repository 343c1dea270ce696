"""Fit and score on evidence tables: feature layers, selection, medians and a calibrator, and the four arms of an ablation."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.durable import discard, materialize
from ..operators import calibrate, evidence, metrics, newton, wide
from ..operators.calibrate import Calibrator


@dataclass
class Assembler:
    """Raw evidence rows to a complete feature frame.  Everything that looks beyond a row is fitted once and kept here."""

    names: list[str]
    fill: dict[str, float]
    branch: str
    moments: dict[str, tuple[float, float]] = field(default_factory=dict)  # mean and deviation of each feature, filled, on the rows of the fit

    @classmethod
    def fit(cls, dev: DataFrame, test: DataFrame | None = None, mask: str = "true") -> Assembler:
        """Features are chosen on the masked rows of ``dev``; ``test``, if given, must have every chosen one."""
        evidence.refuse_targets(dev)
        if dev.isEmpty():
            raise ValueError("no rows to assemble")
        evidence.short_methods(dev.sparkSession)
        branch = evidence.conflict_branch(dev)
        layers = evidence.all_layers(dev, branch)
        other = layers if test is None else evidence.all_layers(evidence.refuse_targets(test), branch)
        # features are many times as wide as the rows they are made of, so they are not written: each of two passes works them out
        held = evidence.family(layers.where(mask))
        known = wide.summaries(held, held.columns) if held.columns else {}
        names = evidence.select_features(held, other, "true", known)
        middle = wide.exact_medians(held, {n: known[n] for n in names})
        fill = {n: middle.get(n, 0.0) for n in names}
        return cls(names, fill, branch, {n: known[n].filled(fill[n]) for n in names})

    def transform(self, df: DataFrame, keep: tuple[str, ...] = ("unit_id",)) -> DataFrame:
        """``keep`` and the features, complete; a feature that the table lacks takes its median."""
        layers = evidence.all_layers(evidence.refuse_targets(df), self.branch)
        return evidence.impute(layers, self.fill).select(*keep, *self.names)


def matrices(dev: DataFrame, test: DataFrame | None = None, image: str = "image", fraction: float = 0.5, seed: int = 20260920, keep: tuple[str, ...] = ("unit_id",)) -> tuple[Assembler, DataFrame, DataFrame, DataFrame | None]:
    """(assembler, score-training rows, calibration rows, test rows if there are any).

    ``dev`` is split by whole images, each of which falls to one half, so the halves share none.
    """
    split = evidence.image_split(dev, image, fraction, seed)
    assembler = Assembler.fit(split, test, "is_score_train")
    part = lambda d: None if d is None else assembler.transform(d, (*keep, image))
    return assembler, part(split.where("is_score_train")), part(split.where(~F.col("is_score_train"))), part(test)


@dataclass
class EvidenceScorer:
    assembler: Assembler
    calibrator: Calibrator | None = None
    notes: list[str] = field(default_factory=list)

    def attach(self, df: DataFrame, labels: DataFrame, key: str = "unit_id", label: str = "y") -> DataFrame:
        """Feature rows with the label of their key; rows without one are left out."""
        return self.assembler.transform(df, (key,)).join(labels.select(key, label), key)

    def fit(self, df: DataFrame, labels: DataFrame, key: str = "unit_id", label: str = "y", l2: float = 0.05) -> EvidenceScorer:
        self.calibrator = calibrate.fit(self.attach(df, labels, key, label), self.assembler.names, label, l2)
        if self.calibrator.weights is None:
            self.notes.append("the labels have one class only: scores are its base rate")
        return self

    def score(self, df: DataFrame, keep: tuple[str, ...] = ("unit_id",)) -> DataFrame:
        """``keep`` and risk.  A row's risk never depends on the rows scored with it."""
        if self.calibrator is None:
            raise ValueError("the scorer is not fitted")
        rows = self.assembler.transform(df, keep)
        return rows.select(*keep, self.calibrator.predict(rows).alias("risk"))


ARMS = ("language", "language+instrument", "language+resampling", "language+instrument+resampling")


def arms(train: DataFrame, test: DataFrame, names: list[str], label: str = "y", response: str = "response_id", resampled: tuple[str, ...] = (), l2: float = 0.05, fusion_l2: float = 0.02, known: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """arm, response, score, y: responses of ``test`` scored by each arm fitted on ``train``.

    ``names`` are features of claims; those that begin with ``mech_`` are the instrument's and left out of the language arms.
    Resampling arms fuse a response's largest claim risk with its ``resampled`` statistics; without any there are two arms.
    ``known``: as in ``newton.fit``.
    """
    kinds = [a for a in ARMS if "resampling" not in a]
    claims: dict[str, Calibrator] = {}
    for kind in kinds:  # each fit begins at the one before, which has fewer features
        used = names if "instrument" in kind else [n for n in names if not n.startswith("mech_")]
        claims[kind] = newton.fit(train, used, label, l2, written=False, start=next(reversed(claims.values()), None), known=known).calibrator

    def per_response(df: DataFrame) -> DataFrame:
        """Largest claim risks of all kinds in one pass; claims without a response count for none."""
        risks = [F.when(F.col(response).isNotNull(), claims[k].predict(df)).alias(f"__risk_{i}") for i, k in enumerate(kinds)]
        top = [F.greatest(F.coalesce(F.max(f"__risk_{i}"), F.lit(0.0)), F.lit(0.0)).alias(f"evidence_{i}") for i in range(len(kinds))]
        own = (F.max(label).alias(label), *(F.first(c).alias(c) for c in resampled))
        return df.select(response, label, *resampled, *risks).groupBy(response).agg(*own, *top)

    scored = per_response(test)
    values = {k: F.col(f"evidence_{i}") for i, k in enumerate(kinds)}
    if resampled:
        fitted = materialize(per_response(train))  # a narrow row per response, read by every head
        for i, k in enumerate(kinds):
            values[f"{k}+resampling"] = calibrate.fit(fitted, [f"evidence_{i}", *resampled], label, fusion_l2).predict(scored)
        discard(fitted)
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("arm"), values[a].alias("score")) for a in ARMS if a in values))).alias("__x")
    return scored.select(response, F.col(label).alias("y"), each).select("__x.arm", response, "__x.score", "y")


def arm_report(scored: DataFrame) -> DataFrame:
    """arm, n, auroc, brier of each arm."""
    spark, scored = scored.sparkSession, materialize(scored.select("arm", "score", "y"))  # read several times per arm
    rows = []
    for (arm,) in scored.select("arm").distinct().orderBy("arm").collect():  # four at most
        d = scored.where(F.col("arm") == arm)
        rows.append((arm, d.count(), metrics.auroc(d, "y", "score").first()[0], metrics.brier(d, "y", "score").first()[0]))
    discard(scored)
    return spark.createDataFrame(rows, "arm string, n long, auroc double, brier double")
