"""The evidence scorer as an ML estimator and model: fitted, saved, loaded and put in pipelines as one.

A model holds all that looks beyond a row: chosen features in order, their medians, the fitted branch, the calibrator, and the columns it was
fitted on with their types.  It is saved as one JSON record on whatever store Spark writes to, without pickled objects.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evidence
from ..operators.calibrate import Calibrator
from .evidence_scorer import Assembler, EvidenceScorer

FORMAT, FORMAT_VERSION = "verisieve.evidence", 1


class _Columns(Params):
    keyCol = Param(Params._dummy(), "keyCol", "column that tells evidence rows apart", typeConverter=TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "label, 1 for wrong; no feature", typeConverter=TypeConverters.toString)
    riskCol = Param(Params._dummy(), "riskCol", "column that transform adds", typeConverter=TypeConverters.toString)
    mask = Param(Params._dummy(), "mask", "predicate of the rows that features, medians and coefficients are fitted on", typeConverter=TypeConverters.toString)
    l2 = Param(Params._dummy(), "l2", "penalty", typeConverter=TypeConverters.toFloat)

    def __init__(self, *args):
        super().__init__(*args)
        self._setDefault(keyCol="unit_id", labelCol="y", riskCol="risk", mask="true", l2=0.05)


def _plain(kind: str) -> bool:
    return not kind.startswith(("array", "map", "struct", "binary"))


class EvidenceEstimator(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, keyCol="unit_id", labelCol="y", riskCol="risk", mask="true", l2=0.05):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> EvidenceModel:
        key, label = self.getOrDefault("keyCol"), self.getOrDefault("labelCol")
        rows, labels = dataset.drop(label), dataset.where(self.getOrDefault("mask")).select(key, label)
        n = dataset.where(F.col(key).isNull() | F.col(label).isNull()).limit(1).count()
        if n:
            raise ValueError(f"{key} and {label} must be there in every row")
        scorer = EvidenceScorer(Assembler.fit(rows, mask=self.getOrDefault("mask")))
        scorer.fit(rows.where(self.getOrDefault("mask")), labels, key, label, self.getOrDefault("l2"))
        inputs = {c: t for c, t in rows.dtypes if c != key}
        return self._copyValues(EvidenceModel(scorer, inputs))


class EvidenceModel(Model, _Columns, MLReadable, MLWritable):
    """Adds ``riskCol`` to evidence rows; their own columns stay as they are."""

    def __init__(self, scorer: EvidenceScorer | None = None, inputs: dict[str, str] | None = None):
        super().__init__()
        self.scorer, self.inputs = scorer, dict(inputs or {})

    def check(self, df: DataFrame) -> None:
        """Targets, columns of another kind, and tables that share no column with the fitted one are refused."""
        evidence.refuse_targets(df)
        kinds = dict(df.dtypes)
        wrong = [c for c, t in self.inputs.items() if c in kinds and _plain(t) != _plain(kinds[c])]
        if wrong:
            raise ValueError(f"columns of another type than at the fit: {', '.join(wrong[:5])}")
        if self.inputs and not set(self.inputs) & set(kinds):
            raise ValueError("the table has none of the columns that the model was fitted on")
        if self.getOrDefault("riskCol") in kinds:
            raise ValueError(f"the table has a column {self.getOrDefault('riskCol')} already")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        self.check(dataset)
        a, c = self.scorer.assembler, self.scorer.calibrator
        d = dataset.withColumn("__own", F.struct(*(F.col(f"`{x}`") for x in dataset.columns)))
        d = evidence.impute(evidence.all_layers(d, a.branch), a.fill)
        return d.select("__own.*", c.predict(d).alias(self.getOrDefault("riskCol")))

    def state(self) -> dict:
        a = self.scorer.assembler
        return {"format": FORMAT, "format_version": FORMAT_VERSION, "names": a.names, "fill": a.fill, "branch": a.branch, "calibrator": self.scorer.calibrator.state(), "notes": self.scorer.notes, "inputs": self.inputs}

    @classmethod
    def of_state(cls, s: dict) -> EvidenceModel:
        if s.get("format") != FORMAT or s.get("format_version") != FORMAT_VERSION:
            raise ValueError("not an evidence model of this format")
        c = Calibrator.of_state(s["calibrator"])
        if c.features != s["names"]:
            raise ValueError("the calibrator has other features than the assembler")
        return cls(EvidenceScorer(Assembler(s["names"], s["fill"], s["branch"]), c, s["notes"]), s["inputs"])

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: EvidenceModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:  # noqa: N802  (the name that Spark calls)
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata={"state": self.model.state()})


class _Reader(MLReader):
    def load(self, path: str) -> EvidenceModel:
        found = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = EvidenceModel.of_state(found.get("state") or {})
        model._resetUid(found["uid"])
        DefaultParamsReader.getAndSetParams(model, found)
        return model
