"""Many columns at once: summaries and medians without written tables, halves of images, and what the arms of the ablation are scored on."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from verisieve.operators import evidence, newton, wide
from verisieve.plans import catalog, evidence_scorer
from verisieve.plans import fixtures as fx

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n", [1, 7, 20_000])
def test_summaries_and_medians_are_those_of_plain_numpy(spark, n):
    rng = np.random.default_rng(n)
    x = {"even": rng.random(n), "skew": np.exp(3 * rng.normal(size=n)), "few": rng.integers(0, 3, n).astype(float), "same": np.full(n, 0.1), "none": np.full(n, np.nan), "rising": np.arange(n, dtype=float), "zero": np.where(rng.random(n) < 0.5, -0.0, 0.0)}
    for c in ("even", "few"):
        x[c][rng.random(n) < 0.3] = np.nan
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in zip(*x.values(), strict=True)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in x)).repartitionByRange(5, "rising")  # tasks see other values each
    got = wide.summaries(df, list(x))
    medians = wide.exact_medians(df, got)
    shifted = wide.exact_medians(df, {c: replace(s, low=-1e9, high=-1e9) for c, s in got.items() if s.n})  # pivots that miss every median
    for c, v in x.items():
        v = v[~np.isnan(v)]
        assert (got[c].n_rows, got[c].n) == (n, len(v))
        if len(v):
            assert got[c].mean == pytest.approx(v.mean(), rel=1e-12) and medians[c] == shifted[c] == np.median(v)
            filled = np.concatenate([v, np.full(n - len(v), 0.7)])
            assert got[c].filled(0.7) == pytest.approx((filled.mean(), filled.std()), rel=1e-9, abs=1e-12)
        if len(v) > 1:
            assert got[c].spread == pytest.approx(v.std(ddof=1), rel=1e-9, abs=1e-15)
    assert "none" not in medians
    usability = evidence.usability(df, list(x))
    assert evidence.usable(got) == {r.name for r in usability.where("usable").collect()}


def test_no_rows(spark):
    df = spark.createDataFrame([], "a double, b double")
    got = wide.summaries(df, ["a", "b"])
    assert got["a"] == wide.Summary(0, 0, 0.0, 0.0, None, None) and wide.exact_medians(df, got) == {} and evidence.usable(got) == set()


@pytest.mark.parametrize("fraction", [0.0, 0.3, 0.5, 1.0])
def test_halves_follow_the_order_of_hashes_and_join_nothing(spark, fraction):
    names = [None, "", *(f"i{i}" for i in range(41))]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names * 3)], "k int, image string")
    got = evidence.image_split(df, "image", fraction, 5)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    hashes = {r.image: r.h for r in df.select("image", F.xxhash64(F.lit(5), "image").alias("h")).collect()}
    want = set(sorted(names, key=hashes.get)[: round(fraction * len(names))])
    assert all(r.is_score_train == (r.image in want) for r in got.collect()) and got.count() == 3 * len(names)


def test_a_fit_begins_anywhere_and_takes_known_moments(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 3))
    y = (x @ [1.0, -2.0, 0.5] + rng.logistic(size=600) > 0.3).astype(int)
    df = spark.createDataFrame([(int(b), *map(float, a)) for a, b in zip(x, y, strict=True)], "y int, a double, b double, c double")
    plain = newton.fit(df, ["a", "b", "c"], "y").calibrator
    part = newton.fit(df.where("a > -1"), ["c", "a"], "y").calibrator  # other means too
    known = {n: s.filled(0.0) for n, s in wide.summaries(df, ["a", "b", "c"]).items()}
    other = newton.fit(df, ["a", "b", "c"], "y", written=False, start=part, known=known)
    assert other.calibrator.weights == pytest.approx(plain.weights, abs=1e-8) and other.calibrator.intercept == pytest.approx(plain.intercept, abs=1e-8)
    near = newton.fit(df, ["a", "b", "c"], "y", written=False, start=plain)
    assert len(near.log) == 1 and near.calibrator.status == "converged"


def test_ablation_is_scored_on_the_other_half_and_writes_no_features(spark, monkeypatch):
    written, scored = [], []
    for module in (evidence_scorer, newton, wide, evidence):
        monkeypatch.setattr(module, "materialize", lambda df, *a, f=module.materialize: (written.append(len(df.columns)), f(df, *a))[1])
    monkeypatch.setattr(evidence_scorer, "arms", lambda train, test, *a, f=evidence_scorer.arms, **b: (scored.extend((train, test)), f(train, test, *a, **b))[1])
    got = catalog.QUERIES["ablation_arms"](spark, SF).collect()
    split = evidence.image_split(fx.evidence_rows(spark, SF), "image").select("unit_id", "is_score_train").collect()
    train, test = ({r.unit_id for r in d.select("unit_id").collect()} for d in scored)
    assert train == {r.unit_id for r in split if r.is_score_train} and test == {r.unit_id for r in split if not r.is_score_train}
    assert train and test and {r.n for r in got} == {len({u.split("-")[0] for u in test})} and {r.arm for r in got} == {"language", "language+instrument"}
    assert max(written) <= 4  # before: all features of both halves


def test_score_evidence_writes_no_features(spark, monkeypatch):
    written = []
    for module in (evidence_scorer, newton, wide, evidence, *([catalog] if hasattr(catalog, "materialize") else [])):
        monkeypatch.setattr(module, "materialize", lambda df, *a, f=module.materialize: (written.append(len(df.columns)), f(df, *a))[1])
    got = catalog.QUERIES["score_evidence"](spark, SF)
    assert got.count() == fx.table(spark, SF, "lineitem").count() and max(written) <= 4
    assert got.where("risk is null or risk <= 0 or risk >= 1").count() == 0
