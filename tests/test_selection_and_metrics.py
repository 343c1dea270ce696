"""Aggregation, conformal selection and metrics: known values, brute force, partition invariance."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from verisieve.operators import aggregate, conformal, metrics, ordered


def frame(spark, rows, schema, parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts)


def test_responses_take_their_largest_claim(spark):
    r = frame(spark, [(i,) for i in range(3)], "id int")
    c = frame(spark, [(0, 0.1), (0, 0.9), (1, 0.2), (1, 0.3)], "rid int, s double")
    got = {x.id: x.risk_score for x in aggregate.claim_to_response_max(r, c, "id", "rid", "s").collect()}
    assert got == {0: 0.9, 1: 0.3, 2: 0.0}
    low = aggregate.claim_to_response_max(r, c.withColumn("s", -F.col("s")), "id", "rid", "s", -0.2)
    assert {x.id: x.risk_score for x in low.collect()} == {0: -0.1, 1: -0.2, 2: -0.2}


def test_flag_uses_the_rows_threshold_and_reaches_it(spark):
    d = frame(spark, [(1, 0.5, None), (2, 0.5, 0.6), (3, 0.4999999, None)], "id int, risk_score double, threshold double")
    assert {x.id: x.is_high_risk for x in aggregate.flag(d).collect()} == {1: True, 2: False, 3: False}


def test_image_level_keeps_negatives(spark):
    d = frame(spark, [("a", -5.0, 0), ("a", -3.0, 1), ("b", -9.0, 0), ("b", -1.0, 0), ("c", float("nan"), 1)], "i string, s double, y int")
    assert {x.i: (x.score, x.label) for x in aggregate.image_level(d, "i", "s", "y").collect()} == {"a": (-3.0, 1), "b": (-1.0, 0), "c": (0.0, 1)}


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_p_values_by_counting(spark, parts):
    rng = random.Random(parts)
    cal = [round(rng.random(), 2) for _ in range(80)]
    test = [round(rng.random(), 2) for _ in range(60)] + [2.0, -1.0]
    got = conformal.p_values(frame(spark, [(x,) for x in cal], "score double", parts), frame(spark, list(enumerate(test)), "id int, score double", parts)).collect()
    assert {r.id: round(r.p_value, 12) for r in got} == {i: round((1 + sum(c >= s for c in cal)) / 81, 12) for i, s in enumerate(test)}


def accepted(spark, ps, alpha, how):
    d = frame(spark, list(enumerate(ps)), "id int, p_value double")
    return [r.accepted for r in sorted(conformal.step_up(d, alpha, how).collect())]


def test_step_up_known_values(spark):
    assert accepted(spark, [0.001, 0.002, 0.9, 0.95], 0.1, "BH") == [True, True, False, False]
    assert not any(accepted(spark, [0.05, 0.2, 0.4, 0.6, 0.8], 0.05, "BH"))
    assert accepted(spark, [0.02, 0.02, 0.02, 0.9], 0.03, "BH") == [True, True, True, False]  # a tied block has its last rank
    with pytest.raises(ValueError):
        accepted(spark, [0.1], 1.0, "BH")
    with pytest.raises(ValueError):
        accepted(spark, [0.1], 0.1, "holm")


def test_step_up_by_definition(spark):
    rng = random.Random(4)
    for how in ("BH", "BY"):
        ps = [round(rng.random() ** 3, 3) for _ in range(50)]
        h = sum(1 / i for i in range(1, 51)) if how == "BY" else 1.0
        ok = [p for k, p in enumerate(sorted(ps), 1) if p <= 0.2 * k / 50 / h]
        cut = max(ok, default=-1.0)
        assert accepted(spark, ps, 0.2, how) == [p <= cut for p in ps]


def test_harmonic_series_meets_its_sum():
    assert conformal.harmonic(100_000) == pytest.approx(sum(1 / i for i in range(1, 100_001)), abs=1e-12)


def test_empty_calibration_is_refused_and_summary_counts(spark):
    with pytest.raises(ValueError):
        conformal.p_values(frame(spark, [], "score double"), frame(spark, [(1.0,)], "score double"))
    d = frame(spark, [(True, 1), (True, 0), (False, 1)], "accepted boolean, y int")
    assert tuple(conformal.summary(d, "y").first()) == (3, 2, 0.5)
    assert conformal.summary(d.where("not accepted"), "y").first().fdp is None


def test_auroc_by_pairs(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 1), round(rng.random(), 1), rng.random()) for _ in range(70)]
    won = total = 0.0
    for (y, s, w), (z, t, v) in itertools.product(rows, rows):
        if y == 1 and z == 0:
            total += w * v
            won += w * v * (1.0 if s > t else 0.5 if s == t else 0.0)
    assert metrics.auroc(frame(spark, rows, "y int, s double, w double"), "y", "s", "w").first()[0] == pytest.approx(won / total)
    assert metrics.auroc(frame(spark, [(1, 0.5)], "y int, s double"), "y", "s").first()[0] is None


def test_brier_and_calibration_error(spark):
    assert metrics.brier(frame(spark, [(0, 0.2), (1, 0.7), (1, 0.9)], "y int, p double"), "y", "p").first()[0] == pytest.approx(0.14 / 3)
    base = frame(spark, [(1, 0.25)] + [(0, 0.25)] * 3, "y int, p double")
    assert metrics.ece(metrics.reliability_curve(base, "y", "p")).first()[0] == pytest.approx(0.0)
    assert metrics.auroc(base, "y", "p").first()[0] == 0.5
    turned = frame(spark, [(0, 0.9), (1, 0.1)] * 5, "y int, p double")
    assert metrics.ece(metrics.reliability_curve(turned, "y", "p")).first()[0] == pytest.approx(0.9)
    one = metrics.reliability_curve(frame(spark, [(1, 1.0)], "y int, p double"), "y", "p", 10).first()
    assert (one.bin, one.n) == (9, 1)
    with pytest.raises(Exception, match="probabilities"):
        metrics.reliability_curve(frame(spark, [(1, 1.5)], "y int, p double"), "y", "p").collect()
    with pytest.raises(ValueError):
        metrics.bin_edges(base, "p", 5, "other")


def test_quantiles_and_medians_are_exact(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=301), 1)
    d = frame(spark, [(float(v),) for v in x] + [(None,)], "v double", 5)
    assert ordered.quantiles(d, "v", [0.0, 0.1, 0.5, 0.77, 1.0]) == pytest.approx(np.quantile(x, [0.0, 0.1, 0.5, 0.77, 1.0]).tolist())
    assert ordered.quantiles(d.where("false"), "v", [0.5]) == [None]
    assert ordered.medians(frame(spark, [(1.0, 5.0), (2.0, None), (4.0, None), (8.0, None)], "a double, b double"), ["a", "b"]).orderBy("name").collect() == [("a", 3.0), ("b", 5.0)]


def test_bootstrap_repeats_and_ranks(spark):
    rng = random.Random(3)
    rows = [(y := rng.randint(0, 1), y * 0.6 + rng.random(), rng.random(), f"i{k % 20}") for k in range(120)]
    a = metrics.paired_bootstrap(frame(spark, rows, "y int, a double, b double, i string"), "y", "a", "b", "i", 60).first()
    b = metrics.paired_bootstrap(frame(spark, rows, "y int, a double, b double, i string", 7), "y", "a", "b", "i", 60).first()
    assert a == b and a.low <= a.delta <= a.high and a.n_replicates == 60 and a.p_not_better < 0.1


def test_medians_sort_only_what_lies_near_them(spark, monkeypatch):
    n, held = 20_000, []
    x = F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / F.lit(7.0)
    d = spark.range(n).select(x.alias("a"), (-x).alias("b"), (F.col("id") % 2).cast("double").alias("c"), F.when(F.col("id") < 3, F.lit(5.0)).alias("d"), F.lit(None).cast("double").alias("e"))
    keep = ordered.materialize
    monkeypatch.setattr(ordered, "materialize", lambda df: held.append(keep(df)) or held[-1])
    got = {r.name: r.median for r in ordered.medians(d, ["a", "b", "c", "d", "e"]).collect()}
    a = np.array([r.a for r in d.collect()])
    assert got == {"a": np.median(a), "b": np.median(-a), "c": 0.5, "d": 5.0}
    assert 0 < sum(h.count() for h in held) < n / 20


def test_bootstrap_of_few_scores_draws_each_image_once(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(rng.randint(0, 1), rng.randint(0, 10) / 10, rng.randint(0, 40) / 40, f"i{rng.randint(0, 2500)}") for _ in range(9000)]
    d = frame(spark, rows, "y int, a double, b double, i string")
    few = metrics.paired_bootstrap(d, "y", "a", "b", "i", 40)
    assert "cuts" not in few._jdf.queryExecution().analyzed().toString()  # no ranges of scores
    monkeypatch.setattr(metrics, "FEW", 0)
    assert few.first().asDict() == pytest.approx(metrics.paired_bootstrap(d, "y", "a", "b", "i", 40).first().asDict(), rel=1e-12)
