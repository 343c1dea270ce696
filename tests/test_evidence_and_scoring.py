"""Evidence layers, imputation, calibration, sources, streaming, end-to-end scoring."""

from __future__ import annotations

import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from verisieve.operators import calibrate, evidence
from verisieve.plans import catalog, scoring
from verisieve.sources import io
from verisieve.sources.providers import MockProvider
from verisieve.streaming import score as streaming


def table(spark, n=60, seed=1):
    rng = np.random.default_rng(seed)
    names = [*evidence.SUPPORTS, *evidence.RISKS, "decomposition_confidence", "atomicity_score", "faithfulness_score", "direct_verifier_support_mean", "direct_verifier_ocr_read_support", "direct_verifier_risk", "mech_a"]
    rows = []
    for i in range(n):
        r = [None if rng.random() < 0.1 else float(rng.random()) for _ in names]
        rows.append([f"u{i}", f"img{i // 2}", *r])
    return spark.createDataFrame(rows, "unit_id string, image string, " + ", ".join(f"{c} double" for c in names))


def test_cardinalities():
    assert (len(evidence.SUPPORTS), len(evidence.RISKS), len(evidence.BASE), len(evidence.VIEWS), len(evidence.PRODUCTS)) == (23, 9, 12, 8, 5)
    assert (len(evidence.CONTRADICTION), len(evidence.QUALITY), len(evidence.TYPES)) == (13, 10, 11)
    from verisieve.operators import features

    assert (len(features.BELIEF), len(features.DIRECT), len(features.ALIGN), len(features.CROSS), len(features.BOXES), len(features.RESAMPLED), len(features.LIVE)) == (13, 9, 4, 3, 19, 7, 48)


def test_layers_stay_in_range(spark):
    d = evidence.all_layers(table(spark))
    names = [c for c in (*evidence.CONTRADICTION, *evidence.QUALITY, *evidence.DIRECT) if c in d.columns and c not in table(spark).columns]
    assert len(names) == 13 + 10 + 35
    r = d.agg(*(x for n in names for x in (F.min(n).alias("a" + n), F.max(n).alias("b" + n), F.count_if(F.col(n).isNull()).alias("n" + n)))).first()
    for n in names:
        assert 0 <= r["a" + n] <= r["b" + n] <= 1 and r["n" + n] == 0, n


def test_missing_and_textual_values(spark):
    d = spark.createDataFrame([("0.25", "x", None, " TRUE "), ("", "0.5", "NaN", "1.0")], "claim_bcm_direct_verify_support string, direct_verifier_ocr_read_support string, bcm_multiview_disagreement string, parser_added_claim string")
    r = evidence.all_layers(d).collect()
    assert r[0].risk_claim_bcm_direct_verify_support == 0.75 and r[1].risk_claim_bcm_direct_verify_support is None
    assert r[1].risk_bcm_multiview_disagreement is None and r[0].v2_reliable_disagreement == 0.0
    assert [x.direct_verifier_ocr_requested for x in r] == [1.0, 0.0]  # an unreadable value counts as asked
    assert [x.quality_parser_added_claim for x in r] == [1.0, 0.0]


def test_conflict_branch_is_fitted_once(spark):
    d = spark.createDataFrame([(None, 0.2), (None, None)], "claim_bcm_direct_verify_support double, claim_bcm_claim_match_after_answer_support double")
    assert evidence.conflict_branch(d) == "match" and evidence.conflict_branch(d.drop("claim_bcm_claim_match_after_answer_support")) == "pressure"
    whole = evidence.contradiction_layer(d, "match").collect()
    alone = evidence.contradiction_layer(d.where("claim_bcm_claim_match_after_answer_support is null"), "match").first()
    assert whole[0].v2_direct_counterfactual_conflict == pytest.approx(0.8) and alone in whole


def test_usability_boundary_and_imputation(spark):
    rows = [(float(i) if i < 11 else None, float(i) if i < 10 else None, 3.0, None) for i in range(15)]
    d = spark.createDataFrame(rows, "a double, b double, c double, d double")
    assert {r.name: r.usable for r in evidence.usability(d, ["a", "b", "c", "d"]).collect()} == {"a": True, "b": False, "c": False, "d": False}
    fill = evidence.fit_imputer(d, ["a", "b", "d"])
    assert fill == {"a": 5.0, "b": 4.5, "d": 0.0}
    assert evidence.impute(d, fill | {"absent": 2.0}).agg(F.sum("a"), F.max("absent")).first() == (55.0 + 20.0, 2.0)
    with pytest.raises(Exception, match="infinite"):
        evidence.impute(spark.createDataFrame([(float("inf"),)], "a double"), fill).collect()


def test_joins_pick_first_or_last_and_rename(spark):
    left = spark.createDataFrame([("a", 1), ("b", 2)], "unit_id string, x int")
    right = spark.createDataFrame([("a", 7, 5), ("a", 8, 2), ("c", 9, 1)], "unit_id string, x int, row_pos int")
    got = evidence.left_join_first(left, right, "unit_id", "row_pos", "_r").orderBy("unit_id").collect()
    assert [tuple(r) for r in got] == [("a", 1, 8), ("b", 2, None)]
    last = evidence.lookup_last(left.select("unit_id"), right.withColumn("x", F.col("x").cast("string")), "unit_id", "x", "row_pos")
    assert {r.unit_id: r.x for r in last.collect()} == {"a": "7", "b": ""}


def test_image_split_is_a_partition_of_images(spark):
    d = table(spark, 101)
    a = evidence.image_split(d, "image").select("unit_id", "image", "is_score_train").collect()
    b = evidence.image_split(d.repartition(7), "image").select("unit_id", "image", "is_score_train").collect()
    assert sorted(a) == sorted(b) and len(a) == 101
    sides = {r.image: r.is_score_train for r in a}
    assert all(sides[r.image] == r.is_score_train for r in a) and sum(sides.values()) == round(len(sides) / 2)


def newton(x, y, l2):
    x = (x - x.mean(0)) / np.where(x.std(0) > 1e-8, x.std(0), 1)
    a = np.c_[np.ones(len(x)), x]
    w = np.zeros(a.shape[1])
    ridge = np.r_[0, np.full(x.shape[1], 2 * l2)]
    for _ in range(60):
        p = 1 / (1 + np.exp(-a @ w))
        w -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a / len(a) + np.diag(ridge) + 1e-12 * np.eye(len(w)), a.T @ (p - y) / len(a) + ridge * w)
    return w


def test_calibrator_meets_newtons_solution(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 3))
    y = (x[:, 0] + 0.5 * rng.normal(size=200) > 0).astype(int)
    d = spark.createDataFrame([(*map(float, r), 1.0, int(t)) for r, t in zip(x, y, strict=True)], "a double, b double, c double, k double, y int")
    c = calibrate.fit(d, ["a", "b", "c", "k"], "y")
    want = newton(x, y, 0.05)
    assert [c.intercept, *c.weights[:3]] == pytest.approx(want.tolist(), abs=1e-5) and c.weights[3] == pytest.approx(0)
    assert c.ranked_weights()[0][0] == "a"
    again = calibrate.Calibrator.of_state(json.loads(json.dumps(c.state())))
    assert d.select(again.predict(d).alias("p")).collect() == d.select(c.predict(d).alias("p")).collect()
    missing = spark.createDataFrame([(None, float("nan"), float("inf"), 1.0)], "a double, b double, c double, k double")
    z = c.intercept + sum(-m / s * w for m, s, w in zip(c.mean[:3], c.std[:3], c.weights[:3], strict=True))
    assert missing.select(c.predict(missing)).first()[0] == pytest.approx(1 / (1 + np.exp(-z)))
    with pytest.raises(ValueError):
        c.predict(d.drop("b"))


def test_calibrator_with_one_class(spark):
    c = calibrate.fit(spark.createDataFrame([(1.0, 1), (2.0, 1)], "a double, y int"), ["a"], "y")
    assert c.status == "single_class" and c.weights is None and c.fallback == pytest.approx(1 - 1e-6)
    assert calibrate.l2_of_c(1.0, 50) == 0.01


def dev(spark, n=24):
    rows = [(i, "What does the sign say?", "open 24 days" if i % 2 else "closed for good", "open 24 days; Dakota", 0 if i % 2 else 1) for i in range(n)]
    return spark.createDataFrame(rows, "response_id int, question string, answer string, image string, failed int")


def test_unfitted_demo_score(spark):
    r = spark.createDataFrame([(1, "What does the sign say?", "open 24 days", "open 24 days; Dakota", None), (2, "q", "x", "", 0.1)], "response_id int, question string, answer string, image string, threshold double")
    got = {x.response_id: x for x in scoring.score(r, MockProvider(), scoring.Scorer()).collect()}
    assert got[1].num_claims == 1 and got[1].feature_dim == 48 and 0 < got[1].risk_score < 0.5 and not got[1].is_high_risk and got[2].is_high_risk
    assert got[1].calibrated_confidence == pytest.approx(1 - got[1].risk_score, abs=1e-6) and any("not fitted" in w for w in got[1].warnings)


def test_fit_save_load_score(spark, tmp_path):
    scorer = scoring.fit(dev(spark), MockProvider(), scoring.Config())
    assert "fitted on mock evidence" in scorer.warnings and scorer.calibrator.status == "converged"
    scorer.save(str(tmp_path / "s.json"))
    back = scoring.Scorer.load(str(tmp_path / "s.json"))
    got = {x.response_id: x.risk_score for x in scoring.score(dev(spark).drop("failed"), MockProvider(), back, return_claims=False).collect()}
    assert min(v for k, v in got.items() if k % 2 == 0) > max(v for k, v in got.items() if k % 2)
    (tmp_path / "t.json").write_text(json.dumps({"format": "other"}))
    with pytest.raises(ValueError):
        scoring.Scorer.load(str(tmp_path / "t.json"))


def test_fusion_needs_a_signal(spark):
    flat = scoring.fit(dev(spark, 12), MockProvider(), scoring.Config(k=2))
    assert flat.fusion is None and any("constant" in w for w in flat.warnings)


def test_json_lines_with_quarantine(spark, tmp_path):
    good = {"question": "q", "answer": "a", "image": "i", "failed": 1}
    (tmp_path / "d.jsonl").write_text("\ufeff" + json.dumps(good) + "\n\n" + json.dumps(good | {"group": "g"}) + "\n{broken\n" + json.dumps({"question": "q"}) + "\n", encoding="utf-8")
    ok, bad = io.read_lines(spark, str(tmp_path / "d.jsonl"), io.DEV_SCHEMA, ["question", "answer", "image", "failed"])
    assert ok.count() == 2 and bad.count() == 2
    with pytest.raises(io.InputError, match="line 4"):
        io.read_dev(spark, str(tmp_path / "d.jsonl"))
    (tmp_path / "e.jsonl").write_text("\n")
    with pytest.raises(io.InputError, match="no records"):
        io.read_dev(spark, str(tmp_path / "e.jsonl"))
    with pytest.raises(io.InputError, match="not found"):
        io.read_dev(spark, str(tmp_path / "absent.jsonl"))


def test_evidence_tables_are_joined(spark, tmp_path):
    texts = {"features": "unit_id,bcm_multiview_support_mean\nu1,0.5\nu2,\n", "claims": "unit_id,image,claim_type\nu1,a,other\nu1,b,counting\n", "direct": "unit_id,claim_type\nu1,x\n", "mechanical": "unit_id,mech_text\nu1,\nu2,y\n"}
    for name, t in texts.items():
        with gzip.open(tmp_path / f"dev_{name}.csv.gz", "wt") as f:
            f.write(t)
    got = {r.unit_id: r for r in io.read_evidence(spark, str(tmp_path), "dev").collect()}
    assert (got["u1"].claim_type, got["u1"].claim_type_direct, got["u1"].image, got["u1"].mech_text, got["u2"].image) == ("other", "x", "b", "", "")
    with gzip.open(tmp_path / "bad.csv.gz", "wt") as f:
        f.write("unit_id,label\nu,1\n")
    with pytest.raises(io.InputError, match="label"):
        io.read_csv_without_targets(spark, str(tmp_path / "bad.csv.gz"))
    with pytest.raises(io.InputError, match="absent"):
        io.read_evidence(spark, str(tmp_path), "test")


def test_bundles_are_verified(spark, tmp_path):
    r = spark.createDataFrame([("dev", 1, "i", 0, 0.5)], "split string, response_id long, image string, y int, mvr_a double")
    io.write_bundle({"responses": r}, str(tmp_path / "b"))
    assert io.read_bundle(spark, str(tmp_path / "b"))["responses"].count() == 1
    r.union(r).write.mode("overwrite").partitionBy("split").parquet(str(tmp_path / "b" / "responses"))
    with pytest.raises(io.InputError, match="manifest"):
        io.read_bundle(spark, str(tmp_path / "b"))
    with pytest.raises(io.InputError, match="lacks"):
        io.write_bundle({"responses": r.drop("y")}, str(tmp_path / "c"))
    with pytest.raises(KeyError):
        io.select_columns(r, ["y", "absent"])


def test_paths_are_scrubbed(tmp_path):
    v = {"a": "/home/u/run/x.csv", "b": ["C:\\data\\y", "\\\\srv\\share\\z", "plain/rel", 3]}
    once = io.scrub(v, ["/home/u/run"])
    assert once == {"a": "x.csv", "b": ["y", "z", "plain/rel", 3]} and io.scrub(once, ["/home/u/run"]) == once
    p = tmp_path / "m.json"
    p.write_text(json.dumps(v))
    assert io.scrub_file(str(p), ["/home/u/run"], check=True) and io.scrub_file(str(p), ["/home/u/run"]) and not io.scrub_file(str(p), check=True)


def test_exports_and_label_firewall(spark, tmp_path):
    d = spark.createDataFrame([("u", 1, 0.5)], "unit_id string, label int, x double")
    assert io.export_without_targets(d, str(tmp_path / "o")) == ["label"]
    assert spark.read.option("header", True).csv(str(tmp_path / "o")).columns == ["unit_id", "x"]
    with pytest.raises(ValueError):
        evidence.refuse_targets(d)


def test_streamed_rows_score_as_in_batch(spark, tmp_path):
    d = table(spark, 20)
    names = ["v2_contradiction_pressure_mean", "quality_low_atomicity", "mech_a"]
    rows = evidence.all_layers(d, "direct")
    fill = evidence.fit_imputer(rows, names)
    c = calibrate.fit(evidence.impute(rows, fill).withColumn("y", (F.col("v2_view_reliability") > 0.5).cast("int")), names, "y")
    want = sorted((r.unit_id, r.risk) for r in streaming.score_stream(d, c, fill, "direct").collect())
    d.repartition(3).write.parquet(str(tmp_path / "in"))
    out = []
    stream = streaming.score_stream(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")), c, fill, "direct")
    streaming.start(stream, lambda b, _: out.extend((r.unit_id, r.risk) for r in b.collect()), str(tmp_path / "cp"), once=True).awaitTermination(120)
    assert sorted(out) == pytest.approx(want) if not want else [a for a, _ in sorted(out)] == [a for a, _ in want] and [b for _, b in sorted(out)] == pytest.approx([b for _, b in want])


def test_entry_imports_and_registers():
    import __spark_entry__ as e

    q, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(q) and "risk_selection" in q


DIRECT_ORDER = [  # fixed values: the order binds coefficients
    "risk", "low_support_mean", "low_support_min", "contradict_mean", "low_match_mean", "low_evidence_presence", "confidence_mean", "confidence_weighted_risk", "support_uncertainty",
    "support_spread", "direct_support_risk", "visual_evidence_risk", "ocr_read_risk", "number_check_risk", "ocr_requested", "number_requested", "ocr_or_number_risk",
]


def test_features_keep_their_declared_order():
    names = evidence.candidates()
    at = names.index("direct_verifier_risk")
    assert names[at : at + len(DIRECT_ORDER)] == [f"direct_verifier_{x}" for x in DIRECT_ORDER]
    assert len(names) == len(set(names)) == 12 + 5 + 13 + 10 + 11 + 51 and names[-1] == "direct_verifier_prob_low_support_x_quality"


def test_selection_refuses_a_test_table_that_lacks_a_feature(spark):
    d = evidence.all_layers(table(spark)).withColumn("mech_a", F.rand(3))
    names = evidence.select_features(d, d, "true")
    assert names[-1] == "mech_a" and "ix_support_disagreement" in names
    with pytest.raises(ValueError, match="lacks selected features: ix_support_disagreement"):
        evidence.select_features(d, d.drop("ix_support_disagreement"), "true")
    with pytest.raises(ValueError, match="one family"):
        evidence.select_features(d.drop("mech_a"), d, "true")


def test_evidence_scorer_scores_rows_alone_as_together(spark):
    from verisieve.plans import evidence_scorer as es

    raw = table(spark).withColumn("mech_a", F.rand(5))
    labels = raw.select("unit_id", (F.xxhash64("unit_id") % 2 == 0).cast("int").alias("y"))
    s = es.EvidenceScorer(es.Assembler.fit(raw)).fit(raw, labels)
    every = {r.unit_id: r.risk for r in s.score(raw).collect()}
    few = s.score(raw.limit(3)).collect()
    assert len(every) == raw.count() and all(r.risk == pytest.approx(every[r.unit_id], abs=1e-12) for r in few)
    with pytest.raises(ValueError, match="target columns"):
        s.score(raw.withColumn("label", F.lit(1)))
    with pytest.raises(ValueError, match="no rows"):
        es.Assembler.fit(raw.where("false"))


def test_splits_that_share_an_image_are_refused(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "image string") for xs in (["p", "q"], ["r", None]))
    evidence.require_apart(a, b, "image", "halves")
    evidence.require_partition([a, b], a.union(b), "image")
    with pytest.raises(ValueError, match="share image 'q'"):
        evidence.require_apart(a, spark.createDataFrame([("q",)], "image string"), "image", "halves")
    with pytest.raises(ValueError, match="make up the whole"):
        evidence.require_partition([a], a.union(b), "image")
    d = evidence.image_split(a.union(b).union(b), "image")
    assert d.where("is_score_train is null").count() == 0 and d.where("image is null").select("is_score_train").distinct().count() == 1


def test_labelled_sources_and_dev_sets(spark, tmp_path):
    from verisieve.operators import reports
    from verisieve.sources import io

    p = tmp_path / "a.jsonl"
    p.write_text('﻿{"question": "q", "answer": "Red", "image": "i", "gold": "red"}\n\n{"question": "q", "answer": "blue", "image": "j", "gold": ["red", "blue!"]}\n{"question": "q", "answer": "x", "image": "k", "answers": ["x", "y", "z"]}\n')
    got = {r.image: (r.failed, round(r.score, 6)) for r in io.read_labelled(spark, str(p)).collect()}
    assert got == {"i": (0, 1.0), "j": (0, 1.0), "k": (1, 0.333333)}
    r = reports.labelled_summary(io.read_labelled(spark, str(p))).first()
    assert (r.n_rows, r.n_failed, r.n_groups, r.warnings) == (3, 1, 3, "fewer than 300 rows: too few to fit on")
    bad = tmp_path / "b.jsonl"
    bad.write_text('{"question": "q", "answer": "a", "image": "i", "failed": 1}\nnot json\n')
    with pytest.raises(io.InputError, match="line 2"):
        io.read_dev(spark, str(bad))
    with pytest.raises(io.InputError, match="line 1"):
        io.read_labelled(spark, str(bad))
    ok = io.read_dev(spark, str(bad), strict=False).collect()
    assert [x.response_id for x in ok] == ["b.jsonl#1"]
    with pytest.raises(io.InputError, match="lacks image, failed"):
        (tmp_path / "c.jsonl").write_text('{"question": "q", "answer": "a"}\n')
        io.read_provider_dev(spark, str(tmp_path / "c.jsonl"))


def test_a_fit_and_a_score_of_the_same_responses_share_their_claims(spark, monkeypatch):
    asked, evidence_of = [], MockProvider.evidence
    monkeypatch.setattr(MockProvider, "evidence", lambda self, claims: asked.append(1) or evidence_of(self, claims))
    got = catalog.score_responses(spark, "/root/testdata/sf0.001")
    assert len(asked) == 1 and got.count() == catalog.fx.pairs(spark, "/root/testdata/sf0.001").count()


def test_resampling_is_worked_out_once_for_a_fit_and_a_score(spark, monkeypatch):
    drawn, samples_of = [], MockProvider.samples
    monkeypatch.setattr(MockProvider, "samples", lambda self, responses, k: drawn.append(k) or samples_of(self, responses, k))
    catalog.score_responses(spark, "/root/testdata/sf0.001")
    assert drawn == [2]
