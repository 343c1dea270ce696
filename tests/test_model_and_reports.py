"""The saved evidence model, arms of the ablation, verification by path, record order of CSV tables, gain over a control."""

from __future__ import annotations

import csv
import gzip
import json

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from verisieve.operators import metrics, reports
from verisieve.plans import evidence_scorer
from verisieve.plans.evidence_model import EvidenceEstimator, EvidenceModel
from verisieve.sources import io
from verisieve.plans import fit_queries

from .test_evidence_and_scoring import table


def labelled(spark):
    return table(spark, 80).withColumns({"mech_a": F.rand(7), "y": (F.xxhash64("unit_id") % 2 == 0).cast("int")})


def test_a_model_travels_as_one(spark, tmp_path):
    d = labelled(spark).persist()
    model = EvidenceEstimator(l2=0.1, riskCol="score", mask="unit_id < 'u6'").fit(d)
    assert isinstance(model, EvidenceModel) and model.getOrDefault("riskCol") == "score"
    model.save(str(tmp_path / "m"))
    back = EvidenceModel.load(str(tmp_path / "m"))
    raw = d.drop("y")
    want = {r.unit_id: r for r in model.transform(raw).collect()}
    other = spark.newSession()
    again = other.createDataFrame(raw.collect(), raw.schema)
    got = {r.unit_id: r for r in back.transform(again).collect()}
    assert got == want and len(got) == 80 and back.uid == model.uid
    assert model.transform(raw).columns == [*raw.columns, "score"]
    assert all(r.mech_a == q.mech_a for r, q in zip(raw.orderBy("unit_id").collect(), sorted(want.values(), key=lambda r: r.unit_id), strict=True))
    alone = {r.unit_id: r.score for r in model.transform(raw.limit(2)).collect()}
    assert all(v == want[k].score for k, v in alone.items())  # no row depends on its neighbours
    with pytest.raises(Exception):
        model.save(str(tmp_path / "m"))
    model.write().overwrite().save(str(tmp_path / "m"))


def test_a_model_in_a_pipeline(spark, tmp_path):
    d = labelled(spark)
    fitted = Pipeline(stages=[EvidenceEstimator()]).fit(d)
    fitted.save(str(tmp_path / "p"))
    back = PipelineModel.load(str(tmp_path / "p"))
    raw = d.drop("y")
    a, b = ({r.unit_id: r.risk for r in m.transform(raw).collect()} for m in (fitted, back))
    assert len(a) == 80 and a.keys() == b.keys()
    EvidenceEstimator(l2=0.5).save(str(tmp_path / "e"))
    assert EvidenceEstimator.load(str(tmp_path / "e")).getOrDefault("l2") == 0.5


def test_foreign_models_and_tables_are_refused(spark, tmp_path):
    d = labelled(spark)
    model = EvidenceEstimator().fit(d)
    raw = d.drop("y")
    for bad, why in (
        (raw.withColumn("label", F.lit(1)), "target columns"),
        (raw.withColumn("mech_a", F.array(F.lit(1.0))), "another type"),
        (raw.select(F.lit(1).alias("z")), "none of the columns"),
        (raw.withColumn("risk", F.lit(0.0)), "column risk already"),
    ):
        with pytest.raises(ValueError, match=why):
            model.transform(bad)
    with pytest.raises(ValueError, match="this format"):
        EvidenceModel.of_state(model.state() | {"format": "other"})
    with pytest.raises(ValueError, match="other features"):
        EvidenceModel.of_state(model.state() | {"names": ["x"]})
    EvidenceEstimator().save(str(tmp_path / "e"))
    with pytest.raises(Exception):
        EvidenceModel.load(str(tmp_path / "e"))
    with pytest.raises(ValueError, match="must be there"):
        EvidenceEstimator().fit(d.withColumn("y", F.when(F.col("unit_id") != "u1", F.col("y"))))
    assert model.transform(raw.drop("mech_a")).count() == 80  # an absent feature takes its median


def test_four_arms(spark):
    rng = np.random.default_rng(2)
    rows = []
    for r in range(120):
        y, mvr = r % 2, float(rng.random())
        for c in range(2):
            rows.append((f"r{r}", y, y * 0.3 + float(rng.random()), y * 0.8 + float(rng.random()), mvr + y * 0.5))
    d = spark.createDataFrame(rows, "response_id string, y int, lm_a double, mech_b double, mvr_x double")
    train, test = d.where("hash(response_id) % 2 = 0"), d.where("hash(response_id) % 2 <> 0")
    scored = evidence_scorer.arms(train, test, ["lm_a", "mech_b"], resampled=("mvr_x",))
    got = {r.arm: r for r in evidence_scorer.arm_report(scored).collect()}
    assert tuple(sorted(got)) == tuple(sorted(evidence_scorer.ARMS)) and len({r.n for r in got.values()}) == 1
    assert got["language+instrument"].auroc > got["language"].auroc and got["language+instrument+resampling"].auroc > got["language"].auroc


def test_examples_are_the_smallest_keys(spark):
    a = spark.createDataFrame([(i, float(i), "x") for i in range(500)], "k int, v double, t string").repartition(7)
    b = a.withColumns({"v": F.when(F.col("k") % 3 == 0, F.col("v") + 1).otherwise(F.col("v") + 1e-14), "t": F.when(F.col("k") == 77, None).otherwise(F.col("t"))})
    got = {r.name: r for r in reports.difference_examples(a, b.where("k <> 3"), ["k"], ["v", "t"], n=3).collect()}
    assert (got["v"].n_compared, got["v"].n_equal) == (499, 499 - 166) and [x.key.k for x in got["v"].examples] == [0, 6, 9]
    assert got["t"].n_equal == 498 and [(x.key.k, x.a, x.b) for x in got["t"].examples] == [(77, "x", None)]
    same = reports.difference_examples(a, a, ["k"], ["v"]).first()
    assert same.rate == 1.0 and same.examples is None
    assert reports.sample_rows(a, ["k"], 3, 5).collect() == reports.sample_rows(a.repartition(2), ["k"], 3, 5).collect()
    assert reports.sample_rows(a, ["k"], 3, 5).collect() != reports.sample_rows(a, ["k"], 3, 6).collect()


def test_verification_by_path(spark):
    mine = spark.createDataFrame([(s, p, f"{s}{p}") for s in range(1, 7) for p in (1, 2)], "sample_id int, claim_pos int, claim_text string")
    method = {1: ("m", "m"), 2: ("r", "m"), 3: ("r", "r"), 4: ("r", "r"), 5: ("r",), 6: ("r", "r")}
    text = {(4, 2): "changed"}
    stored = [(s, f"c{p}", m, text.get((s, p), f"{s}{p}")) for s, ms in method.items() for p, m in enumerate(ms, 1)]
    counts, fields = reports.verify_decomposition(spark.createDataFrame(stored, "sample_id int, claim_id string, decomposition_method string, claim_text string"), mine, "r", "m", ["claim_text"])
    c = counts.first()
    assert (c.n_responses, c.n_model_only, c.n_mixed, c.n_compared, c.n_uneven, c.uneven_examples) == (6, 1, 1, 5, 2, [2, 5])
    f = fields.first()
    assert (f.n_compared, f.n_equal) == (6, 5) and [(x.key.sample_id, x.key.claim_pos, x.a, x.b) for x in f.examples] == [(4, 2, "42", "changed")]


def test_claims_are_worked_out_once_for_their_verification(spark):
    got = fit_queries.decomposition_verified(spark, "/root/testdata/sf0.001")
    assert "conversations" not in got._jdf.queryExecution().executedPlan().toString()  # written, not worked out for each step
    rates = {r.name: (r.n_compared, r.n_equal) for r in got.collect()}
    assert len(rates) == 6 and len({n for n, _ in rates.values()}) == 1


@pytest.mark.parametrize("size", ["1k", "128m"])
def test_first_and_last_record_are_the_files(spark, tmp_path, size):
    """Several files a table, records with line ends in quotes, a key in many places: first and last are by file name and record."""
    rng = np.random.default_rng(3)
    for name, columns in (("features", ["unit_id", "bcm_multiview_support_mean"]), ("claims", ["unit_id", "image", "note"]), ("direct", ["unit_id", "claim_type"]), ("mechanical", ["unit_id", "mech_text"])):
        folder = tmp_path / f"dev_{name}.csv.gz"
        folder.mkdir()
        for part in range(3):
            with gzip.open(folder / f"p{part}.csv.gz", "wt", newline="") as f:
                w = csv.writer(f)
                w.writerow(columns)
                keys = [f"u{i}" for i in range(20)] if name == "features" and part == 1 else [] if name == "features" else [f"u{int(rng.integers(0, 20))}" for _ in range(30 if part else 200)]
                for n, k in enumerate(keys):
                    w.writerow([k, *(f'{part}-{n}\n"two" lines, {c}' if c != "bcm_multiview_support_mean" else "0.5" for c in columns[1:])])
    records = {t: [r for p in range(3) for r in csv.DictReader(gzip.open(tmp_path / f"dev_{t}.csv.gz" / f"p{p}.csv.gz", "rt", newline=""))] for t in io.EVIDENCE_TABLES}
    first = lambda t, k, c: next((r[c] for r in records[t] if r["unit_id"] == k), None)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        got = {r.unit_id: r for r in io.read_evidence(spark, str(tmp_path), "dev").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 20
    for k, r in got.items():
        assert (r.note, r.claim_type, r.mech_text) == (first("claims", k, "note"), first("direct", k, "claim_type"), first("mechanical", k, "mech_text"))
        assert r.image == ([x["image"] for x in records["claims"] if x["unit_id"] == k] or [""])[-1]


def test_gain_over_a_control(spark):
    rng = np.random.default_rng(1)
    p = rng.random(300)
    rows = [(float(a), float(0.2 + 0.6 * a), float(a * a), int(rng.random() < a * a)) for a in p]
    d = spark.createDataFrame(rows, "p double, c double, q double, y int")
    got = {(r.strategy, r.n_bins): r for r in metrics.gain_grid(d, "y", "p", "c", "q").collect()}
    assert len(got) == 8
    for (s, n), r in got.items():
        one = metrics.calibration_gain(d, "y", "p", "q", n, s).first()
        assert (r.ece_before, r.ece_after, r.gain) == pytest.approx((one.ece_before, one.ece_after, one.gain))
        assert r.gain_over_control == pytest.approx((r.ece_control - r.ece_after) / r.ece_control)
    json.dumps([list(k) for k in got])
