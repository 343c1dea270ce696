"""The Newton fit against a plain solver, arrays in containers, rules of bundles, digests of files."""

from __future__ import annotations

import hashlib
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from verisieve.operators import calibrate, newton
from verisieve.sources import bundles, digests, io, npz

SF = "/root/testdata/sf0.001"


def plain(x, y, l2, rounds=100):
    """Coefficients, the intercept first, of a damped Newton solver over all rows at once."""
    x = np.where(np.isfinite(x), x, np.nan)
    mean, std = np.nan_to_num(np.nanmean(x, axis=0)), np.nanstd(x, axis=0)
    std = np.where(std > 1e-8, std, 1.0)
    z = (np.nan_to_num(x) - mean) / std
    a = np.c_[np.ones(len(z)), z]
    ridge = np.r_[0, np.full(z.shape[1], 2 * l2)]
    loss = lambda w: float(np.mean(np.logaddexp(0, a @ w) - y * (a @ w))) + l2 * float(w[1:] @ w[1:])
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-a @ w))
        g = a.T @ (p - y) / len(a) + ridge * w
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a / len(a) + np.diag(ridge) + 1e-12 * np.eye(len(w)), g)
        t = 1.0
        while loss(w - t * step) > loss(w) and t > 1e-9:
            t /= 2
        w = w - t * step
    return w


def frame(spark, x, y, parts=7):
    names = [f"f{i}" for i in range(x.shape[1])]
    rows = [(*(None if v != v else float(v) for v in r), int(t)) for r, t in zip(x, y, strict=True)]
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names) + ", y int").repartition(parts), names


def test_newton_meets_a_plain_solver(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5)) * [1, 10, 0.1, 1, 1] + [0, 5, 0, 0, 3]
    x[:, 3] = 7.0  # constant
    x[::9, 4] = np.nan
    y = (x[:, 0] + 0.1 * x[:, 1] + rng.normal(size=400) > 0.5).astype(int)
    d, names = frame(spark, x, y)
    got = newton.fit(d, names, "y", 0.01)
    c = got.calibrator
    assert c.status == "converged" and [c.intercept, *c.weights] == pytest.approx(plain(x, y, 0.01).tolist(), abs=1e-9)
    assert [s.iteration for s in got.log] == list(range(1, len(got.log) + 1)) and got.log[-1].gradient < 1e-9 and got.log[-1].length == 0
    assert all(a.objective >= b.objective for a, b in zip(got.log, got.log[1:], strict=False))
    other = newton.fit(d.repartition(40), names, "y", 0.01).calibrator  # over FAN partial sums: added along the tree
    assert other.weights == pytest.approx(c.weights, abs=1e-10)
    spark_fit = calibrate.fit(d, names, "y", 0.01)
    assert spark_fit.mean == c.mean and spark_fit.weights == pytest.approx(c.weights, abs=1e-4)


def test_newton_on_separable_and_collinear_columns(spark):
    x = np.array([[i, 2.0 * i, -i] for i in range(-30, 31)], dtype=float)
    y = (x[:, 0] > 3).astype(int)
    d, names = frame(spark, x, y, 3)
    c = newton.fit(d, names, "y", 1e-4).calibrator
    assert c.status in ("converged", "no_decrease") and [c.intercept, *c.weights] == pytest.approx(plain(x, y, 1e-4).tolist(), abs=1e-6)
    assert newton.fit(d.where("y = 1"), names, "y").calibrator.status == "single_class"
    assert newton.fit(d.where("false"), names, "y").calibrator.fallback == 0.5
    assert newton.fit(d, names, "y", 1e-4, max_iter=1).calibrator.status == "max_iter"
    with pytest.raises(Exception, match="null rows"):
        newton.fit(d.withColumn("y", F.when(F.col("f0") > 0, F.col("y"))), names, "y")


def test_newton_shortens_steps_that_overshoot(spark):
    """From 0, a whole step on a few far rows raises the loss: shorter ones are tried together."""
    x = np.array([[-3000.0], [1.0], [2.0], [3.0], [-1.0]] * 3)
    y = np.array([1, 1, 1, 1, 0] * 3)
    rows = spark.createDataFrame([(float(t), [float(v) for v in r]) for r, t in zip(x, y, strict=True)], "y double, x array<double>")
    w, step = np.array([0.0, 0.0]), np.array([0.0, -4.0])
    ts = 0.5 ** np.arange(6)
    want = [float(np.sum(np.logaddexp(0, x[:, 0] * 4 * t) - y * x[:, 0] * 4 * t)) for t in ts]
    assert newton.losses_at(rows, w, step, ts).tolist() == pytest.approx(want)
    assert newton.sums_at(rows, w, hessian=False).hessian.size == 0


def test_newton_with_300_features_of_line_items(spark):
    """Random waves over four columns; rows stay on executors, the driver adds sums of 301 * 301."""
    t = spark.read.parquet(f"{SF}/lineitem.parquet")
    base = [F.col("l_quantity") / 50, F.col("l_extendedprice") / 105000, F.col("l_discount") * 10, F.col("l_tax") * 12.5]
    rng = np.random.default_rng(4)
    a = rng.normal(size=(300, 4)) * 3
    waves = [F.cos(sum((b * float(v) for b, v in zip(base[1:], r[1:], strict=True)), base[0] * float(r[0])) + float(r[0])).alias(f"w{i}") for i, r in enumerate(a)]
    d = t.select(*waves, (F.col("l_returnflag") == "R").cast("int").alias("y")).repartition(20)
    names = [f"w{i}" for i in range(300)]
    c = newton.fit(d, names, "y", 0.001).calibrator
    rows = d.toPandas()
    want = plain(rows[names].to_numpy(), rows["y"].to_numpy(), 0.001, 30)
    assert c.status == "converged" and np.abs(np.array([c.intercept, *c.weights]) - want).max() < 1e-9


def test_objective_and_derivatives(spark):
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(90, 3)), rng.integers(0, 2, 90)
    d, names = frame(spark, x, y)
    c = calibrate.Calibrator(names, [0.1, 0.0, -0.2], [1.5, 1.0, 0.5], 0.3, [0.5, -1.0, 0.25], l2=0.02)
    w = np.array([c.intercept, *c.weights])
    value = lambda w: newton.objective(d, calibrate.Calibrator(names, c.mean, c.std, float(w[0]), [float(v) for v in w[1:]], l2=0.02), "y").first().objective
    got = {(r.row, r.col): r.value for r in newton.derivatives(d, c, "y").collect()}
    assert len(got) == 4 * 5
    h = 1e-4
    for i in range(4):
        e = np.eye(4)[i] * h
        assert got[i, -1] == pytest.approx((value(w + e) - value(w - e)) / (2 * h), abs=1e-6)
    assert got[1, 2] == got[2, 1] and all(got[i, i] > 0 for i in range(4))
    far = spark.createDataFrame([(1e6, 0), (-1e6, 1)], "f0 double, y int")
    assert math.isfinite(newton.objective(far, calibrate.Calibrator(["f0"], [0.0], [1.0], 0.0, [1.0]), "y").first().objective)


# -- containers and bundles --------------------------------------------------


def arrays(n_claims=50, n_responses=12):
    rng = np.random.default_rng(0)
    out = {"lm_names": np.array(["lm_a", "lm_b"]), "mechanical_names": np.array(["mech_a"]), "mvr_names": np.array(["mvr_x", "mvr_y"]), "baseline_names": np.array(["m1", "m2"]), "seed": np.array(7)}
    for split in ("dev", "test"):
        out |= {
            f"{split}_matrix": rng.random((n_claims, 3)), f"{split}_claim_response_index": rng.integers(0, n_responses, n_claims), f"{split}_mvr": rng.random((n_responses, 2)),
            f"{split}_response_ids": np.array([f"{split}-{i}" for i in range(n_responses)]), f"{split}_response_images": np.array([f"i{i // 2}" for i in range(n_responses)]),
            f"{split}_response_y": rng.integers(0, 2, n_responses), f"baseline_{split}": rng.random((2, n_responses)),
        }
    return out | {"dev_claim_labels": rng.integers(0, 2, n_claims), "dev_claim_train_mask": np.arange(n_claims) % 2 == 0}


def container(tmp_path, data, save=np.savez, name="b.npz"):
    save(tmp_path / name, **data)
    manifest = tmp_path / f"{name}.json"
    manifest.write_text(json.dumps({"bundle_sha256": hashlib.sha256((tmp_path / name).read_bytes()).hexdigest()}))
    return str(tmp_path / name), str(manifest)


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_arrays_are_read_by_slices_of_rows(spark, tmp_path, save):
    data = {"m": np.arange(3000.0).reshape(1000, 3), "v": np.arange(70, dtype=np.int32), "s": np.array(["ä", "bc", ""]), "b": np.array([True, False]), "f": np.arange(4, dtype=np.float32), "none": np.zeros((0, 3)), "one": np.array(5)}
    path, _ = container(tmp_path, data, save)
    reader = npz.NpzSource({"path": path, "member": "m", "slice_bytes": "4096"}).reader(None)
    assert (len(reader.partitions()) > 5) == (save is np.savez)
    for name, a in data.items():
        got = npz.read_array(spark, path, name, 4096).orderBy("row").collect()
        assert [r.row for r in got] == list(range(len(a) if a.shape else 1))
        assert [r.value for r in got] == (a.tolist() if a.shape else [5]), name
    assert npz.read_array(spark, path, "m", 4096).rdd.getNumPartitions() == len(reader.partitions())


def test_objects_and_absent_arrays_are_refused(spark, tmp_path):
    np.savez(tmp_path / "o.npz", o=np.array([{"a": 1}], dtype=object), t=np.asfortranarray(np.ones((2, 3))))
    for member, why in (("o", "unpickling"), ("x", "no array x"), ("t", "by columns")):
        with pytest.raises(Exception, match=why):
            npz.read_array(spark, str(tmp_path / "o.npz"), member).collect()


def test_a_container_equals_the_bundle_written_from_it(spark, tmp_path):
    data = arrays()
    tables = npz.import_bundle(spark, *container(tmp_path, data))
    io.write_bundle(tables, str(tmp_path / "out"))
    back = io.read_bundle(spark, str(tmp_path / "out"))
    for name, df in tables.items():
        assert sorted(map(repr, back[name].select(df.columns).collect())) == sorted(map(repr, df.collect()))
    dev = back["claims"].where("split = 'dev'").select("lm_a", "lm_b", "mech_a", "response_idx", "label", "is_score_train").collect()
    want = [(*r, i, y, t) for r, i, y, t in zip(data["dev_matrix"].tolist(), data["dev_claim_response_index"].tolist(), data["dev_claim_labels"].tolist(), data["dev_claim_train_mask"].tolist(), strict=True)]
    assert sorted(map(tuple, dev)) == sorted(want)
    scores = {(r.split, r.method, r.response_id): r.score for r in back["baselines"].collect()}
    assert scores["test", "m2", "test-3"] == data["baseline_test"][1, 3] and len(scores) == 48
    d = {(r.table, r.split): (r.n_rows, r.n_columns) for r in io.describe_bundle(back).collect()}
    assert d["claims", "dev"] == (50, 7) and d["responses", "test"] == (12, 7)


def test_changed_and_incomplete_containers_are_refused(spark, tmp_path):
    data = arrays()
    path, manifest = container(tmp_path, data)
    with open(path, "ab") as f:
        f.write(b"x")
    with pytest.raises(bundles.BundleError, match="does not match the hash"):
        npz.import_bundle(spark, path, manifest)
    path, manifest = container(tmp_path, {k: v for k, v in data.items() if k != "dev_mvr"}, name="c.npz")
    with pytest.raises(bundles.BundleError, match="lacks the arrays dev_mvr"):
        npz.import_bundle(spark, path, manifest)
    path, manifest = container(tmp_path, data | {"dev_claim_labels": np.zeros(3)}, name="d.npz")
    with pytest.raises(bundles.BundleError, match=r"dev_claim_labels has shape \(3,\), not \(50,\)"):
        npz.import_bundle(spark, path, manifest)


def valid(spark):
    claims = spark.createDataFrame([("dev", i % 4, 0.5, i % 2, i < 6) for i in range(12)] + [("test", i % 4, 0.25, None, None) for i in range(8)], "split string, response_idx long, lm_a double, label long, is_score_train boolean")
    responses = spark.createDataFrame([(s, i, f"{s}{i}", f"{s}-img{i}", i % 2, 0.1) for s in ("dev", "test") for i in range(4)], "split string, response_idx long, response_id string, image string, y long, mvr_a double")
    baselines = responses.selectExpr("split", "explode(array('m1', 'm2')) as method", "response_id", "0.5D as score")
    return {"claims": claims, "responses": responses, "baselines": baselines}


NAN = float("nan")
BROKEN = [
    ("claims: split is dev or test", "claims", lambda d: d.withColumn("split", F.when(F.col("response_idx") == 3, "train").otherwise(F.col("split")))),
    ("claims: response_idx is there", "claims", lambda d: d.withColumn("response_idx", F.when(F.col("response_idx") != 3, F.col("response_idx")))),
    ("claims: numbers are finite", "claims", lambda d: d.withColumn("lm_a", F.when(F.col("response_idx") == 1, NAN).otherwise(F.col("lm_a")))),
    ("claims: numbers are there", "claims", lambda d: d.withColumn("lm_a", F.when(F.col("response_idx") == 1, F.col("lm_a")))),
    ("claims: development labels are 0 or 1", "claims", lambda d: d.withColumn("label", F.col("label") * 2)),
    ("claims: development rows are for training or not", "claims", lambda d: d.withColumn("is_score_train", F.when(F.col("response_idx") != 2, F.col("is_score_train")))),
    ("claims: some development rows are for training", "claims", lambda d: d.withColumn("is_score_train", F.col("is_score_train") & F.lit(False))),
    ("claims: some development rows are not for training", "claims", lambda d: d.withColumn("is_score_train", F.col("is_score_train") | F.lit(True))),
    ("claims: each belongs to a response", "claims", lambda d: d.withColumn("response_idx", F.col("response_idx") + 1)),
    ("responses: split is dev or test", "responses", lambda d: d.withColumn("split", F.when(F.col("response_idx") == 3, "x").otherwise(F.col("split")))),
    ("responses: response_id is there", "responses", lambda d: d.withColumn("response_id", F.when(F.col("response_idx") != 3, F.col("response_id")))),
    ("responses: numbers are finite", "responses", lambda d: d.withColumn("mvr_a", F.lit(float("inf")))),
    ("responses: numbers are there", "responses", lambda d: d.withColumn("mvr_a", F.lit(None).cast("double"))),
    ("responses: y is 0 or 1", "responses", lambda d: d.withColumn("y", F.col("y") * 3)),
    ("responses: an image is named", "responses", lambda d: d.withColumn("image", F.lit(""))),
    ("responses: ids are unique in a split", "responses", lambda d: d.withColumn("response_id", F.concat("split", F.col("response_idx") % 2))),
    ("baselines: split is dev or test", "baselines", lambda d: d.withColumn("split", F.lit(None).cast("string"))),
    ("baselines: response_id is there", "baselines", lambda d: d.withColumn("response_id", F.lit(None).cast("string"))),
    ("baselines: a method is named", "baselines", lambda d: d.withColumn("method", F.lit(""))),
    ("baselines: each belongs to a response", "baselines", lambda d: d.withColumn("response_id", F.concat("response_id", F.lit("x")))),
    ("baselines: a method scores every response once", "baselines", lambda d: d.where("not (method = 'm2' and response_id = 'dev1')")),
]


def test_a_valid_bundle_breaks_no_rule(spark):
    tables = valid(spark)
    got = {r.rule: r.n_broken for r in bundles.validate(tables).collect()}
    assert set(got.values()) == {0} and {b[0] for b in BROKEN} <= set(got)
    bundles.require_valid(tables)
    odd = tables | {"baselines": tables["baselines"].withColumn("score", F.lit(NAN))}  # a baseline may fail to score
    bundles.require_valid(odd)


@pytest.mark.parametrize("rule,table,change", BROKEN, ids=[b[0] for b in BROKEN])
def test_each_rule_is_broken_by_its_fixture(spark, rule, table, change):
    tables = valid(spark)
    bad = {r.rule: r.n_broken for r in bundles.validate(tables | {table: change(tables[table])}).where("n_broken > 0").collect()}
    assert rule in bad


def test_a_broken_bundle_is_not_written(spark, tmp_path):
    tables = valid(spark)
    with pytest.raises(bundles.BundleError, match=r"responses: y is 0 or 1 \(4 rows, such as dev1\)"):
        io.write_bundle(tables | {"responses": tables["responses"].withColumn("y", F.col("y") * 3)}, str(tmp_path / "b"))
    assert not (tmp_path / "b").exists()


def test_digests_are_streamed(spark, tmp_path):
    rng = np.random.default_rng(0)
    sizes = {"a.bin": 5 * digests.CHUNK + 17, "b.bin": 3, "empty.bin": 0, "sub/c.bin": 1000}
    for name, n in sizes.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(rng.bytes(n))
    got = {r.path.rsplit("/", 1)[-1]: (r.length, r.sha256) for r in io.sha256(spark, str(tmp_path)).collect()}
    assert got == {n.rsplit("/", 1)[-1]: (k, hashlib.sha256((tmp_path / n).read_bytes()).hexdigest()) for n, k in sizes.items()}
    reads = []
    real = digests.open_file(str(tmp_path / "a.bin"))

    class Counting:
        def __enter__(self):
            return self

        def __exit__(self, *a):
            real.close()

        def read(self, n):
            reads.append(n)
            return real.read(n)

    before, digests.open_file = digests.open_file, lambda p: Counting()
    try:
        assert digests.digest("any") == got["a.bin"][1] and max(reads) == digests.CHUNK and len(reads) == 7
    finally:
        digests.open_file = before
