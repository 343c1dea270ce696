"""The model path: tolerant JSON, one reply a prompt, durable memo, seeds, similarity on distinct pairs."""

from __future__ import annotations

import difflib
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from verisieve.operators import decompose, similar_pairs
from verisieve.plans import scoring
from verisieve.sources.providers import EvidenceProvider, MockProvider, ModelProvider, kind_of
from verisieve.sources.replies import Memo, asked

A, B = {"claim_text": "a b", "claim_type": "other"}, {"claim_text": "c", "is_atomic": True}
J = json.dumps
#: completion -> claim texts
SHAPES = [
    (None, []), ("", []), ("   \n", []), ("no json here", []), ("null", []), ("5", []), ("true", []), ('"[{}]"', []), ('"text [1] {"', []),
    (J([A, B]), ["a b", "c"]), (J({"claims": [A, B]}), ["a b", "c"]), (J([]), []), (J({}), []), (J({"claims": None}), []), (J({"claims": {"x": 1}}), []), (J({"claims": "a"}), []),
    (f"```json\n{J([A])}\n```", ["a b"]), (f"```\n{J({'claims': [A]})}\n```", ["a b"]), (f"``` {J([A])}```", ["a b"]), (f"```json{J([A])}", ["a b"]),
    (f"[{J(A)},{J(A)}] thanks", ["a b", "a b"]), (f"{J({'meta': {'x': 1}, 'claims': [A]})} done", ["a b"]), (f"Here you are: {J([A])}", ["a b"]), (f"Here: {J({'claims': [B]})} and more [1]", ["c"]),
    (f"see [1] then {J({'claims': [A]})}", []), (f"a {{broken and then {J([A])}", ["a b"]), (f"[ {J({'claims': [A]})}", ["a b"]), ("{'claims': []}", []), (f"{{{J([A])}", ["a b"]),
    (J([1, "x", None, A, [B]]), ["a b"]), (J({"claims": [None, A]}), ["a b"]), (J([{"claim_text": 5}]), ["5"]), (J([{"claim_text": {"k": [1, 2.5]}}]), ['{"k":[1,2.5]}']), (J([{"claim_text": None}]), [None]),
    ('[{"claim_text": "a", "claim_text": "z"}]', ["z"]), ('{"claims": [{"claim_text": "a"}], "claims": []}', []), ("﻿" + J([A]), ["a b"]), ('[{"claim_text": "a\nb"}]', []), ('[{"claim_text": "\\u00e9 }]["}] tail ]', ["é }]["]),
    (" " + J([A]) + " ", ["a b"]), ("[{\"claim_text\": 'a'}]", []), ('{"claims": [{"claim_text": "a"}', [None]),
]


def test_shapes_of_completions(spark):
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SHAPES)], "i int, t string")
    got = {r.i: [c.claim_text for c in r.c] for r in d.select("i", decompose.json_claims(F.col("t")).alias("c")).collect()}
    for i, (t, want) in enumerate(SHAPES):
        plain = [c["claim_text"] for c in decompose.parse_claims(t)]
        if want == [None] and t.startswith('{"claims"'):
            want = plain  # cut off: what the first whole object inside gives
        assert plain == want, t
        assert got[i] == want, t


def test_flags_and_numbers_read_alike(spark):
    item = {"claim_text": "a", "is_atomic": False, "decomposition_confidence": 0.30, "is_visual_verifiable": None, "claim_id": 7}
    texts = [J([item]), f"x {J({'claims': [item]})} y", f"[oops {J([item])}"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(decompose.json_claims(F.col("t")).alias("c")).collect()
    assert {tuple(r.c[0]) for r in got} == {("7", "a", None, None, "false", None, None, None, "0.3")}


def counting_loader(folder):
    """A model that notes every prompt it gets in a file of its own."""

    def load():
        import uuid

        def model(image, prompts, sample):
            (Path(folder) / uuid.uuid4().hex).write_text(json.dumps([image, prompts, sample]))
            return [(json.dumps([{"claim_text": "open 24 days", "source_span": "open 24 days"}]) if p.startswith("List") else "yes open 24 days", 0.9) for p in prompts]

        return model

    return load


def notes(folder):
    return [json.loads(p.read_text()) for p in Path(folder).iterdir()]


def responses(spark, n=10):
    rows = [(i, f"What does sign {i} say?", "open 24 days", f"img{i % 4}", i % 2) for i in range(n)]
    return spark.createDataFrame(rows, "response_id int, question string, answer string, image string, failed int").repartition(3)


def test_each_prompt_is_asked_once(spark, tmp_path):
    (tmp_path / "notes").mkdir()
    reads = tmp_path / "reads"
    reads.mkdir()

    def load_reader():
        import uuid

        def read(image):
            (reads / uuid.uuid4().hex).write_text(image)
            return [("Open 24", 0.9)]

        return read

    p = ModelProvider(counting_loader(str(tmp_path / "notes")), load_reader)
    scorer = scoring.fit(responses(spark), p, scoring.Config(k=3))
    calls = notes(tmp_path / "notes")
    asked_ = [(i, q, s) for i, qs, s in calls for q in qs]
    lists = [x for x in asked_ if x[1].startswith("List")]
    assert len(lists) == len(set(lists)) == 10  # one decomposition a response
    plain = [x for x in asked_ if not x[2]]
    assert len(plain) == len(set(plain))  # no prompt about an image twice
    assert len([x for x in asked_ if x[2]]) == 10 * 3  # k samples a response
    assert sorted(f.read_text() for f in reads.iterdir()) == [f"img{i}" for i in range(4)]
    got = scoring.score(responses(spark).drop("failed"), p, scorer)
    assert got.count() == 10 and got.count() == 10 and {r.num_claims for r in got.collect()} == {1}
    assert len(notes(tmp_path / "notes")) == len(calls)  # scoring the same responses asks nothing
    again = ModelProvider(counting_loader(str(tmp_path / "notes")), load_reader, store=p.store)
    again.completions(responses(spark, 12)).collect()
    assert len([q for _, qs, _ in notes(tmp_path / "notes") for q in qs if q.startswith("List")]) == 12  # a new session asks what is new


def test_a_failed_task_leaves_the_same_replies(spark, tmp_path):
    """The first run of each task dies half-way; replies come from the second, seeded alike, and nothing is written twice."""

    def load(seed):
        import random

        from pyspark import TaskContext

        rng, first = random.Random(seed), TaskContext.get().attemptNumber() == 0

        def model(image, prompts, sample):
            if first and image == "img1" and not (tmp_path / "died").exists():
                (tmp_path / "died").write_text("")
                raise RuntimeError("lost")
            return [(f"{image} {rng.random()}", 1.0) for _ in prompts]

        return model

    rows = spark.createDataFrame([(f"k{i}", f"img{i % 3}", "p", True) for i in range(40)], "key string, image string, prompt string, sample boolean")
    fail_once = Memo(f"{tmp_path}/a", "key string, text string, confidence double")
    with pytest.raises(Exception, match="lost"):
        fail_once.get(rows, asked(load, 5))  # local mode does not retry tasks: the job fails as a whole
    assert fail_once.known(spark).count() == 0
    a = fail_once.get(rows, asked(load, 5))
    b = Memo(f"{tmp_path}/b", "key string, text string, confidence double").get(rows.repartition(7), asked(load, 5))
    assert a.count() == 40 and sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert sorted(map(tuple, fail_once.get(rows, asked(load, 99)).collect())) == sorted(map(tuple, a.collect()))


def test_rounds_are_committed_one_by_one(spark, tmp_path):
    seen = []

    def compute(d):
        if len(seen) == 2:
            raise RuntimeError("the driver died")
        seen.append(d.count())
        return d.select("key", F.lit("t").alias("text"), F.lit(1.0).alias("confidence"))

    rows = spark.range(100).select(F.concat(F.lit("k"), "id").alias("key"))
    m = Memo(f"{tmp_path}/m", "key string, text string, confidence double", rounds=4)
    with pytest.raises(RuntimeError):
        m.get(rows, compute)
    kept = m.known(spark).count()
    assert kept == sum(seen) > 0
    seen.clear()
    m2 = Memo(f"{tmp_path}/m", "key string, text string, confidence double", rounds=2)
    assert m2.get(rows, lambda d: seen.append(d.count()) or d.select("key", F.lit("u").alias("text"), F.lit(1.0).alias("confidence"))).count() == 100
    assert sum(seen) == 100 - kept


def test_a_model_with_too_few_replies_is_refused(spark, tmp_path):
    rows = spark.createDataFrame([("k", None, "p", False)], "key string, image string, prompt string, sample boolean")
    with pytest.raises(Exception, match="0 replies to 1 prompts"):
        Memo(f"{tmp_path}/c", "key string, text string, confidence double").get(rows, asked(lambda: lambda i, p, s: []))


# -- similarity --------------------------------------------------------------

TEXTS = ["", "a", "open 24 days", "open 24 day", "shut", "ab" * 120, "ba" * 110 + "c", "naïve ☃ 𝒳", "𝒳☃", "open", None]


def test_bounds_hold_and_pairs_equal_the_library(spark):
    rows = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in TEXTS for b in TEXTS)]
    d = spark.createDataFrame(rows, "i int, a string, b string").repartition(3)
    d = d.withColumns({"lb": similar_pairs.length_bound(F.col("a"), F.col("b")), "mb": similar_pairs.multiset_bound(F.col("a"), F.col("b"))})
    got = similar_pairs.similarity_pairs(d, "a", "b").collect()
    assert len(got) == len(rows)
    for r in got:
        m = difflib.SequenceMatcher(None, r.a or "", r.b or "")
        assert r.similarity == (1.0 if (r.a or "") == (r.b or "") else m.ratio())
        assert r.lb == pytest.approx(m.real_quick_ratio()) and r.mb == pytest.approx(m.quick_ratio()) and r.similarity <= min(r.lb, r.mb) + 1e-12


def test_best_of_candidates_equals_all_comparisons(spark):
    some = [t for t in TEXTS if t is not None]
    rows = [(i, t, some[j:] + some[: j // 2]) for i, (t, j) in enumerate((t, j) for t in TEXTS for j in range(0, 9, 2))]
    rows += [(900, "x", []), (901, "x", None), (902, None, ["", "a"]), (903, "open", ["nepo", "open!", "!open", "open!"]), (904, "q", [None])]
    got = {r.i: r for r in similar_pairs.best_similarity(spark.createDataFrame(rows, "i int, t string, cs array<string>").repartition(3), ["i"], "t", "cs").collect()}
    assert set(got) == {r[0] for r in rows}
    for i, t, cs in rows:
        ratios = [1.0 if (t or "") == (c or "") else difflib.SequenceMatcher(None, t or "", c or "").ratio() for c in cs or []]
        want = (max(ratios), ratios.index(max(ratios))) if ratios else (0.0, None)
        assert (got[i].best, got[i].position) == want and got[i].n_candidates == len(ratios) and got[i].n_compared <= len(ratios), (i, t)
    assert sum(r.n_compared for r in got.values()) < 0.5 * sum(r.n_candidates for r in got.values())


def test_best_of_candidates_moves_no_pairs(spark):
    """A row has all that its answer needs: no table of pairs is shuffled or written and read again."""
    d = spark.range(50).select("id", F.concat(F.lit("open "), "id").alias("t"), F.array(F.lit("open 7"), F.lit("shut"), F.lit(None).cast("string")).alias("cs"))
    got = similar_pairs.best_similarity(d, ["id"], "t", "cs")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "parquet" not in plan.lower()
    r = got.where("id = 7").first()
    assert (r.best, r.position, r.n_candidates, r.n_compared) == (1.0, 0, 3, 1)


def test_kinds_of_providers():
    made = lambda name, **more: type(name, (), more)()
    assert kind_of(None) == "none"
    assert (kind_of(MockProvider()), kind_of(ModelProvider(lambda: None))) == ("mock", "model")
    assert kind_of(made("MyMockReader", kind="bench")) == "bench"  # what it says itself goes first
    assert [kind_of(made(n)) for n in ("MyMockReader", "LLaVAServer", "RapidOCRBoxes", "Other")] == ["mock", "llava", "rapidocr", "custom"]
    assert [kind_of(made("Other", kind=k)) for k in ("", None, 3)] == ["custom"] * 3
    assert kind_of(EvidenceProvider()) == "custom"
