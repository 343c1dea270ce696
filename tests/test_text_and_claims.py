"""Text functions and decomposition against plain Python and known facts."""

from __future__ import annotations

import difflib
import random
import statistics

import pytest
from pyspark.sql import functions as F

from verisieve.functions import similarity
from verisieve.functions import text as T
from verisieve.functions.similarity import containment_similarity
from verisieve.operators import decompose as D
from verisieve.operators import features
from verisieve.sources.providers import MockProvider, ModelProvider


def one(spark, make, *values):
    names = [f"v{i}" for i in range(len(values))]
    d = spark.createDataFrame([values], ", ".join(f"{n} {'array<string>' if isinstance(v, list) else 'string'}" for n, v in zip(names, values, strict=True)))
    return d.select(make(*(F.col(n) for n in names)).alias("x")).first()[0]


def test_normalising(spark):
    assert one(spark, T.normalize, "The Cat, sat!") == "cat sat"
    assert one(spark, T.clean, " a\u00a0\u2003b\n\tc ") == "a b c" and one(spark, T.clean, None) == ""
    assert one(spark, T.content_tokens, "The cat AND the Dog, cat") == ["cat", "dog"]


@pytest.mark.parametrize(("text", "want"), [("Yes", 1.0), ("no.", 0.0), ("It is correct", 1.0), ("maybe", 0.5), ("", 0.5), ("hm\nyes", 0.5), ("not sure, false", 0.0), ("Supported!", 1.0)])
def test_yes_and_no(spark, text, want):
    assert one(spark, T.parse_support, text) == want


def test_split_versions_differ(spark):
    s = "The sign is red, and it says stop; it stands on a pole: near a car. The sign is red. " + " ".join(f"w{i}" for i in range(30))
    assert one(spark, D.split_v1, s)[:3] == ["The sign is red", "it says stop", "it stands on a pole: near a car."]
    v2 = one(spark, D.split_v2, s)
    assert v2[:4] == ["The sign is red", "it says stop", "it stands on a pole", "near a car."]
    assert len(v2[-2].split()) == 22 and len(v2[-1].split()) == 8 and "The sign is red." not in v2
    assert one(spark, D.split_v2, " ") == [D.EMPTY] and one(spark, D.split_v2, "...") == ["..."]


def test_types(spark):
    assert one(spark, D.type_v1, "Read the word", "3") == "counting" and one(spark, D.type_v2, "q", "the sign says 3") == "OCR_text"
    assert one(spark, D.type_v2, "How many?", "cats") == "counting" and one(spark, D.type_v2, "Who is it?", "a man") == "entity_identity"
    assert one(spark, D.type_v2, "Is there a dog?", "a dog of unusual size and much hair") == "object_presence"
    assert one(spark, D.type_v2, "q", "plain") == "answer_identity" and one(spark, D.type_v2, "q", "six plain things in a row here") == "counting"


def test_conditioning_and_scores(spark):
    assert one(spark, D.conditioned, "What is it?", "a cat") == "The answer to the question 'What is it?' is a cat."
    assert one(spark, D.conditioned, "How many dogs?", "two") == "The answer count for the question 'How many dogs?' is two."
    assert one(spark, D.conditioned, "", "a cat.") == "a cat."
    quoted = "The answer to the question 'what and why while so' is it's red."
    assert one(spark, D.atomicity_v2, quoted) == 1.0 and one(spark, D.atomicity_v1, quoted) == pytest.approx(0.82 - 0.18)
    assert one(spark, D.atomicity_v2, "a and b but c; d because e while f") == 0.2 if 5 * 0.18 > 0.8 else True
    assert one(spark, D.faithfulness, "a red cat", "red cat", "x") == 1.0 and one(spark, D.faithfulness, "a red cat", "", "red red dog") == pytest.approx(2 / 3)
    assert one(spark, D.faithfulness, "a", "", "to") == 0.5 and one(spark, D.faithfulness, "a", "a", D.EMPTY) == 0.0
    assert one(spark, D.strip_prefix, "answer this question in a word or phrase. Who?") == "Who?"


def test_caps():
    assert D.max_claims_of("8") == 8 and D.max_claims_of(8.0) == 8
    for bad in (0, 1.5, "x", None):
        with pytest.raises(ValueError):
            D.max_claims_of(bad)


RESPONSES = "response_id int, question string, answer string"


def test_rule_claims_and_their_verdict(spark):
    rows = [(1, "What is it?", "a cat"), (2, "q", "; ".join(f"part {chr(97 + i)}" for i in range(12))), (3, "q", None)]
    got = D.validated(D.rule_claims(spark.createDataFrame(rows, RESPONSES))).collect()
    by = {i: sorted((r for r in got if r.response_id == i), key=lambda r: r.claim_pos) for i in (1, 2, 3)}
    assert [r.claim_text for r in by[1]] == ["The answer to the question 'What is it?' is a cat."] and by[1][0].claim_set_validated
    assert [r.claim_pos for r in by[2]] == list(range(1, 9)) and by[2][0].claim_set_validation_errors == "fallback_truncated|incomplete_response_coverage"
    assert by[2][0].claim_text == "Part a." and by[2][0].uncovered_response_terms == ["i", "j", "k", "l"]
    assert by[3][0].source_span == D.EMPTY


def test_model_claims_are_parsed_leniently():
    good = '{"claims":[{"claim_text":"a","is_atomic":true}]}'
    for t in (good, "```json\n" + good + "\n```", "Here: " + good + " done", '[{"claim_text":"a","is_atomic":true}]'):
        assert [c["claim_text"] for c in D.parse_claims(t)] == ["a"] and D.parse_claims(t)[0]["is_atomic"] == "true"
    for t in ("", None, "no json", "{broken", "```\n{", "[]", '{"claims":3}', "7"):
        assert D.parse_claims(t) == []


def test_hybrid_takes_a_valid_model_set_or_falls_back(spark):
    ok = '{"claims":[{"claim_text":"The cat is red.","source_span":"cat is red","claim_type":"attribute","requires_external_knowledge":"false"}]}'
    rows = [(1, "q", "The cat is red", ok), (2, "q", "A long answer about other things", ok), (3, "q", "The cat is red", "nothing")]
    got = {r.response_id: r for r in D.hybrid_claims(spark.createDataFrame(rows, RESPONSES + ", completion string"), "completion").collect()}
    assert {i: r.method for i, r in got.items()} == {1: "llm_checked", 2: "rule_fallback", 3: "rule_fallback"}
    assert not got[1].requires_external_knowledge and got[1].claim_type == "attribute" and not got[1].source_span_inferred
    loose = D.model_claims(spark.createDataFrame(rows[:1], RESPONSES + ", completion string"), "completion", text_flags=False).first()
    assert loose.requires_external_knowledge


def test_hybrid_claims_parse_completions_once(spark):
    """The model's claims are written, so a plan that reads keys and claims parses and checks no completion twice."""
    ok = '{"claims":[{"claim_text":"The cat is red.","source_span":"cat is red"}]}'
    rows = [(i, "q", "The cat is red", ok if i % 2 else None) for i in range(6)]
    got = D.hybrid_claims(spark.createDataFrame(rows, RESPONSES + ", completion string"), "completion")
    assert "EvalPython" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r.response_id: r.method for r in got.collect()} == {i: "llm_checked" if i % 2 else "rule_fallback" for i in range(6)}


def test_answers_of_one_key_are_judged_apart(spark):
    """Tokens of claims count for the whole key, coverage is of each row's own answer."""
    rows = [(1, "q", "red cat"), (1, "q", "blue dog"), (1, "q", None)]
    claims = D.rule_claims(spark.createDataFrame(rows, RESPONSES)).where("answer is null or answer <> 'blue dog' or claim_pos > 1")
    got = {r.answer: r for r in D.validated(claims).collect()}
    assert set(got) == {"red cat", None} and got["red cat"].response_coverage_score == 1.0 and got[None].response_coverage_score == 1.0
    whole = {r.answer: (r.claim_set_size, r.response_coverage_score, r.uncovered_response_terms) for r in D.validated(D.rule_claims(spark.createDataFrame(rows, RESPONSES))).collect()}
    assert whole == {"red cat": (3, 1.0, []), "blue dog": (3, 1.0, []), None: (3, 1.0, [])}


def test_claims_have_the_types_of_the_rules(spark):
    """What is found once for a question gives each claim the type that question and claim together have."""
    qs = ["What is next", "what is  next ", "Who is it?", "how many are left", "", None, "Is there a blue sign", "nextto", "What text? 3"]
    spans = ["to the car", "to", "tomorrow", "a red cat", "two of them; a brand", "plain", "it says 3, next to one"]
    d = spark.createDataFrame([(i, q, a) for i, (q, a) in enumerate((q, a) for q in qs for a in spans)], RESPONSES)
    for version, typed, claim in ((1, D.type_v1, "claim_text"), (2, D.type_v2, "source_span")):
        got = D.rule_claims(d, version=version).withColumns({"want": typed(F.col("question"), F.col(claim)), "route": D.verifiability(F.col("question"), F.col("claim_type")), "know": D.needs_knowledge(F.col("question"), F.col("claim_type"))}).collect()
        assert len(got) >= len(qs) * len(spans)
        for r in got:
            assert (r.claim_type, r.is_visual_verifiable, r.requires_external_knowledge) == (r.want, r.route, r.know), r
    assert "spatial_relation" in {r.claim_type for r in got if r.question == "What is next" and r.source_span == "to the car"}


def test_best_span_prefers_the_first_of_equals(spark):
    assert one(spark, D.best_span, "red cat; red dog", "red cat") == "red cat" and one(spark, D.best_span, "...", "x") == ""


def test_boxes_against_plain_python(spark):
    texts = ["Dakota Digital", "open 24 days", "", "open 24 days!"]
    d = spark.createDataFrame([(c, [(t, 0.5 + 0.1 * i) for i, t in enumerate(texts)]) for c in ("open 48 days", "open 24 days", "", "dakota 24")], f"claim_text string, boxes {features.BOX_TYPE}")
    got = {r.claim_text: r for r in features.boxes(d).collect()}
    r = got["open 48 days"]
    assert r.mech_ocr_number_missing_risk == 1.0 and r.mech_ocr_n_strings == 3.0
    assert r.mech_ocr_best_similarity == pytest.approx(difflib.SequenceMatcher(None, "open 48 days", "open 24 days").ratio())
    assert r.mech_ocr_best_match_confidence == pytest.approx(0.6)  # the first of equal boxes
    assert got["open 24 days"].mech_ocr_absent_risk == 0.0 and got[""].mech_ocr_absent_risk == 1.0
    assert got["dakota 24"].mech_ocr_all_words_present == 1.0 and got["dakota 24"].mech_ocr_containment_present == 0.0


def test_resampled_statistics(spark):
    d = spark.createDataFrame([(1, ["open", "shut door", "open 24"], ["Open 24 days"]), (2, ["a cat"], [])], "response_id int, samples array<string>, box_texts array<string>")
    got = {r.response_id: r for r in features.resampled(d).collect()}
    fz = [difflib.SequenceMatcher(None, s, "open 24 days").ratio() for s in ("open", "shut door", "open 24")]
    r = got[1]
    assert (r.mvr_unsupported_rate, r.mvr_all_supported) == (pytest.approx(1 / 3), 0.0)
    assert r.mvr_fuzzy_std == pytest.approx(statistics.pstdev(fz)) and r.mvr_fuzzy_best_of_k == pytest.approx(max(fz))
    assert got[2].mvr_unsupported_rate == 1.0 and got[2].mvr_fuzzy_mean == 0.0
    with pytest.raises(Exception, match="resampled"):
        features.resampled(d.withColumn("samples", F.array().cast("array<string>"))).collect()


def test_alignment_empty_and_containment(spark):
    d = spark.createDataFrame([("a cat", ""), ("red cat", "the red cat sat")], "claim_text string, evidence string")
    got = {r.claim_text: r for r in features.alignment(d).collect()}
    assert tuple(got["a cat"][c] for c in features.ALIGN) == (0.0, 0.0, 0.0, 1.0)
    sim = difflib.SequenceMatcher(None, "red cat", "the red cat sat").ratio()
    assert got["red cat"].align_score == pytest.approx((sim + 1) / 2)
    assert one(spark, containment_similarity, "red cat", "the red cat sat") == 1.0 and one(spark, containment_similarity, "", "x") == 0.0


def test_labels(spark):
    for n, want in ((0, 0.0), (1, 1 / 3), (2, 2 / 3), (3, 1.0), (10, 1.0)):
        answers = ["the Cat!"] * n + ["dog"] * 3
        d = spark.createDataFrame([("cat", answers)], "a string, xs array<string>")
        f, s = features.vqa_label(F.col("a"), F.col("xs"))
        assert d.select(f, s).first() == (int(want < 0.5), pytest.approx(want))
    f, s = features.gold_label(F.lit("A dog"), F.array(F.lit("dog.")))
    assert spark.range(1).select(f, s).first() == (0, 1.0)


def test_a_model_answers_through_the_provider(spark):
    def load():
        def model(image, prompts, sample):
            return [("Yes", 0.9) if "yes or no" in p else (f"{image} text", 0.7) for p in prompts]

        return model

    p = ModelProvider(load, lambda: lambda image: [("Box " + image, 0.8), (None, 1.0)])
    d = spark.createDataFrame([(1, "q", "a", "img", "img text", "OCR_text")], "response_id int, question string, answer string, image string, claim_text string, claim_type string")
    r = p.evidence(p.boxes(d)).first()
    assert [v.view for v in r.views] == list(features.VIEWS) and [v.support for v in r.views] == [1.0, 1.0, 1.0, 1.0]
    assert r.direct.ocr_read_support == 1.0 and r.direct.number_check_support == 1.0 and r.boxes[0].text == "Box img" and len(r.boxes) == 1
    assert p.samples(d, 2).first().samples == ["img text", "img text"] and p.completions(d).first().completion == "img text"
    with pytest.raises(ValueError):
        p.samples(d, 0)


def test_mock_evidence_formulas(spark):
    d = spark.createDataFrame([(1, "q", "red cat", "open; shut", "red cat sat", "other")], "response_id int, question string, answer string, image string, claim_text string, claim_type string")
    p = MockProvider()
    r = p.evidence(p.boxes(d)).first()
    assert [b.text for b in r.boxes] == ["open", "shut"] and r.direct.evidence_phrase == "open shut" and r.direct.contradiction == pytest.approx(0.55)
    assert all(abs(v.support - (0.35 + 0.5 * 2 / 3)) <= 0.075 for v in r.views)


def test_short_second_texts_have_difflibs_ratio_without_its_matcher(monkeypatch):
    r = random.Random(3)
    text = lambda n, letters: "".join(r.choice(letters) for _ in range(n))
    pairs = [(text(r.choice((0, 1, 8, 40, 300)), x), text(r.choice((0, 1, 7, 8, 9, 64, 199)), x)) for x in ("ab", "abcdé 😀", "abcdefghij ") for _ in range(60)]
    pairs += [(a, (a + b)[:199]) for a, b in pairs]
    want = [1.0 if a == b else difflib.SequenceMatcher(None, a, b).ratio() for a, b in pairs]
    long = "spoken words " * 20
    also = difflib.SequenceMatcher(None, "words spoken", long).ratio()
    assert similarity._known_ratios()("words spoken", long) == also
    monkeypatch.setattr(difflib, "SequenceMatcher", None)
    ratio = similarity._known_ratios()
    assert [ratio(a, b) for a, b in pairs] == want


def test_separators_and_type_words_in_rare_letters_are_found(spark):
    answers = ["Red becau\u017fe blue W\u0130TH green", "a; ; b", "one:two , , three", ";", "x, and y. \u212a While z"]
    got = spark.createDataFrame([(a,) for a in answers], "a string").select(D.split_v2(F.col("a")).alias("s"), D.split_v1(F.col("a")).alias("t")).collect()
    assert [x.s for x in got] == [["Red", "blue", "green"], ["a", "b"], ["one", "two", "three"], [";"], ["x", "y.", "\u212a", "z"]]
    assert [x.t for x in got] == [["Red", "blue", "green"], ["a", "b"], ["one:two , , three"], [";"], ["x", "y.", "\u212a", "z"]]
    rows = spark.createDataFrame([("1", "q", "a \u017fign"), ("2", "q", "\u0663 of them"), ("3", "q", "dr\u0131nking")], "response_id string, question string, answer string")
    assert [x.claim_type for x in D.rule_claims(rows).orderBy("response_id").collect()] == ["OCR_text", "counting", "action"]


def test_claims_split_each_answer_once(spark):
    rows = spark.createDataFrame([("1", "q", "a; b")], "response_id string, question string, answer string")
    plan = D.rule_claims(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan
