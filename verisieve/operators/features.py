"""Features of one claim against its evidence (live path): belief views, direct check, alignment, text boxes, resampled answers.

All are array folds over the row, so nothing is exploded; the only Python step is the similarity UDF.  Text boxes are
``array<struct<text, score>>``, views ``array<struct<view, support, confidence, evidence, uncertainty>>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import EPS, clip
from ..functions.similarity import similarities, similarity
from ..functions.text import characters, clean, content_words, find_all, normalize, numbers, once, share, tokens

VIEWS = ("independent", "visual", "minus_claim", "answer_match")
BELIEF = [f"belief_{x}" for x in ("support_mean", "support_min", "support_max", "support_spread", "confidence_mean", "uncertainty_mean", "low_support_risk", "min_support_risk", "num_views", *(f"support_{v}" for v in VIEWS))]
DIRECT = [f"direct_verifier_{x}" for x in ("support", "contradiction", "evidence_present", "uncertainty", "composite_risk", "visual_evidence_support", "ocr_read_support", "number_check_support", "low_support_risk")]
ALIGN = ["align_char_similarity", "align_content_coverage", "align_score", "align_unsupported_risk"]
CROSS = ["live_visual_x_contradiction", "live_low_support_x_belief", "align_x_low_support_risk"]
BOXES = [f"mech_ocr_{x}" for x in ("n_strings", "text_density", "empty", "exact_present", "containment_present", "all_words_present", "best_similarity", "best_similarity_conf", "best_token_recall", "best_token_precision", "best_match_confidence", "char_coverage", "has_number", "number_present", "number_missing_risk", "absent_risk", "low_similarity_risk", "low_recall_risk", "low_char_coverage_risk")]
RESAMPLED = [f"mvr_{x}" for x in ("unsupported_rate", "all_unsupported", "all_supported", "fuzzy_mean", "fuzzy_min", "fuzzy_std", "fuzzy_best_of_k")]
#: The order binds coefficients.
LIVE = [*BELIEF, *DIRECT, *ALIGN, *CROSS, *BOXES]

VIEW_TYPE = "array<struct<view:string,support:double,confidence:double,evidence:string,uncertainty:double>>"
BOX_TYPE = "array<struct<text:string,score:double>>"


def _mean(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs)


def _is_view(name: str):
    return lambda x: x.view == name


def belief(df: DataFrame, views: str = "views") -> DataFrame:
    """13 columns; without views, four neutral ones are taken; a view that is missing counts 0.5, the first of several wins."""
    neutral = F.array(*(F.struct(F.lit(v).alias("view"), F.lit(0.5).alias("support"), F.lit(0.5).alias("confidence"), F.lit("").alias("evidence"), F.lit(0.5).alias("uncertainty")) for v in VIEWS)).cast(VIEW_TYPE)
    v = F.when(F.size(views) > 0, F.col(views)).otherwise(neutral)
    d = df.withColumn("__v", v)
    s = F.col("__v.support")
    d = d.withColumns({"belief_support_mean": _mean(s), "belief_support_min": F.array_min(s), "belief_support_max": F.array_max(s), "belief_confidence_mean": _mean(F.col("__v.confidence")), "belief_uncertainty_mean": _mean(F.col("__v.uncertainty")), "belief_num_views": F.size("__v").cast("double")})
    named = {f"belief_support_{n}": F.coalesce(F.try_element_at(F.filter("__v", _is_view(n)), F.lit(1)).support, F.lit(0.5)) for n in VIEWS}
    return d.withColumns({"belief_support_spread": F.col("belief_support_max") - F.col("belief_support_min"), "belief_low_support_risk": 1.0 - F.col("belief_support_mean"), "belief_min_support_risk": 1.0 - F.col("belief_support_min"), **named}).drop("__v")


def direct(df: DataFrame, check: str = "direct") -> DataFrame:
    g = lambda f: F.col(f"{check}.{f}").cast("double")
    names = ("support", "contradiction", "evidence_present", "uncertainty", "visual_evidence_support", "ocr_read_support", "number_check_support")
    risk = clip(0.5 * (1.0 - g("support")) + 0.3 * g("contradiction") + 0.2 * g("uncertainty"))
    return df.withColumns({**{f"direct_verifier_{n}": g(n) for n in names}, "direct_verifier_composite_risk": risk, "direct_verifier_low_support_risk": 1.0 - g("support")})


def alignment(df: DataFrame, claim: str = "claim_text", evidence: str = "evidence") -> DataFrame:
    """Character similarity and content coverage of claim and evidence, and their mean; an empty side gives 0, 0, 0 and risk 1."""
    c, e = F.lower(clean(F.col(claim))), F.lower(clean(F.col(evidence)))
    d = df.withColumns({"__c": c, "__e": e}).withColumn("__s", similarity(F.col("__c"), F.col("__e")))
    cw = F.array_distinct(content_words(F.col("__c")))
    none = (F.col("__c") == "") | (F.col("__e") == "")
    cover = share(F.array_intersect(cw, find_all(F.col("__e"), "[a-z0-9]+")), cw)  # the claim's words are distinct and no stop words
    d = d.withColumns({"align_char_similarity": F.when(none, 0.0).otherwise(F.col("__s")), "align_content_coverage": F.when(none, 0.0).otherwise(cover)})
    d = d.withColumn("align_score", 0.5 * (F.col("align_char_similarity") + F.col("align_content_coverage")))
    return d.withColumn("align_unsupported_risk", 1.0 - F.col("align_score")).drop("__c", "__e", "__s")


def mean_alignment(df: DataFrame, key: list[str], claim: str = "claim_text", evidences: str = "evidences") -> DataFrame:
    """Alignment averaged over an array of evidence texts; blank ones are skipped, none left is the empty case."""
    some = F.filter(evidences, lambda e: clean(e) != "")
    long = df.select(*key, claim, F.explode(F.when(F.size(some) > 0, some).otherwise(F.array(F.lit("")))).alias("evidence"))
    return alignment(long, claim).groupBy(*key).agg(*(F.avg(c).alias(c) for c in ALIGN))


def cross(df: DataFrame) -> DataFrame:
    c = F.col
    return df.withColumns({"live_visual_x_contradiction": c("direct_verifier_visual_evidence_support") * c("direct_verifier_contradiction"), "live_low_support_x_belief": c("direct_verifier_low_support_risk") * c("belief_low_support_risk"), "align_x_low_support_risk": c("align_unsupported_risk") * c("belief_low_support_risk")})


def _all(xs: Column, test) -> Column:
    return (F.size(xs) > 0) & F.forall(xs, test)


def boxes(df: DataFrame, claim: str = "claim_text", texts: str = "boxes") -> DataFrame:
    """19 columns.  Words and numbers count as present if they are substrings of the joined boxes; the first of equal best boxes wins."""
    d = df.withColumn("__c", normalize(F.col(claim)))
    read = F.transform(F.coalesce(F.col(texts), F.array().cast(BOX_TYPE)), lambda b: F.struct(normalize(b.text).alias("t"), F.coalesce(b.score, F.lit(1.0)).alias("score")))
    d = d.withColumn("__b", F.filter(read, lambda b: b.t != ""))
    d = d.withColumn("__s", similarities(F.col("__c"), F.col("__b.t")))
    d = d.withColumns({"__w": F.array_distinct(tokens(F.col("__c"))), "__j": F.array_join(F.col("__b.t"), " "), "__n": numbers(F.col("__c"))})
    c, b, w, j, n = (F.col(x) for x in ("__c", "__b", "__w", "__j", "__n"))
    said = c != ""
    flag = lambda x: x.cast("double")
    start = F.struct(F.lit(0.0).alias("sim"), F.lit(0.0).alias("simc"), F.lit(0.0).alias("conf"))
    best = F.aggregate(F.arrays_zip("__b", "__s"), start, lambda a, x: F.when(said & (x["__s"] > a.sim), F.struct(x["__s"].alias("sim"), (x["__s"] * x["__b"]["score"]).alias("simc"), x["__b"]["score"].alias("conf"))).otherwise(a))
    zero = F.struct(F.lit(0.0).alias("rec"), F.lit(0.0).alias("prec"))
    size = lambda xs: F.greatest(F.size(xs), F.lit(1))
    shares = lambda own, hit: F.struct((hit / size(w)).alias("rec"), (hit / size(own)).alias("prec"))
    recalls = F.transform(b, lambda x: once(F.array_distinct(tokens(x.t)), lambda own: once(F.size(F.array_intersect(w, own)), lambda hit: shares(own, hit))))
    chars = characters(c)
    d = d.withColumns(
        {
            "__best": best,
            "__rec": F.aggregate(recalls, zero, lambda a, x: F.when(x.rec > a.rec, x).otherwise(a)),
            "mech_ocr_n_strings": F.size(b).cast("double"),
            "mech_ocr_text_density": F.size(tokens(j)).cast("double"),
            "mech_ocr_empty": flag(F.size(b) == 0),
            "mech_ocr_exact_present": flag(said & F.array_contains(F.col("__b.t"), c)),
            "mech_ocr_containment_present": flag(said & F.exists(b, lambda x: x.t.contains(c) | c.contains(x.t))),
            "mech_ocr_all_words_present": flag(_all(w, lambda x: j.contains(x))),
            "mech_ocr_char_coverage": once(chars, lambda xs: share(F.filter(xs, lambda x: j.contains(x)), xs)),
            "mech_ocr_has_number": flag(F.size(n) > 0),
            "mech_ocr_number_present": flag(_all(n, lambda x: j.contains(x))),
        }
    )
    d = d.withColumns({"mech_ocr_best_similarity": F.col("__best.sim"), "mech_ocr_best_similarity_conf": F.col("__best.simc"), "mech_ocr_best_match_confidence": F.col("__best.conf"), "mech_ocr_best_token_recall": F.col("__rec.rec"), "mech_ocr_best_token_precision": F.col("__rec.prec"), "mech_ocr_number_missing_risk": F.col("mech_ocr_has_number") - F.col("mech_ocr_number_present")})
    absent = 1.0 - F.greatest("mech_ocr_exact_present", "mech_ocr_containment_present", "mech_ocr_all_words_present")
    d = d.withColumns({"mech_ocr_absent_risk": absent, "mech_ocr_low_similarity_risk": 1.0 - F.col("mech_ocr_best_similarity"), "mech_ocr_low_recall_risk": 1.0 - F.col("mech_ocr_best_token_recall"), "mech_ocr_low_char_coverage_risk": 1.0 - F.col("mech_ocr_char_coverage")})
    return d.drop("__c", "__b", "__s", "__w", "__j", "__n", "__best", "__rec")


def support_bit(sample: Column, box_texts: Column) -> Column:
    """Whether normalised boxes back a normalised answer: one contains the other, or all its longer words are somewhere in the boxes."""
    some = F.filter(box_texts, lambda t: t != "")
    ws = F.filter(F.split(sample, " "), lambda w: F.length(w) > 1)
    j = F.array_join(some, " ")
    near = F.exists(some, lambda o: o.contains(sample) | sample.contains(o))
    return F.when((sample == "") | (F.size(some) == 0), 0.0).when(near | _all(ws, lambda w: j.contains(w)), 1.0).otherwise(0.0)


def resampled(df: DataFrame, samples: str = "samples", texts: str = "box_texts", k: int | None = None, key: str = "response_id") -> DataFrame:
    """Seven statistics over the first k resampled answers; no answers is an error, no boxes makes them constant.

    Similarity takes boxes that are empty after normalising, the support bit does not.
    """
    used = F.slice(samples, 1, int(k)) if k else F.col(samples)
    checked = F.when(F.coalesce(F.size(used), F.lit(0)) < 1, F.raise_error(F.lit("at least one resampled answer is needed"))).otherwise(used)
    d = df.withColumns({"__x": F.transform(checked, lambda s: normalize(s)), "__o": F.transform(F.coalesce(F.col(texts), F.array().cast("array<string>")), lambda t: normalize(t))})
    long = d.select(key, "__o", F.posexplode_outer("__x").alias("p", "s"))  # none is empty; the inner form would normalise them once more in a filter
    long = long.withColumns({"bit": support_bit(F.col("s"), F.col("__o")), "fuzzy": F.coalesce(F.array_max(similarities(F.col("s"), F.col("__o"))), F.lit(0.0))})
    rows = long.groupBy(key).agg(
        (1.0 - F.avg("bit")).alias("mvr_unsupported_rate"), (1.0 - F.max("bit")).alias("mvr_all_unsupported"), F.min("bit").alias("mvr_all_supported"),
        F.avg("fuzzy").alias("mvr_fuzzy_mean"), F.min("fuzzy").alias("mvr_fuzzy_min"), F.stddev_pop("fuzzy").alias("mvr_fuzzy_std"), F.max("fuzzy").alias("mvr_fuzzy_best_of_k"),
    )
    return df.join(rows, key, "left")


def assemble(claims: DataFrame) -> DataFrame:
    """All 48 live columns of claims with views, direct, boxes; the direct check's phrase is the evidence text."""
    d = boxes(cross(alignment(direct(belief(claims)).withColumn("__phrase", F.col("direct.evidence_phrase")), "claim_text", "__phrase")))
    return d.drop("__phrase")


def prior(df: DataFrame) -> Column:
    """A stand-in risk before any fit."""
    at = lambda c: F.coalesce(F.col(c), F.lit(0.5)) if c in df.columns else F.lit(0.5)
    return clip(0.5 * (at("direct_verifier_composite_risk") + at("mech_ocr_absent_risk")), EPS, 1 - EPS)


def vqa_label(answer: Column, answers: Column, threshold: float = 0.5) -> tuple[Column, Column]:
    """(failed, score): a third of a point for each annotator who agrees, one at most."""
    p = normalize(answer)
    score = F.least(F.size(F.filter(answers, lambda a: normalize(a) == p)) / F.lit(3.0), F.lit(1.0))
    return (score < threshold).cast("int"), score


def gold_label(answer: Column, gold: Column, threshold: float = 0.5) -> tuple[Column, Column]:
    """(failed, score) against gold answers: one match is enough."""
    p = normalize(answer)
    score = F.exists(gold, lambda g: normalize(g) == p).cast("double")
    return (score < threshold).cast("int"), score
