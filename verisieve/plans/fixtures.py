"""Stand-in inputs made of the test tables: orders are responses, line items are claims, conversations are questions and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def claims(spark: SparkSession, d: str) -> DataFrame:
    """response_id, image, risk in [0, 1], label, weight."""
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("response_id"), F.col("l_suppkey").alias("image"), (F.col("l_extendedprice") / 105000.0).alias("risk"), (F.col("l_returnflag") == "R").cast("int").alias("label"), F.col("l_quantity").alias("weight"))


def probabilities(spark: SparkSession, d: str) -> DataFrame:
    """p, y, w, image."""
    return table(spark, d, "lineitem").select(F.least(F.col("l_discount") * 10.0, F.lit(1.0)).alias("p"), (F.col("l_returnflag") == "R").cast("int").alias("y"), F.col("l_quantity").alias("w"), F.col("l_suppkey").alias("image"))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """response_id, question, answer: a user turn and the assistant turn after it."""
    t = table(spark, d, "conversations")
    u = t.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    a = t.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return u.join(a, ["conv_id", "turn"]).select(F.concat_ws("-", "conv_id", "turn").alias("response_id"), "question", "answer")


def evidence_rows(spark: SparkSession, d: str) -> DataFrame:
    """An evidence table over line items, with missing values: unit_id is (order, line, part, supplier) in one string."""
    c = F.col
    pick = lambda e, m, r: F.when(c("l_partkey") % m != r, e)
    q, p, x, t = c("l_quantity") / 50.0, c("l_extendedprice") / 105000.0, c("l_discount") * 10.0, c("l_tax") * 12.5
    return table(spark, d, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("unit_id"), c("l_suppkey").cast("string").alias("image"),
        pick(q, 7, 0).alias("bcm_multiview_support_mean"), p.alias("bcm_multiview_disagreement"), x.alias("bcm_multiview_answer_similarity_mean"), pick(t, 5, 1).alias("bcm_multiview_claim_support_rate"), t.alias("bcm_multiview_unique_answer_ratio"),
        pick(p, 6, 2).alias("claim_bcm_visual_answer_support"), pick(x, 4, 3).alias("claim_bcm_visual_answer_similarity"), q.alias("claim_bcm_independent_answer_support"), pick(t, 9, 4).alias("claim_bcm_claim_match_after_answer_support"), pick(q, 3, 1).alias("claim_bcm_direct_verify_support"), pick(x, 8, 5).alias("claim_bcm_counterfactual_verify_support"),
        pick(p, 10, 3).alias("decomposition_confidence"), q.alias("atomicity_score"), x.alias("faithfulness_score"), F.when(c("l_linenumber") % 3 == 0, "true").when(c("l_linenumber") % 3 == 1, " Yes ").otherwise("0").alias("parser_added_claim"),
        F.when(c("l_returnflag") == "R", "HARD").when(c("l_returnflag") == "A", "ocr").otherwise("direct").alias("is_visual_verifiable"), F.when(c("l_linestatus") == "O", "counting").otherwise("OCR_text").alias("claim_type"),
        pick(q, 11, 1).alias("direct_verifier_support_mean"), pick(p, 12, 5).alias("direct_verifier_contradict_mean"), x.alias("direct_verifier_confidence_mean"), pick(t, 13, 6).alias("direct_verifier_evidence_presence"), q.alias("direct_verifier_risk"),
        F.when(c("l_linenumber") == 1, 0.5).when(c("l_linenumber") == 2, None).otherwise(x).alias("direct_verifier_ocr_read_support"), F.when(c("l_linenumber") == 3, 0.5).otherwise(t).alias("direct_verifier_number_check_support"), p.alias("direct_verifier_visual_evidence_support"),
    )


#: The same table in DuckDB.
def _sql_evidence() -> str:
    q, p, x, t = "l_quantity / 50.0", "l_extendedprice / 105000.0", "l_discount * 10.0", "l_tax * 12.5"
    q, p, x, t = (f"cast(({e}) as double)" for e in ("l_quantity / 50.0::double", "l_extendedprice / 105000.0::double", "l_discount * 10.0::double", "l_tax * 12.5::double"))
    pick = lambda e, m, r: f"case when l_partkey % {m} <> {r} then {e} end"
    cols = {
        "unit_id": "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)", "image": "cast(l_suppkey as varchar)",
        "bcm_multiview_support_mean": pick(q, 7, 0), "bcm_multiview_disagreement": p, "bcm_multiview_answer_similarity_mean": x, "bcm_multiview_claim_support_rate": pick(t, 5, 1), "bcm_multiview_unique_answer_ratio": t,
        "claim_bcm_visual_answer_support": pick(p, 6, 2), "claim_bcm_visual_answer_similarity": pick(x, 4, 3), "claim_bcm_independent_answer_support": q, "claim_bcm_claim_match_after_answer_support": pick(t, 9, 4), "claim_bcm_direct_verify_support": pick(q, 3, 1), "claim_bcm_counterfactual_verify_support": pick(x, 8, 5),
        "decomposition_confidence": pick(p, 10, 3), "atomicity_score": q, "faithfulness_score": x, "parser_added_claim": "case l_linenumber % 3 when 0 then 'true' when 1 then ' Yes ' else '0' end",
        "is_visual_verifiable": "case l_returnflag when 'R' then 'HARD' when 'A' then 'ocr' else 'direct' end", "claim_type": "case l_linestatus when 'O' then 'counting' else 'OCR_text' end",
        "direct_verifier_support_mean": pick(q, 11, 1), "direct_verifier_contradict_mean": pick(p, 12, 5), "direct_verifier_confidence_mean": x, "direct_verifier_evidence_presence": pick(t, 13, 6), "direct_verifier_risk": q,
        "direct_verifier_ocr_read_support": f"case l_linenumber when 1 then 0.5::double when 2 then null else {x} end", "direct_verifier_number_check_support": f"case l_linenumber when 3 then 0.5::double else {t} end", "direct_verifier_visual_evidence_support": p,
    }
    return "select " + ", ".join(f"{e} as {n}" for n, e in cols.items()) + " from lineitem"


SQL_EVIDENCE = _sql_evidence()
SQL_PAIRS = "select u.conv_id || '-' || u.turn as response_id, u.text as question, a.text as answer from conversations u join conversations a on u.conv_id = a.conv_id and a.turn = u.turn + 1 where u.role = 'user' and a.role = 'assistant'"
SQL_PROB = "select least(l_discount * 10.0::double, 1.0::double) as p, case l_returnflag when 'R' then 1 else 0 end as y, l_quantity as w, l_suppkey as image from lineitem"
SQL_CLAIMS = "select l_orderkey as response_id, l_suppkey as image, l_extendedprice / 105000.0::double as risk, case l_returnflag when 'R' then 1 else 0 end as label from lineitem"
