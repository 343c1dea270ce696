"""Registered queries of the Newton fit, of bundle rules and of similarity on distinct pairs, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.durable import materialize, shared_dir
from ..operators import decompose, metrics, newton, reports, similar_pairs
from ..sources import bundles
from . import evidence_scorer
from . import fixtures as fx
from .catalog import _DIFFER, _LAYERS, _SCORED, _quantile, _risk_sql, _two_tables, _uniform, FIXED, FIXED_EVIDENCE, _embedding_frame, query, rounded
from .evidence_model import EvidenceModel

# -- the Newton fit ----------------------------------------------------------


@query()
def ridge_newton(spark, d):
    """feature, weight, mean, std of a fit to all embeddings, and how it ended; one class against all others."""
    names = [f"x{i}" for i in range(64)]
    got = newton.fit(_embedding_frame(spark, d), names, "y")
    c = got.calibrator
    rows = [("intercept", c.intercept, None, None)] + list(zip(c.features, c.weights or [], c.mean, c.std, strict=False))
    out = spark.createDataFrame(rows, "feature string, weight double, mean double, std double")
    return rounded(out).withColumns({"status": F.lit(c.status), "iterations": F.lit(len(got.log))})


def _list(xs: list[float]) -> str:
    return "[" + ", ".join(f"{x!r}::double" for x in xs) + "]"


_D = len(FIXED.features)
_ROWS = f"""
with e as (select case label when 0 then 1.0::double else 0.0::double end as y, list_transform(range(1, {_D + 1}), lambda i: case when isfinite(embedding[i]::double) then embedding[i]::double else 0.0::double end) as x from embeddings),
a as (select y, list_concat([1.0::double], list_transform(range(1, {_D + 1}), lambda i: (x[i] - ({_list(FIXED.mean)})[i]) / ({_list(FIXED.std)})[i])) as a from e),
z as (select y, a, list_dot_product(a, {_list([FIXED.intercept, *FIXED.weights])}) as z from a)"""
_PENALTY = FIXED.l2 * sum(w * w for w in FIXED.weights)


@query(f"{_ROWS}, l as (select greatest(z, 0.0) + ln(1 + exp(-abs(z))) - y * z as l from z) select count(*) as n, round(avg(l), 9) as loss, round(avg(l) + {_PENALTY!r}::double, 9) as objective from l")
def ridge_objective(spark, d):
    """The objective of a calibrator with fixed numbers."""
    return rounded(newton.objective(_embedding_frame(spark, d), FIXED, "y"))


@query(
    f"""{_ROWS}, p as (select y, a, 1 / (1 + exp(-z)) as p from z),
    g as (select i - 1 as row, -1 as col, avg((p - y) * a[i]) + case when i > 1 then {2 * FIXED.l2!r}::double * ({_list([0.0, *FIXED.weights])})[i] else 0 end as value from p, range(1, {_D + 2}) t(i) group by i),
    h as (select i - 1 as row, j - 1 as col, avg(p * (1 - p) * a[i] * a[j]) + case when i = j and i > 1 then {2 * FIXED.l2!r}::double else 0 end as value from p, range(1, {_D + 2}) t(i), range(1, {_D + 2}) u(j) group by i, j)
    select row::int as row, col::int as col, round(value, 9) as value from g union all select row::int, col::int, round(value, 9) from h"""
)
def ridge_derivatives(spark, d):
    """Gradient and Hessian at fixed coefficients, over all rows."""
    return rounded(newton.derivatives(_embedding_frame(spark, d), FIXED, "y"))


# -- bundles -----------------------------------------------------------------


def _bundle(spark, d):
    """A bundle with faults: orders are responses (those of some customers are left out), line items claims, two methods the baselines."""
    split = lambda key: F.when(F.col(key) % 3 == 0, "test").when(F.col(key) % 101 == 0, "train").otherwise("dev")
    o = fx.table(spark, d, "orders").where("o_custkey % 10 <> 0")
    y = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0).otherwise(2)
    image = F.when(F.col("o_custkey") % 97 == 0, "").otherwise(F.concat(F.lit("c"), "o_custkey"))
    price = lambda c: F.when(F.col(c) % 89 == 0, float("nan")).when(F.col(c) % 83 == 0, None)
    responses = o.select(split("o_orderkey").alias("split"), F.col("o_orderkey").alias("response_idx"), F.col("o_orderkey").cast("string").alias("response_id"), image.alias("image"), y.alias("y"), price("o_custkey").otherwise(0.5).alias("mvr_a"))
    li = fx.table(spark, d, "lineitem")
    label = F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 0)
    claims = li.select(split("l_orderkey").alias("split"), F.col("l_orderkey").alias("response_idx"), price("l_partkey").otherwise(1.0).alias("lm_a"), label.alias("label"), F.when(F.col("l_linenumber") < 5, F.col("l_linenumber") % 2 == 0).alias("is_score_train"))
    named = F.when(F.col("o_orderkey") % 103 == 0, "").otherwise("m1")
    first = o.select(split("o_orderkey").alias("split"), named.alias("method"), F.col("o_orderkey").cast("string").alias("response_id"), F.lit(0.5).alias("score"))
    second = fx.table(spark, d, "orders").select(split("o_orderkey").alias("split"), F.lit("m2").alias("method"), F.col("o_orderkey").cast("string").alias("response_id"), F.lit(0.25).alias("score"))
    return {"claims": claims, "responses": responses, "baselines": first.unionByName(second)}


def _sql_split(k: str) -> str:
    return f"case when {k} % 3 = 0 then 'test' when {k} % 101 = 0 then 'train' else 'dev' end"


def _sql_value(k: str, v: str) -> str:
    return f"case when {k} % 89 = 0 then 'nan'::double when {k} % 83 = 0 then null else {v}::double end"


def _sql_rules() -> str:
    count = lambda rule, table, test: f"select '{rule}' as rule, count(*) filter ({test}) as n_broken from {table}"
    parts = []
    for t, key in (("claims", "response_idx"), ("responses", "response_id"), ("baselines", "response_id")):
        value = {"claims": "lm_a", "responses": "mvr_a", "baselines": "0.0::double"}[t]
        parts += [
            count(f"{t}: split is dev or test", t, "split not in ('dev', 'test')"), count(f"{t}: {key} is there", t, f"{key} is null"),
            count(f"{t}: numbers are finite", t, f"coalesce(isnan({value}), false)"), count(f"{t}: numbers are there", t, f"{value} is null"),
        ]
    parts += [
        count("claims: development labels are 0 or 1", "claims", "split = 'dev' and label is null"),
        count("claims: development rows are for training or not", "claims", "split = 'dev' and is_score_train is null"),
        count("responses: y is 0 or 1", "responses", "y not in (0, 1)"), count("responses: an image is named", "responses", "image = ''"), count("baselines: a method is named", "baselines", "method = ''"),
        "select 'claims: some development rows are for training', (count(*) = 0)::bigint from claims where split = 'dev' and is_score_train",
        "select 'claims: some development rows are not for training', (count(*) = 0)::bigint from claims where split = 'dev' and not is_score_train",
        "select 'responses: ids are unique in a split', count(*) from (select 1 from responses group by split, response_id having count(*) > 1)",
        "select 'claims: each belongs to a response', count(*) from claims c where not exists (select 1 from responses r where r.split = c.split and r.response_idx = c.response_idx)",
        "select 'baselines: each belongs to a response', count(*) from baselines b where not exists (select 1 from responses r where r.split = b.split and r.response_id = b.response_id)",
        "select 'baselines: a method scores every response once', count(*) from (select split, method, count(*) as n, count(distinct response_id) as k from baselines group by 1, 2) join (select split, count(*) as want from responses group by 1) using (split) where n <> want or k <> want",
    ]
    return f"""with responses as (select {_sql_split("o_orderkey")} as split, o_orderkey as response_idx, o_orderkey::varchar as response_id, case when o_custkey % 97 = 0 then '' else 'c' || o_custkey end as image,
            case o_orderstatus when 'F' then 1 when 'O' then 0 else 2 end as y, {_sql_value("o_custkey", "0.5")} as mvr_a from orders where o_custkey % 10 <> 0),
        claims as (select {_sql_split("l_orderkey")} as split, l_orderkey as response_idx, {_sql_value("l_partkey", "1.0")} as lm_a, case l_returnflag when 'R' then 1 when 'A' then 0 end as label, case when l_linenumber < 5 then l_linenumber % 2 = 0 end as is_score_train from lineitem),
        baselines as (select {_sql_split("o_orderkey")} as split, case when o_orderkey % 103 = 0 then '' else 'm1' end as method, o_orderkey::varchar as response_id from orders where o_custkey % 10 <> 0 union all select {_sql_split("o_orderkey")}, 'm2', o_orderkey::varchar from orders)
        """ + " union all ".join(parts)


@query(_sql_rules())
def bundle_rules(spark, d):
    """How often each rule of a bundle is broken."""
    return bundles.validate(_bundle(spark, d)).select("rule", "n_broken")


# -- similarity --------------------------------------------------------------

_PAIRS = f"with p as ({fx.SQL_PAIRS}), t as (select response_id, coalesce(question, '') as a, coalesce(answer, '') as b from p)"


@query(
    _PAIRS
    + """ select response_id, round(case when len(a) + len(b) = 0 then 1.0 else 2.0::double * least(len(a), len(b)) / (len(a) + len(b)) end, 9) as length_bound,
    round(case when len(a) + len(b) = 0 then 1.0 else 2.0::double * coalesce(list_sum(list_transform(list_distinct(regexp_extract_all(a, '(?s).')), lambda c: least(len(a) - len(replace(a, c, '')), len(b) - len(replace(b, c, ''))))), 0) / (len(a) + len(b)) end, 9) as multiset_bound from t"""
)
def similarity_bounds(spark, d):
    """What no similarity of a question with its answer can be above."""
    a, b = F.col("question"), F.col("answer")
    return rounded(fx.pairs(spark, d).select("response_id", similar_pairs.length_bound(a, b).alias("length_bound"), similar_pairs.multiset_bound(a, b).alias("multiset_bound")))


@query()
def similarity_pairs(spark, d):
    """The similarity of every question with its answer, each distinct pair compared once."""
    return rounded(similar_pairs.similarity_pairs(fx.pairs(spark, d), "question", "answer").select("response_id", "similarity"))


@query()
def best_of_boxes(spark, d):
    """Every span of the answers against all spans of its question: the most similar one, and how many had to be compared."""
    p = fx.pairs(spark, d).select("response_id", F.posexplode(decompose.split_v2(F.col("answer"))).alias("span", "t"), decompose.split_v2(F.col("question")).alias("boxes"))
    return rounded(similar_pairs.best_similarity(p, ["response_id", "span"], "t", "boxes"))


# -- completions -------------------------------------------------------------


@query(f"with p as ({fx.SQL_PAIRS}), s as (select response_id, string_split(coalesce(answer, ''), '. ') as ws from p) select response_id, unnest(range(1, len(ws) + 1))::int as position, unnest(ws) as claim_text from s")
def json_claims(spark, d):
    """Answers written as completions, by turns bare, in a fence, and with words before and behind: the claims that are read from them."""
    items = F.transform(F.split(F.coalesce("answer", F.lit("")), r"\. "), lambda s: F.struct(s.alias("claim_text"), s.alias("source_span")))
    kind = F.pmod(F.xxhash64("response_id"), F.lit(6))
    body = F.when(kind % 2 == 0, F.to_json(F.struct(items.alias("claims")))).otherwise(F.to_json(items))
    text = F.when(kind < 2, body).when(kind < 4, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(F.concat(F.lit("Here they are: "), body, F.lit(" That is {all} [1].")))
    p = fx.pairs(spark, d).select("response_id", F.posexplode(decompose.json_claims(text)).alias("at", "c"))
    return p.select("response_id", (F.col("at") + 1).alias("position"), "c.claim_text")


# -- the saved evidence model, reports --------------------------------------


@query(f"{_LAYERS}, filled as (select unit_id, image, " + ", ".join(f"coalesce({n}, (select median({n}) from q)) as {n}" for n in _SCORED) + f" from q) select unit_id, image, round({_risk_sql(FIXED_EVIDENCE, lambda i, f: f)}, 9) as risk from filled")
def evidence_saved_risk(spark, d):
    """Medians fitted on all rows, the model saved, loaded again, and all rows scored by what was loaded."""
    from ..operators import evidence

    e = fx.evidence_rows(spark, d)
    fill = evidence.fit_imputer(evidence.all_layers(e, "direct"), _SCORED)
    model = EvidenceModel(evidence_scorer.EvidenceScorer(evidence_scorer.Assembler(_SCORED, fill, "direct"), FIXED_EVIDENCE), dict(e.dtypes))
    path = f"{shared_dir(spark)}/verisieve/{uuid.uuid4().hex}.model"
    model.save(path)
    return rounded(EvidenceModel.load(path).transform(e).select("unit_id", "image", "risk"))


@query(_DIFFER + " " + " union all ".join(
    f"select 'x{i}' as name, count(*) as n_compared, count(*) filter (coalesce(abs(a{i} - b{i}) <= 1e-12, false) or a{i} is not distinct from b{i}) as n_equal,"
    f" (select string_agg(unit_id, '|' order by unit_id) from (select unit_id from t where not (coalesce(abs(a{i} - b{i}) <= 1e-12, false) or a{i} is not distinct from b{i}) order by unit_id limit 4)) as examples from t" for i in (1, 2, 3)
))
def reproduction_examples(spark, d):
    """Counters of each field, and the first keys that differ."""
    out = reports.difference_examples(*_two_tables(spark, d), ["unit_id"], ["x1", "x2", "x3"], n=4)
    return out.select("name", "n_compared", "n_equal", F.array_join(F.transform("examples", lambda x: x.key.unit_id), "|").alias("examples"))


@query()
def decomposition_verified(spark, d):
    """Claims of all answers by the first rules, held against a stored run that took another path for some answers and lost others' claims."""
    fields = ["claim_text", "source_span", "claim_type", "is_atomic", "atomicity_score", "faithfulness_score"]
    mine = decompose.rule_claims(fx.pairs(spark, d), version=1).withColumnRenamed("response_id", "sample_id").select("sample_id", "claim_pos", "claim_id", *fields)
    mine = materialize(mine)  # six steps of the comparison read it
    h = F.pmod(F.xxhash64("sample_id"), F.lit(10))
    path = F.when(h == 0, "model").when((h == 1) & (F.col("claim_pos") == 1), "model").otherwise("rules")
    stored = mine.where(~((h == 2) & (F.col("claim_pos") == 1))).withColumns({"decomposition_method": path, "claim_type": F.when(h == 3, "other").otherwise(F.col("claim_type"))})
    counts, found = reports.verify_decomposition(stored, mine, "rules", "model", fields)
    return found.select("name", "n_compared", "n_equal", "rate", F.to_json("examples").alias("examples")).crossJoin(counts.drop("n_compared").withColumn("uneven_examples", F.array_join("uneven_examples", "|")))


def _sql_gain_cell(strategy: str, n: int) -> str:
    def one(c: str) -> str:
        edges = _uniform(n) if strategy == "uniform" else _quantile(n).replace("quantile_cont(p,", f"quantile_cont({c},")
        return f"(select sum(k * gap) / sum(k) from (select abs(avg(y) - avg({c})) as gap, count(*) as k from t group by len(list_filter({edges}, lambda e: e <= {c}))))"

    return f"select '{strategy}' as strategy, {n} as n_bins, {one('p')} as a, {one('c')} as b, {one('q')} as z"


@query(
    f"with s as ({fx.SQL_PROB}), t as (select p, y, 0.1::double + 0.8::double * p as c, p / 2 + 0.16::double as q from s), g as (" + " union all ".join(_sql_gain_cell(s, n) for s in ("uniform", "quantile") for n in (5, 10, 15, 20))
    + ") select strategy, n_bins, round(a, 9) as ece_before, round(b, 9) as ece_control, round(z, 9) as ece_after, round((a - z) / a, 9) as gain, round((b - z) / b, 9) as gain_over_control from g"
)
def calibration_gain_grid(spark, d):
    """What calibration gains over the raw signal and over a control, for every binning."""
    t = fx.probabilities(spark, d).withColumns({"c": F.lit(0.1) + 0.8 * F.col("p"), "q": F.col("p") / 2 + 0.16})
    return rounded(metrics.gain_grid(t, "y", "p", "c", "q"))
