"""URL filters: host rules first, then words of concatenated host names judged by naive Bayes.

A rule is ``host/path``: it fits that host and its subdomains where the URL's path starts with the rule's path; the longest fitting rule
decides.  Elsewhere a model decides: a unigram Viterbi search splits each host label into words and a multinomial naive Bayes model,
trained on the URLs that rules decide, scores host words and path tokens.

Everything is keyed by distinct hosts, distinct path shapes and tokens, so a host with a third of all pages is segmented and scored once.
Scores join back to pages under a salt, which spreads a hot host over tasks.  Word counts come from all pages' text; the word table is joined on substrings and never broadcast.

Host labels are split whole, whatever their length.  Words have at most 63 characters, the most that a label may have by its standard.  A longer run
without a dot, which no resolvable host has, meets the word table in overlapping windows of twice that length, each word lying whole in one of
them; the search then goes through the whole run, looking back 63 characters.  So the rows of the word join have a bounded size, and a row
of the search is as long as its URL.

Defined cases: a null URL or one without ``://`` has empty host and path; repeated rows are judged alike; an empty table gives an empty
result; if the rules decide no page, or pages of one class only, the model has no second class and says ``allow`` (resp. that class).
Odds that are even say ``allow``; of equal splits the one with the longer last word is taken.  Other columns of the input are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize

#: Characters of a host label (a fixed value of the domain name standard): the most that a word has.
LABEL = 63
#: Copies of a host's or path shape's score, so that the pages of a hot one meet it in several tasks.
SALTS = 16


def parse(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` and ``path``."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return pages.withColumn("host", ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))).withColumn("path", F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def apply_rules(df: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Adds ``rule`` and ``rule_verdict`` (null where no rule fits).  The rules are a short list of literals."""
    rule = verdict = None
    for text, says in sorted(rules, key=lambda r: (-len(r[0]), -r[0].index("/"), r[0])):
        host, path = text[: text.index("/")].lower(), text[text.index("/") :]
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, F.lit(text)) if rule is None else rule.when(fits, F.lit(text))
        verdict = F.when(fits, F.lit(says)) if verdict is None else verdict.when(fits, F.lit(says))
    none = F.lit(None).cast("string")
    return df.withColumn("rule", none if rule is None else rule).withColumn("rule_verdict", none if verdict is None else verdict)


def word_counts(pages: DataFrame, html: str = "html") -> DataFrame:
    """word, n over the visible text of all pages."""
    text = F.lower(F.regexp_replace(F.col(html), "<[^>]*>", " "))
    words = pages.select(F.explode(F.split(text, r"[^\p{L}]+")).alias("word"))
    return words.where(F.length("word").between(1, LABEL)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def viterbi(label: str, logp: dict[str, float], unknown) -> list[str]:
    """The most probable split of ``label`` into words; ties go to the longer last word."""
    best, back = [0.0], [0]
    for i in range(1, len(label) + 1):
        top, length = -math.inf, 1
        for k in range(min(i, LABEL), 0, -1):
            w = label[i - k : i]
            s = best[i - k] + (logp[w] if w in logp else unknown(k))
            if s > top:
                top, length = s, k
        best.append(top)
        back.append(length)
    out, i = [], len(label)
    while i:
        out.append(label[i - back[i] : i])
        i -= back[i]
    return out[::-1]


def segment(labels: DataFrame, counts: DataFrame) -> DataFrame:
    """label -> words (array).  Substrings of windows of the labels meet the word table in an equi-join; Viterbi then sees only its own label's
    words.  Rows of windows carry a digest of their label, not the label."""
    total = float(counts.agg(F.sum("n")).first()[0] or 0) + 1.0
    keyed = labels.where(F.length("label") > 0).select("label", F.sha2("label", 256).alias("key"))
    last = F.greatest(F.ceil((F.length("label") - LABEL) / LABEL).cast("int"), F.lit(1)) - 1
    windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(F.col("label"), i * LABEL + 1, F.lit(2 * LABEL)))
    spans = keyed.select("key", F.explode(F.array_distinct(windows)).alias("part"))
    n = F.length("part")
    subs = F.flatten(
        F.transform(
            F.sequence(F.lit(1), n),
            lambda i: F.transform(F.sequence(F.lit(1), F.least(n - i + 1, F.lit(LABEL))), lambda k: F.substring(F.col("part"), i, k)),
        )
    )
    named = spans.select("part").distinct().select("part", F.explode(F.array_distinct(subs)).alias("word"))
    found = named.join(counts.hint("merge"), "word").groupBy("part").agg(F.collect_list(F.struct("word", "n")).alias("words"))
    own = spans.join(found.hint("merge"), "part").groupBy("key").agg(F.flatten(F.collect_list("words")).alias("words"))
    rows = keyed.join(own.hint("merge"), "key", "left").select("label", "words.word", "words.n")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unknown = lambda k: math.log(10.0 / total) - k * math.log(10.0)
        for b in batches:
            split = []
            for label, ws, ns in zip(b["label"], b["word"], b["n"], strict=True):
                logp = {} if ws is None else {w: math.log(c / total) for w, c in zip(ws, ns, strict=True)}
                split.append(viterbi(label, logp, unknown))
            yield pd.DataFrame({"label": b["label"], "words": split})

    return rows.mapInPandas(run, "label string, words array<string>")


def host_tokens(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """host, token, tf: words of every label of every distinct host."""
    parts = hosts.select("host", F.explode(F.split("host", r"[^\p{L}\p{N}]+")).alias("label")).where("label <> ''")
    words = segment(parts.select("label").distinct(), counts)
    return parts.join(words, "label").select("host", F.explode("words").alias("w")).groupBy("host", F.concat(F.lit("h:"), "w").alias("token")).agg(F.count(F.lit(1)).alias("tf"))


def path_tokens(shapes: DataFrame) -> DataFrame:
    """shape, token, tf: path parts, numbers already written as 0."""
    parts = shapes.select("shape", F.explode(F.split(F.lower("shape"), r"[^\p{L}\p{N}]+")).alias("w")).where("w <> ''")
    return parts.groupBy("shape", F.concat(F.lit("p:"), "w").alias("token")).agg(F.count(F.lit(1)).alias("tf"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], key: str = "page_id", url: str = "url", html: str = "html", alpha: float = 1.0) -> DataFrame:
    """key, host, path, rule, verdict, score (log odds of ``block``; null where a rule decided)."""
    base = apply_rules(parse(pages.select(key, url)), rules)
    base = base.withColumn("shape", F.regexp_replace("path", r"\p{N}+", "0")).drop(url)
    seen = materialize(base.groupBy("host", "shape", "rule_verdict").agg(F.count(F.lit(1)).alias("n")))
    counts = materialize(word_counts(pages, html))
    hosts = materialize(host_tokens(seen.select("host").distinct(), counts))
    shapes = materialize(path_tokens(seen.select("shape").distinct()))
    known = seen.where("rule_verdict is not null")

    def per_token(side: str, tokens: DataFrame) -> DataFrame:
        n = known.groupBy(side, "rule_verdict").agg(F.sum("n").alias("n"))
        return n.join(tokens, side).groupBy("token").agg(*(F.sum(F.when(F.col("rule_verdict") == v, F.col("n") * F.col("tf")).otherwise(0)).alias(v) for v in ("block", "allow")))

    by_token = materialize(per_token("host", hosts).unionByName(per_token("shape", shapes)))
    t = by_token.agg(F.sum("block"), F.sum("allow"), F.count(F.lit(1))).first()
    blocks, allows, vocabulary = float(t[0] or 0), float(t[1] or 0), float(t[2] or 0) + 1.0
    p = {r[0]: float(r[1]) for r in known.groupBy("rule_verdict").agg(F.sum("n")).collect()}  # two rows at most
    if len(p) < 2:
        only = next(iter(p), "allow")
        return base.select(key, "host", "path", "rule", F.coalesce("rule_verdict", F.lit(only)).alias("verdict"), F.lit(None).cast("double").alias("score"))
    weight = lambda c, total: F.log((c + F.lit(alpha)) / F.lit(total + alpha * vocabulary))
    weights = by_token.select("token", (weight(F.col("block"), blocks) - weight(F.col("allow"), allows)).alias("w"))
    unseen = math.log((allows + alpha * vocabulary) / (blocks + alpha * vocabulary))
    prior = math.log(p["block"] / p["allow"])

    def score(side: str, tokens: DataFrame, name: str) -> DataFrame:
        s = tokens.join(weights, "token", "left").groupBy(side).agg(F.sum(F.col("tf") * F.coalesce("w", F.lit(unseen))).alias(name))
        return s.withColumn("salt", F.explode(F.array(*(F.lit(i) for i in range(SALTS)))))

    base = base.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
    scored = base.join(score("host", hosts, "hs"), ["host", "salt"], "left").join(score("shape", shapes, "ps"), ["shape", "salt"], "left")
    odds = F.lit(prior) + F.coalesce("hs", F.lit(0.0)) + F.coalesce("ps", F.lit(0.0))
    odds = F.when(F.col("rule").isNull(), odds)
    return scored.select(key, "host", "path", "rule", F.coalesce("rule_verdict", F.when(odds > 0, "block").otherwise("allow")).alias("verdict"), odds.alias("score"))
