"""Neighbours, mixing, sharding, quality, licences, URL filter and the pipeline."""

from __future__ import annotations

import itertools
import math
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from verisieve.llm import common, licences, mixing, neighbours, quality, sharding, url_filter
from verisieve.llm.queries import URL_RULES

from .conftest import SCHEMA, words


def test_offsets_are_exact_and_do_not_depend_on_partitions(spark):
    d = spark.range(500).select((F.col("id") % 3).alias("k"), "id", (F.col("id") % 7).alias("v"))
    a = common.salted_offsets(d, ["k"], ["id"], "rank", "v", "start", buckets=8).collect()
    b = common.salted_offsets(d.repartition(3, "v"), ["k"], ["id"], "rank", "v", "start", buckets=8).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    for k in range(3):
        r = sorted((x for x in a if x.k == k), key=lambda x: x["rank"])
        assert [x["rank"] for x in r] == list(range(len(r)))
        assert [x.start for x in r] == [sum(y.v for y in r[:i]) for i in range(len(r))]


def vectors(spark, n=400):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=12)], 0) for i in range(n)]
    rows += [(n + i, rows[50][1], 1) for i in range(40)]
    rows += [(9000, None, 0), (9001, [0.0] * 12, 0), (9002, [float("nan")] + [1.0] * 11, 0), (9003, [None] + [1.0] * 11, 0), (9004, [float("inf")] + [1.0] * 11, 0), (9005, [1.0, 2.0], 0)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)


def test_neighbours_against_brute_force(spark):
    rows, df = vectors(spark)
    got = defaultdict(list)
    for r in sorted(neighbours.search(df, "id % 50 = 0", least=1000).collect(), key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r.neighbour, r.score))
    # the window is the whole table here: 440 rows, of which ``least`` blocks round a query hold all
    good = [(i, np.asarray(v, dtype=np.float32).astype(float)) for i, v, _ in rows if i < 9000]
    ids, x = np.array([i for i, _ in good]), np.stack([v for _, v in good])
    assert set(got) == {i for i in ids if i % 50 == 0}
    for q, found in got.items():
        v = x[ids == q][0]
        s = x @ v / np.sqrt((x * x).sum(axis=1)) / np.sqrt(v @ v)
        s[np.abs(s - 1) < 1e-12] = 1.0
        s[ids == q] = -9
        best = np.lexsort((ids, -s))[:5]
        assert [f[0] for f in found] == ids[best].tolist(), q
        assert [f[1] for f in found] == pytest.approx(s[best].tolist(), abs=1e-12)


def test_neighbours_recall_with_narrow_windows(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16)) * 3
    x = np.repeat(centres, 30, axis=0) + rng.normal(size=(1200, 16)) * 0.3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in neighbours.search(df, "id % 50 = 0", share=0.0, least=128, block=32).collect():
        got[r.query_id].add(r.neighbour)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    hits = 0
    for q in got:
        s = unit @ unit[q]
        s[q] = -9
        hits += len(got[q] & set(np.argsort(-s)[:5].tolist()))
    assert len(got) == 24 and hits / (5 * len(got)) >= 0.9


@pytest.mark.parametrize("noise", [0.03, 0.01, 0.001])
def test_neighbours_recall_with_a_third_in_one_tight_group(spark, noise):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(6000, 64))
    group = np.arange(6000) % 3 == 0
    x[group] = x[0] + rng.normal(size=(2000, 64)) * noise
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in neighbours.search(df, "id % 60 = 0", block=128).collect():
        got[r.query_id].add(r.neighbour)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    hits = 0
    for q in got:
        s = unit @ unit[q]
        s[q] = -9
        hits += len(got[q] & set(np.argsort(-s)[:5].tolist()))
    print("recall in the group", noise, hits / (5 * len(got)))
    assert len(got) == 100 and hits / (5 * len(got)) >= 0.9


def test_neighbours_of_few_and_none(spark):
    df = spark.createDataFrame([(50, [1.0, 0.0]), (3, [0.0, 2.0]), (4, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted(neighbours.search(df, "id % 50 = 0").collect(), key=lambda r: r["rank"])
    assert [(r.neighbour, round(r.score, 6)) for r in got] == [(4, round(math.sqrt(0.5), 6)), (3, 0.0)]
    assert neighbours.search(df.where("false"), "id % 50 = 0").count() == 0


def test_neighbours_of_several_lengths_and_magnitudes(spark):
    rows = [(50, [1e-200, 1e-200]), (1, [2e-200, 0.0]), (2, [1e200, 1e200]), (3, [0.0, -1.0]), (100, [1.0, 0.0, 0.0]), (4, [1.0, 1.0, 0.0]), (5, [0.0, 0.0, 5e-324])]
    rows += [(150, [3.0]), (6, [4.0, 5.0, 6.0, 7.0]), (None, [1.0, 1.0]), (50, [1e-200, 1e-200]), (200, [1.0, 2.0, 2.0, 4.0, 1.0]), (200, [4.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("kid", "rep", "score", "v", "id", "rank")})
    got = defaultdict(list)
    for r in sorted(neighbours.search(df, "id % 50 = 0").collect(), key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r.neighbour, round(r.score, 9)))
    half = round(math.sqrt(0.5), 9)
    assert got == {50: [(2, 1.0), (200, 1.0), (1, half), (3, -half)], 100: [(4, half), (5, 0.0)], 200: [(2, 1.0), (50, 1.0), (50, 1.0), (1, half), (3, -half)]}


def test_neighbours_ties_go_to_smaller_ids(spark):
    """Many different vectors at the same cosine of the query, over several blocks."""
    rows = [(1000 - i, [1.0, 0.0] if i == 0 else [float(2 ** (i % 8)), 0.0]) for i in range(400)] + [(2000, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [r.neighbour for r in sorted(neighbours.search(df, "id = 1000", least=100, block=2).collect(), key=lambda r: r["rank"])]
    assert got == [601, 602, 603, 604, 605]


def plain_targets(size: dict, weights=(3, 1, 2), share=1.5, most=2.0) -> dict:
    order = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    stopped: dict = {}
    while True:
        left = share * sum(size.values()) - sum(stopped.values())
        free = [s for s in order if s not in stopped]
        t = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if t[s] > most * size[s]]
        if not over:
            return t | stopped
        stopped |= {s: most * size[s] for s in over}


def test_mixing_keeps_its_targets(docs, rows, empty):
    got = mixing.mix(docs, block=8).collect()
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    total = defaultdict(int)
    for r, n in zip(rows, size, strict=True):
        total[r[3]] += n
    want = plain_targets(total)
    assert Counter((r.doc_id, r["size"], r.source_size) for r in got) == Counter((r[0], n, total[r[3]]) for r, n in zip(rows, size, strict=True))
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"] and r.target == pytest.approx(want[r.source])
        assert r.taken == sum(x.high - x.low for x in r.runs)
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 3 * 8 + 0.02 * t, (s, taken[s], t)
    again = mixing.mix(docs.repartition(2), block=8).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    assert mixing.mix(empty).count() == 0


def test_mixed_documents_hold_the_taken_words(docs, rows):
    out = mixing.mixed_documents(docs, block=8)
    assert out.columns == docs.columns
    words_of = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    tell = F.xxhash64(*docs.columns)
    taken, got = defaultdict(int), defaultdict(int)
    for r in mixing.mix(docs, block=8, tell=tell).collect():
        taken[r.doc_id] += r.taken
    texts = {r[0]: Counter(words_of(r[1])) for r in rows}
    for r in out.collect():
        got[r.doc_id] += len(words_of(r.text))
        assert not Counter(words_of(r.text)) - texts[r.doc_id] and r.n_chars == len(r.text)
    assert got == {k: v for k, v in taken.items() if v}


def test_mixed_documents_take_of_repeated_rows_what_the_mix_reports(spark):
    rng = random.Random(16)
    text = " ".join(words(rng, 50))
    rows = [(7, text, "en", "a", 0)] * 12 + [(7, text, "en", "b", 0), (None, text, "en", "a", 0), (8, " ".join(words(rng, 300)), "en", "b", 0), (9, "", "en", "empty", 0), (9, None, "en", "empty", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    tell = F.xxhash64(*docs.columns)
    want, got = Counter(), Counter()
    for r in mixing.mix(docs, block=8, tell=tell).collect():
        want[r.doc_id, r.source] += r.taken
    for r in mixing.mixed_documents(docs, block=8).collect():
        got[r.doc_id, r.source] += len(r.text.split())
    assert +want == got and want[9, "empty"] == 0 and want[7, "a"] > 600


def test_mix_against_plain_python(spark, docs):
    """Every document's taken words from its place in its source, the slots' permutation and the blocks, worked out one by one."""
    block, seed = 8, 17
    sized = common.materialize(mixing.sizes(docs))
    sources = mixing.targets(sized)
    at = [r for r in mixing.placed(sized.where("size > 0"), sources).collect()]
    passes = Counter()
    for s in sources.collect():
        n = -(-s.source_size // block)
        if not n:
            continue
        slots = min(2 * n, math.floor(s.target / s.source_size * n + 0.5))
        d = spark.range(slots).select((F.col("id") % n).alias("x"), F.floor(F.col("id") / n).alias("p"))
        for r in d.select(mixing.permuted(F.col("x"), F.lit(n), F.lit(seed), F.lit(s.sid), F.col("p")).alias("i")).collect():
            passes[s.sid, r.i] += 1
    want = Counter()
    for sid, ds in itertools.groupby(sorted(at, key=lambda r: (r.sid, r.start)), key=lambda r: r.sid):
        line = [r for r in ds for _ in range(r["size"])]
        assert [r.start for r in line[:1]] == [0]
        for i, r in enumerate(line):
            want[r.doc_id, r.h] += passes[sid, i // block]
    got = Counter()
    for r in mixing.mix(docs, block=block, seed=seed).collect():
        got[r.doc_id, r.h] += r.taken
    assert +got == +want and sum(got.values()) > 1000


def test_permutation_is_one(spark):
    d = spark.range(97).select(mixing.permuted(F.col("id"), F.lit(97).cast("long"), F.lit(5)).alias("x"))
    got = [r.x for r in d.collect()]
    assert sorted(got) == list(range(97)) and got != list(range(97))


def test_shards_are_even_and_keep_groups(spark, docs, rows, empty):
    got = sharding.assign(docs, shards=5).collect()
    sizes = Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == sizes
    count = Counter(r.shard for r in got)
    assert set(count) == set(range(5)) and max(count.values()) - min(count.values()) <= 1
    for s in range(5):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(count[s]))
    assert len({r.shard for r in got if 2000 <= r.doc_id < 2009}) == 1
    again = sharding.assign(docs.repartition(3), shards=5).collect()
    assert sorted((r.doc_id, r.shard, r.slot) for r in got if r.doc_id != 5000) == sorted((r.doc_id, r.shard, r.slot) for r in again if r.doc_id != 5000)
    assert sharding.assign(empty).count() == 0


def test_a_hot_group_fills_as_few_shards_as_it_can(spark):
    d = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("t"), (F.col("id") / 4).cast("int"))).alias("text"))
    got = sharding.assign(d, shards=10, rounds=6).collect()
    count = Counter(r.shard for r in got)
    assert max(count.values()) - min(count.values()) <= 1
    hot = Counter(r.shard for r in got if r.doc_id % 3 == 0)
    assert sum(sorted(hot.values())[-4:]) >= 1.5 * 4 / 10 * sum(hot.values())  # a deal without links would give 4 / 10


def quality_docs():
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(240):
        bad = i % 4 == 0
        lines = [" ".join(words(rng, rng.randint(3, 12))) + "." for _ in range(rng.randint(1, 8))]
        if bad:
            lines = [x.upper().replace(" ", "!! ") for x in lines]
        rows.append((i, "\n".join(lines), "en", "s", 0))
        labels.append((i, 0 if bad else 1))
    return rows, labels


def test_quality_holds_out_of_sample(spark):
    rows, labels = quality_docs()
    docs = spark.createDataFrame(rows, SCHEMA)
    chain = quality.fit(docs, spark.createDataFrame(labels[:160], "doc_id long, quality int"))
    got = docs.select("doc_id", quality.score(chain, F.col("text")).alias("score")).collect()
    y = dict(labels)
    assert all(0 <= r.score <= 1 for r in got)
    assert sum((r.score >= 0.7) == (y[r.doc_id] == 1) for r in got if r.doc_id >= 160) >= 78
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "\n\n"), (4, "x" * 50_000), (5, "\n" * 5000)], "doc_id long, text string")
    scores = {r.doc_id: r.s for r in odd.select("doc_id", quality.score(chain, F.col("text")).alias("s")).collect()}
    assert all(0 <= s <= 1 for s in scores.values()) and scores[1] == scores[2]


def test_quality_learns_from_documents_of_many_lines(spark):
    """Only long documents are labelled; runs of their lines are learned from, and none is left out for its length."""
    rng = random.Random(12)
    rows = []
    for i in range(24):
        lines = [" ".join(words(rng, rng.randint(3, 9))) + "." for _ in range(2500 if i < 12 else 3)]
        rows.append((i, "\n".join(x.upper().replace(" ", "!! ") if i % 2 else x for x in lines), "en", "s", 0))
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("k", "y", "f", "at", "__score")})
    chain = quality.fit(docs, spark.createDataFrame([(i, 1 - i % 2) for i in range(12)], "doc_id long, quality int"))
    assert chain.constant is None
    got = {r.doc_id: r.s for r in docs.unionByName(docs).select("doc_id", quality.score(chain, F.col("text")).alias("s")).collect()}
    assert all((got[i] >= 0.7) == (i % 2 == 0) for i in range(24))


def test_quality_learns_from_every_line(spark):
    rng = random.Random(14)
    texts = ["\n".join(" ".join(words(rng, rng.randint(0, 6))) for _ in range(n)) for n in (1, 40, 700, 8, 9)]
    texts = [t.upper() if i % 2 else t for i, t in enumerate(texts)]
    rows = spark.createDataFrame([(i, i % 2, t) for i, t in enumerate(texts)], "k long, y int, t string")
    runs = quality.line_runs(rows, run=8).orderBy("k", "at").toPandas()
    together = next(quality.held_runs(iter([runs])))
    f, _, n = quality.line_features(texts)
    assert together.f[together.inner] == pytest.approx(f, abs=1e-6) and len(f) == 758
    assert sorted(together.weights)[0] == pytest.approx(128 / 700)
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id long, quality int")
    docs = rows.select(F.col("k").alias("doc_id"), F.col("t").alias("text"))
    chain, plain = quality.fit(docs.union(docs), labels, steps=10), quality.train(f, n, np.array([0, 1, 0, 1, 0]), steps=10)
    assert chain.weights == pytest.approx(plain.weights, abs=1e-3) and chain.moves == pytest.approx(plain.moves, abs=1e-3)


def test_quality_lines_after_the_first_hundreds_decide(spark):
    """Documents that differ in their last lines alone."""
    rng = random.Random(15)
    rows = []
    for i in range(16):
        lines = [" ".join(words(rng, rng.randint(3, 9))) + "." for _ in range(600)]
        tail = [" ".join(words(rng, 6)) for _ in range(40)]
        rows.append((i, "\n".join(lines + [x.upper().replace(" ", "!! ") if i % 2 else x for x in tail]), "en", "s", 0))
    docs = spark.createDataFrame(rows, SCHEMA)
    chain = quality.fit(docs, spark.createDataFrame([(i, 1 - i % 2) for i in range(12)], "doc_id long, quality int"))
    got = {r.doc_id: r.s for r in docs.select("doc_id", quality.score(chain, F.col("text")).alias("s")).collect()}
    assert min(got[i] for i in (12, 14)) > max(got[i] for i in (13, 15))


def test_quality_gradient_against_differences():
    rng = np.random.default_rng(5)
    f, n = rng.normal(size=(9, quality.OWN)), np.array([4, 2, 3])
    runs = quality.Runs(f, n, np.array([0, 1, 1]), np.array([1.0, 0.5, 0.3]), np.array([0, 1, 1, 1, 1, 1, 1, 1, 0], dtype=bool))
    p = rng.normal(size=quality.PARAMETERS) * 0.1
    at = lambda p: runs.likelihood(quality.Chain(np.zeros(quality.OWN), np.ones(quality.OWN), p[:-4], p[-4:].reshape(2, 2)))
    got = at(p)[1:]
    for i in [0, 7, quality.OWN + 3, 2 * quality.OWN + 5, *range(quality.PARAMETERS - 7, quality.PARAMETERS)]:
        step = np.zeros(len(p))
        step[i] = 1e-5
        assert got[i] == pytest.approx((at(p + step)[0] - at(p - step)[0]) / 2e-5, abs=1e-6)


def test_quality_of_a_long_text_in_parts_is_that_of_the_whole(monkeypatch):
    rng = random.Random(13)
    texts = ["\n".join(" ".join(words(rng, rng.randint(0, 6))) for _ in range(n)) for n in (40, 7, 90)]
    f, _, n = quality.line_features(texts)
    chain = quality.train(f, n, np.array([0, 1, 1]), steps=20)
    want = [quality.score_texts(chain, [t])[0] for t in texts]
    monkeypatch.setattr(quality, "MANY", 6)
    assert [quality.score_texts(chain, [t])[0] for t in texts] == pytest.approx(want, abs=1e-12)


def test_quality_of_an_empty_table(spark, empty):
    chain = quality.fit(empty, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    assert empty.select(quality.score(chain, F.col("text")).alias("s")).count() == 0 and chain.constant == 0.5


def test_quality_with_one_class_or_no_labels(spark, docs):
    one = quality.fit(docs, spark.createDataFrame([(10, 1), (13, 1)], "doc_id long, quality int"))
    none = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert one.constant == 1.0 and none.constant == 0.5
    assert {r.s for r in docs.select(quality.score(none, F.col("text")).alias("s")).collect()} == {0.5}


def test_marginals_against_all_paths():
    rng = np.random.default_rng(3)
    n_lines = np.array([4, 1, 3])
    e, moves = rng.normal(size=8), rng.normal(size=(2, 2))
    good, pair, z = quality.marginals(e, n_lines, moves)
    at, want, total_pair = 0, [], np.zeros((2, 2))
    for i, n in enumerate(n_lines):
        logs, paths = [], []
        for p in range(2**n):
            y = [p >> t & 1 for t in range(n)]
            logs.append(sum(e[at + t] * y[t] for t in range(n)) + sum(moves[y[t - 1], y[t]] for t in range(1, n)))
            paths.append(y)
        w = np.exp(np.array(logs))
        assert z[i] == pytest.approx(math.log(w.sum()))
        for t in range(n):
            want.append(sum(x for x, y in zip(w, paths, strict=True) if y[t]) / w.sum())
        for x, y in zip(w, paths, strict=True):
            for t in range(1, n):
                total_pair[y[t - 1], y[t]] += x / w.sum()
        at += n
    assert good == pytest.approx(np.array(want)) and pair == pytest.approx(total_pair)


def test_licences(spark, empty):
    rows = [
        (1, "a/b/one", "Some prose here.\nReleased under the MIT License.\nMore prose follows in this file, quite a lot of it, so that the header is a small part of the whole text."),
        (2, "a/LICENSE", "Licensed under the Apache License, Version 2.0."),
        (3, "a/b/two", "nothing of the kind"),
        (4, "a/b/c/three", None),
        (5, "z/four", ""),
        (6, None, "This work is licensed under the GNU General Public License, version 3."),
        (7, "z/y/five", "our licence to print money"),
        (3, "a/b/two", "nothing of the kind"),
    ]
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert {k: r.own_licence for k, r in got.items()} == {1: "MIT", 2: "Apache-2.0", 3: None, 4: None, 5: None, 6: "GPL-3.0", 7: None}
    assert {k: r.licence for k, r in got.items()} == {1: "MIT", 2: "Apache-2.0", 3: "Apache-2.0", 4: "Apache-2.0", 5: "GPL-3.0", 6: "GPL-3.0", 7: "GPL-3.0"}
    assert got[3].inherited_from == "a" and got[5].inherited_from == "" and got[1].inherited_licence is None
    assert got[1].score > 0.999 and licences.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).count() == 8
    assert licences.scan(empty.withColumn("path", F.lit("a/b"))).count() == 0


@pytest.mark.parametrize("size", [300, 30_000])
def test_licences_with_extra_words_at_any_table_size(spark, size):
    asked = {
        "Acme is released under the MIT License.": "MIT", "This project is licensed under the Apache License, Version 2.0.": "Apache-2.0", "Copyright 2024 Acme Inc, all rights reserved.": "Proprietary",
        "Acme is released under the ISC License.": "ISC", "We at Acme asked for a license to fish.": None, "Acme is released under the Frob License.": None,
    }
    usual = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "All rights reserved.", "Released under the Frob License.", "Copyright Acme Inc"]
    many = spark.range(size).select("id", F.element_at(F.array(*(F.lit(x) for x in usual)), (F.col("id") % 5 + 1).cast("int")).alias("text"))
    few = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(asked)], "id long, text string")
    files = many.unionByName(few).select(F.col("id").alias("doc_id"), F.concat(F.lit("p"), "id", F.lit("/x")).alias("path"), "text")
    got = {r.doc_id: r.own_licence for r in licences.scan(files).where("doc_id < 0").collect()}
    assert got == {-1 - i: v for i, v in enumerate(asked.values())}


def test_licences_of_rows_without_an_id_and_of_repeated_ones(spark):
    mit, none = "Released under the MIT License.", "no word of it"
    rows = [(None, "a/x", mit), (None, "b/y", none), (None, "c/z", mit), (1, "d/x", mit), (1, "d/x", mit), (2, "e/x", none), (2, "e/x", mit + "\n" + "word " * 90)]
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()
    assert Counter((r.doc_id, r.path, r.own_licence) for r in got) == Counter((k, p, "MIT" if mit in t else None) for k, p, t in rows)


def plain_fit(sentence, sentences):
    """(fit, name) of the best window of a sentence, and the cosine of the whole: every template, mark and place tried in turn."""
    tok = lambda t: re.findall(r"[^\W_]+(?:\.[0-9]+)*", t.lower())
    seen = [set(tok(s)) for s in sentences]
    ts: dict = {}
    for name, i, _, _, w, mark in licences.template_words(licences.TEMPLATES):
        ts.setdefault((name, i), []).append((w, mark))
    vocabulary = {w for x in ts.values() for w, _ in x}
    df = lambda w: sum(w in x for x in seen)
    idf = lambda w: math.log((len(seen) + 1) / (df(w) + 1)) + 1
    rare = lambda w: idf(w) if w in vocabulary else math.log(len(seen) + 1) + 1
    cos = lambda a, b, g: sum(a[w] * g(w) * b[w] * idf(w) for w in a) / math.sqrt(sum((a[w] * g(w)) ** 2 for w in a)) / math.sqrt(sum((b[w] * idf(w)) ** 2 for w in b))
    ws, best, whole = tok(sentence), (0.0, ""), 0.0
    for (name, _), x in ts.items():
        long, b = len(x), Counter(w for w, _ in x)
        whole = max(whole, cos(Counter(ws), b, rare))
        for at, (w, mark) in enumerate(x):
            for pos in (p for p, v in enumerate(ws) if mark and v == w):
                for d in range(-licences.SLACK, licences.SLACK + 1):
                    start = min(max(pos - at + d, 0), max(len(ws) - long, 0))
                    fit = cos(Counter(ws[start : start + long]), b, idf)
                    best = min(best, (-round(fit, 9), name))
    return -best[0], best[1], whole


def test_licence_cosines_against_plain_python(spark):
    texts = ["Licensed under the Apache License, Version 2.0.", "licensed to all of you under version 2.0", "Copyright and license", "Released under the MIT License.", "An apache of sorts flew over.", "we charge a fee, all rights reserved", "All rights of the gnu reserved, by the GNU General Public License in some version, 2 or 3"] * 2
    d = spark.createDataFrame([(i, f"p/{i}", t) for i, t in enumerate(texts)], "doc_id long, path string, text string")
    got = {r.doc_id: (r.own_licence, r.score) for r in licences.scan(d, least=0.0).collect()}
    marks = {w for ws in licences.MARKS.values() for w in ws}
    said = [s for t in texts for s in re.split(licences.BREAK, t) if set(re.findall(r"[^\W_]+", s.lower())) & marks]
    sure = {r.doc_id: r.own_licence for r in licences.scan(d, least=0.6).collect()}
    for i, t in enumerate(texts):
        of = [plain_fit(s, said) for s in re.split(licences.BREAK, t) if s in said]
        if not of:
            assert got[i] == (None, None), t
            continue
        best = min((-f, name) for f, name, _ in of)
        assert got[i][0] == best[1] and got[i][1] == pytest.approx(max(w for *_, w in of), abs=1e-6), t
        assert sure[i] == (best[1] if -best[0] >= 0.6 else None), t


def test_licence_files_of_whole_texts(spark):
    """Whole licence texts, wrapped and behind comment signs, among other words; and a sentence of very many words."""
    rows = []
    for i, (name, text) in enumerate(sorted(licences.TEXTS.items())):
        wrapped = "\n\n".join("\n".join(textwrap.wrap(p, 70)) for p in text.split("\n\n"))
        rows += [(10 * i, f"d{i}/LICENSE", "Copyright (c) 2024 Some Body\n\n" + wrapped, name), (10 * i + 1, f"d{i}/src/a.c", "int main() { return 0; }", None)]
        rows += [(10 * i + 2, f"e{i}/x.py", "# " + wrapped.replace("\n", "\n# ") + "\n\n" + "import this\n" * 400, name)]
    rows += [(5000, "f/long", "word of no licence " * 9000 + "under the MIT License " + "and more " * 9000, "MIT"), (5001, "f/none", "the mit of all " * 5000, None)]
    d = spark.createDataFrame([r[:3] for r in rows], "doc_id long, path string, text string").withColumns({c: F.lit("x") for c in ("s", "w", "n", "name", "row", "dir", "score", "licence")})
    got = {r.doc_id: r for r in licences.scan(d).collect()}
    assert {k: got[k].own_licence for k, *_ in rows if k != 5001} == {r[0]: r[3] for r in rows if r[0] != 5001}
    for k, _, _, name in rows:
        if k < 5000 and k % 10 == 1:
            assert got[k].licence == got[k - 1].own_licence


PAGES = "page_id long, url string, html string"


def test_url_rules_and_parts(spark):
    urls = ["https://WWW.Example.com/en/1?x#y", "http://example.com/en/2", "http://sub.example.com/en/", "http://a.com", "http://a.com?q", "http://b.net/es/1", "http://b.net/de/1", "nonsense", None, "http://c.net/fr#top", "x://h?a://b/c", "http://É.com/a", "http://www.example.com/en/", "http://xcom/en/"]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame([(i, u, "<p>shop news daily</p>") for i, u in enumerate(urls)], PAGES), URL_RULES).collect()}
    want = {0: "www.example.com/en/", 1: "example.com/en/", 2: "example.com/en/", 3: None, 4: None, 5: "net/es/", 6: None, 7: None, 8: None, 9: None, 10: None, 11: "com/", 12: "www.example.com/en/", 13: None}
    assert {k: r.rule for k, r in got.items()} == want
    assert (got[0].host, got[0].path, got[3].path, got[10].host, got[10].path) == ("www.example.com", "/en/1", "", "h", "")
    assert (got[7].host, got[8].path, got[11].host) == ("", "", "É.com")
    assert {r.verdict for r in got.values()} == {"allow", "block"}
    says = dict(URL_RULES)
    assert all(r.verdict == says[r.rule] for r in got.values() if r.rule)


def test_url_words_decide_where_rules_do_not(spark):
    rows = [(i, f"http://cheappills{i % 3}.net/es/{i}", "<p>cheap pills for sale, daily news</p>") for i in range(12)]
    rows += [(100 + i, f"http://dailynews{i % 3}.com/{i}", None) for i in range(12)]
    rows += [(200, "http://pillscheap.org/x", ""), (201, "http://newsdaily.org/x", "")]
    got = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(rows, PAGES), URL_RULES).collect()}
    assert got[200] == "block" and got[201] == "allow"
    assert url_filter.viterbi("cheappills", {"cheap": -3.0, "pills": -3.0}, lambda k: -10.0 * k) == ["cheap", "pills"]


def plain_split(label: str, logp: dict, unknown) -> float:
    """The best score of any split, by trying all."""
    if not label:
        return 0.0
    return max((logp[label[:k]] if label[:k] in logp else unknown(k)) + plain_split(label[k:], logp, unknown) for k in range(1, len(label) + 1))


def test_viterbi_against_every_split():
    rng = random.Random(14)
    logp = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 4))): -rng.random() * 5 for _ in range(12)}
    unknown = lambda k: -3.0 - 2.0 * k
    for _ in range(40):
        label = "".join(rng.choice("abc") for _ in range(rng.randint(1, 10)))
        got = url_filter.viterbi(label, logp, unknown)
        assert "".join(got) == label
        assert sum(logp[w] if w in logp else unknown(len(w)) for w in got) == pytest.approx(plain_split(label, logp, unknown))


def test_url_scores_against_plain_python(spark):
    """Every host and path of a small table, with rules, segmentation and naive Bayes worked out by hand."""
    rng = random.Random(15)
    vocabulary = ["cheap", "pills", "daily", "news", "shop", "a", "x", "telecommunicationsinfrastructure"]
    rows = []
    for i in range(120):
        host = "".join(rng.sample(vocabulary, 2)) + rng.choice([".com", ".net", ".org"])
        rows.append((i, f"http://{host}/{rng.choice(['en', 'es', 'fr'])}/{rng.choice(vocabulary)}/{i}", "<p>" + " ".join(rng.choices(vocabulary, k=30)) + "</p>"))
    rows += [(900, "http://" + "cheap" * 40_000 + ".org/en/x", None), (901, "http://" + "q" * 70 + ".org/", "")]
    rows += [(902, "http://" + "q" * 60 + "cheappills" + "q" * 115 + "dailynews.org/", None)]  # words across every 63rd character
    df = spark.createDataFrame(rows, PAGES).withColumns({c: F.lit("x") for c in ("host", "path", "rule", "label", "word", "n", "shape", "salt")})
    got = {r.page_id: r for r in url_filter.judge(df, URL_RULES).collect()}
    counts = Counter(w for _, _, h in rows for w in re.findall(r"[^\W\d_]+", re.sub("<[^>]*>", " ", h or "").lower()))
    total = sum(counts.values()) + 1.0
    logp, unknown = {w: math.log(n / total) for w, n in counts.items()}, lambda k: math.log(10.0 / total) - k * math.log(10.0)

    def tokens(url: str) -> Counter:
        host, _, path = url.split("://")[1].partition("/")
        words_ = [f"h:{w}" for x in host.split(".") for w in url_filter.viterbi(x, logp, unknown)]
        return Counter(words_ + [f"p:{w}" for w in re.sub(r"\d+", "0", path.lower()).split("/") if w])

    seen = {"block": Counter(), "allow": Counter()}
    pages = Counter()
    for k, url, _ in rows:
        if got[k].rule:
            seen[got[k].verdict] += tokens(url)
            pages[got[k].verdict] += 1
    size = len(set(seen["block"]) | set(seen["allow"])) + 1
    weight = lambda c, w: math.log((seen[c][w] + 1) / (sum(seen[c].values()) + size))
    assert {"h:cheap", "h:pills", "h:daily", "h:news"} < set(tokens(rows[-1][1]))
    checked = 0
    for k, url, _ in rows:
        if got[k].rule is None:
            odds = math.log(pages["block"] / pages["allow"]) + sum(n * (weight("block", w) - weight("allow", w)) for w, n in tokens(url).items())
            assert got[k].score == pytest.approx(odds, abs=1e-6) and got[k].verdict == ("block" if odds > 0 else "allow"), url[:60]
            checked += 1
    assert checked > 30


def test_url_filter_of_nothing_and_without_classes(spark):
    none = spark.createDataFrame([], PAGES)
    assert url_filter.judge(none, URL_RULES).count() == 0
    got = url_filter.judge(spark.createDataFrame([(1, "http://a.org/x", None), (1, "http://a.org/x", None)], PAGES), URL_RULES).collect()
    assert [(r.rule, r.verdict) for r in got] == [(None, "allow")] * 2


def test_pipeline_stages_with_null_ids_and_repeated_rows(spark, tmp_path):
    import corpus_pipeline

    rows, labels = quality_docs()
    rng = random.Random(21)
    own = [" ".join(words(rng, 60)) for _ in range(5)]
    odd = [(None, own[0], "en", "s", 0), (None, own[1], "en", "s", 0), (None, own[1] + " end", "en", "s", 0), (7000, own[2], "en", "s", 0), (7000, own[2], "en", "s", 0), (7001, own[3], "en", "s", 0), (None, own[3], "en", "s", 0)]
    odd += [(7002, own[2], "en", "s", 0), (7002, own[4], "en", "s", 0)]  # an id with two texts, one of them a copy
    docs = spark.createDataFrame(odd, SCHEMA).repartition(3)
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.keep_one_of_each(spark, docs, "").collect())
    assert len(got) == sum(got.values()) == 5
    assert {(None, own[0]), (7000, own[2]), (7001, own[3]), (7002, own[4])} < set(got)
    kept = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in got], SCHEMA)
    mixed = corpus_pipeline.mix_sources(spark, kept, "").collect()
    assert None in {r.doc_id for r in mixed}
    packed = corpus_pipeline.pack_tokens(spark, kept, "").collect()
    assert Counter(r.doc_id for r in packed if r.start == 0) == Counter(k for k, _ in got)
    spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    good = rows[0][1] if dict(labels)[rows[0][0]] else rows[1][1]
    both = spark.createDataFrame([*rows, (None, good, "en", "s", 0), (None, good, "en", "s", 0)], SCHEMA)
    assert corpus_pipeline.keep_good(spark, both, str(tmp_path)).where("doc_id is null").count() == 2


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rows, labels = quality_docs()
    rows += [(5000 + i, rows[1][1], "en", "s", 0) for i in range(5)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = [docs.count()]
    for _, f in corpus_pipeline.STAGES[:-1]:
        docs = common.materialize(f(spark, docs, str(tmp_path)))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append(docs.count())
    assert 180 <= seen[1] <= 190 and seen[1] - seen[2] >= 5
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert packed.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 1024
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == packed.count()


@pytest.mark.parametrize("repeats", [1, 5, 6, 50])
def test_neighbours_of_repeated_rows(spark, repeats):
    """The asked id repeated, other ids repeated, and an asked id with several vectors hide no equal vector."""
    rng = np.random.default_rng(repeats)
    same = rng.normal(size=6).tolist()
    rows = [(50, same)] * repeats + [(51, same), (52, same)] + [(60 + i, rng.normal(size=6).tolist()) for i in range(30)]
    rows += [(100, rng.normal(size=6).tolist())] + [(101, rows[-1][1])] * repeats + [(102, [2 * x for x in rows[-1][1]])] * repeats
    rows += [(150, [1.0, *(rng.normal(size=5) * 0.01).tolist()]) for _ in range(repeats)] + [(160 + i, [1.0, *(rng.normal(size=5) * 0.5).tolist()]) for i in range(7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = defaultdict(list)
    for r in neighbours.search(df, "id % 50 = 0", least=1000).collect():
        got[r.query_id].append((r.neighbour, round(r.score, 9)))
    ids, x = np.array([r[0] for r in rows]), np.stack([r[1] for r in rows])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    for q in (50, 100, 150):
        want = []
        for v in {tuple(r[1]) for r in rows if r[0] == q}:
            s = np.round(unit @ (np.array(v) / np.linalg.norm(v)), 9)
            s[ids == q] = -9
            want += [(int(ids[j]), float(s[j])) for j in np.lexsort((ids, -s))[:5]]
        assert sorted(got[q]) == sorted(want), q


def test_a_licence_that_the_file_does_not_know_matches_by_its_own_template(spark):
    own = {
        "EUPL-1.2": ["Licensed under the European Union Public Licence version 1.2."],
        "House": ["Use within the warehouse only; carriage elsewhere needs a docket."],
        "MIT": ["Released under the MIT License."],
    }
    rows = [(1, "a/x", own["EUPL-1.2"][0]), (2, "a/y", own["House"][0] + " Prose follows here."), (3, "a/z", own["MIT"][0]), (4, "b/x", "Nothing of that kind."), (5, "c/x", None)]
    got = {r.doc_id: (r.own_licence, r.licence) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, path string, text string"), templates=own).collect()}
    assert got == {1: ("EUPL-1.2", "EUPL-1.2"), 2: ("House", "House"), 3: ("MIT", "MIT"), 4: (None, None), 5: (None, None)}
    assert licences.marks_of(licences.TEMPLATES) == {f: set(ws) for f, ws in licences.MARKS.items()}  # all known families have marks of their own
    assert {"european", "union"} <= licences.marks_of(own)["EUPL"] and "licensed" not in licences.marks_of(own)["EUPL"]
