"""Fingerprints, token counts, near-dedup and packing against plain Python."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from verisieve.llm import components, fingerprint, near_dedup, packing, token_counts

from .conftest import SCHEMA, corpus, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_fingerprints_against_plain_python(docs, rows):
    got = fingerprint.edited_pairs(docs).collect()
    order = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: r)
    assert len(got) == len(order)
    want = []
    for i, (k, t) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1]
        cut = len(t) // 4
        want.append((k, len(t), hashlib.sha256((t[: len(t) - cut] + nxt[:cut]).encode()).hexdigest()))
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    prints = dict(zip((t for _, t in order), map(fingerprint.encode, fingerprint.digests([t.encode() for _, t in order])), strict=True))
    texts = dict(order)
    for r in got:
        assert r.fingerprint == prints[texts[r.doc_id]] and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert r.near_edited == pytest.approx(fingerprint.likeness_of(r.fingerprint, r.edited_fingerprint))
    same = [r for r in got if 2000 <= r.doc_id < 2008]
    assert {r.near_next for r in same} == {1.0} and len({r.fingerprint for r in same}) == 1


def test_fingerprints_of_one_row_and_none(spark, empty):
    one = fingerprint.edited_pairs(spark.createDataFrame([(7, "abcdefgh", "en", "s", 8)], SCHEMA)).collect()
    assert [(r.doc_id, r.edited_sha256, r.near_next) for r in one] == [(7, hashlib.sha256(b"abcdefab").hexdigest(), 1.0)]
    assert fingerprint.edited_pairs(empty).count() == 0
    assert fingerprint.fingerprint_texts(empty).count() == 0
    gone = fingerprint.edited_pairs(spark.createDataFrame([(None, "a", "en", "s", 1), (2**60 + 1, "b", "en", "s", 1)], SCHEMA)).collect()
    assert {r.doc_id for r in gone} == {None, 2**60 + 1}


def test_digest_separates_edits_from_others():
    rng = random.Random(3)
    t = [" ".join(words(rng, 150)) for _ in range(40)]
    own = fingerprint.digests([x.encode() for x in t])
    edited = fingerprint.digests([(x[: len(x) * 3 // 4] + y[: len(x) // 4]).encode() for x, y in zip(t, t[1:] + t[:1], strict=True)])
    assert (fingerprint.likeness(own, edited) > fingerprint.likeness(own, np.roll(own, -1, 0))).mean() > 0.9
    assert fingerprint.likeness(own, own).min() == 1.0


def read_vocabulary() -> list[bytes]:
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:  # read here, without the operator's help
        ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    return [ranks[i] for i in range(len(ranks))]


def pre_tokens(text: str | None) -> list[bytes]:
    """Words with the one space before them, and the rest of white-space runs, character by character."""
    white, data, out, i = b"\t\n\x0b\x0c\r ", (text or "").encode(), [], 0
    while i < len(data):
        j = i
        while j < len(data) and data[j] in white:
            j += 1
        k = j
        while k < len(data) and data[k] not in white:
            k += 1
        if k == j:
            out.append(data[i:j])
        else:
            lead = j - 1 if j > i and data[j - 1] == 32 else j
            if j - 1 > i:
                out.append(data[i : j - 1])
            if lead == j and j > i:
                out.append(data[j - 1 : j])
            out.append(data[lead:k])
        i = k
    return out


def split_word(w: bytes, scores: dict[bytes, float], longest: int) -> list[bytes]:
    """The best split without any sharing; ties to fewer tokens, then to the shorter last piece."""
    best: list[tuple[float, int, int]] = [(0.0, 0, 0)]
    for i in range(1, len(w) + 1):
        best.append(max((best[j][0] + scores[w[j:i]], best[j][1] - 1, j) for j in range(max(0, i - longest), i) if w[j:i] in scores))
    out, i = [], len(w)
    while i:
        out.append(w[best[i][2] : i])
        i = best[i][2]
    return out[::-1]


def plain_scores(texts, pieces: list[bytes], rounds: int) -> dict[bytes, float]:
    scores, longest = {p: -math.log(i + 1.0) for i, p in enumerate(pieces)}, max(map(len, pieces))
    for _ in range(rounds):
        n = Counter()
        for w, k in Counter(w for t in texts for w in pre_tokens(t)).items():
            for p in split_word(w, scores, longest):
                n[p] += k
        scores = {p: math.log((n[p] + 1) / (sum(n.values()) + len(pieces))) for p in pieces}
    return scores


@pytest.mark.parametrize("rounds", [0, 2])
def test_token_counts_against_unshared_search(docs, rows, empty, rounds):
    path, pieces = public_tokenizers.path("byte_bpe_50k.tiktoken"), read_vocabulary()
    scores, longest = plain_scores([r[1] for r in rows], pieces, rounds), max(map(len, pieces))
    told = {w: len(split_word(w, scores, longest)) for w in {w for r in rows for w in pre_tokens(r[1])}}
    want = sorted((r[0], len((r[1] or "").encode().split()), sum(told[w] for w in pre_tokens(r[1]))) for r in rows)
    assert sorted(map(tuple, token_counts.token_counts(docs, path, rounds=rounds).collect())) == want
    assert token_counts.token_counts(empty, path, rounds=rounds).count() == 0


def test_token_counts_cover_every_byte(rows):
    odd = ["a  b", " a", "a ", "\n\na\n b\t c", "  ", "\r\n", "x\t y", "\x1c z", "é\u00a0ü \u2003 b"]
    for t in [r[1] or "" for r in rows] + odd:
        found = token_counts.PRE_TOKEN.findall(t.encode())
        assert b"".join(found) == t.encode() and found == pre_tokens(t), t[:40]


def test_token_counts_know_the_whole_vocabulary(spark):
    path, pieces = public_tokenizers.path("byte_bpe_50k.tiktoken"), read_vocabulary()
    scores, longest = {p: -math.log(i + 1.0) for i, p in enumerate(pieces)}, max(map(len, pieces))
    one = ["responsibilities", "telecommunications", "misunderstanding", "characterization", "disproportionately", "entrepreneurship"]
    texts = [*(" " + w for w in one), "-" * 64, "=" * 64, "_" * 64, "-" * 63 + " " + "-" * 200, "responsibilitiesX xresponsibilities", *(p.decode() for p in pieces if len(p) > 16 and p.isascii() and not p.strip().count(b" "))]
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA), path, rounds=0).collect()}
    assert [got[i] for i in range(len(one))] == [1] * len(one)
    assert got == {i: sum(len(split_word(w, scores, longest)) for w in pre_tokens(t)) for i, t in enumerate(texts)}


def test_token_counts_with_a_small_store(docs, monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    want = sorted(map(tuple, token_counts.token_counts(docs, path).collect()))
    for name, value in (("STORE", 40), ("STORE_BYTES", 3)):
        monkeypatch.setattr(token_counts, name, value)
    assert sorted(map(tuple, token_counts.token_counts(docs, path).collect())) == want


def shingle_set(text):
    w = [x.translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})) for x in WORD.findall(text or "")]
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def plain_components(rows, percent=85):
    ids = [r[0] for r in rows]
    sets = [shingle_set(r[1]) for r in rows]
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for i, s in enumerate(sets):
        both = Counter(j for g in s for j in where[g])
        for j, n in both.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(ids[i]), find(ids[j])
                parent[max(a, b)] = min(a, b)
        for g in s:
            where[g].append(i)
    return {i: (len(s), find(i)) for i, s in zip(ids, sets, strict=True)}


@pytest.mark.parametrize("percent", [85, 80])
def test_near_dedup_against_brute_force(docs, rows, percent):
    want = plain_components(rows, percent)
    got = near_dedup.near_duplicates(docs, percent).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc_id], r
        assert r.kept == (r.doc_id == r.component_id)


def test_near_dedup_of_a_group_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    monkeypatch.setattr(near_dedup, "MOST", 16)
    rng = random.Random(9)
    base = words(rng, 90)
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 4])):
            w[rng.randrange(len(w))] = f"edit{i}"
        rows.append((i, " ".join(w), "en", "s", 0))
    want = plain_components(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want and len({c for _, c in want.values()}) > 1


def near(spark, rows, percent=85):
    return near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), percent).collect()


def test_near_dedup_of_nothing_and_of_null_ids(spark, empty):
    assert near_dedup.near_duplicates(empty).count() == 0
    rng = random.Random(31)
    a, b, c = (words(rng, 60) for _ in range(3))
    rows = [(None, " ".join(a), "en", "s", 1), (4, " ".join(a), "en", "s", 1), (3, " ".join([*a, "end"]), "en", "s", 1)]
    rows += [(None, " ".join(b), "en", "s", 1), (None, " ".join([*b, "end"]), "en", "s", 1), (None, " ".join(c), "en", "s", 1), (9, " ".join([*c, "end"]), "en", "s", 1), (None, None, "en", "s", 1)]
    got = Counter((r.doc_id, r.component_id, r.kept) for r in near(spark, rows))
    assert got == Counter([(None, 3, False), (4, 3, False), (3, 3, True), (None, None, True), (None, None, True), (None, 9, False), (9, 9, True), (None, None, True)])


def test_near_dedup_reads_asked_texts_again_and_no_others(spark):
    rows = [(None, "a b c")] * 6 + [(None, "d e f"), (7, "a b c"), (7, "g h i"), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.xxhash64("text").alias("mark"), "text")
    asked = docs.where("doc_id is null and text = 'a b c' or text = 'g h i' or doc_id = 8").select(F.col("doc_id").alias("rep"), "mark")
    again = near_dedup.asked_texts(docs, asked)
    assert sorted(map(str, again.collect())) == sorted(map(str, docs.where("text = 'a b c' and doc_id is null or text = 'g h i' or doc_id = 8").select("doc_id", "text").collect()))
    sets = near_dedup.full_sets(again.coalesce(1)).collect()
    assert len(sets) == 3 and sorted(len(r.shingles) for r in sets) == [0, 8, 8] and {r.digest is None for r in sets if not r.shingles} == {True}


def test_near_dedup_of_ids_with_several_texts(spark):
    rng = random.Random(32)
    a, b, c = (words(rng, 60) for _ in range(3))
    rows = [(k, " ".join(t), "en", "s", 1) for k, t in ((1, a), (1, b), (2, [*a, "end"]), (3, [*b, "end"]), (4, c), (1, a), (6, [*c, "end"]), (4, b))]
    want = plain_components(rows)
    assert {c for _, c in want.values()} == {1}
    for part in (rows, rows[::-1]):
        assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near(spark, part)) == Counter((r[0], len(shingle_set(r[1])), 1, r[0] == 1) for r in rows)


@pytest.mark.parametrize("percent", [80, 85])
def test_near_dedup_at_every_size_round_the_border(spark, percent):
    """A document of n shingles beside the longest that still links with it, and beside the first that does not."""
    rng = random.Random(33)
    rows = []
    for n in range(55, 96):
        most = 100 * n // percent
        for large in (most, most + 1):
            w = [f"w{rng.getrandbits(60)}" for _ in range(large + 4)]
            rows += [(len(rows), " ".join(w[: n + 4]), "en", "s", 0), (len(rows) + 1, " ".join(w), "en", "s", 0)]
    want = plain_components(rows, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near(spark, rows, percent)}
    assert got == want and len({c for _, c in want.values()}) == len(rows) // 2 + 41


def test_near_dedup_of_a_cluster_of_groups_that_do_not_link(spark, monkeypatch):
    """Versions of one long text: neighbours link, others share bands but do not; large and small groups in one cluster."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "MOST", 8)
    rng = random.Random(34)
    base, rows = words(rng, 400), []
    for i in range(160):
        w = list(base)
        for j in range(18 * (i % 7 if i % 3 else 3)):
            w[(j * 5) % 400] = f"v{i % 7 if i % 3 else 3}x{j}"
        if i % 3:
            w[399 - i] = f"own{i}"
        rows.append((i, " ".join(w), "en", "s", 0))
    want = plain_components(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near(spark, rows)} == want


def test_small_and_large_sketches_find_pairs_at_the_border():
    rng = np.random.default_rng(5)
    found = total = 0
    for n in (7, 20, 60, 64, 70, 75, 90, 300):
        for _ in range(60):
            union = np.unique(rng.integers(0, 2**64 - 1, n, dtype=np.uint64))
            out = int(0.14 * n)
            a, b = union[: n - out // 2], union[out - out // 2 :]
            total += 1
            found += bool(set(near_dedup.band_keys(a, near_dedup.raw_registers(a)).tolist()) & set(near_dedup.band_keys(b, near_dedup.raw_registers(b)).tolist()))
    assert found == total


def test_pairs_between_the_two_tables_meet_at_80_percent(spark):
    rng = random.Random(11)
    rows = []
    for small, large in ((63, 76), (63, 77), (63, 78), (62, 76), (62, 77), (61, 76)):
        for _ in range(5):
            w = [f"w{rng.getrandbits(60)}" for _ in range(large + 4)]  # as many shingles as the size says
            k = 10 * len(rows)
            rows += [(k, " ".join(w[: small + 4]), "en", "s", 0), (k + 1, " ".join(w), "en", "s", 0)]
    want = plain_components(rows, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), 80).collect()}
    assert got == want and len({c for _, c in want.values()}) == 30


def test_estimate_corrects_accidental_matches():
    rng = np.random.default_rng(6)
    shared, one, two = (rng.integers(0, 2**64 - 1, k, dtype=np.uint64) for k in (4000, 1000, 1000))
    a, b = (near_dedup.raw_registers(np.unique(np.concatenate([shared, x]))) for x in (one, two))
    c = near_dedup.accidental(3, 3)
    assert 0 < c < 0.01
    assert ((a == b).mean() - c) / (1 - c) == pytest.approx(4000 / 6000, abs=0.08)


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def test_word_tokenizer_equals_tokenizers_on_whole_texts(rows):
    plain = Tokenizer.from_file(TOKENIZER)
    own = packing.WordTokenizer(TOKENIZER)
    odd = ["a  b", "a   b c", "x\n\ny", "\n", " ", " lead", "trail ", "tab\t b", "t\t\tx y", "cr\r\nz w", "no\u00a0break x", "<|endoftext|> hi", "a\n b", "a \nb", "\x1f a b", "b \x1fa", "it's I'll 'll a", "日本 語 x\u3000y", "é\u0301 b", "9 99 a1b2 !!? ."]
    for t in [r[1] or "" for r in rows] + odd:
        assert own.encode(t) == np.asarray(plain.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes(), t[:40]


def test_packing_is_an_exact_round_trip(docs, rows, empty):
    got = packing.pack(docs, TOKENIZER, length=64).collect()
    plain = Tokenizer.from_file(TOKENIZER)
    want = Counter()
    for k, t, *_ in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [2]
        cuts, start = [], 0
        first = len(ids) % 64 or 64 if len(ids) > 64 else len(ids)
        while start < len(ids):
            stop = min(len(ids), start + (first if start == 0 else 64))
            cuts.append((start, stop))
            start = stop
        for p, (a, b) in enumerate(cuts):
            want[k, p, a, b - a, zlib.crc32(np.asarray(ids[a:b], dtype="<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for x in by.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by) <= 1.05 * -(-sum(r.length for r in got) // 64) + 1
    assert packing.pack(empty, TOKENIZER).count() == 0


def test_plan_covers_any_histogram():
    rng = np.random.default_rng(2)
    for size, h in ((100, {int(k): int(v) for k, v in zip(rng.integers(1, 101, 300), rng.integers(1, 400, 300), strict=True)}), (10, {10: 3}), (10, {7: 5, 1: 1}), (8, {})):
        counts = Counter()
        for lengths, n in packing.plan(h, size):
            assert sum(lengths) <= size and n > 0
            for v in lengths:
                counts[v] += n
        assert counts == Counter({k: v for k, v in h.items() if v})


def test_corpus_is_what_the_tests_need():
    assert len({r[0] for r in corpus()}) < len(corpus())
