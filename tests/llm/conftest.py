from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice(["ta", "ri", "mon", "ke", "lu", "sha", "ve"]) for _ in range(rng.randint(1, 3))) for _ in range(n)]


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    """Documents with copies, near copies, null and empty texts, a very long text, null sources and repeated rows."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        t = " ".join(words(rng, rng.randint(1, 160)))
        rows.append((10 + 3 * i, t.replace(" lu", ".\nLu"), "en", f"s{i % 4}", len(t)))
    base = words(rng, 120)
    for i in range(12):
        w = list(base)
        for _ in range(i % 5):
            w[rng.randrange(len(w))] = "changed"
        rows.append((1000 + i, " ".join(w), "fr", "s0", 1))
    rows += [(2000 + i, "the very same text of seven words", "en", "s1", 33) for i in range(9)]
    rows += [(3000, None, None, None, None), (3001, "", "en", None, 0), (3002, " \t\n ", "en", "s2", 4), (3003, "one", "en", "s2", 3), (3004, "ÄÖ é two\u00a0three four five SIX", "de", "s3", 28)]
    rows += [(4000, " ".join(words(rng, 9000)), "en", "s2", 1), (4001, "x" * 30_000, "en", "s2", 30_000), (5000, "twice here", "en", "s3", 10), (5000, "twice here", "en", "s3", 10)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With extra columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    d = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return d.withColumns({c: F.lit("x") for c in ("size", "h", "rank", "digest", "shard", "runs", "words", "score", "length", "path_", "key")})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
