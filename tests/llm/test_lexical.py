"""Ranked search against scores that are counted one document at a time."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from lemmata.llm import lexical, registry

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def slow_search(docs, items, k):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    n_docs, length = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for d, b, n in bags:
            m = 100 - 25 + (25 * n * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 12 * m)) for t in terms(text) if t in b)
            if s > 0:
                scores.append((-s, d is not None, d or 0))
        out += [(item, rank, d if known else None, -s) for rank, (s, known, d) in enumerate(sorted(scores)[:k], 1)]
    return out


def key(row):
    return tuple((x is not None, x) for x in row)


@pytest.fixture
def data():
    rng = random.Random(5)
    words = ["alpha", "Beta", "été", "x1", "定理", "of", "of", "of", "rare%d"]
    def text(n):
        return " ".join(rng.choice(words).replace("%d", str(rng.randint(0, 90))) for _ in range(n))

    docs = [(i, text(rng.randint(0, 40))) for i in range(400)]
    docs += [(7, "alpha alpha"), (7, "alpha alpha"), (None, "alpha été"), (1000, None), (1001, ""), (1002, "-- !?"), (1003, "of " * 30_000 + "alpha")]
    items = [(1, "alpha of of OF été"), (2, "nothing here"), (3, None), (4, "rare x1 x1 x1 定理 beta"), (4, "Alpha"), (None, "of")]
    return docs, items


@pytest.mark.parametrize(("block", "at_once"), [(8192, 1024), (64, 2)])
def test_search_equals_counting(spark, data, monkeypatch, block, at_once):
    monkeypatch.setattr(lexical, "BLOCK", block)
    docs, items = data
    got = lexical.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), ["item_id"], k=20, at_once=at_once)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(slow_search(docs, items, 20), key=key)


def test_empty_and_odd_columns(spark, data):
    docs, items = data
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert lexical.search(d.limit(0), q, ["item_id"]).count() == 0 and lexical.search(d, q.limit(0), ["item_id"]).count() == 0
    odd = q.selectExpr("item_id as `a.b`", "text as at", "'r' as rank", "'s' as SCORE", "1 as doc_id", "2 as `x``y`")
    got = lexical.search(d.selectExpr("doc_id as at", "text as `t.t`", "1 as terms"), odd, odd.columns, k=2, doc_id="at", text="t.t", query_text="at")
    assert got.columns == [*odd.columns, "rank_", "doc_id_", "score_"] and got.where("rank_ = 1").count() == 4


def test_slices():
    """Sums and the k best of random slices, dense and sparse, with repeats and ties."""
    rng = np.random.default_rng(0)
    for _ in range(60):
        n = int(rng.integers(1, 300))
        total, bags = np.zeros(n, object), []
        for _ in range(int(rng.integers(1, 9))):
            at = np.flatnonzero(rng.random(n) < rng.choice([0.02, 0.5, 1]))
            if len(at):
                x, c = rng.integers(1, rng.choice([2, 9, 1 << 33]), len(at)), int(rng.integers(1, 7))
                bags.append((c, lexical.unpacked(lexical.packed(at, x))))
                total[at] += c * x
        if bags:
            k = int(rng.integers(1, 25))
            want = sorted((-int(s), i) for i, s in enumerate(total) if s)[:k]
            assert lexical.best(lexical.added(bags, -(-n // 64)), k) == [(-s, i) for s, i in want]


def test_query(spark):
    name = next(k for k in registry.QUERIES if k.startswith("op11_"))
    df = registry.QUERIES[name](spark, SF)
    assert df.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    docs, items = (duckdb.sql(f"select * from '{SF}/{t}.parquet'").select(c).fetchall() for t, c in (("documents", "doc_id, text"), ("benchmark", "item_id, text")))
    assert sorted(map(tuple, df.collect())) == sorted(slow_search(docs, items, 20))
