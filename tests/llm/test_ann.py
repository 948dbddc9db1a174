"""Repeated ids, and the exact way for many queries, against brute force."""

import numpy as np

from lemmata.llm import ann

KIND = "id long, v array<double>"


def slow(rows, queries, k):
    one = {}
    for i, v in rows:
        one[i] = min(one.get(i, v), v)
    out = []
    for q in sorted({i for i, _ in queries}):
        own = min(v for i, v in queries if i == q)
        near = sorted((float(np.sqrt(((np.array(v) - own) ** 2).sum())), i) for i, v in one.items() if i != q and len(v) == len(own))
        out += [(q, rank, i, round(d, 9)) for rank, (d, i) in enumerate(near[:k], 1)]
    return out


def shown(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in df.collect())


def test_repeated_ids(spark):
    """An id with several vectors has one list, and one place in those of others."""
    rng = np.random.default_rng(1)
    rows = [(i // 3 if i % 4 == 0 else i, rng.normal(size=5).round(2).tolist()) for i in range(60)]
    rows += rows[:7] + [(5, rows[0][1]), (100, [1.0, 2.0])]
    df = spark.createDataFrame(rows, KIND)
    want = [x for x in slow(rows, rows, 4)]
    got = shown(ann.search(df, df, k=4, success=0.999999))
    assert got == want and len({x[:2] for x in got}) == len(got)


def test_exact_grid(spark, monkeypatch):
    """More queries to search exactly than are sent at once: rows and queries meet in blocks."""
    for name, value in (("EXACT", 5), ("CELL_ROWS", 30), ("CELL_QUERIES", 7)):
        monkeypatch.setattr(ann, name, value)
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=4 + i % 2) * 10 ** (i % 3)).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, KIND)
    assert shown(ann.search(df, df, k=6, most=1)) == slow(rows, rows, 6)
