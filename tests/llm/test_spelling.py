"""Spelling variants against comparing each word with each other."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from lemmata.llm import registry, spelling

SF = "/root/testdata/sf0.001"


def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[p + 1 :] == b[p + 1 :] or a[p:] == b[p + 1 :] or a[p + 1 :] == b[p:]


def slow_groups(docs, ratio=10):
    count = Counter()
    for d, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            count[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    count = {w: n for w, n in count.items() if n >= 2 and len(w) >= 7}
    # words within one edit share what is left of them without some character, or are it
    by = {}
    for w in count:
        for x in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by.setdefault(x, []).append(w)
    near = {w: set() for w in count}
    for group in by.values():
        for a in group:
            near[a].update(b for b in group if one_apart(a, b))
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-count[x], x), default=None)
        if best is not None and count[best] >= ratio * count[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w, ""), root(w), n, len(near[w]), count.get(form.get(w), 0)) for w, n in count.items())


def rows(df):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or 0) for r in df.collect())


def test_tries_find_what_comparing_finds():
    rng = random.Random(1)
    for _ in range(400):
        letters, most = rng.choice(["a", "ab", "abé"]), rng.choice([2, 4, 9])
        some = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(1, most)))  # noqa: B023, E731
        words = sorted({some() for _ in range(rng.randint(0, 40))})
        trie = spelling.Trie([(w, i) for i, w in enumerate(words)])
        assert len(trie.own) <= 2 * len(words) + 1
        asked = sorted([*words, some(), some(), some()])
        got = {asked[i]: sorted(map(trie.word, nodes)) for i, nodes in trie.near(asked)}
        assert got == {w: near for w in asked if (near := [x for x in words if one_apart(w, x)])}


@pytest.mark.parametrize("shard", [2 << 20, 100])
def test_groups(spark, monkeypatch, shard):
    """Chains of forms, ties, long words, and with many small tries in several passes."""
    monkeypatch.setattr(spelling, "SHARD", shard)
    monkeypatch.setattr(spelling, "PASS", 3000 if shard == 100 else spelling.PASS)
    rng = random.Random(2)
    base = ["theorems", "theoremes", "theoreme", "xtheoreme", "lemmatas", "lemmatis", "lemmatos", "été" * 3, "z" * 5000, "z" * 5001]
    docs = [(i, " ".join(rng.choice(base[: 1 + i % 10]) for _ in range(60))) for i in range(300)]
    docs += [(500, "chainaaa " * 2), (501, "chainaab " * 30), (502, "chainabb " * 400), (503, "chainbbb " * 5000)]
    docs += [(None, "nobodys nobodys"), (504, None), (505, ""), (506, "short words only"), (7, "theorems"), (7, "theorems")]
    got = spelling.grouped(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"] and rows(got) == slow_groups(docs)
    by = {r[0]: r for r in rows(got)}
    assert by["chainaaa"][2] == "chainbbb"


def test_empty_and_odd_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.grouped(empty).count() == 0
    odd = spark.createDataFrame([(1, "wordword wordword", "x", "y")], "`a.b` long, word string, n string, form string")
    assert rows(spelling.grouped(odd, doc_id="a.b", text="word")) == slow_groups([(1, "wordword wordword")])


def test_query(spark):
    name = next(k for k in registry.QUERIES if k.startswith("op12_"))
    df = registry.QUERIES[name](spark, SF)
    assert dict(df.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}
    assert rows(df) == slow_groups(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())
