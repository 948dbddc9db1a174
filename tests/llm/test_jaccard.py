"""The pipeline's near-dedup stage against exact five-word Jaccard similarity."""

import random

import numpy as np
import pytest

from lemmata.llm import jaccard, simhash


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def kept(texts):
    sets, root = [grams(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if 5 * both >= 4 * either:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [i for i in range(len(texts)) if find(i) == i]


@pytest.mark.parametrize(("block", "shingles"), [(4, 300), (1024, 1 << 21)])
def test_keep_one(spark, monkeypatch, block, shingles):
    """Copies with planted edits from one word to more than the rule allows; a shared passage; short texts."""
    monkeypatch.setattr(jaccard, "GROUP_BLOCK", block)
    monkeypatch.setattr(jaccard, "SHINGLE_BLOCK", shingles)
    r = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    passage = r.choices(words, k=40)
    texts = [None, "", "a b", "A  b", "a b c d e", "a b c d e f"]
    for n in (30, 60, 120, 300) * 4:
        base = r.choices(words, k=n) + passage * (n < 100)
        texts.append(" ".join(base))
        for edits in range(1, 7):
            copy = list(base)
            for at in r.sample(range(len(copy)), edits * max(1, n // 100)):
                copy[at] = r.choice(words)
            texts.append(" ".join(copy))
    texts += [texts[6] + " end"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(x["doc_id"] for x in simhash.keep_one(docs).collect())
    assert got == kept(texts) and len(texts) - len(got) >= 30


def test_pigeonhole_finds(spark, monkeypatch):
    """Without prefixes, all near copies within REACH bits of a fingerprint are still found."""
    r = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for n in (80, 150, 300) * 8:
        base = r.choices(words, k=n)
        texts.append(" ".join(base))
        for edits in (1, 2, 3):
            copy = list(base)
            for at in r.sample(range(n), edits * n // 80):
                copy[at] = r.choice(words)
            texts.append(" ".join(copy))
    made = [jaccard.shingles(t) for t in texts]
    marks = np.array([np.frombuffer(jaccard.sketch(s), np.uint64)[: jaccard.FINGERPRINTS] for s in made])
    close = lambda i, j: np.bitwise_count(marks[i] ^ marks[j]).min() <= jaccard.REACH
    near = lambda i, j: 5 * (both := len(np.intersect1d(made[i], made[j]))) >= 4 * (len(made[i]) + len(made[j]) - both)
    monkeypatch.setattr(jaccard, "groups", lambda docs: docs.sparkSession.createDataFrame([], "gid long, fp long"))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"] for x in simhash.keep_one(docs).collect()}
    pairs = [(i, j) for j in range(len(texts)) for i in range(j) if close(i, j) and near(i, j)]
    assert len(pairs) >= 20 and all(j not in got for _, j in pairs)


def test_forest_joins_what_is_together():
    """Sets of one root need no edge, and what is near one of them is joined to it."""
    a = np.zeros((1, 16), np.uint64)
    far = np.full((1, 16), ~np.uint64(0))
    u, v = jaccard.near_forest(np.array([1, 2, 3, 4]), np.full(4, 10), np.array([1, 1, 3, 4]), np.concatenate([a, far, far, a]))
    assert sorted(zip(u.tolist(), v.tolist(), strict=True)) == [(1, 4), (2, 3)]
