"""Whole queries against slow versions: op2's order and cells, op4's order, op7's windows, the pipeline."""

import re
import zlib
from collections import defaultdict
from html.parser import HTMLParser

import duckdb
import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from lemmata.llm import htmltext, langid, quality, sharding, tokens
from lemmata.llm.common import read
from test_jaccard import kept as brute

SF = "/root/testdata/sf0.001"


class Words(HTMLParser):
    """The words of what is shown, as they stand."""

    HIDDEN = {"head", "script", "style", "template", "noscript", "title"}

    def __init__(self):
        super().__init__()
        self.words, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in self.HIDDEN

    def handle_endtag(self, tag):
        self.hidden -= tag in self.HIDDEN and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden:
            self.words += re.findall(r"\w+", data)


def test_op2_order():
    """On the given pages (which have no table cells): all words in the order of the source."""
    for (source,) in duckdb.sql(f"select html from '{SF}/pages.parquet' where html is not null").fetchall():
        if not re.search(r"(?i)hidden|display|visibility|<ol|<img|<input", source):
            want = Words()
            want.feed(source)
            want.close()
            assert re.findall(r"\w+", htmltext.extract(source)) == want.words


def test_op2_random_tables():
    """Every row a line, and every column as wide as its widest cell."""
    rng = np.random.default_rng(5)
    for _ in range(60):
        wide, high = int(rng.integers(2, 5)), int(rng.integers(1, 6))
        cells = [[" ".join("w" * int(rng.integers(1, 9)) + str(i * 10 + j) for _ in range(int(rng.integers(1, 4)))) for j in range(wide)] for i in range(high)]
        source = "<p>before</p><table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in cells) + "</table><p>after</p>"
        column = [max(len(r[j]) for r in cells) for j in range(wide)]
        want = "\n".join(" | ".join([*(c.ljust(n) for c, n in zip(r[:-1], column, strict=False)), r[-1]]) for r in cells)
        assert htmltext.extract(source) == f"before\n\n{want}\n\nafter"


def test_op4_order(spark):
    """Cells by counting ranks, and every place in every shard."""
    rows = [(r["doc_id"], r["source"], r["lang"], r["text"] or "") for r in read(spark, SF, "documents").collect()]
    rows = [(k, source, lang, len(t.encode()) + 16, zlib.crc32(t.encode())) for k, source, lang, t in rows]
    cells = []
    for i in (1, 2, 3, 0):
        values = sorted(r[i] for r in rows)
        edges = {values[-(-k * len(values) // 32) - 1] for k in range(1, 32)}
        cells.append([sum(e < r[i] for e in edges) for r in rows])
    place = sharding.hilbert_index(np.array(cells).T, 5)
    order = sorted(range(len(rows)), key=lambda i: (place[i], rows[i][4], rows[i][3], rows[i][0]))
    small, more = divmod(len(rows), 40)
    sizes = [small + (s < more) for s in range(40)]
    want = {}
    for s, n in enumerate(sizes):
        for slot in range(n):
            want[rows[order[sum(sizes[:s]) + slot]][0]] = (s, slot)
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.query(spark, SF).collect()} == want


def slow_language(net, text):
    """Every window of the whole text by plain sums over its bytes, weighted by what is new in it."""
    data = text.encode()
    step, total, mass = net.window - 3, 0, 0
    for at in range(0, max(1, len(data) - 3), step):
        x = np.zeros(net.window, int)
        part = data[at : at + net.window]
        x[: len(part)] = list(part)
        feats = []
        for w, c in net.conv.items():
            runs = np.stack([net.emb[x[i : net.window - w + 1 + i]] for i in range(w)], axis=1)
            feats.append(np.maximum((runs.reshape(len(runs), -1) @ c).max(0) + net.bias[w], 0))
        z = np.concatenate(feats) @ net.out + net.out_bias
        p = np.exp(z - z.max())
        weight = min(max(len(data) - at, 1), step)
        total, mass = total + weight * p / p.sum(), mass + weight
    return total / mass


def test_op7_windows(spark):
    docs = read(spark, SF, "documents").select("doc_id", "text", "lang")
    net = langid.fit(docs, per_lang=40)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in langid.predict(docs, net, keep=["doc_id"]).collect():
        text = texts[r["doc_id"]]
        if not re.search(r"[^\W\d_]", text or ""):
            assert (r["lang_pred"], r["score"]) == (langid.UNKNOWN, 0.0)
            continue
        p = slow_language(net, text)
        assert abs(p.max() - r["score"]) < 1e-4 and (net.langs[p.argmax()] == r["lang_pred"] or np.diff(np.sort(p))[-1] < 1e-4)


def test_pipeline_run(spark):
    """The last table, from slow versions of the stages."""
    docs = read(spark, SF, "documents")
    net = langid.fit(docs.select("doc_id", "text", "lang"))
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    left = {k: t for k, t in rows.items() if re.search(r"[^\W\d_]", t or "") and slow_language(net, t).max() >= 0.5}
    bits = {r["doc_id"]: r["fail_bits"] for r in quality.ledger(docs, keep=["doc_id"]).collect()}
    left = sorted((k, t) for k, t in left.items() if not bits[k] & quality.mask(quality.POLICIES["web-2"]))
    left = [left[i] for i in brute([t for _, t in left])]
    tok = Tokenizer.from_file(tokens.file_of("word_bpe_49k.json"))
    want = {k: len(tok.encode(t, add_special_tokens=False).ids) + 1 for k, t in left}
    pieces = defaultdict(list)
    for r in corpus_pipeline.run(spark, SF).collect():
        pieces[r["doc_id"]].append((r["start"], r["length"]))
    assert {k: sum(n for _, n in p) for k, p in pieces.items()} == want
    for p in pieces.values():
        at = 0
        for start, n in sorted(p):
            assert start == at and n & (n - 1) == 0 and n <= 2048
            at += n
