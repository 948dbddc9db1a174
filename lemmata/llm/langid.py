"""Language identification with a byte convolutional network.

Filters of several widths run over the raw UTF-8 bytes of fixed-length windows,
each is max-pooled over its window, and a softmax layer gives the language.  The
network is trained in numpy on a bounded sample of labelled rows (``per_lang``, ``total``)
and, of each, on ``per_text`` windows that are spread over the whole text.  For
prediction the first layer is folded into tables over byte pairs, so a filter of
width w costs w/2 table rows a byte instead of a matrix product.

Every window of every text is used.  A document's probabilities are the mean of
its windows', weighted by their bytes.

Null text, or text without a letter: ``und`` with score 0.  Empty tables give
empty results; a text that is shorter than a window is padded with zero bytes,
as in training; a very long one has more windows, in blocks of bounded memory.  No
labelled row at all: everything is ``und``.  Equal probabilities: the first language
by name.  Rows that repeat are judged alike; rows that share doc_id and lang count once in
the sample.  A caller's columns come back unchanged, whatever their names: where lang_pred
or score is taken, the result is named with an underscore after it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ROW, per_batch, read, row_of, unfolded

UNKNOWN = "und"
WIDTHS = (2, 3, 4)
WINDOW = 256


@dataclass
class ByteCNN:
    """emb (256, E); conv[w] (w * E, K); bias[w] (K,); out (len(conv) * K, classes)."""

    langs: list[str]
    emb: np.ndarray
    conv: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray
    window: int = WINDOW

    def forward(self, x: np.ndarray) -> tuple:
        """x (n, window) uint8 -> probabilities and what the backward pass needs."""
        e = self.emb[x]
        n, length, dim = e.shape
        pooled, kept = [], []
        for w, c in self.conv.items():
            cols = np.concatenate([e[:, i : length - w + 1 + i] for i in range(w)], axis=2)
            h = cols.reshape(-1, w * dim) @ c
            h = h.reshape(n, length - w + 1, -1)
            at = h.argmax(1)
            top = np.take_along_axis(h, at[:, None], 1)[:, 0] + self.bias[w]
            pooled.append(np.maximum(top, 0))
            kept.append((w, at, cols))
        feats = np.concatenate(pooled, axis=1)
        return _softmax(feats @ self.out + self.out_bias), feats, kept

    def tables(self) -> list[tuple[int, np.ndarray, np.ndarray | None]]:
        """For each width: sums over byte pairs (and the last byte of an odd width)."""
        out = []
        dim = self.emb.shape[1]
        for w, c in self.conv.items():
            taps = [self.emb @ c[i * dim : (i + 1) * dim] for i in range(w)]
            pairs = [(taps[i][:, None] + taps[i + 1][None]).reshape(65536, -1).astype(np.float32) for i in range(0, w - 1, 2)]
            out.append((w, pairs, taps[-1].astype(np.float32) if w % 2 else None))
        return out


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def windows(data: bytes, window: int = WINDOW) -> np.ndarray:
    """(n, window) uint8.  Neighbours share the three bytes that a filter may span."""
    step = window - max(WIDTHS) + 1
    n = max(1, -(-(len(data) - max(WIDTHS) + 1) // step))
    flat = np.zeros(n * step + window, dtype=np.uint8)
    flat[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    return np.lib.stride_tricks.sliding_window_view(flat, window)[: n * step : step]


def spread(text: str, per_text: int = 4, window: int = WINDOW) -> np.ndarray:
    """(up to per_text, window): windows at even steps from the text's first to its last."""
    w = windows(text.encode(), window)
    return w[np.unique(np.linspace(0, len(w) - 1, per_text).astype(int))]


def train(
    samples: list[tuple[np.ndarray, str]],
    window: int = WINDOW,
    filters: int = 16,
    dim: int = 8,
    steps: int = 600,
    batch: int = 64,
    rate: float = 4e-3,
    seed: int = 7,
) -> ByteCNN:
    """``steps`` steps of Adam on cross-entropy, however few the samples (windows, lang)."""
    langs = sorted({lang for _, lang in samples})
    index = {x: i for i, x in enumerate(langs)}
    x = np.concatenate([w for w, _ in samples])
    y = np.array([index[lang] for w, lang in samples for _ in w])
    rng = np.random.default_rng(seed)
    net = ByteCNN(
        langs,
        rng.normal(0, 0.3, (256, dim)).astype(np.float32),
        {w: rng.normal(0, (2 / (w * dim)) ** 0.5, (w * dim, filters)).astype(np.float32) for w in WIDTHS},
        {w: np.zeros(filters, np.float32) for w in WIDTHS},
        rng.normal(0, 0.1, (len(WIDTHS) * filters, len(langs))).astype(np.float32),
        np.zeros(len(langs), np.float32),
        window,
    )
    weight = np.array([len(y) / (len(langs) * max(1, (y == i).sum())) for i in range(len(langs))], np.float32)
    params = [net.emb, *net.conv.values(), *net.bias.values(), net.out, net.out_bias]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    while step < steps:
        order = rng.permutation(len(y))
        for at in range(0, min(len(y), (steps - step) * batch), batch):
            rows = order[at : at + batch]
            xb, yb = x[rows], y[rows]
            prob, feats, kept = net.forward(xb)
            n = len(rows)
            d = prob
            d[np.arange(n), yb] -= 1
            d *= (weight[yb] / n)[:, None]
            g_out, g_ob = feats.T @ d, d.sum(0)
            d_feat = (d @ net.out.T) * (feats > 0)
            g_emb = np.zeros_like(net.emb)
            g_conv, g_bias = [], []
            for i, (w, top, cols) in enumerate(kept):
                df = d_feat[:, i * filters : (i + 1) * filters]
                g_bias.append(df.sum(0))
                # only the position that won the pool has a gradient
                won = np.take_along_axis(cols, top[:, :, None], 1)  # (n, filters, w * dim)
                g_conv.append(np.einsum("nkd,nk->dk", won, df))
                d_cols = df[:, :, None] * net.conv[w].T[None]
                for t in range(w):
                    bytes_at = np.take_along_axis(xb, top + t, 1)
                    np.add.at(g_emb, bytes_at.ravel(), d_cols[:, :, t * dim : (t + 1) * dim].reshape(-1, dim))
            step += 1
            for p, g, m, v in zip(params, [g_emb, *g_conv, *g_bias, g_out, g_ob], first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


class Predictor:
    def __init__(self, net: ByteCNN):
        self.net, self.tables = net, net.tables()

    def probabilities(self, texts: list[bytes], block: int = 128) -> np.ndarray:
        net, step = self.net, self.net.window - max(WIDTHS) + 1
        total = np.zeros((len(texts), len(net.langs)))
        mass = np.zeros(len(texts))
        parts, owner, size = [], [], []

        def flush() -> None:
            if not parts:
                return
            x = np.concatenate(parts)
            own, w = np.concatenate(owner), np.concatenate(size)
            for at in range(0, len(x), block):
                p = self._block(x[at : at + block]) * w[at : at + block, None]
                np.add.at(total, own[at : at + block], p)
                np.add.at(mass, own[at : at + block], w[at : at + block])
            parts.clear(), owner.clear(), size.clear()

        held = 0
        for i, data in enumerate(texts):
            w = windows(data, net.window)
            parts.append(w)
            owner.append(np.full(len(w), i))
            size.append(np.clip(len(data) - step * np.arange(len(w)), 1, step).astype(float))
            held += len(w)
            if held >= 4096:
                flush()
                held = 0
        flush()
        return total / np.maximum(mass, 1)[:, None]

    def _block(self, x: np.ndarray) -> np.ndarray:
        pair = np.left_shift(x[:, :-1], 8, dtype=np.intp)
        pair |= x[:, 1:]
        length, pooled = x.shape[1], []
        for w, pairs, last in self.tables:
            n = length - w + 1
            h = pairs[0].take(pair[:, :n], axis=0, mode="clip")
            for i in range(1, len(pairs)):
                h += pairs[i].take(pair[:, 2 * i : 2 * i + n], axis=0, mode="clip")
            if last is not None:
                h += last.take(x[:, w - 1 : w - 1 + n], axis=0, mode="clip")
            while n > 1:  # the pool, by halves: long runs of memory for each step
                half = n // 2
                np.maximum(h[:, :half], h[:, n - half : n], out=h[:, :half])
                n -= half
            pooled.append(np.maximum(h[:, 0] + self.net.bias[w], 0))
        return _softmax(np.concatenate(pooled, axis=1) @ self.net.out + self.net.out_bias)


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, per_lang: int = 800, total: int = 8000, per_text: int = 4, window: int = WINDOW) -> list[tuple[np.ndarray, str]]:
    """A bounded sample of labelled rows: for each language the ``per_lang`` rows with the
    least hashed doc_id, ``total`` rows at most; of each, ``per_text`` windows.

    A language's count first gives a limit that about twice the wanted rows are below, so that
    no language sends more than that to be ranked; counts are sent to the tasks, of the
    ``total`` most frequent languages at most.  Texts are cut where they lie; the driver
    gets ``total * per_text`` windows at most."""
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.withColumn("key", F.xxhash64("doc_id", "lang"))
    share = (2.0 * per_lang + 50) / F.col("n")
    low = (F.col("key") / F.lit(2.0**64) + 0.5) < share  # -2**63 .. 2**63 as 0 .. 1
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(total)
    few = rows.select("lang", "key").join(F.broadcast(counts), "lang").where(low).select("lang", "key").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    least = few.withColumn("n", rank).where(F.col("n") <= per_lang).orderBy("n", "key").limit(total).select("key")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [spread(t, per_text, window).tobytes() for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("key"), batch.column("lang"), pa.array(made, pa.binary())], names=["key", "lang", "w"])

    # ``total`` keys at most: small enough to send to each task
    chosen = rows.select("key", "lang", "text").join(F.broadcast(least), "key", "left_semi")
    cuts = chosen.mapInArrow(per_batch(cut, 500), "key long, lang string, w binary")
    one = cuts.groupBy("key").agg(F.min(F.struct("lang", "w")).alias("x")).orderBy("key").limit(total).select("x.*")
    return [(np.frombuffer(r.w, np.uint8).reshape(-1, window), r.lang) for r in one.collect()]


def fit(docs: DataFrame, per_lang: int = 800, total: int = 8000, per_text: int = 4, **how) -> ByteCNN | None:
    rows = sample(docs, per_lang, total, per_text, how.get("window", WINDOW))
    return train(rows, **how) if rows else None


MADE = ["lang_pred", "score"]


def _scored(docs: DataFrame, net: ByteCNN | None, text: str, keep: list[str]) -> DataFrame:
    """(_row, lang_pred, score)"""
    if net is None:
        return docs.select(row_of(keep), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    source = docs.select(row_of(keep), F.col(text).alias("text"), letter.alias("letter"))
    schema = source.select(ROW).schema.add("lang_pred", "string").add("score", "double")
    shared = docs.sparkSession.sparkContext.broadcast(net)
    made_by = {}

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        if "model" not in made_by:
            made_by["model"] = Predictor(shared.value)
        model = made_by["model"]
        texts = batch.column("text").to_pylist()
        known = [i for i, ok in enumerate(batch.column("letter").to_pylist()) if ok]
        lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if known:
            p = model.probabilities([texts[i].encode() for i in known])
            for i, k, s in zip(known, p.argmax(1), p.max(1), strict=True):
                lang[i], score[i] = model.net.langs[k], min(1.0, float(s))
        return pa.RecordBatch.from_arrays([batch.column(ROW), pa.array(lang, pa.string()), pa.array(score)], names=[ROW, *MADE])

    return source.mapInArrow(per_batch(work, 500), schema)


def predict(docs: DataFrame, net: ByteCNN | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns by default) plus lang_pred and score.  Only ``text`` decides."""
    keep = docs.columns if keep is None else keep
    return unfolded(_scored(docs, net, text, keep), keep, MADE)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = predict(docs, fit(docs), keep=["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def accept(docs: DataFrame, net: ByteCNN | None, least: float = 0.5) -> DataFrame:
    """The rows whose text is in a learned language with a score of ``least`` or more."""
    scored = _scored(docs, net, "text", docs.columns)
    return unfolded(scored.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)), docs.columns, [])
