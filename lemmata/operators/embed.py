"""Embedding: pluggable models, loaded once a Python worker.

``HashingModel`` needs nothing and is the default.  ``SentenceModel`` and ``MaskedMeanModel``
wrap models of the sentence-transformers and transformers packages, which are imported where
they run; use them as ``Embedder(SentenceModel(name), MaskedMeanModel(name))``."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.query import in_math, in_text, prompt, query_type
from ..schema import MATH_DIM, MAX_TOKENS, POOL_FLOOR, TEXT_DIM

#: A model's factory; its model maps texts to an (n, dim) array.
Model = Callable[[], Callable[[list[str]], np.ndarray]]


def mean_pool(hidden: np.ndarray, mask: np.ndarray, floor: float = POOL_FLOOR) -> np.ndarray:
    """(n, tokens, dim), (n, tokens) -> (n, dim): the mean over unmasked tokens."""
    m = mask[:, :, None].astype(float)
    return (hidden * m).sum(1) / np.maximum(m.sum(1), floor)


def normalized(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


@dataclass(frozen=True)
class HashingModel:
    """Signed hashed character n-grams; a text that is shorter than a gram is one."""

    dim: int
    sizes: tuple[int, ...] = (3, 4)

    def __call__(self) -> Callable[[list[str]], np.ndarray]:
        mix = np.uint64(0x9E3779B97F4A7C15)

        def one(text: str) -> np.ndarray:
            chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
            out = np.zeros(self.dim)
            for n in self.sizes:
                n = min(n, len(chars))
                h = np.full(max(1, len(chars) - n + 1), n, np.uint64)
                for i in range(n):
                    h = (h ^ chars[i : i + len(h)]) * mix
                    h ^= h >> np.uint64(29)
                sign = 1.0 - 2.0 * (h >> np.uint64(63)).astype(float)
                out += np.bincount((h % np.uint64(self.dim)).astype(np.int64), sign, self.dim)
            return out

        return lambda texts: np.stack([one(t) for t in texts]) if texts else np.zeros((0, self.dim))


def device(wanted: str | None = None) -> str:
    """``wanted``, or the best that torch has here: cuda, mps, cpu."""
    if wanted:
        return wanted
    import torch

    if torch.cuda.is_available():
        return "cuda"
    return "mps" if torch.backends.mps.is_available() else "cpu"


@dataclass(frozen=True)
class SentenceModel:
    """A sentence encoder by its name; queries come with their prompt in front already."""

    name: str
    on: str | None = None
    batch: int = 32

    def __call__(self) -> Callable[[list[str]], np.ndarray]:
        from sentence_transformers import SentenceTransformer

        model = SentenceTransformer(self.name, device=device(self.on))
        return lambda texts: model.encode(texts, batch_size=self.batch, normalize_embeddings=True, convert_to_numpy=True)


@dataclass(frozen=True)
class MaskedMeanModel:
    """A token encoder by its name: the mean of its last layer over the unmasked of at most
    ``tokens`` tokens."""

    name: str
    on: str | None = None
    batch: int = 32
    tokens: int = MAX_TOKENS

    def __call__(self) -> Callable[[list[str]], np.ndarray]:
        import torch
        from transformers import AutoModel, AutoTokenizer

        where = device(self.on)
        split, model = AutoTokenizer.from_pretrained(self.name), AutoModel.from_pretrained(self.name).to(where)
        model.eval()

        def encode(texts: list[str]) -> np.ndarray:
            out = []
            for at in range(0, len(texts), self.batch):
                made = split(texts[at : at + self.batch], padding=True, truncation=True, max_length=self.tokens, return_tensors="pt").to(where)
                with torch.no_grad():
                    hidden = model(**made).last_hidden_state
                out.append(mean_pool(hidden.cpu().numpy(), made["attention_mask"].cpu().numpy()))
            return np.concatenate(out)

        return encode


_loaded: dict = {}


def encoder(model: Model) -> Callable[[Column], Column]:
    """A column function text -> unit vector.  Null text gives null."""

    @F.pandas_udf("array<float>")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if model not in _loaded:
            _loaded[model] = model()
        for texts in parts:
            known = texts.notna().to_numpy()
            out = np.full(len(texts), None, dtype=object)
            if known.any():
                made = normalized(np.asarray(_loaded[model](texts[known].tolist()), float)).astype(np.float32)
                out[np.flatnonzero(known)] = list(made)
            yield pd.Series(out)

    return encode


@dataclass
class Embedder:
    text: Model = HashingModel(TEXT_DIM)
    math: Model = HashingModel(MATH_DIM)

    @property
    def name(self) -> str:
        """Tells apart whose vectors stored ones are."""
        return hashlib.md5(repr((self.text, self.math)).encode()).hexdigest()

    def blocks(self, blocks: DataFrame) -> DataFrame:
        """Adds text_vec and math_vec."""
        return blocks.withColumn("text_vec", encoder(self.text)(F.col("text"))).withColumn("math_vec", encoder(self.math)(F.col("text")))

    def queries(self, queries: DataFrame) -> DataFrame:
        """(query, ...) -> with query_type, text_vec, math_vec.  Only the views that the
        kind asks for are embedded: the other's input is null, so its model sees nothing."""
        kind = F.col("query_type")
        typed = queries.withColumn("query_type", query_type(F.col("query")))
        return typed.withColumn("text_vec", encoder(self.text)(F.when(in_text(kind), prompt(F.col("query"))))).withColumn("math_vec", encoder(self.math)(F.when(in_math(kind), F.col("query"))))
