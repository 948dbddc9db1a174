"""Byte-level BPE encoding and decoding with a pair occurrence index.

The texts of a batch are cut into pieces by the tokenizer's pattern, and pieces that
were not met before are merged together: all their symbols lie in one array with links
to the neighbours, and an index maps each pair of symbols to all its positions.  Active
ranks are taken in ascending order from a heap; a rank's pair is merged at all its
positions, from left to right, and the lists of the pairs that this changes are updated.
Stale positions are left in their lists and skipped when met.

All merges of one rank at once equal the usual piece-by-piece order if no merge can
make a pair of lower or equal rank; ``Merges`` checks that when it is made.

Null text counts as empty (no ids).  Special tokens in a text give their ids, and decode
to their text.  Very long pieces are merged like others but not kept.  An empty table
gives an empty result, and repeated rows are encoded alike.  A caller's columns come back
unchanged, whatever their names: a result whose name is taken is named with an underscore
after it.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .common import ROW, per_batch, read, row_of, unfolded
from .tokens import byte_letters, chunks, file_of, kept, load

#: Fixed value: the pattern of byte-level BPE with this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEPT_LENGTH = 64


class Merges:
    """What encoding needs of a tokenizer's file."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        kind = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or not kind.get("use_regex"):
            raise ValueError("not a plain byte-level BPE")
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.byte_id = np.zeros(256, np.int32)
        for c, b in letters.items():
            self.byte_id[b] = vocab[c]
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes = [b""] * self.size
        for t, i in vocab.items():
            self.bytes[i] = bytes(letters[c] for c in t)
        for t, i in self.special.items():
            self.bytes[i] = t.encode()
        #: pair (left * size + right) -> rank; rank -> what it makes
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        born: dict[int, int] = {}
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            if max(born.get(x, -1), born.get(y, -1)) >= r or z in born or x * self.size + y in self.rank:
                raise ValueError("a merge makes a pair of lower rank; ranks can't be applied in order")
            born[z] = r
            self.rank[x * self.size + y] = r
            self.made.append(z)
        self.pattern = regex.compile(PATTERN)
        self.splits = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece."""
        joined = b"".join(pieces)
        if not joined:
            return [np.zeros(0, np.int32) for _ in pieces]
        sym = self.byte_id[np.frombuffer(joined, np.uint8)].tolist()
        n = len(sym)
        starts = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        first = np.zeros(n + 1, bool)
        first[starts] = True
        first = first.tolist()
        nxt = list(range(1, n + 1))
        prv = list(range(-1, n - 1))
        for s in starts[:-1].tolist():
            if s < n:
                prv[s] = -1
        for e in starts[1:].tolist():
            if e > 0:
                nxt[e - 1] = -1
        size, rank, made = self.size, self.rank, self.made
        where: dict[int, list[int]] = {}
        # the index of the first pairs, by one sort
        ids = np.array(sym, np.int64)
        ok = np.flatnonzero(~np.array(first[1:n], bool)) if n > 1 else np.zeros(0, np.int64)
        keys = ids[ok] * size + ids[ok + 1]
        order = np.argsort(keys, kind="stable")
        keys, ok = keys[order], ok[order]
        cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(keys)], strict=True):
            r = rank.get(int(keys[a]))
            if r is not None:
                where[r] = ok[a:b].tolist()
        heap = list(where)
        heapq.heapify(heap)
        pair_of = {r: k for k, r in ((k, rank[k]) for k in {int(x) for x in keys[cut]} if k in rank)}
        while heap:
            r = heapq.heappop(heap)
            spots = where.pop(r)
            left, right = divmod(pair_of[r], size)
            new = made[r]
            if spots != sorted(spots):
                spots.sort()
            for i in spots:
                if sym[i] != left:
                    continue
                j = nxt[i]
                if j < 0 or sym[j] != right:
                    continue
                k = nxt[j]
                sym[i], sym[j], nxt[i] = new, -1, k
                if k >= 0:
                    prv[k] = i
                    p = new * size + sym[k]
                    q = rank.get(p)
                    if q is not None:
                        if q in where:
                            where[q].append(i)
                        else:
                            where[q] = [i]
                            pair_of[q] = p
                            heapq.heappush(heap, q)
                h = prv[i]
                if h >= 0:
                    p = sym[h] * size + new
                    q = rank.get(p)
                    if q is not None:
                        if q in where:
                            where[q].append(h)
                        else:
                            where[q] = [h]
                            pair_of[q] = p
                            heapq.heappush(heap, q)
        out = np.array(sym, np.int32)
        live = out >= 0
        at = np.concatenate([[0], np.cumsum(live)])[starts]
        out = out[live]
        return [out[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def pieces(self, text: str) -> list[str]:
        """Pieces in order; a special token is a piece of its own."""
        if self.splits is None or not any(s in text for s in self.special):
            return self.pattern.findall(text)
        out: list[str] = []
        for part in self.splits.split(text):
            out += [part] if part in self.special else self.pattern.findall(part)
        return out


class Coder:
    """Encodes batches and keeps the ids of up to about ``most`` chunks and pieces."""

    def __init__(self, data: bytes, most: int = 1_500_000):
        self.merges, self.most = Merges(data), most
        self.fixed = {t: np.array([i], "<u4").tobytes() for t, i in self.merges.special.items()}
        self.known: dict[str, bytes] = dict(self.fixed)
        self.chunks: dict[str, bytes] = {}
        self.spell = self.merges.bytes

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit bytes."""
        if len(self.known) + len(self.chunks) > self.most:
            self.known, self.chunks = dict(self.fixed), {}
        get = self.chunks.get
        split = [chunks(t) if t else [] for t in texts]
        found = [list(map(get, s)) for s in split]
        new: set[str] = set()
        for s, f in zip(split, found, strict=True):
            if None in f:
                new.update([c for c, x in zip(s, f, strict=True) if x is None])
        if new:
            self._learn(list(new))
            found = [[get(c) if x is None else x for c, x in zip(s, f, strict=True)] if None in f else f for s, f in zip(split, found, strict=True)]
            for c in [c for c in new if len(c) > KEPT_LENGTH]:
                del self.chunks[c]
        return [b"".join(f) for f in found]

    def _learn(self, new: list[str]) -> None:
        """A chunk starts where white space follows something else, which no piece spans."""
        known = self.known
        split = [self.merges.pieces(c) for c in new]
        pieces = list(set().union(*split) - known.keys())
        if pieces:
            known.update(zip(pieces, [x.astype("<u4").tobytes() for x in self.merges.merge([p.encode() for p in pieces])], strict=True))
        self.chunks.update(zip(new, [b"".join(map(known.__getitem__, s)) for s in split], strict=True))
        for p in [p for p in pieces if len(p) > KEPT_LENGTH]:
            del known[p]

    def decode(self, ids: bytes) -> str:
        spell = self.spell
        return b"".join([spell[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode(errors="replace")


def encode(docs: DataFrame, keep: list[str], text: str = "text", path: str | None = None, with_ids: bool = True) -> DataFrame:
    """``keep``, n_tokens, ids_sha256, decoded_sha256 and, if wanted, ids and decoded."""
    made = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * with_ids
    source = docs.select(row_of(keep), F.col(text).alias("text"))
    schema = source.select(ROW).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if with_ids:
        schema = schema.add("ids", ArrayType(IntegerType())).add("decoded", "string")
    shared = docs.sparkSession.sparkContext.broadcast(load(path or file_of("byte_bpe_50k.json")))
    held: dict = {}

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        if "coder" not in held:
            held["coder"] = kept(Coder, shared.value)
        coder = held["coder"]
        coded = coder.encode(batch.column("text").to_pylist())
        back = [coder.decode(b) for b in coded]
        arrays = [batch.column(ROW)]
        arrays.append(pa.array([len(b) // 4 for b in coded], pa.int64()))
        arrays.append(pa.array([hashlib.sha256(b).hexdigest() for b in coded]))
        arrays.append(pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back]))
        if with_ids:
            arrays += [pa.array([np.frombuffer(b, "<i4") for b in coded], pa.list_(pa.int32())), pa.array(back, pa.string())]
        return pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return unfolded(source.mapInArrow(per_batch(work, 1000), schema), keep, made)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"), ["doc_id"], with_ids=False)
