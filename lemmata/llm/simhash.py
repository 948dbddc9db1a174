"""SimHash near-duplicates by a generalised pigeonhole search.

A text's fingerprint has bit b if over half of its shingles' XXH64 values have it.
Two fingerprints link if they differ in at most ``distance`` bits; documents are
grouped by what they can reach over links.

Search, over the distinct fingerprints only (so any number of copies is one row):

1. Bits that agree or differ together go into the same part, by their pair counts.
2. If two fingerprints differ in at most d bits and part i may differ in t_i bits,
   with the sum of (t_i + 1) equal to d + 1, then some part is within its t_i.  The
   number of parts and the unequal t_i are chosen by dynamic programming on the
   expected number of candidates and of probes; t_i = -1 leaves a part out.
3. Each fingerprint is filed under its parts and probes what is within t_i of them.
   Each pair met under a key is verified on all 64 bits.  A key's rows give at most
   a spanning forest, never all pairs.  Keys with many rows are split into blocks,
   and each two blocks meet in a cell of their own.

Nothing is capped: every pair within the distance is connected.

Null text counts as empty.  A text without words has fingerprint zero and links
like any other; with fewer words than a shingle the whole sequence is one shingle.  Very
long texts are read whole, in parts.  Repeated rows share a fingerprint and thus a
component; so do ties, as equal fingerprints are one.  Null doc_ids take part, and
never become a component_id unless all ids of the component are null.  An empty table
gives an empty result.  A caller's columns come back unchanged, whatever their names: a
result whose name is taken is named with an underscore after it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard
from .common import ROW, cells, partitions, per_batch, read, row_of, stage, unfolded, unstage
from .graph import components

BITS = 64
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Rows of one key that one task compares.
BLOCK = 8192
#: Seconds for a row that is filed and for a pair that is compared, as measured on one core.
ROW_S, PAIR_S = 1.5e-6, 4e-9


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """Unsigned 64 bits."""
    w = (text or "").encode().translate(LOWER).split()
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    grams = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), np.uint64, n)
    count = np.zeros(BITS, np.int64)
    for at in range(0, n, 255):
        # eight counts of at most 255 are added at once, as the bytes of 64 bits
        bits = np.unpackbits(h[at : at + 255].astype("<u8").view(np.uint8), bitorder="little").view(np.uint64).reshape(-1, BITS // 8)
        count += bits.sum(0).view(np.uint8)
    return int(np.packbits(2 * count > n, bitorder="little").view("<u8")[0])


def marked(docs: DataFrame, keep: list[str], doc_id: str = "doc_id", text: str = "text", words: int = 4, seed: int = 42) -> DataFrame:
    """(_row: a struct of ``keep``, doc_id, fp long: the 64 bits, signed)"""
    source = docs.select(row_of(keep), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = source.select(ROW, "doc_id").schema.add("fp", "long")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, words, seed) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(ROW), batch.column("doc_id"), pa.array(fps)], names=[ROW, "doc_id", "fp"])

    return source.mapInArrow(per_batch(work), schema)


def pair_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """n and (64, 64): how many fingerprints have both bits (on the diagonal: the bit)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS))
        n = 0
        for b in batches:
            for at in range(0, b.num_rows, 1 << 14):
                v = b.column(0).slice(at, 1 << 14).to_numpy(zero_copy_only=False).astype("<i8")
                bits = np.unpackbits(v.view(np.uint8), bitorder="little").reshape(-1, BITS).astype(np.float32)
                total += bits.T @ bits
                n += len(v)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS + 1, dtype=np.int32)), pa.array(np.append(total.ravel(), n).astype(np.int64))], names=["at", "n"])

    got = np.zeros(BITS * BITS + 1)
    for r in fps.select("fp").mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        got[r["at"]] = r["n"]
    return int(got[-1]), got[:-1].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Deal the bits to parts of equal width; each part grows by the bit that is most
    correlated with those it has."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(corr, 0)
    left, out = set(range(BITS)), []
    for i in range(parts):
        width = BITS // parts + (i < BITS % parts)
        rest = sorted(left)
        first = rest[int(corr[np.ix_(rest, rest)].max(1).argmax())]
        part = [first]
        left.remove(first)
        while len(part) < width:
            rest = sorted(left)
            best = rest[int(corr[np.ix_(rest, part)].mean(1).argmax())]
            part.append(best)
            left.remove(best)
        out.append(part)
    return out


def near(part: list[int], n: int, both: np.ndarray, most: int) -> list[float]:
    """For t = 0 .. most: the chance that two fingerprints differ in t bits of the part
    or fewer.  Each bit's agreement depends on that of the bit before it."""
    p = np.diag(both) / max(n, 1)
    agree = p * p + (1 - p) ** 2
    # state[last bit agrees][bits that differ]
    state = np.zeros((2, most + 2))
    state[1, 0], state[0, 1] = agree[part[0]], 1 - agree[part[0]]
    for a, b in zip(part, part[1:], strict=False):
        p11 = both[a, b] / max(n, 1)
        joint = p11**2 + (p[a] - p11) ** 2 + (p[b] - p11) ** 2 + (1 - p[a] - p[b] + p11) ** 2
        yes = min(1.0, joint / max(agree[a], 1e-12))
        no = min(1.0, max(0.0, (agree[b] - joint) / max(1 - agree[a], 1e-12)))
        new = np.zeros_like(state)
        new[1] = state[1] * yes + state[0] * no
        new[0, 1:] = (state[1] * (1 - yes) + state[0] * (1 - no))[:-1]
        state = new
    return list(np.cumsum(state.sum(0))[: most + 1])


def allocate(n: int, both: np.ndarray, distance: int = 4, radius: int = 2) -> list[tuple[list[int], int]]:
    """(bits, t) of the parts in use, of least expected cost."""
    best: tuple[float, list] = (float("inf"), [])
    for parts in range(1, distance + 2):
        groups = group_bits(n, both, parts)
        # cost[u]: least cost of giving u units (t + 1) to the parts so far, and how
        cost: dict[int, tuple[float, tuple]] = {0: (0.0, ())}
        for g in groups:
            chance = near(g, n, both, radius)
            new: dict[int, tuple[float, tuple]] = {}
            for u, (c, how) in cost.items():
                for t in range(-1, radius + 1):
                    v = u + t + 1
                    if v > distance + 1:
                        break
                    rows = sum(comb(len(g), j) for j in range(t + 1))
                    own = (rows * n * ROW_S + n * n / 2 * chance[t] * PAIR_S) if t >= 0 else 0.0
                    if c + own < new.get(v, (float("inf"),))[0]:
                        new[v] = (c + own, (*how, t))
            cost = new
        if distance + 1 in cost and cost[distance + 1][0] < best[0]:
            c, how = cost[distance + 1]
            best = (c, [(g, t) for g, t in zip(groups, how, strict=True) if t >= 0])
    return best[1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def forest(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect all fingerprints that links connect: each is visited once and
    compared with those that aren't visited yet."""
    rest = np.unique(fps)
    us, vs = [], []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            hit = np.bitwise_count(rest ^ x) <= distance
            if hit.any():
                found = rest[hit]
                us.append(np.full(len(found), x))
                vs.append(found)
                queue += list(found)
                rest = rest[~hit]
    none = np.zeros(0, fps.dtype)
    return (np.concatenate(us), np.concatenate(vs)) if us else (none, none)


def _verify(distance: int, small: int = 16):
    names = ("part", "key", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def group_edges(ids: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            """ids: non-decreasing group numbers."""
            us, vs = [], []
            starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            sizes = np.diff(np.r_[starts, len(ids)])
            size = np.repeat(sizes, sizes)
            few = size <= small
            g, f = ids[few], fps[few]
            for d in range(1, small):
                hit = (g[d:] == g[:-d]) & (np.bitwise_count(f[d:] ^ f[:-d]) <= distance)
                if len(g) <= d:
                    break
                us.append(f[:-d][hit])
                vs.append(f[d:][hit])
            for s, k in zip(starts[sizes > small], sizes[sizes > small], strict=True):
                u, v = forest(fps[s : s + k], distance)
                us.append(u)
                vs.append(v)
            u = np.concatenate(us) if us else np.zeros(0, np.uint64)
            v = np.concatenate(vs) if vs else np.zeros(0, np.uint64)
            differ = u != v
            return pa.RecordBatch.from_arrays([pa.array(u[differ].view(np.int64)), pa.array(v[differ].view(np.int64))], names=["u", "v"])

        held: list[np.ndarray] | None = None  # the rows of the group that may go on
        for batch in batches:
            cols = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held[:-1], cols, strict=True)]
                fps = np.concatenate([held[-1], fps])
            new = np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in cols])]
            last = int(np.flatnonzero(new)[-1])
            if last:
                yield group_edges(np.cumsum(new)[:last], fps[:last])
            held = [*(c[last:] for c in cols), fps[last:]]
        if held is not None:
            yield group_edges(np.zeros(len(held[-1]), np.int64), held[-1])

    return run


def links(fps: DataFrame, distance: int = 4) -> DataFrame:
    """fps(fp, distinct) -> edges (u, v) that connect exactly what links connect."""
    spark = fps.sparkSession
    n, both = pair_counts(fps)
    plan = allocate(n, both, distance)
    where = []  # (part, its bits, the bits that a probe turns over)
    for i, (bits, t) in enumerate(plan):
        m = sum(1 << b for b in bits)
        where += [(i, _signed(m), _signed(sum(1 << b for b in c))) for j in range(t + 1) for c in combinations(bits, j)]
    masks = F.from_json(F.lit(json.dumps([dict(zip(("part", "mask", "flip"), x, strict=True)) for x in where])), "array<struct<part:int,mask:bigint,flip:bigint>>")
    keys = fps.select("fp", F.explode(masks).alias("k")).select(
        F.col("k.part").alias("part"), F.col("fp").bitwiseAND(F.col("k.mask")).bitwiseXOR(F.col("k.flip")).alias("key"), "fp"
    )
    met, by = cells(keys, ["part", "key"], "fp", BLOCK)
    dealt = met.repartition(partitions(spark), *by).sortWithinPartitions(*by)
    return dealt.mapInArrow(_verify(distance), "u long, v long")


def components_of(fps: DataFrame, edges: DataFrame) -> DataFrame:
    """fps(fp, rep: the least doc_id), edges(u, v) between fps -> (fp, component_id).

    Components are found over the classes' (no doc_id?, doc_id, fp): the least that can be
    reached then holds the answer, and no component has to meet in one place to find it."""
    node = F.struct(F.col("rep").isNull().alias("none"), F.col("rep").alias("doc_id"), "fp")
    nodes = fps.select("fp", node.alias("node"))
    one = edges.join(nodes.select(F.col("fp").alias("u"), F.col("node").alias("a")), "u")
    both = one.join(nodes.select(F.col("fp").alias("v"), F.col("node").alias("b")), "v")
    roots = components(both.select(F.col("a").alias("u"), F.col("b").alias("v")))
    found = roots.select(F.col("node.fp").alias("fp"), F.col("root.doc_id").alias("least"), F.lit(True).alias("linked"))
    own = F.when(F.col("linked"), F.col("least")).otherwise(F.col("rep"))
    return fps.join(found, "fp", "left").select("fp", own.alias("component_id"))


def group(docs: DataFrame, keep: list[str] | None = None, distance: int = 4, **how) -> DataFrame:
    """``keep`` (all columns by default), fp, and component_id: the least doc_id reached."""
    keep = docs.columns if keep is None else keep
    return unfolded(_grouped(stage(marked(docs, keep, **how), "fingerprints"), distance), keep, ["fp", "component_id"])


def _grouped(rows: DataFrame, distance: int) -> DataFrame:
    """rows(doc_id, fp, ...) -> with component_id"""
    fps = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "fps")
    edges = stage(links(fps.select("fp"), distance), "links")
    classes = stage(components_of(fps, edges), "classes")
    unstage(edges, fps)
    return rows.join(classes, "fp")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = group(read(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def close(marks: DataFrame, distance: int) -> DataFrame:
    """marks(name, fp), distinct names, fps not -> edges (u, v) of names that connect exactly
    what the links of their fingerprints connect.  A fingerprint goes by its least name."""
    reps = stage(marks.groupBy("fp").agg(F.min("name").alias("rep")), "fps")
    found = links(reps.select("fp"), distance)
    across = found.join(reps.select(F.col("fp").alias("u"), F.col("rep").alias("a")), "u").join(reps.select(F.col("fp").alias("v"), F.col("rep").alias("b")), "v")
    alike = marks.join(reps, "fp").where("name <> rep").select(F.col("name").alias("u"), F.col("rep").alias("v"))
    return across.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(alike)


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component of near copies, for the pipeline: those of exact five-word
    Jaccard similarity of 0.8 or more.  The pigeonhole search finds candidates by several
    64-bit fingerprints; those that are too far apart in all of them come from jaccard.py."""
    return jaccard.keep_one(docs, close)
