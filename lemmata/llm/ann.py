"""Approximate nearest neighbours by multiprobe p-stable hashing.

Table l hashes a vector v to the cell floor((A v + b) / w), A with normal entries (which
are 2-stable, so distances survive projection).  A query visits its own cell and those
around it in descending order of their estimated success (Lv et al., 2007): the chance that
a vector at the query's radius falls into them.  The radius is the distance at which the
query has its k nearest in a bounded sample of the index, and w follows the sample's radii.
A table is probed until the chances add up to what gives ``success`` over all tables; so the
number of probes follows the data and not a constant.  The candidates of all tables are
merged, and distances are exact, in double precision on the original vectors.

A query that would need over ``most`` probes in a table, or that met fewer than k others
while there are more, is searched exactly: up to EXACT of them are sent to all rows; more are
dealt with the rows to a grid of blocks, like a crowded cell.

Equal vectors are one class, which is hashed once and keeps its k + 1 least ids: no other
id of it can be among a query's k nearest.  Nothing else is capped: all candidates at the
distance of the k-th are kept until ties are broken by id.

Layout: rows are dealt by the cell's code, each row with its vector; a task takes one cell
after the other, holds the cell's queries, streams its vectors past them, and keeps each
query's best over all its cells.  Probes of cells without vectors are dropped before they
get their query's vector.  A cell with many vectors or queries is split into blocks, and
each block of vectors meets each block of queries.

Vectors that are null, zero, or hold null or non-finite components take no part.  Vectors
of another length are in cells of their own.  Rows with a null id take no part; rows that
repeat an id and its vector count once, and an id with several vectors stands for the least of
them in the order of arrays, as a query and as a candidate, so every query id has one list and
every candidate one place in it.  Equal distances go to the smaller id.  An empty
table gives an empty result.  Only the id and the vector are read; whatever other columns
are named, they don't matter.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, read, stage, unstage

#: Vectors and queries of one cell that one block holds; rows that are worked on at once.
CELL_ROWS, CELL_QUERIES, CHUNK = 100_000, 4096, 2048
#: Vectors of the sample; queries of it by which the number of hashes is chosen.
SAMPLE, TRIED = 2000, 16
#: Queries whose best a task holds before it hands them on; queries of one exact pass.
HELD, EXACT = 100_000, 8192
#: An odd number for mixing cells to 64 bits.
MIX = np.uint64(0x9E3779B97F4A7C15)
#: A vector's length from which squared distances by the expanded form are trusted: relative rounding.
ROUNDING = 1e-9


class Hashes:
    def __init__(self, dim: int, tables: int, hashes: int, width: float, seed: int = 11):
        rng = np.random.default_rng([seed, dim])
        self.tables, self.hashes, self.width = tables, hashes, width
        self.a = rng.normal(size=(dim, tables * hashes))
        self.b = rng.uniform(0, width, tables * hashes)

    def cells(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n, tables, hashes): cell numbers, and how far into the cell (0 to 1)."""
        p = ((v @ self.a + self.b) / self.width).reshape(len(v), self.tables, self.hashes)
        h = np.floor(p)
        return np.clip(h, -(2**62), 2**62).astype(np.int64), p - h

    def codes(self, cells: np.ndarray, table: np.ndarray | int, dim: int) -> np.ndarray:
        """(..., hashes) -> (...) signed 64 bits."""
        x = (np.zeros(cells.shape[:-1], np.uint64) + np.uint64(dim)) * MIX + np.asarray(table).astype(np.uint64)
        for i in range(cells.shape[-1]):
            x = (x ^ cells[..., i].astype(np.uint64)) * MIX
            x ^= x >> np.uint64(29)
        return x.view(np.int64)


#: The normal distribution's cumulative function at even steps; beyond them it is 0 or 1.
_AT = np.linspace(-8, 8, 4001)
_CDF = np.concatenate([[0.0], np.cumsum((np.exp(-(_AT[1:] ** 2) / 2) + np.exp(-(_AT[:-1] ** 2) / 2)) / 2 * np.diff(_AT))]) / np.sqrt(2 * np.pi)


def below(x: np.ndarray) -> np.ndarray:
    return np.interp(x, _AT, _CDF, left=0.0, right=1.0)


def perturbations(inside: np.ndarray, reach: float, target: float, most: int) -> tuple[np.ndarray, float]:
    """(probes, hashes) offsets -1, 0, 1 in descending order of success, until the chances add
    up to ``target`` or ``most`` are made; and that sum.

    inside (hashes,): the place in the cell, 0 to 1; reach: the radius over the cell's width.
    Along one hash, a vector at that radius lies a normal step of that size away, so it is in
    the same cell or a neighbour with known chances; the hashes are independent."""
    m = len(inside)
    low, high = below(-inside / reach), below((1 - inside) / reach)
    own = np.maximum(high - low, 1e-300)
    side = np.concatenate([low - below((-1 - inside) / reach), below((2 - inside) / reach) - high])
    cost = np.maximum(0.0, np.log(np.concatenate([own, own])) - np.log(np.maximum(side, 1e-300)))
    order = np.argsort(cost, kind="stable")
    z, dim, step = cost[order].tolist(), (order % m).tolist(), np.where(order < m, -1, 1).tolist()
    chance = float(own.prod())
    made, got = [()], chance
    heap = [(z[0], (0,))]
    while heap and got < target and len(made) < most:
        s, chosen = heapq.heappop(heap)
        if len({dim[i] for i in chosen}) == len(chosen):  # not both borders of one hash
            made.append(chosen)
            got += chance * float(np.exp(-s))
        last = chosen[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (s - z[last] + z[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (s + z[last + 1], (*chosen, last + 1)))
    out = np.zeros((len(made), m), np.int64)
    for row, chosen in zip(out, made, strict=True):
        for i in chosen:
            row[dim[i]] = step[i]
    return out, got


@dataclass
class Plan:
    """How vectors of one length are hashed and probed."""

    hashes: Hashes
    sample: np.ndarray
    near: int  # the sample's neighbour that is as far as the index's k-th
    target: float  # of one table
    most: int

    def radius(self, q: np.ndarray) -> float:
        d = np.sqrt(((self.sample - q) ** 2).sum(1))
        d = np.sort(d[d > 0])
        return float(d[min(self.near, len(d) - 1)]) if len(d) else 0.0

    def probes(self, q: np.ndarray) -> tuple[np.ndarray, bool]:
        """The codes to visit, and whether they reach the target."""
        h, r = self.hashes, self.radius(q)
        if not np.isfinite(r) or r <= 0:
            return np.zeros(0, np.int64), False
        cells, inside = h.cells(q[None])
        codes, fine = [], True
        for t in range(h.tables):
            offsets, got = perturbations(inside[0, t], r / h.width, self.target, self.most)
            codes.append(h.codes(cells[0, t] + offsets, t, len(q)))
            fine &= got >= self.target
        return np.unique(np.concatenate(codes)), fine


def plan(sample: np.ndarray, rows: int, k: int, tables: int, wide: float, success: float, most: int) -> Plan:
    """``rows``: vectors of this length in the index.  Cells are ``wide`` median radii; the
    hashes are as many as leave about one vector a cell, or fewer if the sample's own vectors
    would need more than half of ``most`` probes."""
    dim, near = sample.shape[1], max(0, round(k * len(sample) / max(rows, 1)) - 1)
    target = 1 - (1 - success) ** (1 / tables)
    tried = sample[np.linspace(0, len(sample) - 1, min(TRIED, len(sample))).astype(int)]
    bare = Plan(None, sample, near, target, most)
    radii = np.array([r for x in tried if (r := bare.radius(x)) > 0])
    width = wide * float(np.median(radii)) if len(radii) else 1.0
    hashes = max(4, round(np.log(max(rows, 2)) / np.log(2.2)))
    while True:
        p = Plan(Hashes(dim, tables, hashes, width), sample, near, target, most)
        inside = p.hashes.cells(tried)[1][:, 0]
        needed = [len(perturbations(x, float(np.median(radii)) / width, target, most)[0]) for x in inside] if len(radii) else [0]
        if hashes <= 4 or np.median(needed) <= most / 2:
            return p
        hashes -= 1


def valid(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id long, v: array<float> if it was, else array<double>)"""
    kind = "array<float>" if rows.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(kind).alias("v")).where(F.col("id").isNotNull() & v.isNotNull()).where(fine)


def _matrix(col: pa.Array) -> np.ndarray:
    """All rows of one length, in double precision."""
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def _by_dim(col: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    sizes = col.value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(sizes):
        yield int(d), np.flatnonzero(sizes == d)


def _parts(batches: Iterator[pa.RecordBatch], rows: int = CHUNK) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """(dim, rows, their matrix)"""
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            batch = whole.slice(at, rows)
            for dim, own in _by_dim(batch.column("v")):
                part = batch.take(pa.array(own))
                yield dim, part, _matrix(part.column("v"))


def distinct_vectors(index: DataFrame, keep: int) -> DataFrame:
    """(id, ids, v): each vector once, with its least id and its ``keep`` least ids.  Each batch
    sends at most ``keep`` rows of a vector, so a mass of copies isn't dealt to one task."""

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part, v in _parts(batches, 1 << 14):
            ids = part.column("id").to_numpy()
            same = np.unique(np.ascontiguousarray(v + 0.0).view(np.dtype((np.void, v.shape[1] * 8))).ravel(), return_inverse=True)[1]
            order = np.lexsort((ids, same))
            s, i = same[order], ids[order]
            fresh = np.r_[True, (s[1:] != s[:-1]) | (i[1:] != i[:-1])]
            order, s = order[fresh], s[fresh]
            starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            rank = np.arange(len(s)) - np.repeat(starts, np.diff(np.r_[starts, len(s)]))
            yield part.take(pa.array(np.sort(order[rank < keep])))

    few = index.select("id", "v").mapInArrow(least, index.select("id", "v").schema).distinct()
    n = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    ids = few.withColumn("n", n).where(F.col("n") <= keep).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return ids.select(F.col("ids")[0].alias("id"), "ids", "v")


def one_each(rows: DataFrame) -> DataFrame:
    """rows(id, v) with the least vector of each id that comes more than once."""
    again = rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    if again.isEmpty():
        return rows
    again = stage(again, "repeated-ids")
    least_ = rows.join(again, "id").groupBy("id").agg(F.min("v").alias("v"))
    return rows.select("id", "v").join(again, "id", "left_anti").unionByName(least_)


def _plans(classes: DataFrame, sizes: dict[int, int], k: int, **how) -> dict[int, Plan]:
    """By the SAMPLE vectors of least hashed id."""
    got = classes.select("v").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow().column("v").combine_chunks()
    if isinstance(got, pa.ChunkedArray):
        got = pa.concat_arrays(got.chunks) if got.num_chunks else pa.array([], got.type)
    return {d: plan(_matrix(got.take(pa.array(own))), sizes[d], k, **how) for d, own in _by_dim(got)}


def search(index: DataFrame, queries: DataFrame, k: int = 10, tables: int = 6, wide: float = 2.5, success: float = 0.96, most: int = 1000) -> DataFrame:
    """index and queries (id, v) -> query_id, rank, vec_id, score.  A query's own id is no
    candidate of its."""
    spark = index.sparkSession
    classes = stage(distinct_vectors(one_each(index), k + 1), "classes")
    asked = stage(one_each(queries).select("id", "v").distinct(), "queries")
    reps = stage(asked.groupBy("v").agg(F.min("id").alias("id")), "query-classes")
    # vector lengths are few: one row each
    counts = classes.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("ids"))
    sizes = {r["dim"]: (r["n"], r["ids"]) for r in counts.collect()}
    plans = _plans(classes, {d: n for d, (n, _) in sizes.items()}, k, tables=tables, wide=wide, success=success, most=most)
    shared = spark.sparkContext.broadcast(plans)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, _, v in _parts(batches):
            if p := shared.value.get(dim):
                yield pa.RecordBatch.from_arrays([pa.array(p.hashes.codes(p.hashes.cells(v)[0], np.arange(p.hashes.tables), dim).ravel())], names=["code"])

    def file_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, part, v in _parts(batches):
            if p := shared.value.get(dim):
                code = p.hashes.codes(p.hashes.cells(v)[0], np.arange(p.hashes.tables), dim)
                for t in range(p.hashes.tables):
                    yield pa.RecordBatch.from_arrays([pa.array(code[:, t]), part.column("id"), part.column("ids"), part.column("v")], names=["code", "id", "ids", "v"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, code); a null code if the query is to be searched exactly."""
        for dim, part, v in _parts(batches, 64):
            p, ids, made = shared.value.get(dim), part.column("id").to_pylist(), []
            for i, q in zip(ids, v, strict=True):
                found, fine = p.probes(q) if p else (None, False)
                made.append((pa.array(np.full(len(found), i, np.int64)), pa.array(found)) if fine else (pa.array([i], pa.int64()), pa.array([None], pa.int64())))
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([m[0] for m in made]), pa.concat_arrays([m[1] for m in made])], names=["id", "code"])

    probes = stage(reps.repartition(partitions(spark)).mapInArrow(ask, "id long, code long"), "probes")
    met = stage(classes.select("v").mapInArrow(codes, "code long").groupBy("code").agg(F.count("*").alias("n")), "cells")
    live = stage(probes.join(met, "code").select("id", "code", "n"), "live-probes")
    vectors = classes.mapInArrow(file_, f"code long, id long, ids array<long>, v {classes.schema['v'].dataType.simpleString()}")
    points = live.select("id", "code").join(reps, "id").select("code", "id", "v")
    # cells that are large on either side: in how many blocks
    crowded = live.groupBy("code").agg(F.first("n").alias("n"), F.count("*").alias("q")).where((F.col("n") > CELL_ROWS) | (F.col("q") > CELL_QUERIES))
    crowded = stage(crowded.select("code", F.ceil(F.col("n") / CELL_ROWS).cast("int").alias("bn"), F.ceil(F.col("q") / CELL_QUERIES).cast("int").alias("bq")), "crowded")
    hits = _compared(vectors, points, None if crowded.isEmpty() else crowded, k)
    each = hits.select("class", F.explode("ids").alias("id"), "score").distinct()
    near = stage(_lists(each, k), "near")
    # what was not probed to the end, or met too few
    wanted = reps.select(F.col("id").alias("class"), "v").join(near.select("class", F.size("near").alias("found")), "class", "left")
    full = reduce(lambda c, x: c.when(F.size("v") == x[0], F.lit(min(k + 1, x[1][1]))), sizes.items(), F.when(F.lit(False), F.lit(0))).otherwise(F.lit(0))
    unmet = probes.where("code is null").select(F.col("id").alias("class"), F.lit(True).alias("unmet"))
    needy = stage(wanted.join(unmet, "class", "left").where(F.col("unmet") | (F.coalesce("found", F.lit(0)) < full)).select(F.col("class").alias("id"), "v"), "needy")
    if n_needy := needy.count():
        exact = stage(_lists(_exact(classes, needy, n_needy, k), k), "exact")
        near = near.join(needy.select(F.col("id").alias("class")), "class", "left_anti").unionByName(exact)
    unstage(probes, met, live, crowded)
    named = asked.join(reps.select(F.col("id").alias("class"), "v"), "v").select(F.col("id").alias("query_id"), "class").join(near, "class")
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)
    return named.select("query_id", F.posexplode(others).alias("p", "x")).select("query_id", (F.col("p") + 1).alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))


def _compared(vectors: DataFrame, points: DataFrame, crowded: DataFrame | None, k: int) -> DataFrame:
    """(class, ids, score): vectors(code, id, ids, v) against the points(code, id, v) of their cells.
    ``crowded`` (code, bn, bq) cells are split, and each block of vectors meets each of points."""
    if crowded is None:
        vectors, points = (x.withColumns({"a": F.lit(0), "b": F.lit(0)}) for x in (vectors, points))
    else:

        def split(x: DataFrame, own: str, other: str, at: tuple[str, str]) -> DataFrame:
            both = x.join(crowded, "code", "left")
            block = F.pmod(F.xxhash64("id"), F.coalesce(own, F.lit(1))).cast("int")
            return both.withColumns({at[0]: block, at[1]: F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))}).drop("bn", "bq")

        vectors, points = split(vectors, "bn", "bq", ("a", "b")), split(points, "bq", "bn", ("b", "a"))
    cols = ["code", "a", "b", "kind", "id", "ids", "v"]
    points = points.withColumns({"kind": F.lit(0), "ids": F.lit(None).cast("array<bigint>")}).select(*cols)
    both = points.unionByName(vectors.withColumn("kind", F.lit(1)).select(*cols))
    dealt = both.repartition(partitions(points.sparkSession), "code", "a", "b").sortWithinPartitions("code", "a", "b", "kind")
    return dealt.mapInArrow(_meet(k + 1), "class long, ids array<long>, score double")


def _lists(each: DataFrame, k: int) -> DataFrame:
    """each(class, id, score) -> (class, near: its k + 1 nearest, in order)"""
    n = F.row_number().over(Window.partitionBy("class").orderBy("score", "id"))
    best = each.withColumn("n", n).where(F.col("n") <= k + 1)
    return best.groupBy("class").agg(F.sort_array(F.collect_list(F.struct("score", "id"))).alias("near"))


class Best:
    """The ``keep`` nearest classes of each query so far, by (score, id)."""

    def __init__(self, keep: int):
        self.keep, self.near, self.ids = keep, {}, {}

    def bound(self, q: int) -> float:
        got = self.near.get(q)
        return got[0][-1] if got is not None and len(got[0]) == self.keep else np.inf

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if (old := self.near.get(q)) is not None:
            fresh = ~np.isin(ids, old[1])  # another table may have given the class
            scores, ids = np.concatenate([old[0], scores[fresh]]), np.concatenate([old[1], ids[fresh]])
        order = np.lexsort((ids, scores))[: self.keep]
        self.near[q] = (scores[order], ids[order])

    def compare(self, qs: np.ndarray, x: np.ndarray, ids: np.ndarray, v: np.ndarray) -> None:
        """Exact distances of those that may be among the best: up to the bound, or up to the
        keep-th nearest of these vectors, with room for the expanded form's rounding."""
        vv = (v * v).sum(1)
        for at in range(0, len(qs), 256):
            own = x[at : at + 256]
            xx = (own * own).sum(1)
            d = vv[None] - 2 * (own @ v.T) + xx[:, None]
            room = ROUNDING * (vv.max() + xx)
            bound = np.array([self.bound(q) for q in qs[at : at + 256].tolist()]) ** 2
            if len(ids) > self.keep:
                bound = np.minimum(bound, np.partition(d, self.keep - 1, axis=1)[:, self.keep - 1])
            hit = d <= (bound * (1 + ROUNDING) + 2 * room)[:, None]
            for i in np.flatnonzero(hit.any(1)).tolist():
                j = np.flatnonzero(hit[i])
                self.add(int(qs[at + i]), np.sqrt(((v[j] - own[i]) ** 2).sum(1)), ids[j])

    def out(self, many: dict[int, list[int]]) -> Iterator[pa.RecordBatch]:
        for part in _slices(list(self.near.items()), 2000):
            q = np.concatenate([np.full(len(ids), k, np.int64) for k, (_, ids) in part])
            found = np.concatenate([ids for _, (_, ids) in part]).tolist()
            scores = np.concatenate([s for _, (s, _) in part])
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array([many.get(i, [i]) for i in found], pa.list_(pa.int64())), pa.array(scores)], names=["class", "ids", "score"])
        self.near.clear()


def _slices(x: list, n: int) -> Iterator[list]:
    yield from (x[at : at + n] for at in range(0, len(x), n))


def _several(part: pa.RecordBatch) -> dict[int, list[int]]:
    """The classes of more than one id."""
    sizes = part.column("ids").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    rows = pa.array(np.flatnonzero(sizes > 1))
    return dict(zip(part.column("id").take(rows).to_pylist(), part.column("ids").take(rows).to_pylist(), strict=True))


def _meet(keep: int):
    """Rows (code, a, b, kind, id, ids, v) sorted by cell and kind: queries (0), then vectors (1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, many = Best(keep), {}
        cell, qs, xs = None, [], []
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(at, CHUNK)
                key = np.stack([batch.column(c).to_numpy() for c in ("code", "a", "b", "kind")], axis=1)
                ids, vectors = batch.column("id").to_numpy(), batch.column("v")
                several = _several(batch)
                cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    here = tuple(key[a, :3])
                    if here != cell:
                        cell, qs, xs = here, [], []
                    if key[a, 3] == 0:
                        qs.append(ids[a:b])
                        xs.append(_matrix(vectors.slice(a, b - a)))
                    elif qs:
                        if len(qs) > 1:
                            qs, xs = [np.concatenate(qs)], [np.concatenate(xs)]
                        best.compare(qs[0], xs[0], ids[a:b], _matrix(vectors.slice(a, b - a)))
                        if several:
                            many |= {i: several[i] for i in ids[a:b].tolist() if i in several}
                if len(best.near) > HELD or len(many) > HELD:
                    yield from best.out(many)
                    many = {}
        yield from best.out(many)

    return run


def _exact(classes: DataFrame, needy: DataFrame, n: int, k: int) -> DataFrame:
    """(class, id, score): the k + 1 nearest of each needy query in each task, by comparing it
    with all rows."""
    if n > EXACT:
        # a cell for each vector length
        rows, points = (x.withColumn("code", F.size("v").cast("long")) for x in (classes, needy))
        size = lambda x, most, name: x.groupBy("code").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
        grid = stage(size(rows, CELL_ROWS, "bn").join(size(points, CELL_QUERIES, "bq"), "code"), "grid")
        made = _compared(rows, points, grid, k)
    else:
        by, rows = {}, needy.toArrow()
        if rows.num_rows:
            rows = rows.combine_chunks().to_batches()[0]
            by = {d: (part.column("id").to_numpy(), v) for d, part, v in _parts(iter([rows]), rows.num_rows)}
        shared = classes.sparkSession.sparkContext.broadcast(by)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best, many = Best(k + 1), {}
            for dim, part, v in _parts(batches):
                if dim in shared.value:
                    qs, x = shared.value[dim]
                    best.compare(qs, x, part.column("id").to_numpy(), v)
                    many |= _several(part)
                if len(many) > HELD:
                    yield from best.out(many)
                    many = {}
            yield from best.out(many)

        made = classes.mapInArrow(work, "class long, ids array<long>, score double")
    return made.select("class", F.explode("ids").alias("id"), "score").distinct()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stage(valid(read(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "vectors")
    return search(rows, rows.where("id % 100 = 0"))
