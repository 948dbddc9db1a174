"""Two-view search: top 2n a view, merge, boost, rank.

Queries and blocks are dealt to the cells of a grid, about SIDE blocks by SIDE queries each,
in one shuffle; a cell multiplies matrices and hands on its best 2n of each query, and one more
shuffle merges them.  A cell holds its queries and HELD hits at most: if 2n is large it has fewer
queries and as many more blocks, which pass through it.  How many cells there are is counted when the result is read, so a
plan is the same for any number of queries.  A few queries of a known small number are sent to
the blocks instead (``few``): their vectors are compared where the blocks are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.blocks import boosted, cosine
from ..schema import OVERFETCH, RESULTS

VIEWS = ("text", "math")
#: Of a hit's place: the view, then the rank in it.
VIEW_STEP = 1_000_000_000
#: Blocks and queries that meet in a task; products that it holds at once.
SIDE, PRODUCTS = 8192, 1 << 22
#: Hits that a cell holds, and hands on at once.
HELD, HANDED = 1 << 19, 1 << 16
#: Products in blocks of a matrix differ from exact cosines by less.
SLACK = 1e-6
CELL = ["view_ord", "cell", "qb", "rb"]
HIT = ["query_id", "boost", "view_ord", "block_id", "env_type", "score"]


def matrices(vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By their length (rows, their vectors in double precision); without null, zero and non-finite ones."""
    sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    out = {}
    for d in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == d)
        v = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)
        fine = np.isfinite(v).all(1) & v.any(1)
        if fine.any():
            out[d] = at[fine], v[fine]
    return out


def norms(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v * v).sum(1))


class Top:
    """For each query its ``keep`` best (score, block_id, env_type), ties by block_id."""

    def __init__(self, vectors: np.ndarray, keep: int):
        self.v, self.keep = vectors, keep
        self.norm = norms(vectors)
        self.unit = (vectors / self.norm[:, None]).T
        self.best: list[list[tuple]] = [[] for _ in vectors]

    def add(self, v: np.ndarray, ids: list, envs: list) -> None:
        norm = norms(v)
        about = (v / norm[:, None]) @ self.unit
        low = np.array([b[-1][0] if len(b) == self.keep else -np.inf for b in self.best])
        if len(v) > self.keep:
            low = np.maximum(low, np.partition(about, len(v) - self.keep, axis=0)[len(v) - self.keep])
        hit = about >= low - SLACK
        for q in np.flatnonzero(hit.any(0)).tolist():
            at = np.flatnonzero(hit[:, q])
            # exact, and alike for equal vectors
            score = (v[at] * self.v[q]).sum(1) / (norm[at] * self.norm[q])
            found = [(s, ids[i], envs[i]) for s, i in zip(score.tolist(), at.tolist(), strict=True)]
            self.best[q] = sorted([*self.best[q], *found], key=lambda x: (-x[0], x[1]))[: self.keep]


def views_of(df: DataFrame, *own: str, cells: bool = False) -> DataFrame:
    """A row for each view: ``own``, view_ord, cell, v.  Without ``cells`` all are in cell 0."""
    kinds = {dict(df.dtypes)[f"{view}_vec"] for view in VIEWS}
    kind = kinds.pop() if len(kinds) == 1 else "array<double>"
    each = [F.struct(F.lit(i).alias("view_ord"), (F.col(f"{view}_cell") if cells else F.lit(0)).alias("cell"), F.col(f"{view}_vec").cast(kind).alias("v")) for i, view in enumerate(VIEWS)]
    return df.select(*own, F.explode(F.array(*each)).alias("_v")).select(*own, "_v.*").where(F.col("v").isNotNull() & F.col("cell").isNotNull())


def cell_sizes(df: DataFrame, cells: bool = False) -> DataFrame:
    """(view_ord, cell, n): how many rows a cell has at most; vectors aren't read for it."""
    if not cells:
        views = F.explode(F.array(*map(F.lit, range(len(VIEWS))))).alias("view_ord")
        return df.agg(F.count("*").alias("n")).select(views, F.lit(0).alias("cell"), "n")
    own = [df.groupBy(F.col(f"{view}_cell").alias("cell")).agg(F.count("*").alias("n")).select(F.lit(i).alias("view_ord"), "cell", "n") for i, view in enumerate(VIEWS)]
    return own[0].unionByName(own[1])


def sides(keep: int) -> tuple[int, int]:
    """How many blocks and queries a cell has, about, so that it holds HELD hits at most."""
    if keep > HELD:
        return HELD, 1
    asked = max(1, min(SIDE, HELD // keep))
    return max(1, SIDE * SIDE // asked), asked


def compared(keep: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows by cell, in each the queries (query_id, boost, asked) and then the blocks (block_id,
    env_type, v) -> HIT."""

    def hits(view: int, queries: pa.Table, best: dict[int, tuple[np.ndarray, Top]], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        def made(out: list[tuple]) -> pa.RecordBatch:
            at, score, block, env = zip(*out, strict=True)
            own = queries.select(["query_id", "boost"]).take(pa.array(at, pa.int64())).combine_chunks()
            cols = [*(c.combine_chunks() for c in own.columns), pa.array([view] * len(at), pa.int32()), pa.array(block, kind), pa.array(env, pa.string()), pa.array(score, pa.float64())]
            return pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in cols], names=HIT)

        out: list[tuple] = []
        for at, top in best.values():
            for q, found in enumerate(top.best):
                for i in range(0, len(found), HANDED):
                    out += [(int(at[q]), *x) for x in found[i : i + HANDED]]
                    if len(out) >= HANDED:
                        yield made(out)
                        out = []
                top.best[q] = []
        if out:
            yield made(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell: tuple | None = None
        asked: list[pa.RecordBatch] = []
        queries, best = None, {}
        for b in batches:
            if not b.num_rows:
                continue
            kind, keys = b.schema.field("block_id").type, [b.column(c).to_numpy(zero_copy_only=False) for c in (*CELL, "side")]
            cut = np.flatnonzero(np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])]).tolist()
            for a, z in zip(cut, [*cut[1:], b.num_rows], strict=True):
                *where, side = (int(k[a]) for k in keys)
                if where != cell:
                    if best:
                        yield from hits(cell[0], queries, best, kind)
                    cell, asked, queries, best = where, [], None, {}
                part = b.slice(a, z - a)
                if not side:
                    asked.append(part.select(["query_id", "boost", "asked"]))
                    continue
                if queries is None and asked:
                    queries, asked = pa.Table.from_batches(asked), []
                    best = {d: (at, Top(v, keep)) for d, (at, v) in matrices(queries.column("asked").combine_chunks()).items()}
                    queries = queries.select(["query_id", "boost"])
                step = max(1, PRODUCTS // max(queries.num_rows, 1)) if best else part.num_rows
                for start in range(0, part.num_rows if best else 0, step):
                    some = part.slice(start, step)
                    for d, (at, v) in matrices(some.column("v")).items():
                        if d in best:
                            take = pa.array(at)
                            best[d][1].add(v, some.column("block_id").take(take).to_pylist(), some.column("env_type").take(take).to_pylist())
        if best:
            yield from hits(cell[0], queries, best, kind)

    return run


def meet(rows: DataFrame, row_sizes: DataFrame, asked: DataFrame, asked_sizes: DataFrame, keep: int) -> DataFrame:
    """(query_id, boost, view_ord, block_id, env_type, score): of each query the ``keep`` best (or
    more) of the rows (block_id, env_type, view_ord, cell, v) in the cells it asks."""
    row_side, asked_side = sides(keep)
    parts = lambda n, side: F.ceil(F.col(n) / side).cast("int")
    # one row a cell that both have
    grid = row_sizes.withColumnRenamed("n", "n_rows").join(asked_sizes.withColumnRenamed("n", "n_asked"), ["view_ord", "cell"]).select("view_ord", "cell", parts("n_rows", row_side).alias("row_parts"), parts("n_asked", asked_side).alias("query_parts"))

    def dealt(df: DataFrame, key: str, mine: str, own: str, others: str, other: str) -> DataFrame:
        met = df.join(F.broadcast(grid), ["view_ord", "cell"])
        met = met.withColumns({mine: F.pmod(F.xxhash64(key), F.col(own)).cast("int"), other: F.explode(F.sequence(F.lit(0), F.col(others) - 1))})
        return met.drop("row_parts", "query_parts")

    kinds = dict(rows.dtypes) | dict(asked.select("query_id", "boost").dtypes)
    schema = ", ".join(f"{c} {kinds.get(c, 'double')}" for c in HIT)
    left = dealt(rows, "block_id", "rb", "row_parts", "query_parts", "qb").select(*CELL, F.lit(1).alias("side"), "block_id", "env_type", "v")
    right = dealt(asked, "query_id", "qb", "query_parts", "row_parts", "rb").select(*CELL, F.lit(0).alias("side"), "query_id", "boost", F.col("v").alias("asked"))
    # a cell's queries come first, then its blocks, of which a task has one batch at a time
    both = right.unionByName(left, allowMissingColumns=True).repartition(*CELL).sortWithinPartitions(*CELL, "side")
    return both.mapInArrow(compared(keep), schema)


def sent(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """As ``meet``, for a few queries that are sent to the rows."""
    q = F.broadcast(asked.select("query_id", "boost", "view_ord", F.col("v").cast("array<double>").alias("q")))
    score = cosine(F.col("v").cast("array<double>"), F.col("q"))
    return rows.join(q, "view_ord").select("query_id", "boost", "view_ord", "block_id", "env_type", score.alias("score")).where(F.col("score").isNotNull())


def best_of(hits: DataFrame, keep: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id", "view_ord").orderBy(F.desc("score"), "block_id"))
    return hits.withColumn("view_rank", rank).where(F.col("view_rank") <= keep)


def asked_of(queries: DataFrame) -> DataFrame:
    return views_of(queries, "query_id", "boost")


def candidates(blocks: DataFrame, queries: DataFrame, n: int, where: Column | None = None, few: bool = False) -> DataFrame:
    """(query_id, boost, block_id, env_type, view_ord, score, view_rank): the best 2n of each
    query and view.  Zero vectors, and those of another length, are no hits."""
    found = blocks if where is None else blocks.where(where)
    keep = OVERFETCH * n
    rows, asked = views_of(found, "block_id", "env_type"), asked_of(queries)
    hits = sent(rows, asked) if few else meet(rows, cell_sizes(found), asked, cell_sizes(queries), max(keep, 1))
    return best_of(hits, keep).select("query_id", "boost", "block_id", "env_type", "view_ord", "score", "view_rank")


def merged(hits: DataFrame) -> DataFrame:
    """One row a query and block: the best score, which views, and the place first seen."""
    place = F.col("view_ord").cast("long") * VIEW_STEP + F.col("view_rank")
    g = hits.groupBy("query_id", "block_id").agg(
        F.min("env_type").alias("env_type"), F.first("boost").alias("boost"), F.max("score").alias("base"), F.count("*").alias("views"), F.min("view_ord").alias("view"), F.min(place).alias("first_seen")
    )
    view = F.when(F.col("views") > 1, "both").when(F.col("view") == 0, "text").otherwise("math")
    return g.select("query_id", "block_id", "env_type", boosted(F.col("base"), F.col("env_type"), F.col("boost")).alias("score"), view.alias("matched_view"), "first_seen")


def ranked(merged_hits: DataFrame, n: int) -> DataFrame:
    """The n best of each query; ties keep the order in which they were first seen."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "first_seen"))
    return merged_hits.withColumn("rank", rank).where(F.col("rank") <= n)


def final(hits: DataFrame, n: int) -> DataFrame:
    return ranked(merged(hits), n).select("query_id", "rank", "block_id", "env_type", "score", "matched_view")


def search(blocks: DataFrame, queries: DataFrame, n: int = RESULTS, where: Column | None = None, few: bool = False) -> DataFrame:
    """queries(query_id, boost, text_vec, math_vec).  n < 1 finds nothing.  ``few``: the caller
    knows that there are at most some hundred queries."""
    return final(candidates(blocks, queries, max(n, 0), where, few), max(n, 0))


def with_texts(results: DataFrame, blocks: DataFrame, on: tuple[str, ...] = ("block_id",), few: bool = False) -> DataFrame:
    """Late materialisation: texts and metadata for the winners only.  ``few`` results are sent
    to the blocks; if ``on`` names the blocks' partition too, only the winners' are read."""
    known = ("label", "section", "source_file", "folder", "text")
    named = blocks.select(*on, *(F.coalesce(c, F.lit("")).alias(c) for c in known))
    return named.join(F.broadcast(results) if few else results, list(on))
