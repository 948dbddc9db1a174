"""A stored index for search: cells of each view, and which to look into.

``fit`` takes the SAMPLE blocks with the least hashes of their ids (so any layout of a table
gives the same ones), and one task a view runs k-means over their directions, with one cell
for each BY of them and CELLS at most.  It also measures there how many cells, nearest first, hold
the neighbours of a vector: ``probes`` are as many as hold ``aim`` of the NEAR nearest, on average.
``assigned`` gives every block its cell in each view; the numbers are columns of the block table.

``search`` deals a query to the cells it probes, in order of their centroids' closeness, and
compares it with all blocks there that pass the filter, exactly.  A query whose cells have fewer
than 2n such blocks is compared with all that pass instead, so a filter that leaves few blocks, or
a small table, has exact results.  Cells go through the grid of the exact search: large ones are
split like its blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import OVERFETCH, RESULTS
from . import search as exact

#: Blocks in the sample, of which each cell gets so many; cells; rounds of k-means.
SAMPLE, BY, CELLS, ROUNDS = 16_384, 32, 512, 12
#: Vectors of the sample that measure the probes, and neighbours of each.
TRIED, NEAR = 512, 10
CENTROID = "view_ord int, cell int, probes int, centroid array<double>"


def directions(v: np.ndarray) -> np.ndarray:
    return v / exact.norms(v)[:, None]


def kmeans(unit: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """Centroids by direction; a cell that loses all its members keeps its centroid."""
    centre = unit[np.sort(np.random.default_rng(seed).choice(len(unit), k, replace=False))]
    for _ in range(ROUNDS):
        own = (unit @ centre.T).argmax(1)
        total = np.zeros_like(centre)
        np.add.at(total, own, unit)
        full = total.any(1)
        centre[full] = directions(total[full])
    return centre


def probes_for(unit: np.ndarray, centre: np.ndarray, aim: float) -> int:
    tried = unit[:: -(-len(unit) // TRIED)]
    order = np.argsort(-(tried @ centre.T), axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centre))[None, :], axis=1)
    score = tried @ unit.T
    # itself is the nearest
    near = np.argsort(-score, axis=1)[:, 1 : NEAR + 1]
    own = (unit @ centre.T).argmax(1)
    needed = np.sort(np.take_along_axis(place, own[near], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(aim * len(needed))))]) + 1 if len(needed) else len(centre)


def fit(blocks: DataFrame, aim: float = 0.95) -> DataFrame:
    """CENTROID rows."""
    rows = exact.views_of(blocks, "block_id").select("block_id", "view_ord", "v")
    parts = [rows.where(F.col("view_ord") == i).orderBy(F.xxhash64("block_id"), "block_id").limit(SAMPLE) for i in range(len(exact.VIEWS))]

    def work(key: tuple, part: pa.Table) -> pa.Table:
        made = exact.matrices(part.column("v").combine_chunks())
        at: list[tuple] = []
        if made:  # vectors of the commonest length
            _, v = max(made.values(), key=lambda x: len(x[0]))
            unit = directions(v)
            centre = kmeans(unit, max(1, min(CELLS, len(unit) // BY)))
            n = probes_for(unit, centre, aim)
            at = [(key[0].as_py(), i, n, c.tolist()) for i, c in enumerate(centre)]
        cols = list(zip(*at, strict=True)) if at else [(), (), (), ()]
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64())), strict=True)], names=["view_ord", "cell", "probes", "centroid"])

    return parts[0].unionByName(parts[1]).groupBy("view_ord").applyInArrow(work, CENTROID)


class Index:
    """Centroids on the driver: CELLS a view at most."""

    def __init__(self, centroids: DataFrame):
        self.centre: dict[int, np.ndarray] = {}
        self.probes: dict[int, int] = {}
        rows = sorted(centroids.collect(), key=lambda r: r["cell"])
        for view in {r["view_ord"] for r in rows}:
            self.centre[view] = np.array([r["centroid"] for r in rows if r["view_ord"] == view])
            self.probes[view] = next(r["probes"] for r in rows if r["view_ord"] == view)

    def order(self, view: int, vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(rows with a direction, their cells nearest first)"""
        centre = self.centre.get(view)
        made = exact.matrices(vectors)
        if centre is None or centre.shape[1] not in made:
            return np.zeros(0, np.int64), np.zeros((0, 0), np.int64)
        at, v = made[centre.shape[1]]
        return at, np.argsort(-(directions(v) @ centre.T), axis=1, kind="stable")

    def assigned(self, blocks: DataFrame) -> DataFrame:
        """Adds text_cell and math_cell; null where a vector has no direction."""
        names = [f"{v}_cell" for v in exact.VIEWS]
        own = blocks.drop(*names)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cols = list(b.columns)
                for i, view in enumerate(exact.VIEWS):
                    cell = np.full(b.num_rows, -1)
                    at, order = self.order(i, b.column(f"{view}_vec"))
                    if len(at):
                        cell[at] = order[:, 0]
                    cols.append(pa.array(cell, pa.int32(), mask=cell < 0))
                yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, *names])

        return own.mapInArrow(work, T.StructType([*own.schema.fields, *(T.StructField(n, T.IntegerType()) for n in names)]))

    def routed(self, asked: DataFrame, probes: int | None = None) -> DataFrame:
        """asked(query_id, boost, view_ord, v) with the cells it probes."""
        own = asked.select("query_id", "boost", "view_ord", "v")

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                views = b.column("view_ord").to_numpy(zero_copy_only=False)
                for view in np.unique(views).tolist():
                    part = b.take(pa.array(np.flatnonzero(views == view)))
                    at, order = self.order(view, part.column("v"))
                    order = order[:, : probes or self.probes.get(view, 0)]
                    # a batch at a time of cells, so that vectors aren't copied all at once
                    for k in range(order.shape[1] if len(at) else 0):
                        made = part.take(pa.array(at))
                        yield pa.RecordBatch.from_arrays([*made.columns, pa.array(order[:, k], pa.int32())], names=[*made.schema.names, "cell"])

        return own.mapInArrow(work, T.StructType([*own.schema.fields, T.StructField("cell", T.IntegerType())]))


def sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("view_ord", "cell").agg(F.count("*").alias("n"))


def candidates(blocks: DataFrame, index: Index, queries: DataFrame, n: int, where: Column | None = None, probes: int | None = None) -> DataFrame:
    """As the exact search's; blocks have text_cell and math_cell."""
    found = blocks if where is None else blocks.where(where)
    keep = max(OVERFETCH * n, 1)
    rows, row_sizes, asked = exact.views_of(found, "block_id", "env_type", cells=True), exact.cell_sizes(found, cells=True), exact.asked_of(queries)
    first = index.routed(asked, probes)
    # every block in a cell has a direction, so cells of that many blocks give that many hits
    enough = first.join(F.broadcast(row_sizes), ["view_ord", "cell"]).groupBy("query_id", "view_ord").agg(F.sum("n").alias("n")).where(F.col("n") >= keep)
    of = ["query_id", "view_ord"]
    near, rest = first.join(enough, of, "left_semi"), asked.join(enough, of, "left_anti")
    hits = exact.meet(rows, row_sizes, near, sizes(near), keep).unionByName(exact.meet(exact.views_of(found, "block_id", "env_type"), exact.cell_sizes(found), rest, sizes(rest), keep))
    return exact.best_of(hits, OVERFETCH * n).select("query_id", "boost", "block_id", "env_type", "view_ord", "score", "view_rank")


def search(blocks: DataFrame, index: Index, queries: DataFrame, n: int = RESULTS, where: Column | None = None, probes: int | None = None) -> DataFrame:
    """As the exact search, with scores that are exact for what is found."""
    return exact.final(candidates(blocks, index, queries, max(n, 0), where, probes), max(n, 0))
