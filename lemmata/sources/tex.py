"""Folders of LaTeX files as a DataFrame, in include order.

Folders are local paths or URIs of a store that pyarrow knows (file, hdfs, s3, gs, ...).  The
tasks list directories, look for what files include, and read files, all by the same URIs.
Paths are numbered there in their order; the driver walks the graph of those numbers only."""

from __future__ import annotations

import os
import posixpath
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.blocks import references
from .charset import decode
from .latex import latex_events

FILES = "path string, text string"
#: Bits of a row's number within its partition, in Spark's increasing ids; bits below a round's.
ROW_BITS, ROUND_BITS = 33, 56


def resolved(path: str | Path) -> str:
    """An absolute path; of local ones (with or without file:) the real path."""
    path = str(path)
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" not in path:
        return str(Path(path).resolve())
    scheme, rest = path.split("://", 1)
    return f"{scheme}://{posixpath.normpath(rest)}"


def place(path: str) -> tuple[fs.FileSystem, str, str]:
    """The file system, the path within it, and what a URI has before that path."""
    if "://" not in path:
        return fs.LocalFileSystem(), path, ""
    system, inner = fs.FileSystem.from_uri(path)
    return system, inner, path[: len(path) - len(inner)] if path.endswith(inner) else path.split("://")[0] + "://"


def directory(folder: str | Path) -> str:
    root = resolved(folder)
    system, inner, _ = place(root)
    if system.get_file_info(inner).type != fs.FileType.Directory:
        raise ValueError(f"Not a directory: {root}")
    return root


def kept(df: DataFrame, held: list[DataFrame]) -> DataFrame:
    """``df`` on the executors' disks, until the caller unpersists what is in ``held``."""
    held.append(df.persist(StorageLevel.DISK_ONLY))
    return held[-1]


def spread(df: DataFrame) -> DataFrame:
    """Rows that cost a call to the store each, dealt to all tasks."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def listing(spark: SparkSession, folder: str | Path, held: list[DataFrame]) -> DataFrame:
    """(found, path): all .tex files below, hidden ones too, as found and resolved.  Each level of
    the tree is a job whose tasks list a directory a row; links to directories aren't followed."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p in b["path"]:
                system, inner, before = place(p)
                inside = system.get_file_info(fs.FileSelector(inner))
                rows = [(before + f.path, f.type == fs.FileType.Directory) for f in inside if f.path.endswith(".tex") and f.type == fs.FileType.File or f.type == fs.FileType.Directory and (before or not os.path.islink(f.path))]
                yield pd.DataFrame(rows, columns=["found", "is_folder"])

    level, files = spark.createDataFrame([(directory(folder),)], "path string"), None
    while True:
        level = kept(spread(level).mapInPandas(work, "found string, is_folder boolean"), held)
        own = level.where("not is_folder").select("found")
        files = own if files is None else files.unionByName(own)
        level = level.where("is_folder").select(F.col("found").alias("path"))
        if level.isEmpty():
            return files.withColumn("path", paths_of(F.col("found")))


@F.pandas_udf(T.StringType())
def paths_of(found: pd.Series) -> pd.Series:
    return found.map(resolved)


@F.pandas_udf(T.StringType())
def included(src: pd.Series, ref: pd.Series) -> pd.Series:
    """What a file's reference names: relative to the file."""
    return pd.Series([resolved(posixpath.join(posixpath.dirname(s), r)) for s, r in zip(src, ref, strict=True)], dtype=object)


@F.pandas_udf(T.BooleanType())
def is_file(path: pd.Series) -> pd.Series:
    def one(p: str) -> bool:
        system, inner, _ = place(p)
        return system.get_file_info(inner).type == fs.FileType.File

    return path.map(one).astype(bool)


def load(files: DataFrame) -> DataFrame:
    """files(path) -> (path, text); of files that can't be read text is null."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p in b["path"]:  # one row at a time: texts may be long
                try:
                    system, inner, _ = place(p)
                    with system.open_input_stream(inner) as f:
                        text = decode(f.read())
                except OSError:
                    text = None
                yield pd.DataFrame({"path": [p], "text": [text]})

    return spread(files.select("path")).mapInPandas(read, FILES)


def include_edges(files: DataFrame) -> DataFrame:
    """(src, ord, ref): what each file includes, in order."""
    return files.where(F.col("text").isNotNull()).select(F.col("path").alias("src"), F.posexplode(references(F.col("text"))).alias("ord", "ref"))


def placed(df: DataFrame, order: list[Column | str], held: list[DataFrame] | None = None) -> DataFrame:
    """Adds ``place``: numbers from 0 in this order.  One sort by ranges; of the ranges only the
    counts are summed up in one task."""
    rows = kept(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()), [] if held is None else held)
    part = F.shiftright("_id", ROW_BITS)
    counts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(counts), part == F.col("_part")).withColumn("place", F.col("_before") + F.col("_id").bitwiseAND((1 << ROW_BITS) - 1)).drop("_id", "_part", "_before")


def walked(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """roots(id), edges(src, ord, dst) -> (id, file_ord): depth-first from each root in the order of
    ids, each file once, at its first visit.  The walk is one after the other by nature; it takes
    place on the driver, over numbers."""
    start = np.sort(roots.select("id").toArrow().column("id").to_numpy())
    arcs = edges.select("src", F.col("ord").cast("long").alias("ord"), "dst").toArrow()
    src, ord_, dst = (arcs.column(c).to_numpy() for c in ("src", "ord", "dst"))
    by = np.lexsort((ord_, src))
    src, dst = src[by], dst[by]
    seen: set[int] = set()
    order: list[int] = []
    for root in start.tolist():
        stack = [root]
        while stack:
            at = stack.pop()
            if at not in seen:
                seen.add(at)
                order.append(at)
                a, b = np.searchsorted(src, [at, at + 1])
                stack.extend(dst[a:b][::-1].tolist())
    return roots.sparkSession.createDataFrame(pa.table({"id": pa.array(order, pa.int64()), "file_ord": pa.array(np.arange(len(order)))}))


def ordered(spark: SparkSession, folder: str | Path, held: list[DataFrame] | None = None) -> DataFrame:
    """(path, text, file_ord): the folder's files and what they include, also outside of it.
    Listings and texts are kept on the executors' disks until the caller unpersists what is put
    into ``held``."""
    held = [] if held is None else held
    found = listing(spark, folder, held).groupBy("path").agg(F.min(F.split("found", "/")).alias("_order"))
    new = kept(found.orderBy("_order").select("path", F.monotonically_increasing_id().alias("id")), held)
    known, roots, files, edges, rounds = new, new, None, None, 0
    while True:
        texts = kept(load(new), held)
        refs = kept(include_edges(texts).select("src", "ord", included(F.col("src"), F.col("ref")).alias("dst")), held)
        files, edges = (texts, refs) if files is None else (files.unionByName(texts), edges.unionByName(refs))
        # only what no listing has named yet is looked for
        missing = spread(refs.select(F.col("dst").alias("path")).distinct().join(known, "path", "left_anti"))
        rounds += 1
        new = kept(missing.where(is_file(F.col("path"))).select("path", (F.monotonically_increasing_id() + (rounds << ROUND_BITS)).alias("id")), held)
        if new.isEmpty():
            break
        known = known.unionByName(new)
    numbers = edges.join(known.select(F.col("path").alias("src"), F.col("id").alias("s")), "src").join(known.select(F.col("path").alias("dst"), F.col("id").alias("d")), "dst")
    places = walked(roots, numbers.select(F.col("s").alias("src"), "ord", F.col("d").alias("dst")))
    return known.join(places, "id").join(files, "path").select("path", "text", "file_ord")


def parsed(files: DataFrame, folder: str) -> DataFrame:
    """(path, text, file_ord) -> (folder, source_file, file_ord, pos, kind, name, title, label, body).
    A file that can't be parsed gives one row of kind ``error``, with what went wrong as its title,
    and no others."""
    found = files.select("path", "text", "file_ord").lateralJoin(latex_events(F.col("text").outer()))
    return found.select(F.lit(folder).alias("folder"), F.col("path").alias("source_file"), "file_ord", "pos", "kind", "name", "title", "label", "body")


def folder_events(spark: SparkSession, folder: str | Path, held: list[DataFrame] | None = None) -> DataFrame:
    return parsed(ordered(spark, folder, held), resolved(folder))


def file_events(spark: SparkSession, path: str | Path, folder: str | Path | None = None) -> DataFrame:
    path = resolved(path)
    own = resolved(folder) if folder else posixpath.dirname(path)
    return parsed(load(spark.createDataFrame([(path,)], "path string")).withColumn("file_ord", F.lit(0).cast("long")), own)
