"""What several operators share: tables, cutting lineage, blocks for hot keys."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import session_dir

#: ASCII white space, as every word rule here has it.
BLANK = r"\x20\x09-\x0D"
WORD = rf"[^{BLANK}]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def new_folder(spark: SparkSession, what: str) -> str:
    """A folder of the application's, deleted when it ends."""
    return f"{session_dir(spark)}/{what}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def stage(df: DataFrame, what: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    The written table cuts the lineage, survives lost executors and fixes the
    rows of each part, so later passes over it see the same rows.
    """
    spark = df.sparkSession
    path = new_folder(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    if _scratch:
        _scratch[-1].append(out)
    return out


_scratch: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Tables that are staged within are deleted at the end, save what the caller takes out of
    the list: for results that are written before the scope ends."""
    made: list[DataFrame] = []
    _scratch.append(made)
    try:
        yield made
    finally:
        _scratch.pop()
        unstage(*made)


def unstage(*dfs: DataFrame) -> None:
    """Delete staged tables that nothing will read any more."""
    for df in dfs:
        if path := getattr(df, "staged_path", None):
            drop_folder(df.sparkSession, path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(spark: SparkSession, size: int, each: int) -> int:
    """Parts of about ``each`` bytes or rows, but not fewer than the shuffle partitions."""
    return max(partitions(spark), -(-size // each))


def cells(keyed: DataFrame, key: list[str], mark: str, block: int) -> tuple[DataFrame, list[str]]:
    """``keyed`` plus a and b, and the columns that name a cell (key, a, b).  The rows of a key
    with over ``block`` of them are dealt to blocks by a hash of ``mark``, and each two blocks
    (and each block with itself) meet in one cell; other keys are one cell."""
    by = [*key, "a", "b"]
    hot = stage(keyed.groupBy(*key).agg(F.count("*").alias("cell_rows")).where(F.col("cell_rows") > block), "hot")
    n_hot = hot.count()
    if not n_hot:
        unstage(hot)
        return keyed.withColumns({"a": F.lit(0), "b": F.lit(0)}), by
    # a broadcast only if the number of hot keys is small, whatever the table's size
    met = keyed.join(F.broadcast(hot) if n_hot <= 10_000 else hot, key, "left")
    blocks = F.ceil(F.coalesce("cell_rows", F.lit(1)) / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64(mark), blocks).cast("int")
    met = met.withColumns({"cell_own": own, "cell_other": F.explode(F.sequence(F.lit(0), blocks - 1))})
    met = met.withColumns({"a": F.least("cell_own", "cell_other"), "b": F.greatest("cell_own", "cell_other")})
    return met.drop("cell_rows", "cell_own", "cell_other"), by


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def give_back() -> None:
    """At a task's end: the worker stays for later tasks, and what Arrow and the C library hold
    in reserve would stay with it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def per_batch(work: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch]], rows: int = 2000):
    """For mapInArrow: ``work`` on slices of at most ``rows`` rows, so that what it builds stays small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                made = work(batch.slice(at, rows))
                if isinstance(made, pa.RecordBatch):
                    yield made
                else:
                    yield from made
        give_back()

    return run


#: The one column that holds a caller's columns while an operator works.
ROW = "_row"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def row_of(keep: list[str]) -> Column:
    """The caller's columns as one struct, so that none of their names can clash with an
    operator's own, whatever they are (dots included)."""
    return F.struct(*(F.col(quoted(c)).alias(c) for c in keep)).alias(ROW)


def named(keep: list[str], made: list[str]) -> list[str]:
    """The names of an operator's results beside the caller's columns: a name that is taken
    (Spark compares without case) gets underscores at its end until it is free."""
    taken, out = {c.lower() for c in keep}, []
    for name in made:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def unfolded(df: DataFrame, keep: list[str], made: list[str]) -> DataFrame:
    """The caller's columns as they came, then the results."""
    own = [F.col(f"{ROW}.{quoted(c)}").alias(c) for c in keep]
    return df.select(*own, *(F.col(quoted(m)).alias(n) for m, n in zip(made, named(keep, made), strict=True)))
