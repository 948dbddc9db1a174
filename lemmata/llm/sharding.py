"""Sharding along a Hilbert curve over several metadata dimensions.

Each dimension is quantised to 2**bits cells of about equal row counts.  The cells' limits
are quantiles over all rows: of numbers, dates and times by Spark's approximate percentiles;
of strings, whole, by counts of their distinct values.  Rows are sorted by the Hilbert index of their cell and the run is cut into shards
whose row counts differ by at most one, so each file covers a compact box and min/max
statistics prune on every dimension.

The law held is ``rows``; shard = rank * shards / rows, so no group or hot value matters:
ties on the curve are broken by the text's checksum, the size and doc_id, then by the part a
row comes from, and a hot cell, or a mass of equal rows, is cut where it falls.  Equal texts
of equal metadata lie next to each other.

Nulls are in the lowest cell of their dimension.  Null text has size 16 and checksum 0
(as the empty text); a very long one counts by its size only.  Rows that repeat each get a
place of their own.  With fewer rows than shards some shards are empty; an empty table gives
no rows.  A caller's columns come back unchanged, whatever their names: a result whose name
is taken is named with an underscore after it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ROW, named, parts_for, quoted, read, row_of, stage, unfolded, unstage

#: Rows of one part of the sort.
PART_ROWS = 1_000_000


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """(n, d) cell numbers below 2**bits -> position on the d-dimensional curve (Skilling,
    2004: from axes to the transposed index by inverse undo and Gray coding)."""
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(up, p, 0) ^ swap
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[d - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def _value(df: DataFrame, name: str) -> tuple[Column, bool]:
    """What a dimension is ordered by, and whether it is a number."""
    kind, c = df.schema[name].dataType, F.col(quoted(name))
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double"), True
    if isinstance(kind, (T.NumericType, T.TimestampType, T.BooleanType)):
        return c.cast("double"), True
    return c.cast("string"), False


def _string_limits(strings: DataFrame, at: list[float], parts: int) -> list[str]:
    """strings(v) -> the values at which the given shares of all rows are reached.  Each distinct
    value is counted, values are sorted by range, and a running sum within each range, with the
    sum of the ranges before it (one number a range), finds the places: exact, and no value's
    rows meet in one task."""
    counts = strings.where(F.col("v").isNotNull()).groupBy("v").agg(F.count("*").alias("n"))
    ranged = stage(counts.repartitionByRange(parts, "v").sortWithinPartitions("v").select("v", "n", F.spark_partition_id().alias("part")), "values")
    sums = sorted((r["part"], r["n"]) for r in ranged.groupBy("part").agg(F.sum("n").alias("n")).collect())
    firsts = np.cumsum([0, *(n for _, n in sums)]).tolist()
    bases = strings.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sums, firsts, strict=False)], "part int, base long")
    end = F.col("base") + F.sum("n").over(Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    places = F.array(*(F.lit(x * firsts[-1]) for x in at))
    reached = ranged.join(F.broadcast(bases), "part").select("v", "n", end.alias("end")).where(F.exists(places, lambda x: (x > F.col("end") - F.col("n")) & (x <= F.col("end"))))
    out = sorted(r["v"] for r in reached.select("v").collect())  # as many as shares, at most
    unstage(ranged)
    return out


def limits(df: DataFrame, dims: list[str], bits: int, parts: int) -> dict[str, list]:
    """The distinct inner cell limits of each dimension: 2**bits - 1 values at most."""
    at = [i / (1 << bits) for i in range(1, 1 << bits)]
    kinds = {d: _value(df, d) for d in dims}
    numbers = [d for d in dims if kinds[d][1]]
    out: dict[str, list] = {}
    if numbers:
        row = df.agg(*(F.percentile_approx(kinds[d][0], at, 10_000).alias(f"d{i}") for i, d in enumerate(numbers))).first()
        out |= {d: sorted(set(row[f"d{i}"] or [])) for i, d in enumerate(numbers)}
    for d in dims:
        if d not in out:
            out[d] = _string_limits(df.select(kinds[d][0].alias("v")), at, parts)
    return out


def place(df: DataFrame, dims: list[str], bits: int = 5, parts: int = 200) -> Column:
    """The Hilbert index of each row's cell: a cell is the number of limits below the value."""
    if bits * len(dims) > 62:
        raise ValueError("bits times dimensions must be 62 or less")
    edges = limits(df, dims, bits, parts)

    def cell(d: str) -> Column:
        value = _value(df, d)[0]
        out = F.lit(0)
        for x in edges[d]:
            out = out + (value > F.lit(x)).cast("int")
        return F.coalesce(out, F.lit(0))

    @F.pandas_udf("long")
    def index(*cols: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([c.to_numpy(np.int64) for c in cols], axis=1), bits))

    return index(*(cell(d) for d in dims))


MADE = ["hilbert", "shard", "slot"]


def assign(df: DataFrame, shards: int, dims: list[str], keep: list[str] | None = None, ties: list[str] | None = None, bits: int = 5) -> DataFrame:
    """``keep`` (all columns by default), hilbert, shard and slot.  df's rows are sorted once
    by range; the sorted rows are written, so that each part's rows are fixed, and a part's
    first rank is the sum of the counts before it (one number a part)."""
    spark = df.sparkSession
    keep, ties = df.columns if keep is None else keep, ties or []
    own = [F.col(quoted(t)).alias(f"tie{i}") for i, t in enumerate(ties)]
    parts = parts_for(spark, df.count(), PART_ROWS)
    keyed = df.select(row_of(keep), *own, place(df, dims, bits, parts).alias("hilbert"), F.spark_partition_id().alias("origin"))
    order = ["hilbert", *(f"tie{i}" for i in range(len(ties))), "origin"]
    ranged = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    fixed = stage(ranged.select(ROW, "hilbert", F.spark_partition_id().alias("part"), local.alias("at")), "ranked")
    counts = sorted((r["part"], r["n"]) for r in fixed.groupBy("part").agg(F.count("*").alias("n")).collect())
    firsts = np.cumsum([0, *(n for _, n in counts)]).tolist()
    bases = spark.createDataFrame([(p, b) for (p, _), b in zip(counts, firsts, strict=False)], "part int, base long")
    # one row a part: PART_ROWS rows or more each, so small enough to send to each task
    shard, slot = _cut(F.col("base") + F.col("at"), firsts[-1], shards)
    out = fixed.join(F.broadcast(bases), "part").select(ROW, "hilbert", shard.cast("int").alias("shard"), slot.alias("slot"))
    return unfolded(out, keep, MADE)


def _cut(rank: Column, total: int, shards: int) -> tuple[Column, Column]:
    """Shard and slot of a rank: the first ``total % shards`` shards have a row more."""
    small, more = divmod(total, shards)
    edge = more * (small + 1)
    big = F.floor(rank / F.lit(small + 1))
    rest = F.floor((rank - edge) / F.lit(max(small, 1))) + more
    shard = F.when(rank < edge, big).otherwise(rest).cast("long")
    slot = F.when(rank < edge, rank - big * (small + 1)).otherwise(rank - edge - (rest - more) * max(small, 1)).cast("long")
    return shard, slot


def write_sharded(df: DataFrame, folder: str, shards: int, dims: list[str], ties: list[str] | None = None, bits: int = 5) -> None:
    """One folder a shard, its rows in slot order, so that readers skip files by the min/max
    statistics of any dimension."""
    placed = assign(df, shards, dims, ties=ties, bits=bits)
    hilbert, shard, slot = named(df.columns, MADE)
    sorted_ = placed.drop(hilbert).repartition(shards, shard).sortWithinPartitions(shard, slot)
    sorted_.write.partitionBy(shard).parquet(folder)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = read(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    slim = stage(docs, "metadata")
    out = assign(slim, 40, ["source", "lang", "size", "doc_id"], ["doc_id", "size", "text_crc32"], ["text_crc32", "size", "doc_id"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")
