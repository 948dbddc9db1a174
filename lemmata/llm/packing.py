"""Packing by power-of-two decomposition.

Each document's ids, with an end id, are cut into pieces whose lengths are powers of
two: as many of the greatest length as fit, then the binary digits of the rest, longest
first.  A piece is a sequence of its own, so no sequence crosses documents and nothing
is padded.  Sequences of one length form a bucket; sequence ids are gapless and
ascend through the buckets, so a bucket is one range of ids.

Null text counts as empty: its one id is the end id.  Very long texts just have many
pieces.  Rows that repeat, or share a doc_id or have none, are packed each on their own.  An
empty table gives no pieces.  Pieces of one length are numbered in the order of the parts
they were written in, so ties need no rule.  A caller's columns come back unchanged, whatever
their names: a result whose name is taken is named with an underscore after it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .common import ROW, per_batch, read, row_of, stage, unfolded
from .tokens import Encoder, file_of, kept, load

MADE = ["start", "length", "ids_crc32", "doc_tokens"]
#: An Encoder's settings where other work shares the executor.
SMALL = {"most": 200_000, "part": 1 << 20}


def cuts(n: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; longest is a power of two."""
    out = [(i * longest, longest) for i in range(n // longest)]
    at, rest = n // longest * longest, n % longest
    while rest:
        k = 1 << (rest.bit_length() - 1)
        out.append((at, k))
        at, rest = at + k, rest - k
    return out


def pieces(
    docs: DataFrame,
    keep: list[str],
    text: str = "text",
    path: str | None = None,
    end: int = 1,
    longest: int = 2048,
    with_ids: bool = True,
    encoder: dict[str, int] | None = None,
) -> DataFrame:
    """One row a piece: _row (a struct of ``keep``), MADE, ids if wanted, and the piece's
    place: part, and its number ``at`` among the part's pieces of its length.  ``encoder``:
    how much the Encoder may hold (SMALL: less memory, about half as much time again)."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    source = docs.select(row_of(keep), F.col(text).alias("text"))
    schema = source.select(ROW).schema
    for c in MADE:
        schema = schema.add(c, "long")
    if with_ids:
        schema = schema.add("ids", ArrayType(IntegerType()))
    schema = schema.add("part", "integer").add("at", "long")
    shared = docs.sparkSession.sparkContext.broadcast(load(path or file_of("word_bpe_49k.json")))
    last, held = np.array([end], "<u4").tobytes(), encoder or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, seen = kept(Encoder, shared.value, **held), TaskContext.get().partitionId(), [0] * longest.bit_length()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            row, cols, ids, at = [], [[], [], [], []], [], []
            for i, b in enumerate(coder.ids(batch.column("text"))):
                b += last
                for start, length in cuts(len(b) // 4, longest):
                    own = b[4 * start : 4 * (start + length)]
                    row.append(i)
                    for c, v in zip(cols, (start, length, zlib.crc32(own), len(b) // 4), strict=True):
                        c.append(v)
                    k = length.bit_length() - 1
                    at.append(seen[k])
                    seen[k] += 1
                    if with_ids:
                        ids.append(np.frombuffer(own, "<i4"))
            arrays = [batch.column(ROW).take(pa.array(row, pa.int32())), *(pa.array(c, pa.int64()) for c in cols)]
            if with_ids:
                arrays.append(pa.array(ids, pa.list_(pa.int32())))
            arrays += [pa.array(np.full(len(row), part, np.int32)), pa.array(at, pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, names=schema.names)

        yield from per_batch(work, 2000)(batches)

    return source.mapInArrow(run, schema)


def number(cut: DataFrame) -> DataFrame:
    """Adds sequence_id and offset.  ``cut`` is pieces(), staged: what was written fixes each
    piece's place.  No piece is sorted or dealt to be numbered: a part's pieces of a length
    follow those of shorter lengths and those of the parts before it, and these sums come from
    one count a part and length (at most log2(longest) + 1 rows a part)."""
    counts = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    in_length = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_length = Window.orderBy("length").rowsBetween(Window.unboundedPreceding, -1)
    shorter = counts.groupBy("length").agg(F.sum("n").alias("n")).select("length", F.coalesce(F.sum("n").over(by_length), F.lit(0)).alias("shorter"))
    own = counts.select("length", "part", F.coalesce(F.sum("n").over(in_length), F.lit(0)).alias("before"))
    places = own.join(shorter, "length").select("length", "part", (F.col("before") + F.col("shorter")).alias("base"))
    out = cut.join(places, ["length", "part"])
    return out.withColumn("sequence_id", F.col("base") + F.col("at")).withColumn("offset", F.lit(0).cast("long"))


def pack(docs: DataFrame, keep: list[str], with_ids: bool = True, **how) -> DataFrame:
    """``keep``, MADE, ids if wanted, sequence_id and offset."""
    cut = stage(pieces(docs, keep, with_ids=with_ids, **how), "pieces")
    return unfolded(number(cut), keep, [*MADE, *["ids"] * with_ids, "sequence_id", "offset"])


COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return pack(docs, ["doc_id"], with_ids=False).select(*COLUMNS)
