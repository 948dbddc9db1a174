"""Ranked lexical search by a bit-sliced impact index.

Terms are runs of ASCII letters and digits and of all characters above ASCII, with A-Z
lower-cased.  A term's impact in a document is w * ((1000000000 * tf) div (1000 * tf + 12 * m)),
with w = floor(1000 * ln((2N + 2) / (2 df + 1))), m = 75 + (25 n N) div L; a document's score
is the sum over a query's terms, repeats included.

1. One pass over the documents counts N, L and the queries' terms' df.
2. A second deals each task's documents to blocks of at most BLOCK documents and POSTINGS
   postings.  A block's row of the index has, for each of the terms, bitmaps over the block's
   documents: slice b says in which documents bit b of the impact is set.  Of a bitmap only
   the 64-bit words are kept in which the term occurs; where even those take more room than
   the documents and their impacts, these are kept, and made slices when they are used.
3. A query's slices are added bitwise: a carry-save adder takes all slices of a term at once,
   and one ripple of the carries ends the sum.  A term that a query repeats is added shifted, for
   each bit of the number of repeats.
4. The k best of a block are found from the most significant slice down: the documents that
   are in for sure and those that still tie are bitmaps too; what ties at the end is taken in
   order of doc_id, which is the order of the bits.  A task hands on its k best of a query only.

Queries are worked on in passes of about QUERIES, whose terms and weights every task gets; the
index of a pass holds its terms only.  No posting is shuffled, no score estimated.

Null text has no terms; neither has an empty one, and such documents don't count in N.  A query
without terms that occur finds nothing.  A very long text is read whole.  Repeated rows are
documents, or queries, of their own, so doc_ids may come again; equal scores are ordered by
doc_id, nulls first.  Empty tables give an empty result.  A query's columns come back unchanged,
whatever their names: a result whose name is taken is named with an underscore after it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ROW, quoted, read, row_of, stage, unfolded, unstage

#: Bytes to lower-cased letters, digits and what is above ASCII; the others to spaces.
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
BLOCK, POSTINGS = 4096, 1 << 17
QUERIES, QUERY_BYTES = 1024, 16 << 20
INDEX = "docs array<long>, terms array<int>, slices array<binary>"


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TERMS).split()


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def _bags(batches: Iterator[pa.RecordBatch], known: dict[bytes, int]) -> Iterator[tuple[object, int, list[tuple[int, int]]]]:
    """Of each document its id, its number of terms, and (term, tf) of the known terms."""
    for b in batches:
        for i in range(b.num_rows):  # one text at a time: they may be long
            found = terms_of(b.column("text")[i].as_py())
            yield b.column("doc_id")[i].as_py(), len(found), [(known[t], n) for t, n in Counter(found).items() if t in known]


def statistics(docs: DataFrame, known: dict[bytes, int]) -> tuple[int, int, list[int]]:
    """N, L and the known terms' df: one row for each of them from each task."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(len(shared.value) + 2, np.int64)
        for _, n, bag in _bags(batches, shared.value):
            if n:
                count[-2:] += 1, n
                count[[t for t, _ in bag]] += 1
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[at])], names=["at", "n"])

    out = [0] * (len(known) + 2)
    for r in docs.mapInArrow(work, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    shared.destroy()
    return out[-2], out[-1], out[:-2]


def sliced(doc: np.ndarray, impact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A term's slices: the places of its words, and slices x words.  Documents ascend."""
    word = doc >> 6
    starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    bits = (impact >> np.arange(int(impact.max()).bit_length())[:, None] & 1).astype(np.uint64)
    return word[starts], np.bitwise_or.reduceat(bits << (doc & 63).astype(np.uint64), starts, axis=1)


def packed(doc: np.ndarray, impact: np.ndarray) -> bytes:
    """Numbers of slices and of words, the words' places and the words; or 0 and the number of
    documents, the documents and their impacts."""
    words = 1 + np.count_nonzero(np.diff(doc >> 6))
    if words * (8 * int(impact.max()).bit_length() + 4) > 12 * len(doc):
        return np.array([0, len(doc)], "<u4").tobytes() + doc.astype("<u4").tobytes() + impact.astype("<i8").tobytes()
    at, rows = sliced(doc, impact)
    return np.array([len(rows), len(at)], "<u4").tobytes() + at.astype("<u4").tobytes() + rows.astype("<u8").tobytes()


def unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(places of the words, slices x words)"""
    n, size = np.frombuffer(raw, "<u4", 2).tolist()
    at = np.frombuffer(raw, "<u4", size, 8).astype(np.int64)
    if not n:
        return sliced(at, np.frombuffer(raw, "<i8", size, 8 + 4 * size))
    return at, np.frombuffer(raw, "<u8", n * size, 8 + 4 * size).reshape(n, size)


def index(docs: DataFrame, known: dict[bytes, int], stats: tuple[int, int, list[int]]) -> DataFrame:
    """docs(doc_id, text: UTF-8) -> INDEX: one row a block.  A block's documents are in order of
    doc_id, those without any of the terms left out."""
    n_docs, length, df = stats
    weights = np.array([weight(n_docs, d) if d else 0 for d in df], np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((known, weights))

    def block(held: list) -> pa.RecordBatch:
        held.sort(key=lambda x: (x[0] is not None, x[0] or 0))
        sizes = np.array([len(bag) for _, _, bag in held])
        doc = np.repeat(np.arange(len(held)), sizes)
        norm = np.repeat(np.array([75 + 25 * n * n_docs // length for _, n, _ in held], np.int64), sizes)
        term, tf = np.array([x for _, _, bag in held for x in bag], np.int64).reshape(-1, 2).T
        impact = shared.value[1][term] * (1_000_000_000 * tf // (1000 * tf + 12 * norm))
        order = np.argsort(term, kind="stable")
        order = order[impact[order] > 0]
        term, doc, impact = term[order], doc[order], impact[order]
        cuts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
        ends = np.r_[cuts[1:], len(term)] if len(cuts) else cuts
        rows = [packed(doc[a:b], impact[a:b]) for a, b in zip(cuts.tolist(), ends.tolist(), strict=True)]
        kinds = [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip([[d for d, _, _ in held], term[cuts].tolist(), rows], kinds, strict=True)], names=["docs", "terms", "slices"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for d in _bags(batches, shared.value[0]):
            if d[2]:
                held.append(d)
                size += len(d[2])
                if len(held) == BLOCK or size >= POSTINGS:
                    yield block(held)
                    held, size = [], 0
        if held:
            yield block(held)

    return docs.mapInArrow(work, INDEX)


def added(bags: list[tuple[int, tuple[np.ndarray, np.ndarray]]], words: int) -> np.ndarray:
    """The sum's slices x words, least significant first, of (repeats, slices of a term)."""
    most = sum(n << len(rows) for n, (_, rows) in bags)
    depth = max(1, most.bit_length())
    one, two = np.zeros((depth, words), np.uint64), np.zeros((depth, words), np.uint64)
    for n, (at, rows) in bags:
        for shift in range(n.bit_length()):
            if n >> shift & 1:
                dense = len(at) == words
                x = np.zeros((depth, len(at)), np.uint64)
                x[shift : shift + len(rows)] = rows
                a, b = (one, two) if dense else (one[:, at], two[:, at])
                half = a ^ b
                carry = (a & b) | (half & x)
                half ^= x
                if dense:
                    one, two[1:] = half, carry[:-1]
                    two[0] = 0
                else:
                    one[:, at] = half
                    two[1:, at], two[0, at] = carry[:-1], 0
    # the carries that are left ripple up
    carry = np.zeros(words, np.uint64)
    for s in range(depth):
        half, both = one[s] ^ two[s], one[s] & two[s]
        one[s] = half ^ carry
        carry = both | (half & carry)
    return one


def count(bits: np.ndarray) -> int:
    return int(np.bitwise_count(bits).sum())


def places(bits: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bits.astype("<u8").view(np.uint8), bitorder="little"))


def best(total: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(score, document) of the k best with a score, ties by document."""
    sure, tied = np.zeros(total.shape[1], np.uint64), np.bitwise_or.reduce(total, axis=0)
    if count(tied) > k:
        for row in total[::-1]:
            with_bit = tied & row
            n = count(sure) + count(with_bit)
            if n > k:
                tied = with_bit
            else:
                sure, tied = sure | with_bit, tied & ~row
                if n == k:
                    tied = np.zeros_like(tied)
                    break
    found = np.r_[places(sure), places(tied)[: k - count(sure)]] if k else np.zeros(0, np.int64)
    bits = total[:, found >> 6] >> (found & 63).astype(np.uint64) & np.uint64(1)
    scores = [sum(1 << s for s in np.flatnonzero(c).tolist()) for c in bits.T]
    return sorted(zip(scores, found.tolist(), strict=True), key=lambda x: (-x[0], x[1]))


def _searched(blocks: DataFrame, queries: list[tuple[int, list[tuple[int, int]]]], k: int) -> DataFrame:
    """(at, doc_id, score): each task's k best of each query (at, [(term, repeats)])."""
    shared = blocks.sparkSession.sparkContext.broadcast(queries)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: dict[int, list[tuple]] = {}
        for b in batches:
            for i in range(b.num_rows):
                docs = b.column("docs")[i].as_py()
                own = dict(zip(b.column("terms")[i].as_py(), b.column("slices")[i].values, strict=True))
                words = -(-len(docs) // 64)
                for at, terms in shared.value:
                    if bags := [(n, unpacked(own[t].as_buffer())) for t, n in terms if t in own]:
                        old = top.get(at, [])
                        new = [(-s, docs[d] is not None, docs[d] or 0) for s, d in best(added(bags, words), k)]
                        top[at] = sorted([*old, *new])[:k]
        rows = [(at, d if known else None, -s) for at, found in top.items() for s, known, d in found]
        at, doc, score = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())], names=["at", "doc_id", "score"])

    return blocks.mapInArrow(work, "at long, doc_id long, score long")


def search(docs: DataFrame, queries: DataFrame, keep: list[str], k: int = 20, doc_id: str = "doc_id", text: str = "text", query_text: str = "text", at_once: int = QUERIES) -> DataFrame:
    """``keep`` (columns of queries), rank, doc_id, score."""
    said = queries.select(row_of(keep), F.col(quoted(query_text)).cast("binary").alias("text"))

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                found = sorted(Counter(terms_of(b.column("text")[i].as_py())).items())
                yield pa.RecordBatch.from_arrays([b.column(ROW).slice(i, 1), pa.array([[t for t, _ in found]], pa.list_(pa.binary())), pa.array([[n for _, n in found]], pa.list_(pa.int64()))], names=[ROW, "terms", "repeats"])

    bags = said.mapInArrow(bag, said.select(ROW).schema.add("terms", T.ArrayType(T.BinaryType())).add("repeats", T.ArrayType(T.LongType())))
    asked = stage(bags.withColumn("at", F.monotonically_increasing_id()), "queries")
    size = asked.agg(F.count("*"), F.sum(F.expr("aggregate(terms, 0L, (n, t) -> n + length(t) + 16)"))).first()
    passes = max(1, -(-size[0] // at_once), -(-(size[1] or 0) // QUERY_BYTES))
    own = docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(text)).cast("binary").alias("text"))
    hits = None
    for p in range(passes):
        # about at_once queries
        part = asked.select("at", "terms", "repeats").where(F.pmod(F.xxhash64("at"), F.lit(passes)) == p).collect()
        known = {t: i for i, t in enumerate(sorted({bytes(t) for r in part for t in r["terms"]}))}
        stats = statistics(own, known)
        made = stage(index(own, known, stats), "index")
        found = stage(_searched(made, [(r["at"], [(known[bytes(t)], n) for t, n in zip(r["terms"], r["repeats"], strict=True)]) for r in part], k), "hits")
        unstage(made)
        hits = found if hits is None else hits.unionByName(found)
    rank = F.row_number().over(Window.partitionBy("at").orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))
    ranked = hits.withColumn("rank", rank).where(F.col("rank") <= k)
    return unfolded(ranked.join(asked.select("at", ROW), "at"), keep, ["rank", "doc_id", "score"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark").select("item_id", "text"), ["item_id"])


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_RUNS = f"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')"
SQL = f"""WITH q AS (SELECT item_id, unnest({_RUNS}) AS term FROM benchmark), d AS (SELECT doc_id, len({_RUNS}) AS n, {_RUNS} AS terms FROM documents WHERE len({_RUNS}) > 0),
c AS (SELECT count(*) AS docs, sum(n) AS total FROM d),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(terms) AS term FROM d) GROUP BY ALL HAVING term IN (SELECT term FROM q)),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, c GROUP BY term),
i AS (SELECT doc_id, term, w * ((1000000000 * tf)::BIGINT // (1000 * tf + 12 * (75 + ((25 * n * docs)::BIGINT // total::BIGINT)))::BIGINT) AS impact FROM p JOIN w USING (term), c),
s AS (SELECT item_id, doc_id, sum(impact)::BIGINT AS score FROM q JOIN i USING (term) GROUP BY ALL HAVING sum(impact) > 0),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s)
SELECT * FROM r WHERE rank <= 20"""
