"""Near copies: exact Jaccard similarity of word shingles, candidates by SimHash.

A text's shingles are hashed to 64 bits; two texts link if their sets' Jaccard similarity is
at least LEAST.

1. Pigeonhole search.  Each set has a SimHash of BITS bits.  Its first FINGERPRINTS words of 64
   bits are fingerprints of their own; sets that differ in at most REACH bits of one of them are
   found by simhash's generalised pigeonhole search (correlated bits in parts, thresholds by
   dynamic programming, probes, each pair met verified on 64 bits), and what it connects is
   together.  Nothing within REACH is lost, but at a similarity of 0.8 a pair differs in ten bits
   of 64 on average, and parts that may differ in enough bits for all pairs select nothing.
   So steps 2 and 3 are the exact way for the rest, between sets that aren't together yet.
2. Prefixes.  If all sets are sorted by one order, two sets of n and m shingles that link
   share one among the first n - ceil(LEAST n) + 1 of the one and the first
   m - ceil(LEAST m) + 1 of the other: no pair is lost.  The order puts shingles first whose
   bucket (of 2^18, counted over all texts) is rare, so that common passages seldom are in a
   prefix.  Texts that share a prefix shingle, and whose sizes allow a link, are a group;
   groups of the same members are one.
3. Sketches.  Within a group, texts that aren't together are compared by all BITS bits;
   those that differ in at most FAR bits are candidates.  A pair that links differs
   in more with a chance below 1e-9 (a bit differs with a chance of 0.16, at most 0.19 for the
   shortest texts); pairs that share a passage only are far beyond.  A group gives a spanning
   forest of its candidate pairs, never all pairs; large groups are split into blocks, and
   each two blocks meet in a cell.
4. Exact check.  Texts that candidate pairs of either kind connect are sent once to a task that compares
   their shingle sets; such a component is split into blocks by its number of shingles, and
   each two blocks meet in a cell.

Words are split at ASCII white space, without ASCII case.  A text with fewer words than a
shingle has the whole sequence as its one shingle; null text counts as empty, and texts
without words are one class.  Texts of one set are one class, however many: a class has one
row in each step.  A set's name is a 64-bit hash of it, so among a billion unlike texts two are
expected to share one with a chance of 0.03; rows are named by 128 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from .common import ROW, cells, partitions, per_batch, row_of, stage, unfolded, unstage
from .graph import components

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
WORDS = 5
#: Least similarity, as a fraction of whole numbers: 0.8.
LEAST = (4, 5)
BITS, FAR = 1024, 270
#: Fingerprints that the pigeonhole search takes, and bits of one in which sets may differ.
FINGERPRINTS, REACH = 2, 8
#: Texts of one group, and shingles of one component, that one block holds.
GROUP_BLOCK, SHINGLE_BLOCK = 8192, 1 << 21
#: Of the filter through which texts go that are compared exactly: 8 MB.
FILTER_BITS = 26
MIX = np.uint64(0x9E3779B97F4A7C15)
BUCKET_BITS = 18
LOW_BITS = np.uint64(64 - BUCKET_BITS)
LOW = np.uint64((1 << 64 - BUCKET_BITS) - 1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct uint64 hashes."""
    w = (text or "").encode().translate(LOWER).split()
    h = np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))
    n = max(1, len(w) - WORDS + 1) if len(w) else 0
    out = np.full(n, min(len(w), WORDS), np.uint64)
    for i in range(min(len(w), WORDS)):
        out = (out ^ h[i : i + n]) * MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def name_of(s: np.ndarray) -> int:
    """Signed 64 bits of the whole set."""
    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes())).view(np.int64))


def sketch(s: np.ndarray) -> bytes:
    """SimHash of BITS bits: 64 of each of BITS / 64 mixes of the shingles' hashes."""
    ones = np.zeros(BITS, np.int64)
    salts = np.arange(1, BITS // 64 + 1, dtype=np.uint64) * MIX
    for at in range(0, len(s), 255):
        words = mixed(s[at : at + 255, None] ^ salts)
        # eight counts of at most 255 are added at once, as the bytes of 64 bits
        bits = np.unpackbits(words.astype("<u8").view(np.uint8), axis=1, bitorder="little").view(np.uint64)
        ones += bits.sum(0).view(np.uint8)
    return np.packbits(2 * ones > len(s), bitorder="little").tobytes()


def classes_of(docs: DataFrame) -> DataFrame:
    """docs(doc_id, rid, text) -> (doc_id, rid, fp, n, sketch, marks); fp is a hash of the set,
    marks are its fingerprints."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [shingles(t) for t in batch.column("text").to_pylist()]
        wide = [sketch(s) for s in made]
        marks = [np.frombuffer(x, "<i8", FINGERPRINTS) for x in wide]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("rid"), pa.array([name_of(s) for s in made], pa.int64()), pa.array([len(s) for s in made], pa.int32()), pa.array(wide, pa.binary()), pa.array(marks, pa.list_(pa.int64()))],
            names=["doc_id", "rid", "fp", "n", "sketch", "marks"],
        )

    schema = docs.select("doc_id", "rid").schema.add("fp", "long").add("n", "integer").add("sketch", "binary").add("marks", ArrayType(LongType()))
    return docs.select("doc_id", "rid", "text").mapInArrow(per_batch(work, 500), schema)


def bucket_places(docs: DataFrame) -> np.ndarray:
    """For each bucket its place among all, the rarest first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for b in batches:
            held: list[np.ndarray] = []
            for t in b.column("text").to_pylist():
                held.append((shingles(t) >> LOW_BITS).astype(np.int64))
                if len(held) == 500:
                    total += np.bincount(np.concatenate(held), minlength=len(total))
                    held = []
            if held:
                total += np.bincount(np.concatenate(held), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["at", "n"])

    got = docs.select("text").mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(1 << BUCKET_BITS, np.int64)
    total[got.column("at").to_numpy()] = got.column("n").to_numpy()
    place = np.empty(1 << BUCKET_BITS, np.uint64)
    place[np.argsort(total, kind="stable")] = np.arange(1 << BUCKET_BITS, dtype=np.uint64)
    return place


def prefix(ordered: np.ndarray) -> np.ndarray:
    n = len(ordered)
    return ordered[: n - -(-LEAST[0] * n // LEAST[1]) + 1] if n else ordered


def prefixes(docs: DataFrame) -> DataFrame:
    """(key, n, fp): each set's prefix, its size and name; a set once in each task."""
    place = bucket_places(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            made, times, sizes, fps = [np.zeros(0, np.uint64)], [], [], []
            for t in batch.column("text").to_pylist():
                s = shingles(t)
                fp = name_of(s)
                if fp in seen:
                    continue
                seen.add(fp)
                # the order's key: the bucket's place, then the rest of the hash
                made.append(prefix(np.sort(place[(s >> LOW_BITS).astype(np.int64)] << LOW_BITS | s & LOW)))
                times.append(len(made[-1]))
                sizes.append(len(s))
                fps.append(fp)
            n, fp = np.array(sizes, np.int32), np.array(fps, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(made).view(np.int64)), pa.array(np.repeat(n, times)), pa.array(np.repeat(fp, times))], names=["key", "n", "fp"])

        yield from per_batch(work, 500)(batches)

    return docs.select("text").mapInArrow(run, "key long, n int, fp long")


def _gather(batches: Iterator[pa.RecordBatch], most: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Rows (key, n, fp) in that order -> (gid, fp) of the groups of two or more.  A group ends
    with its key, and where the next size is too large for a link across.  Its gid is a hash of
    its members, or, once it has over ``most``, of its key and first member, so that it needn't
    be held."""
    num, den = LEAST

    def made(gid: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(gid.view(np.int64)), pa.array(fp)], names=["gid", "fp"])

    held = [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)]
    going: np.uint64 | None = None  # the gid of the group that the held row goes on
    for b in batches:
        key, n, fp = (np.concatenate([h, b.column(c).to_numpy()]) for h, c in zip(held, ("key", "n", "fp"), strict=True))
        if not len(key):
            continue
        again = np.r_[False, (key[1:] == key[:-1]) & (fp[1:] == fp[:-1])]
        key, n, fp = key[~again], n[~again], fp[~again]
        new = np.r_[True, (key[1:] != key[:-1]) | (den * n[:-1].astype(np.int64) < num * n[1:].astype(np.int64))]
        starts = np.flatnonzero(new)
        last = int(starts[-1])
        sizes = np.diff(np.r_[starts, len(key)])
        hashes = mixed(fp.view(np.uint64))
        gids = np.add.reduceat(hashes, starts)
        if going is not None:
            gids[0] = going
        open_ = going if last == 0 else None
        if open_ is None and len(key) - last > most:
            open_ = mixed(np.array([key[last], fp[last]]).view(np.uint64)).sum()
        if open_ is not None:
            gids[-1] = open_
            to, keep = len(key), len(key) - 1
        else:
            to, keep = last, last
        whole = (sizes > 1) | (np.arange(len(starts)) == 0) & (going is not None)
        row = np.repeat(whole, sizes)
        row[to:] = False
        yield made(np.repeat(gids, sizes)[row], fp[row])
        held, going = [key[keep:], n[keep:], fp[keep:]], open_
    key, n, fp = held
    if len(key) > 1 and going is None:
        yield made(np.full(len(key), mixed(fp.view(np.uint64)).sum()), fp)


def groups(docs: DataFrame) -> DataFrame:
    """(gid, fp): which sets may link, each group of members once."""
    keys = prefixes(docs)
    dealt = keys.repartition(partitions(keys.sparkSession), "key").sortWithinPartitions("key", "n", "fp")
    return dealt.mapInArrow(_gather, "gid long, fp long").distinct()


def near_forest(fps: np.ndarray, sizes: np.ndarray, roots: np.ndarray, sketches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that, beside those within a root, connect all sets that candidate pairs connect:
    each is visited once and compared with those that aren't visited yet."""
    num, den = LEAST
    rest = np.arange(len(fps))
    us, vs = [], []
    while len(rest) > 1:
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            together = roots[rest] == roots[x]
            if together.any():
                queue += rest[together].tolist()
                rest = rest[~together]
            hit = (den * sizes[rest] >= num * sizes[x]) & (den * sizes[x] >= num * sizes[rest])
            fit = np.flatnonzero(hit)
            for at in range(0, len(fit), 4096):
                own = fit[at : at + 4096]
                hit[own] = np.bitwise_count(sketches[rest[own]] ^ sketches[x]).sum(1, dtype=np.int64) <= FAR
            if hit.any():
                found = rest[hit]
                us.append(np.full(len(found), fps[x]))
                vs.append(fps[found])
                queue += found.tolist()
                rest = rest[~hit]
    none = np.zeros(0, np.int64)
    return (np.concatenate(us), np.concatenate(vs)) if us else (none, none)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (gid, a, b, fp, n, root, sketch) sorted by cell -> candidate edges."""
    names = ("gid", "a", "b", "fp", "n", "root")
    held: list[np.ndarray] | None = None

    def edges(cols: list[np.ndarray], a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        fp, at = np.unique(cols[3][a:b], return_index=True)
        return near_forest(fp, cols[4][a:b][at].astype(np.int64), cols[5][a:b][at], cols[6][a:b][at])

    def out(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        u, v = (np.concatenate([np.zeros(0, np.int64), *(p[i] for p in pairs)]) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    for batch in batches:
        cols = [batch.column(c).to_numpy() for c in names]
        cols.append(np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint64).reshape(-1, BITS // 64))
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        if not len(cols[0]):
            continue
        cut = np.flatnonzero(np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in cols[:3]])])
        yield out([edges(cols, a, b) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True) if b - a > 1])
        held = [c[cut[-1] :] for c in cols]
    if held is not None and len(held[0]) > 1:
        yield out([edges(held, 0, len(held[0]))])


def together(classes: DataFrame, close: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """(node, root): sets that the pigeonhole search connects with others."""
    of = [close(classes.select(F.col("fp").alias("name"), F.col("marks")[i].alias("fp")), REACH) for i in range(FINGERPRINTS)]
    return stage(components(reduce(DataFrame.unionByName, of)), "together")


def candidates(docs: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """Edges (u, v) that connect the sets that candidate pairs connect, save those that
    ``found`` (node, root) has together."""
    near = stage(groups(docs), "near-groups")
    met, by = cells(near, ["gid"], "fp", GROUP_BLOCK)
    rooted = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "n", F.coalesce("root", "fp").alias("root"), "sketch")
    rows = met.join(rooted, "fp").select(*by, "fp", "n", "root", "sketch")
    edges = stage(rows.repartition(partitions(docs.sparkSession), *by).sortWithinPartitions(*by).mapInArrow(_meet, "u long, v long").distinct(), "candidates")
    unstage(near)
    return edges


def forest(fps: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges that connect all sets that links connect: each is visited once and compared
    with those that aren't visited yet."""
    num, den = LEAST
    ids = np.unique(flat, return_inverse=True)[1]
    own = np.split(ids, np.cumsum(sizes)[:-1])
    mark = np.zeros(len(ids) + 1, bool)
    rest = np.arange(len(fps))  # those still compared with, and their shingles
    values, starts = ids, np.cumsum(sizes) - sizes
    alive = np.ones(len(fps), bool)
    us, vs = [], []
    for root in range(len(fps)):
        if not alive[root]:
            continue
        alive[root], queue = False, [root]
        while queue:
            x = queue.pop()
            if 2 * alive[rest].sum() < len(rest):
                rest = rest[alive[rest]]
                if not len(rest):
                    return us, vs
                values = np.concatenate([own[i] for i in rest])
                starts = np.cumsum(sizes[rest]) - sizes[rest]
            mark[own[x]] = True
            both = np.add.reduceat(mark[values], starts, dtype=np.int64)
            mark[own[x]] = False
            found = rest[alive[rest] & (den * both >= num * (sizes[rest] + sizes[x] - both))]
            alive[found] = False
            us += [int(fps[x])] * len(found)
            vs += fps[found].tolist()
            queue += found.tolist()
    return us, vs


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (root, a, b, fp, text) sorted by cell -> the edges of links."""
    cell, held = None, {}

    def close() -> Iterator[pa.RecordBatch]:
        if len(held) > 1:
            made = list(held.values())
            us, vs = forest(np.array(list(held), np.int64), np.concatenate(made), np.array([len(s) for s in made], np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    for b in batches:
        for at in range(0, b.num_rows, 500):
            part = b.slice(at, 500)
            for *where, fp, text in zip(*(part.column(n).to_pylist() for n in ("root", "a", "b", "fp", "text")), strict=True):
                if where != cell:
                    yield from close()
                    cell, held = where, {}
                if fp not in held and len(s := shingles(text)):
                    held[fp] = s
    yield from close()


def bitmap(rids: DataFrame) -> np.ndarray:
    """1 << FILTER_BITS bits, of which those of the rids' hashes are set."""
    bit = F.shiftrightunsigned(F.xxhash64("rid"), 64 - FILTER_BITS)
    got = rids.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))).alias("bits")).toArrow()
    out = np.zeros(1 << FILTER_BITS - 6, np.int64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return out.view(np.uint64)


def once(docs: DataFrame, rids: DataFrame) -> DataFrame:
    """The rows of docs(rid, text) whose rid may be among ``rids``; a rid once in each task, so
    that no mass of equal rows is dealt.  The filter is a bitmap of one fixed size: it lets all
    rids through that are wanted, and the fuller it is the more others."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(rids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            bit = b.column("bit").to_numpy()
            may = np.flatnonzero(shared.value[bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1))
            fresh = []
            for i, r in zip(may.tolist(), b.column("rid").take(pa.array(may)).to_pylist(), strict=True):
                if r not in seen:
                    seen.add(r)
                    fresh.append(i)
            yield b.take(pa.array(fresh, pa.int32())).select(["rid", "text"])

    marked = docs.select("rid", "text", F.shiftrightunsigned(F.xxhash64("rid"), 64 - FILTER_BITS).alias("bit"))
    return marked.mapInArrow(run, docs.select("rid", "text").schema)


def links(docs: DataFrame, classes: DataFrame, close: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """docs(rid, text), classes(fp, rid, n, sketch, marks) -> edges (u, v) of fp that connect
    exactly what links connect."""
    found = together(classes, close)
    near = candidates(docs, classes, found)
    roots = components(near.unionByName(found.select(F.col("node").alias("u"), F.col("root").alias("v"))))
    unstage(found)
    sized = stage(roots.distinct().join(classes.select(F.col("fp").alias("node"), "rid", "n"), "node"), "candidate-roots")
    unstage(near)
    wide = sized.groupBy("root").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / F.lit(SHINGLE_BLOCK))).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), "blocks").cast("int")
    met = sized.join(wide, "root").select("root", "node", "rid", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = met.select("root", F.col("node").alias("fp"), "rid", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))
    by = ["root", "a", "b"]
    dealt = once(docs, sized).join(met, "rid").select(*by, "fp", "text")
    dealt = dealt.repartition(partitions(docs.sparkSession), *by).sortWithinPartitions(*by, "fp")
    return dealt.mapInArrow(_verify, "u long, v long")


def keep_one(docs: DataFrame, close: Callable[[DataFrame, int], DataFrame], text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``close`` is simhash's: names and fingerprints -> edges.  One row of each component of linked texts: that of its least doc_id (null comes last),
    then of the least MD5 of doc_id and text.  Of rows that are equal in both, the one with
    the least hash of all its columns stays.  Columns come back unchanged, whatever their
    names; an empty table gives an empty result."""
    # 128 bits of id and text: rows that share it are repeats
    rid = F.md5(F.concat_ws(":", F.col(doc_id).isNull().cast("string"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.col(text).isNull().cast("string"), F.coalesce(F.col(text), F.lit(""))))
    slim = docs.select(F.col(doc_id).alias("doc_id"), rid.alias("rid"), F.col(text).alias("text"))
    marked = stage(classes_of(slim), "sets")
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid"))
    classes = stage(marked.groupBy("fp").agg(rep.alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("marks").alias("marks")).select("fp", "rep", F.col("rep.rid").alias("rid"), "n", "sketch", "marks"), "classes")
    repeated = stage(marked.groupBy("rid").agg(F.count("*").alias("times")).where("times > 1").select("rid"), "repeated")
    edges = stage(links(slim, classes, close), "links")
    roots = components(edges)
    rooted = classes.select("fp", "rep").join(roots, F.col("fp") == F.col("node"), "left")
    best = stage(rooted.groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("rep").alias("rep")).select(F.col("rep.rid").alias("rid")), "kept")
    unstage(edges, classes, marked)
    rows = docs.select(row_of(docs.columns), rid.alias("rid")).join(best, "rid")
    if not repeated.isEmpty():
        many = rows.join(repeated, "rid", "left_semi")
        one = many.groupBy("rid").agg(F.min_by(ROW, F.xxhash64(F.to_json(ROW))).alias(ROW)).select(ROW, "rid")
        rows = rows.join(repeated, "rid", "left_anti").select(ROW, "rid").unionByName(one)
    return unfolded(rows, docs.columns, [])
