"""Spelling variants: words that are one insertion, deletion or replacement apart, grouped by forms.

Runs of Latin letters (A-Z, a-z, U+00C0 to U+00FF) are lower-cased in A-Z only.  So that variants
exist, a run whose CRC32 with its document's id is divisible by NOISE loses one code point.  What
then has LEAST code points and occurs twice in all is a word.

1. Words are counted in the tasks first, then by one shuffle.
2. They are sorted into ranges, and each range becomes compact tries of at most SHARD bytes of
   words: a node's edge holds all characters up to the next branch, so a trie has at most
   twice as many nodes as words.
3. The tries are broadcast in passes of at most PASS bytes, and each task walks its words, in
   order, through each trie depth-first.  The states of a word's distance-one automaton are the
   place that the word itself leads to, and the places one edit away; words with a common
   prefix share the states after it, and a prefix without states ends the walk for all of them.
4. A trie's neighbours of a word are reduced to their number and the best one; the tries' results
   meet by one more shuffle.
5. A word's form is its commonest neighbour, if that is ``ratio`` times as common (2 or more).
   Along forms counts grow by that factor, so a chain has fewer than 64 steps, and six
   rounds of joins, each of which doubles the step, reach every root.

A word longer than SHARD makes a trie of its own; SHARD, PASS and the longest word bound what a
task holds.  Nothing is capped: all words are tried against all tries.

Null text has no words; a null doc_id counts as an empty string before the colon.  Long texts
are read whole, one at a time.  Repeated rows count as often as they come.  Equal counts (ties)
give the form that is smallest in code-point order.  An empty table gives an empty result.
Only the id and the text are read, whatever other columns there are.
"""

from __future__ import annotations

import pickle
import re
import zlib
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts_for, quoted, read, stage, unstage

NOISE, LEAST = 31, 7
RUN = re.compile(rf"[A-Za-z\xc0-\xff]{{{LEAST},}}")
LOWER = {c: c + 32 for c in range(65, 91)}
#: Bytes of a trie's words, and of the tries that are broadcast at once.
SHARD, PASS = 4 << 20, 32 << 20
#: Of the words that a task counts before it hands them on: how many, and their characters.
HELD, HELD_CHARS = 200_000, 8 << 20
#: Words that one task walks through the tries.
WALKED = 20_000


def lowered(run: str) -> str:
    return run.lower() if run.isascii() else run.translate(LOWER)


def variant(doc_id: object, run: str) -> str:
    """The run, or what is left of it without one code point."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % NOISE:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): the words of at least LEAST code points that occur twice or more."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        chars = 0

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return made

        for b in batches:
            for i in range(b.num_rows):
                k = b.column("doc_id")[i].as_py()
                # shorter runs can't give words
                for run, n in Counter(RUN.findall(b.column("text")[i].as_py() or "")).items():
                    w = variant(k, lowered(run))
                    if len(w) >= LEAST:
                        chars += 0 if w in held else len(w)
                        held[w] += n
                if len(held) >= HELD or chars >= HELD_CHARS:
                    yield out()
                    chars = 0
        yield out()

    own = docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(text)).alias("text"))
    return own.mapInArrow(work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")


#: A place in a trie: a node, and where its edge is left to read.
Place = tuple[int, int]


class Trie:
    """Words in order, end to end in ``text``.  Node i has the edge text[start[i]:stop[i]] above
    it, which begins with firsts[i], the word own[i] that ends there (-1: none), and the children
    child[i] to child[i + 1] - 1."""

    def __init__(self, known: list[tuple[str, int]]):
        words = [w for w, _ in known]
        self.text, self.n = "".join(words), array("q", (n for _, n in known))
        self.at = array("q", accumulate(map(len, words), initial=0))
        self.start, self.stop, self.own, self.child = array("q", [0]), array("q", [0]), array("i"), array("i")
        # words low to high - 1 share their first ``depth`` characters
        queue = [(0, len(words), 0)]
        for low, high, depth in queue:
            self.child.append(len(queue))
            ends = low < high and len(words[low]) == depth
            self.own.append(low if ends else -1)
            low += ends
            while low < high:
                first, end = words[low][depth], low + 1
                while end < high and words[end][depth] == first:
                    end += 1
                # what the first and the last of a run share, all of it do
                to = depth + agree(words[low], words[end - 1], depth)
                self.start.append(self.at[low] + depth)
                self.stop.append(self.at[low] + to)
                queue.append((low, end, to))
                low = end
        self.child.append(len(queue))
        self.firsts = "." + "".join(self.text[a] for a in self.start[1:])

    def word(self, node: int) -> str:
        k = self.own[node]
        return self.text[self.at[k] : self.at[k + 1]]

    def on(self, places: list[Place], c: str) -> list[Place]:
        """Where ``c`` leads from these places."""
        text, stop, child, start, find, out = self.text, self.stop, self.child, self.start, self.firsts.find, []
        for node, at in places:
            if at < stop[node]:
                if text[at] == c:
                    out.append((node, at + 1))
            elif (k := find(c, child[node], child[node + 1])) >= 0:
                out.append((k, start[k] + 1))
        return out

    def others(self, place: Place, c: str) -> list[Place]:
        """Where all other characters lead."""
        node, at = place
        if at < self.stop[node]:
            return [(node, at + 1)] if self.text[at] != c else []
        return [(k, self.start[k] + 1) for k in range(self.child[node], self.child[node + 1]) if self.firsts[k] != c]

    def near(self, words: list[str]) -> Iterator[tuple[int, set[int]]]:
        """(i, nodes of the words at distance one from words[i]); the words are in order."""
        # after each character: the place that the word leads to, the places one edit away
        states: list[tuple[list[Place], list[Place]]] = [([(0, 0)], [])]
        i, last = 0, ""
        while i < len(words):
            word = words[i]
            depth = agree(last, word, 0)
            del states[depth + 1 :]
            last = word
            for c in word[depth:]:
                own, edited = states[-1]
                edited = self.on(edited, c)
                if own:
                    replaced = self.others(own[0], c)
                    # the other two: a character of the trie's before c, and c itself left out
                    edited = [*edited, *replaced, *self.on(replaced, c), *own]
                    own = self.on(own, c)
                if not own and not edited:
                    break
                states.append((own, edited))
            if len(states) <= len(word):
                # no word with this prefix has a neighbour here
                last = word[: len(states)]
                i = bisect_left(words, True, i + 1, key=lambda w, p=last: not w.startswith(p))
                last = last[:-1]
                continue
            own, edited = states[-1]
            ends = [*edited, *(p for o in own for p in self.others(o, ""))]
            if found := {node for node, at in ends if at == self.stop[node] and self.own[node] >= 0}:
                yield i, found
            i += 1


def agree(a: str, b: str, depth: int) -> int:
    """How many characters from ``depth`` on two words share, which share those before."""
    low, most = 0, min(len(a), len(b)) - depth
    if a[depth : depth + most] == b[depth : depth + most]:
        return most
    while most - low > 1:
        mid = (low + most) // 2
        low, most = (mid, most) if a[depth + low : depth + mid] == b[depth + low : depth + mid] else (low, mid)
    return low


def tries(known: DataFrame, size: int) -> DataFrame:
    """known(word, n) -> (data, size): pickled tries of at most SHARD bytes of words, or one word."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def out() -> pa.RecordBatch:
            data = pickle.dumps(Trie(held), 5)
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary()), pa.array([len(data)], pa.int64())], names=["data", "size"])

        for b in batches:
            for w, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist(), strict=True):
                if held and total + len(w.encode()) > SHARD:
                    yield out()
                    held, total = [], 0
                held.append((w, n))
                total += len(w.encode())
        if held:
            yield out()

    ranges = known.repartitionByRange(max(1, -(-size // SHARD)), "word").sortWithinPartitions("word")
    return ranges.mapInArrow(work, "data binary, size long")


def neighbours(known: DataFrame, shards: list[bytes]) -> DataFrame:
    """(word, n, n_near, form_n, form): of the words in these pickled tries, how many are near, and
    the commonest of them.  The words come in order."""
    shared = known.sparkSession.sparkContext.broadcast(shards)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [pickle.loads(x) for x in shared.value]
        for b in batches:
            words = b.column("word").to_pylist()
            count, most, form = [0] * len(words), [0] * len(words), [None] * len(words)
            for t in own:
                for i, nodes in t.near(words):
                    count[i] += len(nodes)
                    n, best = min((-t.n[t.own[x]], t.word(x)) for x in nodes)
                    if form[i] is None or (n, best) < (-most[i], form[i]):
                        most[i], form[i] = -n, best
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("n"), pa.array(count, pa.int64()), pa.array(most, pa.int64()), pa.array(form, pa.string())], names=["word", "n", "n_near", "form_n", "form"])

    return known.select("word", "n").mapInArrow(work, "word string, n long, n_near long, form_n long, form string")


def roots(links: DataFrame) -> DataFrame:
    """links(word, form) -> (word, root): the last of the forms."""
    now = stage(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = stage(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        unstage(now)
        now = new
        if now.where("moved").isEmpty():
            return now.select("word", "root")


def grouped(docs: DataFrame, ratio: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n)"""
    spark = docs.sparkSession
    known = stage(words(docs, doc_id, text), "words")
    size = known.agg(F.count("*"), F.sum(F.octet_length("word"))).first()
    made = stage(tries(known, size[1] or 0).withColumn("id", F.monotonically_increasing_id()), "tries")
    sizes = [(r["id"], r["size"]) for r in made.select("id", "size").collect()]  # one for each SHARD bytes
    passes: list[list[int]] = [[]]
    total = 0
    for k, n in sizes:
        if passes[-1] and total + n > PASS:
            passes.append([])
            total = 0
        passes[-1].append(k)
        total += n
    dealt = known.repartitionByRange(parts_for(spark, size[0], WALKED), "word").sortWithinPartitions("word")
    found = None
    for ids in passes:
        shards = [bytes(r["data"]) for r in made.where(F.col("id").isin(ids)).select("data").collect()]
        part = stage(neighbours(dealt, shards), "near")
        found = part if found is None else found.unionByName(part)
    unstage(made)
    near = found.groupBy("word").agg(F.first("n").alias("n"), F.sum("n_near").alias("n_near"), F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("minus"), "form"))).alias("b"))
    fits = -F.col("b.minus") >= ratio * F.col("n")
    near = stage(near.select("word", "n", "n_near", F.when(fits, F.col("b.form")).alias("form"), F.when(fits, -F.col("b.minus")).alias("form_n")), "forms")
    last = roots(near.where("form is not null"))
    return near.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(read(spark, sf_dir, "documents"))


_RUNS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00c0-\u00ff]{%d,}')" % LEAST
#: CRC32 by its table: what eight shifts make of each byte.
SQL = f"""WITH RECURSIVE tab AS (SELECT list(list_reduce(range(0, 8), lambda c, k : CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, b) ORDER BY b) AS t FROM range(0, 256) r(b)),
o AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest({_RUNS}) AS run FROM documents) GROUP BY ALL),
b AS (SELECT *, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS h FROM o),
c AS (SELECT run, n, xor(list_reduce(list_transform(range(0, length(h) // 2), lambda i : ('0x' || substr(h, 2 * i::INT + 1, 2))::BIGINT), lambda c, x : xor(t[(xor(c, x) & 255) + 1], c >> 8), 4294967295), 4294967295) AS h FROM b, tab),
v AS (SELECT CASE WHEN h % {NOISE} = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM c),
w AS (SELECT word, sum(n)::BIGINT AS n FROM v WHERE length(word) >= {LEAST} GROUP BY word HAVING sum(n) > 1),
d AS (SELECT word, i, left(word, i::INT) || substr(word, i::INT + 2) AS rest FROM (SELECT word, unnest(range(0, length(word))) AS i FROM w)),
near AS (SELECT x.word, y.word AS other FROM d x JOIN d y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word
  UNION SELECT d.word, w.word FROM d JOIN w ON d.rest = w.word UNION SELECT w.word, d.word FROM d JOIN w ON d.rest = w.word),
k AS (SELECT near.word, other, o.n, row_number() OVER (PARTITION BY near.word ORDER BY o.n DESC, other) AS place, count(*) OVER (PARTITION BY near.word) AS n_near FROM near JOIN w o ON o.word = other),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN k.n >= 10 * w.n THEN other END AS form, CASE WHEN k.n >= 10 * w.n THEN k.n END AS form_n FROM w LEFT JOIN k ON k.word = w.word AND place = 1),
r AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT r.word, f.word, f.form FROM r JOIN f ON f.word = r.next)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM f JOIN r ON r.word = f.word AND r.next IS NULL"""
