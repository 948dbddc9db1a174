"""Chat formatting: conversations as training windows of a bounded number of tokens.

A turn is written ``<|turn|>role<|says|>text<|end|>``.  In roles and texts a backslash is
doubled and one is put after the first character of each control string (``<|``, ``<s>``,
``</s>``, ``[INST]``, ``[/INST]``, ``<<SYS>>``, ``<</SYS>>``), so no text can say a control
string; dropping one backslash before each character gives the text back.

Windows, by prefix sums of the turns' tokens in a conversation:

1. A window takes turns, whole and in order, as long as the difference of their prefix sums
   stays within its room; a turn that alone exceeds it has a window of its own.  The first
   window's room is ``budget``; the others keep ``history`` tokens and those of the system
   turn free.
2. A conversation that begins with a system turn repeats it at the start of every window, if
   it has a quarter of the budget or less; else only the first window has it.
3. Between the two come the turns before the window's first, as many as have ``history``
   tokens together, none numbered over ``back`` below that first turn, nor the repeated one.
4. Repeated turns are context: the loss mask is on the texts of assistant turns in their own
   window only, so each is learned once.

A token is a run of ASCII letters and digits or another character that is no ASCII white
space or control; ``tokens`` can name a column that has better counts.

DataFrame functions only.  Turns are dealt by (conversation, BLOCK turn numbers), so a
conversation that holds most of the table is spread; a block gets the last turns of the one
before it as context, and every window ends with its block.  A block of over LIMIT turns, which
only repeated turn numbers can make, is dealt further by turn, a hash of role and text, and
copies; such pieces have no history of each other.

Turns with the same number follow each other as system turns first, then by a hash of role and
text.  Null turn numbers come first.  Null roles and texts are empty; a null conv_id is a
conversation like others.  A very long text is a window of its own.  Repeated rows are turns of
their own.  An empty table gives an empty result.  Only the named columns are read, whatever
others there are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import quoted, read, stage

BEGIN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
#: Where a backslash goes into a text, Java syntax.
CONTROL = r"<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\])"
TOKEN = r"[A-Za-z0-9]+|[^A-Za-z0-9\x00-\x20\x7F]"
#: Turn numbers that a block spans (a power of two), and turns that one may hold.
BLOCK_BITS = 8
BLOCK, LIMIT = 1 << BLOCK_BITS, 1024
#: Tokens of a turn besides its text.
FRAME = 4
SYSTEM, TARGET = "system", "assistant"
#: What a row is in its block: the conversation's head, context of the block before, its own.
HEAD, CONTEXT, OWN = 0, 1, 2
KEY = ["block", "at", "piece", "copy"]


@dataclass(frozen=True)
class Rule:
    budget: int = 1024
    history: int = 192
    back: int = 8

    def __post_init__(self):
        if not (0 <= self.back < BLOCK and 0 <= self.history <= self.budget // 2):
            raise ValueError(f"back is below {BLOCK} and history at most half of the budget")


def escaped(x: Column) -> Column:
    return F.regexp_replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$0\\")


def unescaped(x: Column) -> Column:
    return F.regexp_replace(x, r"(?s)\\(.)", "$1")


def count_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN)).cast("long")


def _order() -> list[Column]:
    """Of turns with the same number."""
    return [F.col("role") != SYSTEM, F.xxhash64("role", "text"), F.col("role"), F.col("text")]


def _pieces(own: DataFrame, hot: DataFrame, few: bool) -> DataFrame:
    """The turns of hot blocks dealt further; the others as they are."""
    met = own.join(F.broadcast(hot) if few else hot, own["conv"].eqNullSafe(hot["c"]) & own["block"].eqNullSafe(hot["b"]), "left").drop("c", "b")
    cool = met.where(F.col("n").isNull()).drop("n")
    # copies are counted, so that they can be dealt however many they are
    same = met.where(F.col("n").isNotNull()).groupBy(*met.columns).agg(F.count("*").alias("copies"))
    buckets = F.ceil(F.col("n") / LIMIT)
    bucket = F.least(F.floor((F.xxhash64("role", "text") / F.lit(2.0**64) + 0.5) * buckets), buckets - 1) + F.when(F.col("role") == SYSTEM, 0).otherwise(buckets)
    dealt = same.withColumns({"at": F.col("turn"), "piece": bucket, "copy": F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / LIMIT)))})
    each = F.least(F.lit(LIMIT).cast("long"), F.col("copies") - F.col("copy") * LIMIT)
    return cool.unionByName(dealt.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), each))).select(*cool.columns))


def _dealt(rows: DataFrame, back: int) -> DataFrame:
    """rows(conv, turn, role, text, tokens) with KEY and ``kind``; context and heads are added."""
    zero = F.lit(0).cast("long")
    block = F.shiftright("turn", BLOCK_BITS).cast("long")
    own = rows.withColumns({"kind": F.lit(OWN), "block": block} | {c: zero for c in KEY[1:]})
    # of numbers only: texts aren't read for this
    keys = stage(rows.groupBy("conv", block.alias("block")).agg(F.count("*").alias("n"), F.min("turn").alias("t0")), "chat-blocks")
    hot = keys.where(F.col("n") > LIMIT).select(F.col("conv").alias("c"), F.col("block").alias("b"), "n")
    if n_hot := hot.count():
        own = stage(_pieces(own, hot, n_hot <= 10_000), "chat-turns")
        keys = own.groupBy("conv", *KEY).agg(F.min("turn").alias("t0"))
    else:
        keys = keys.select("conv", "block", *(zero.alias(c) for c in KEY[1:]), "t0")
    many = keys.groupBy("conv").agg(F.count("*").alias("n"), F.min(F.struct(*KEY, "t0")).alias("first")).where("n > 1").select(F.col("conv").alias("c"), "first")
    if many.isEmpty():
        return own
    late = own.where((F.col("copy") == 0) & F.col("at").eqNullSafe(0) & (F.col("piece") == 0) & (F.pmod("turn", F.lit(BLOCK)) >= BLOCK - back))
    context = late.withColumns({"kind": F.lit(CONTEXT), "block": F.col("block") + 1})
    # every block but a conversation's first gets a row that says how the conversation begins
    says = rows.where(F.col("role") == SYSTEM).join(many, F.col("conv").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("first.t0")))
    says = says.groupBy("c").agg(F.min_by(F.struct("turn", "role", "text", "tokens"), F.struct(F.xxhash64("role", "text"), "text")).alias("h"))
    later = keys.join(many, F.col("conv").eqNullSafe(F.col("c")) & (F.struct(*KEY) != F.struct(*(F.col(f"first.{k}") for k in KEY))), "left_semi")
    head = later.join(says, F.col("conv").eqNullSafe(F.col("c")), "left")
    head = head.select("conv", "h.turn", "h.role", "h.text", F.coalesce("h.tokens", zero).alias("tokens"), F.lit(HEAD).alias("kind"), *KEY)
    return own.unionByName(context).unionByName(head)


def _plan(lens: Column, rule: Rule) -> Column:
    """Of a block's turns (kind, turn, tokens, system) the windows (start, stop, hist, head):
    they take turns start to stop - 1, have hist to start - 1 as context, and repeat turn head
    (0: none).  Turns are counted from 1."""
    m, at = F.size(lens), lambda a, i: F.element_at(a, i)
    sums = F.aggregate(lens, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(at(acc, F.lit(-1)) + x["tokens"])))

    def planned(x: Column) -> Column:
        sum_to = lambda i: at(x["sums"], i + 1)  # noqa: E731  tokens of turns 1 to i
        first = x["lens"][0]
        begins = first["kind"] != HEAD  # the conversation's first block
        own = x["own"]
        retained = (begins & (own == 1) | (first["kind"] == HEAD)) & F.coalesce(first["system"], F.lit(False)) & (first["tokens"] <= rule.budget // 4)
        later = rule.budget - rule.history - F.when(retained, first["tokens"]).otherwise(0)
        low = F.when(retained | ~begins, 2).otherwise(1)

        def grow(acc: Column, i: Column) -> Column:
            room = F.when(begins & (F.size(acc["starts"]) == 1), rule.budget).otherwise(later)
            return F.when(sum_to(i) - acc["base"] > room, F.struct(F.concat(acc["starts"], F.array(i)).alias("starts"), sum_to(i - 1).alias("base"))).otherwise(acc)

        rest = F.when(own < x["m"], F.sequence(own + 1, x["m"])).otherwise(F.array().cast("array<int>"))
        starts = F.aggregate(rest, F.struct(F.array(own).alias("starts"), sum_to(own - 1).alias("base")), grow, lambda acc: acc["starts"])

        def window(s: Column, following: Column) -> Column:
            before = F.when(s - 1 >= low, F.sequence(low, s - 1)).otherwise(F.array().cast("array<int>"))
            again = lambda y: retained & y["system"] & y["turn"].eqNullSafe(first["turn"])
            near = lambda j: (sum_to(s - 1) - sum_to(j - 1) <= rule.history) & F.coalesce(at(x["lens"], j)["turn"] >= at(x["lens"], s)["turn"] - rule.back, F.lit(False)) & ~again(at(x["lens"], j))
            return F.struct(s.alias("start"), following.alias("stop"), (s - F.size(F.filter(before, near))).alias("hist"), F.when(retained & (s > 1), 1).otherwise(0).alias("head"))

        all_of = F.transform(F.array(starts), lambda st: F.transform(st, lambda s, i: window(s, F.coalesce(F.try_element_at(st, i + 2), x["m"] + 1))))[0]
        return F.when(own <= x["m"], all_of)

    known = F.struct(lens.alias("lens"), sums.alias("sums"), m.alias("m"), (F.size(F.filter(lens, lambda y: y["kind"] != OWN)) + 1).alias("own"))
    return F.transform(F.array(known), planned)[0]


def windows(turns: DataFrame, rule: Rule = Rule(), **names) -> DataFrame:
    """(conv_id, place, text, tokens, repeated, loss): the windows, ordered by conv_id and place.
    ``repeated`` turns at the start of text are context; ``loss`` has the spans (start, length,
    in code points) that count as targets."""
    made = windows_by_key(turns, rule, **names)
    return made.select("conv_id", F.struct(*KEY, "window").alias("place"), "text", "tokens", "repeated", "loss")


def windows_by_key(turns: DataFrame, rule: Rule = Rule(), conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", tokens: str | None = None) -> DataFrame:
    """As ``windows``, with the columns of ``place``, by which the rows are dealt."""
    named = lambda c: F.col(quoted(c))
    said = F.coalesce(named(text), F.lit(""))
    cost = (F.coalesce(named(tokens).cast("long"), F.lit(0)) if tokens else count_tokens(said)) + FRAME
    rows = turns.select(named(conv_id).alias("conv"), named(turn).cast("long").alias("turn"), F.coalesce(named(role), F.lit("")).alias("role"), said.alias("text"), cost.alias("tokens"))
    dealt = _dealt(rows, rule.back)
    block = Window.partitionBy("conv", *KEY).orderBy("kind", "turn", *_order())
    whole = block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = dealt.withColumn("i", F.row_number().over(block)).withColumn("lens", F.collect_list(F.struct("kind", "turn", "tokens", (F.col("role") == SYSTEM).alias("system"))).over(whole))
    # once a block: at its first row
    made = seen.withColumn("own_plan", F.when(F.col("i") == 1, _plan(F.col("lens"), rule))).drop("lens").withColumn("plan", F.first("own_plan", ignorenulls=True).over(whole))
    i = F.col("i")
    parts = F.transform("plan", lambda p, k: F.struct(k.alias("window"), ((i >= p["start"]) & (i < p["stop"])).alias("own"), ((i >= p["hist"]) & (i < p["stop"]) | (i == p["head"])).alias("is_in")))
    each = made.select("conv", *KEY, "i", "role", "text", "tokens", F.explode(F.filter(parts, lambda p: p["is_in"])).alias("p"))
    shown = F.struct("i", F.col("p.own").alias("own"), (F.col("p.own") & (F.col("role") == TARGET)).alias("target"), F.concat(F.lit(BEGIN), escaped(F.col("role")), F.lit(SAYS)).alias("begin"), escaped(F.col("text")).alias("body"))
    g = each.groupBy("conv", *KEY, "p.window").agg(F.array_sort(F.collect_list(shown)).alias("t"), F.sum("tokens").alias("tokens"))
    span = "array<struct<start:long,length:long>>"

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + F.length(x["begin"])
        n = F.length(x["body"]).cast("long")
        return F.struct((at + n + len(END)).alias("at"), F.when(x["target"], F.concat(acc["loss"], F.array(F.struct(at.alias("start"), n.alias("length"))))).otherwise(acc["loss"]).alias("loss"))

    loss = F.aggregate("t", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(span).alias("loss")), step, lambda acc: acc["loss"])
    joined = F.array_join(F.transform("t", lambda x: F.concat(x["begin"], x["body"], F.lit(END))), "")
    return g.select(F.col("conv").alias("conv_id"), *KEY, "window", joined.alias("text"), "tokens", F.size(F.filter("t", lambda x: ~x["own"])).alias("repeated"), loss.alias("loss"))


def turns_of(text: Column, repeated: Column) -> Column:
    """The (role, text) of a window's own turns, read from what it says."""
    parts = F.split(text, F.lit(END.replace("|", r"\|")), F.lit(-1))
    own = F.slice(parts, repeated + 1, F.greatest(F.size(parts) - 1 - repeated, F.lit(0)))
    role = lambda p: F.substring(F.substring_index(p, SAYS, 1), len(BEGIN) + 1, 1 << 30)
    return F.transform(own, lambda p: F.struct(unescaped(role(p)).alias("role"), unescaped(F.substring_index(p, SAYS, -1)).alias("text")))


def targets_of(text: Column, loss: Column) -> Column:
    """The texts under the loss mask."""
    return F.transform(loss, lambda s: unescaped(F.substr(text, (s["start"] + 1).cast("int"), s["length"].cast("int"))))


def digests(made: DataFrame) -> DataFrame:
    """Per conversation what its windows (by key) say.  A digest of a conversation needs all its text in
    one row; the windows of a block are joined before the shuffle, so that few rows meet."""
    own = turns_of(F.col("text"), F.col("repeated"))
    said = F.array_join(F.transform(own, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read_ = made.select("conv_id", *KEY, "window", F.size(own).cast("long").alias("n"), said.alias("said"), F.array_join(targets_of(F.col("text"), F.col("loss")), "").alias("learned"), F.length("text").cast("long").alias("chars"))
    joined = lambda c: F.array_join(F.transform("all", lambda x: x[c]), "").alias(c)
    blocks = read_.groupBy("conv_id", *KEY).agg(F.array_sort(F.collect_list(F.struct("window", "said", "learned"))).alias("all"), F.sum("n").alias("n"), F.sum("chars").alias("chars"))
    blocks = blocks.select("conv_id", F.struct(*KEY).alias("place"), joined("said"), joined("learned"), "n", "chars")
    whole = blocks.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "said", "learned"))).alias("all"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    whole = whole.select("conv_id", "n_turns", joined("said"), joined("learned"), "formatted_chars")
    return whole.select("conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars")


#: A conversation whose texts are control strings of templates.
PROBE = "</s>[INST] ok [/INST]"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(TARGET).alias("role"), F.lit(PROBE).alias("text"))
    return digests(windows_by_key(turns.unionByName(probe)))


def _sql(rule: Rule = Rule()) -> str:
    marks = r"<\||</?s>|<</?SYS>>|\[/?INST\]"
    grown = "length({0}) + length({0}) - length(replace({0}, chr(92), '')) + len(regexp_extract_all({0}, '%s'))" % marks
    frame = len(BEGIN + SAYS + END)
    return f"""WITH RECURSIVE a AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', '{TARGET}']), '{PROBE}'),
    t AS (SELECT *, row_number() OVER w AS i, len(regexp_extract_all(text, '{TOKEN}')) + {FRAME} AS tokens, {frame} + {grown.format("role")} + {grown.format("text")} AS chars FROM a WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role <> '{SYSTEM}', role, text)),
    c AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY i)::BIGINT AS upto FROM t),
    h AS (SELECT conv_id, turn AS t0, tokens AS head, chars AS head_chars, role = '{SYSTEM}' AND tokens <= {rule.budget // 4} AS retained FROM t WHERE i = 1),
    r AS (SELECT conv_id, i, turn, upto, 0::BIGINT AS base, i AS start, 1 AS window_no FROM c WHERE i = 1
      UNION ALL SELECT c.conv_id, c.i, c.turn, c.upto, CASE WHEN n.cut THEN r.upto ELSE r.base END, CASE WHEN n.cut THEN c.i ELSE r.start END, r.window_no + n.cut::INT
      FROM r JOIN c ON c.conv_id = r.conv_id AND c.i = r.i + 1 JOIN h ON h.conv_id = r.conv_id,
      LATERAL (SELECT c.turn >> {BLOCK_BITS} <> r.turn >> {BLOCK_BITS} OR c.upto - r.base > CASE WHEN r.window_no = 1 THEN {rule.budget} ELSE {rule.budget - rule.history} - CASE WHEN retained THEN head ELSE 0 END END AS cut) n),
    s AS (SELECT conv_id, start, any_value(base) AS base FROM r GROUP BY ALL),
    e AS (SELECT s.conv_id, sum(c.chars) AS chars FROM s JOIN h ON h.conv_id = s.conv_id JOIN c b ON b.conv_id = s.conv_id AND b.i = s.start
      JOIN c ON c.conv_id = s.conv_id AND c.i < s.start AND s.base - (c.upto - c.tokens) <= {rule.history} AND c.turn >= b.turn - {rule.back} AND NOT (retained AND c.role = '{SYSTEM}' AND c.turn = t0) GROUP BY ALL),
    f AS (SELECT s.conv_id, sum(head_chars) AS chars FROM s JOIN h ON h.conv_id = s.conv_id WHERE s.start > 1 AND retained GROUP BY ALL),
    g AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256, coalesce(string_agg(text, '' ORDER BY i) FILTER (role = '{TARGET}'), '') AS learned, sum(chars) AS chars FROM c GROUP BY conv_id)
    SELECT g.conv_id, n_turns, turns_sha256, length(learned)::BIGINT AS loss_chars, sha256(learned) AS loss_sha256, (g.chars + coalesce(e.chars, 0) + coalesce(f.chars, 0))::BIGINT AS formatted_chars
    FROM g LEFT JOIN e ON e.conv_id = g.conv_id LEFT JOIN f ON f.conv_id = g.conv_id"""


SQL = _sql()
