"""Quality rules with a bitmask ledger.

Each rule is evaluated once for each text.  The ledger keeps the measurements
and one failure bit a rule; a policy is a named set of rules and so a bit mask.
Policies are applied, compared and ablated on the bits alone, without reading
the texts again.  DataFrame functions only.

Words are ``[^\\x20\\x09-\\x0D]+``.  Null and empty texts have no words: they fail
``few_words``.  Very long texts are measured whole, in time that grows with n log n.
Repeated rows are judged like any other; an empty table gives an empty ledger.  A caller's
columns come back unchanged, whatever their names: a column of the ledger whose name is
taken is named with an underscore after it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW, WORD, let, read, row_of, unfolded

SPAN = 8

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper")


def _repeat_words(hashes: Column) -> Column:
    """hashes: one long for each window, in text order.  Words in windows that occur twice or more."""

    def covered(sorted_: Column) -> Column:
        n = F.size(sorted_)
        same = F.transform(
            sorted_,
            lambda x, i: F.when(
                ((i > 0) & (sorted_[F.greatest(i - 1, F.lit(0))]["h"] == x["h"]))
                | ((i < n - 1) & (sorted_[F.least(i + 1, n - 1)]["h"] == x["h"])),
                x["i"],
            ),
        )
        starts = F.sort_array(F.array_compact(same))
        # neighbours that overlap count their common words once
        return let(
            starts,
            lambda s: F.aggregate(
                F.zip_with(F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(SPAN))),
                F.lit(SPAN),
                lambda acc, x: acc + x,
            ),
        )

    return let(
        hashes,
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), covered)
        ),
    )


def _windows(words: Column) -> Column:
    """A hash for each run of SPAN = 8 words, by doubling: 1, 2, 4, 8 words."""
    one = F.transform(words, lambda w: F.xxhash64(w))

    def double(h: Column, by: int) -> Column:
        left = F.greatest(F.size(h) - by, F.lit(0))
        return F.zip_with(F.slice(h, 1, left), F.slice(h, by + 1, left), lambda a, b: F.xxhash64(a, b))

    return let(one, lambda a: let(double(a, 1), lambda b: let(double(b, 2), lambda c: double(c, 4))))


def measures(text: Column) -> Column:
    """A struct of MEASURES (long)."""
    text = F.coalesce(text, F.lit(""))

    def of(t: Column) -> Column:
        words = F.regexp_extract_all(t, F.lit(f"({WORD})"), F.lit(1))
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
        symbols = F.octet_length(t) - F.octet_length(F.regexp_replace(t, r"[#*$%&|<>]+", ""))

        def counted(w: Column) -> Column:
            return F.struct(
                F.size(w).alias("n_words"),
                F.length(F.array_join(w, "")).alias("word_chars"),
                symbols.alias("n_symbols"),
                F.size(lines).alias("n_lines"),
                let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"),
                _repeat_words(_windows(w)).alias("n_repeat_words"),
                (F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}+", ""))).alias("n_upper"),
            )

        return let(words, counted)

    return let(text, of).cast("struct<" + ",".join(f"{m}:bigint" for m in MEASURES) + ">")


@dataclass(frozen=True)
class Rule:
    """``fails`` maps the measurements to a condition; ``bit`` never changes once given."""

    name: str
    bit: int
    fails: object


RULES = (
    Rule("few_words", 0, lambda m: m["n_words"] < 20),
    Rule("repeated_spans", 1, lambda m: 100 * m["n_repeat_words"] > 30 * m["n_words"]),
    Rule("symbols", 2, lambda m: 10 * m["n_symbols"] > 3 * m["n_words"]),
    Rule("repeated_lines", 3, lambda m: (m["n_dup_lines"] >= 3) & (10 * m["n_dup_lines"] > 3 * m["n_lines"])),
    Rule("word_length", 4, lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 20 * m["n_words"])),
    Rule("capitals", 5, lambda m: 2 * m["n_upper"] > m["word_chars"]),
)

BASE = ("few_words", "repeated_spans")

#: Versions never change; a new policy gets a new name.
POLICIES: dict[str, tuple[str, ...]] = {
    "base-1": BASE,
    "web-1": (*BASE, "symbols", "repeated_lines", "word_length"),
    "web-2": (*BASE, "symbols", "repeated_lines", "word_length", "capitals"),
}


def mask(names: tuple[str, ...] | list[str]) -> int:
    bits = {r.name: r.bit for r in RULES}
    return sum(1 << bits[n] for n in set(names))


def ledger(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns by default), MEASURES and ``fail_bits`` long."""
    keep = docs.columns if keep is None else keep
    return unfolded(_ledger(docs, text, keep), keep, [*MEASURES, "fail_bits"])


def _ledger(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """(_row, MEASURES, fail_bits)"""
    measured = docs.select(row_of(keep), measures(F.col(text)).alias("m"))
    # one struct, so that the optimizer doesn't copy the measuring into each rule
    packed = let(F.col("m"), lambda x: F.struct(*(x[c].alias(c) for c in MEASURES), _bits(x).alias("fail_bits")))
    return measured.select(ROW, packed.alias("m")).select(ROW, "m.*")


def _bits(m: Column) -> Column:
    out = F.lit(0).cast("long")
    for r in RULES:
        out = out + F.when(r.fails(m), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long")
    return out


def passes(policy: str, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")) == 0


def ablation(led: DataFrame) -> DataFrame:
    """For each policy and each of its rules: rows that the policy drops, rows that the
    rule fails, and rows that only this rule drops (they'd stay without it)."""
    counts = []
    for policy, names in POLICIES.items():
        held = F.col("fail_bits").bitwiseAND(F.lit(mask(names)).cast("long"))
        for r in RULES:
            if r.name in names:
                counts.append(
                    F.struct(
                        F.lit(policy).alias("policy"),
                        F.lit(r.name).alias("rule"),
                        F.count_if(held != 0).alias("n_dropped"),
                        F.count_if(held.bitwiseAND(F.lit(1 << r.bit).cast("long")) != 0).alias("n_failed"),
                        F.count_if(held == (1 << r.bit)).alias("n_only"),
                    )
                )
    one = led.agg(F.array(*counts).alias("a"), F.bit_or("fail_bits").alias("seen_bits"))
    return one.select(F.explode("a").alias("x"), "seen_bits").select("x.*", "seen_bits")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = ledger(read(spark, sf_dir, "documents"), keep=["doc_id"])
    return led.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (~passes("base-1")).alias("base_failed"),
        passes("web-2").alias("kept"),
        "n_lines",
        "n_upper",
        "fail_bits",
    )


def accept(docs: DataFrame, policy: str = "web-2") -> DataFrame:
    """The rows that no rule of the policy fails, as they came."""
    return unfolded(_ledger(docs, "text", docs.columns).where(passes(policy)), docs.columns, [])


#: DuckDB; one row for each document, like query().
SQL = rf"""
with t as (select doc_id, coalesce(text, '') as text, row_number() over () as k from documents),
w as (select *, regexp_extract_all(text, '{WORD}') as words,
             list_filter(string_split(text, chr(10)), lambda x : regexp_matches(x, '{WORD}')) as lines from t),
g as (select k, unnest(range(0, greatest(len(words) - 7, 0))) as i, words from w),
h as (select k, i, list_aggregate(words[i + 1 : i + 8], 'string_agg', ' ') as s from g),
d as (select k, i from (select k, i, count(*) over (partition by k, s) as n from h) where n > 1),
e as (select k, least(8, i - lag(i) over (partition by k order by i)) as step from d),
r as (select k, sum(coalesce(step, 8)) as n from e group by k),
m as (select w.k, doc_id, len(words) as n_words, len(list_aggregate(words, 'string_agg', '')) as chars,
             len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols, len(lines) as n_lines,
             len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(r.n, 0) as n_repeat_words,
             len(text) - len(regexp_replace(text, '\p{{Lu}}', '', 'g')) as n_upper
      from w left join r on w.k = r.k),
n as (select *, coalesce(chars, 0) as word_chars from m),
f as (select *, (case when n_words < 20 then 1 else 0 end)
       + (case when 100 * n_repeat_words > 30 * n_words then 2 else 0 end)
       + (case when 10 * n_symbols > 3 * n_words then 4 else 0 end)
       + (case when n_dup_lines >= 3 and 10 * n_dup_lines > 3 * n_lines then 8 else 0 end)
       + (case when word_chars < 2 * n_words or word_chars > 20 * n_words then 16 else 0 end)
       + (case when 2 * n_upper > word_chars then 32 else 0 end) as fail_bits from n)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
       n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, (fail_bits & 3) <> 0 as base_failed,
       fail_bits = 0 as kept, n_lines::bigint as n_lines, n_upper::bigint as n_upper, fail_bits::bigint as fail_bits
from f
"""
