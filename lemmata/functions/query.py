"""Column expressions for queries: kind, boost, prompt."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S


def query_type(query: Column) -> Column:
    """TEXT without LaTeX; MIXED if words outlive its removal; else MATH."""
    rest = F.regexp_replace(F.regexp_replace(query, S.LATEX, ""), S.NOISE, " ")
    return F.when(~query.rlike(S.LATEX), "TEXT").when(rest.rlike(S.LETTERS), "MIXED").otherwise("MATH")


def wants_definitions(query: Column) -> Column:
    return query.rlike(S.DEFINITION)


def prompt(query: Column) -> Column:
    return F.concat(F.lit(S.PROMPT), query)


def in_text(kind: Column) -> Column:
    return kind.isin("TEXT", "MIXED")


def in_math(kind: Column) -> Column:
    return kind.isin("MATH", "MIXED")
