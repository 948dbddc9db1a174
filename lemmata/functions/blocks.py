"""Column expressions for blocks, paths and vectors."""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S


def is_statement(env: Column) -> Column:
    return env.isin(*S.ENVIRONMENTS)


def canonical(env: Column) -> Column:
    names = F.create_map(*(F.lit(x) for x in chain.from_iterable(S.ALIASES.items())))
    return F.coalesce(F.try_element_at(names, env), env)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def block_id(path: Column, env: Column, n: Column) -> Column:
    return F.concat_ws("::", basename(path), env, n.cast("string"))


def references(source: Column) -> Column:
    """What \\input and \\include name, in order; also in comments.  ``.tex`` is added to
    names without a suffix."""
    raw = F.transform(F.regexp_extract_all(source, F.lit(S.INCLUDE), F.lit(1)), lambda r: F.trim(r))
    return F.transform(raw, lambda r: F.when(F.element_at(F.split(r, "/"), -1).rlike(r".\.[^.]+$"), r).otherwise(F.concat(r, F.lit(".tex"))))


def where(folder: str | None = None, env_type: str | None = None) -> Column | None:
    """Equality on what is given; None and "" mean no filter."""
    given = [F.col(c) == v for c, v in (("folder", folder), ("env_type", env_type)) if v]
    return reduce(lambda a, b: a & b, given) if given else None


def boosted(score: Column, env_type: Column, boost: Column) -> Column:
    return F.when(boost & (env_type == "definition"), F.least(score * S.BOOST, F.lit(S.CEILING))).otherwise(score)


def cosine(a: Column, b: Column) -> Column:
    """Null for vectors that are null, zero, not finite or of different lengths."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    score = F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)
    return F.when(F.abs(score) <= 2, score)


def hashed_vector(key: Column, dim: int) -> Column:
    """A unit vector for tests: bit i of the key's MD5 as a number gives a sign."""
    tail = F.conv(F.substring(F.md5(key.cast("binary")), -8, 8), 16, 10).cast("long")
    bits = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.floor(tail / F.pow(F.lit(2.0), i)).cast("long") % 2)
    return F.transform(bits, lambda b: F.when(b == 1, F.lit(dim**-0.5)).otherwise(F.lit(-(dim**-0.5))))
