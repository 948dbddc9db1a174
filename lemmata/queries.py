"""The engine's queries over the driver's tables, and their SQL.

The tables hold no LaTeX, so both sides derive the same blocks, vectors and queries from
``documents``, ``embeddings`` and ``benchmark``.  Texts are whole: characters that LaTeX reads
as signs get a backslash.  Searches take every row of ``embeddings`` whose id is divisible by
100 as a query.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import render
from . import schema as S
from .functions import blocks as B
from .functions import query as Q
from .operators import cells, embed
from .operators import search as searching
from .operators import store as storing
from .plans import blocks as plans
from .shared import session_dir
from .sources import latex, tex

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

_NAMES = ", ".join(f"'{e}'" for e in S.ENVIRONMENTS)
_CANON = "CASE env_raw " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in S.ALIASES.items()) + " ELSE env_raw END"
BLK_SQL = f"""
blk0 AS (SELECT doc_id, '/' || source AS folder, '/' || source || '/' || lang || '.tex' AS source_file, lang,
                list_extract([{_NAMES}], (doc_id % 21 + 1)::int) AS env_raw,
                CASE WHEN doc_id % 3 = 0 THEN 'lbl:' || doc_id WHEN doc_id % 5 = 1 THEN 'shared' ELSE '' END AS label,
                regexp_replace(coalesce(text, ''), '([\\\\{{}}$%])', '\\\\\\1', 'g') AS words FROM documents),
blk1 AS (SELECT *, {_CANON} AS env_type,
                '\\begin{{' || env_raw || '}}' || CASE WHEN label <> '' THEN '\\label{{' || label || '}}' ELSE '' END || words || '\\end{{' || env_raw || '}}' AS text FROM blk0),
blk AS (SELECT *, lang || '.tex::' || env_type || '::' || row_number() OVER (PARTITION BY folder, env_type ORDER BY lang, doc_id) AS block_id FROM blk1)
"""
VEC_SQL = """
vec AS (SELECT vec_id AS block_id, CASE label WHEN 0 THEN 'definition' WHEN 1 THEN 'theorem' WHEN 2 THEN 'lemma' ELSE 'proof' END AS env_type,
               '/f' || (vec_id % 4) AS folder, embedding[1:32]::DOUBLE[] AS t, embedding[33:64]::DOUBLE[] AS m FROM embeddings)
"""


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def language_ord(lang: Column) -> Column:
    """A file's place in its folder: the order of two letters."""
    return (F.ascii(lang) * 256 + F.ascii(F.substring(lang, 2, 1))).cast("long")


def documents_as_blocks(spark: SparkSession, sf: str, ids: bool = True) -> DataFrame:
    """``ids``: with block_id, which numbers all rows."""
    names = F.array(*(F.lit(e) for e in S.ENVIRONMENTS))
    env = F.element_at(names, (F.col("doc_id") % 21 + 1).cast("int"))
    folder = F.concat(F.lit("/"), "source")
    docs = table(spark, sf, "documents").select(
        "doc_id", "lang", folder.alias("folder"), F.concat(folder, F.lit("/"), "lang", F.lit(".tex")).alias("source_file"), env.alias("env_raw"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("lbl:"), F.col("doc_id").cast("string"))).when(F.col("doc_id") % 5 == 1, "shared").otherwise("").alias("label"),
        F.regexp_replace(F.coalesce("text", F.lit("")), r"([\\{}$%])", r"\\$1").alias("words"),
    )
    mark = F.when(F.col("label") != "", F.concat(F.lit("\\label{"), "label", F.lit("}"))).otherwise("")
    text = F.concat(F.lit("\\begin{"), "env_raw", F.lit("}"), mark, "words", F.lit("\\end{"), "env_raw", F.lit("}"))
    docs = docs.withColumns({"text": text, "env_type": B.canonical(F.col("env_raw")), "file_ord": language_ord(F.col("lang"))})
    if not ids:
        return docs.drop("file_ord")
    docs = plans.running_number(docs, ["folder", "env_type"], ["lang", "doc_id"])
    return docs.withColumn("block_id", B.block_id(F.col("source_file"), F.col("env_type"), F.col("n"))).drop("file_ord", "n")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("label") == 0, "definition").when(F.col("label") == 1, "theorem").when(F.col("label") == 2, "lemma").otherwise("proof")
    v = F.col("embedding").cast("array<double>")
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("block_id"), kind.alias("env_type"), F.concat(F.lit("/f"), (F.col("vec_id") % 4).cast("string")).alias("folder"), F.slice(v, 1, 32).alias("text_vec"), F.slice(v, 33, 32).alias("math_vec")
    )


def questions(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("item_id")
    lead = F.when(i % 4 == 1, F.format_string("$x_{%d}$ ", i)).when(i % 4 == 2, "\\lim ").when(i % 4 == 3, "definition of ").otherwise("")
    return table(spark, sf, "benchmark").select("item_id", F.concat(lead, "text").alias("query"))


QRY_SQL = r"""
qry AS (SELECT item_id, CASE item_id % 4 WHEN 1 THEN '$x_{' || item_id || '}$ ' WHEN 2 THEN '\lim ' WHEN 3 THEN 'definition of ' ELSE '' END || text AS query FROM benchmark)
"""


def add(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


# --- blocks ---------------------------------------------------------------------------


@add("env_membership_alias", f"WITH {BLK_SQL} SELECT doc_id, env_raw, env_raw IN ({_NAMES}) AS is_statement, env_type FROM blk1")
def _(spark, sf):
    b = documents_as_blocks(spark, sf, ids=False)
    return b.select("doc_id", "env_raw", B.is_statement(F.col("env_raw")).alias("is_statement"), "env_type")


@add("block_ids", f"WITH {BLK_SQL} SELECT doc_id, env_type, block_id FROM blk")
def _(spark, sf):
    b = documents_as_blocks(spark, sf, ids=False)
    events = b.select("folder", "source_file", language_ord(F.col("lang")).alias("file_ord"), F.col("doc_id").alias("pos"), F.lit("block").alias("kind"), F.col("env_raw").alias("name"))
    return plans.numbered(events).select(F.col("pos").alias("doc_id"), "env_type", "block_id")


@add(
    "section_forward_fill",
    """SELECT doc_id, coalesce(last_value(CASE WHEN doc_id % 7 = 0 THEN 'S' || doc_id END IGNORE NULLS)
       OVER (PARTITION BY source, lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS section FROM documents""",
)
def _(spark, sf):
    d = table(spark, sf, "documents")
    starts = F.col("doc_id") % 7 == 0
    events = d.select(
        F.col("source").alias("folder"), F.col("lang").alias("source_file"), F.lit(0).alias("file_ord"), F.col("doc_id").alias("pos"), F.when(starts, "section").otherwise("block").alias("kind"), F.concat(F.lit("S"), F.col("doc_id").cast("string")).alias("title")
    )
    return plans.with_sections(events).select(F.col("pos").alias("doc_id"), "section")


@add(
    "include_edges",
    r"""WITH s AS (SELECT doc_id, '\input{ a' || doc_id || ' } % \include{b/c.v2}' AS t FROM documents),
    e AS (SELECT doc_id, unnest(regexp_extract_all(t, '\\(?:input|include)\{([^}]+)\}', 1)) AS r, unnest(range(0, 2)) AS ord FROM s)
    SELECT doc_id, ord::int AS ord, CASE WHEN regexp_matches(trim(r), '.\.[^./]+$') THEN trim(r) ELSE trim(r) || '.tex' END AS ref FROM e""",
)
def _(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.format_string("\\input{ a%d } %% \\include{b/c.v2}", "doc_id").alias("text"))
    return tex.include_edges(d).select(F.col("src").cast("long").alias("doc_id"), "ord", "ref")


#: Document d includes 3d + 3, 3d + 1 and 3d + 2, in this order, and what lies beyond the table is missing.
_INCLUDED = (3, 1, 2)


@add(
    "file_order",
    """WITH RECURSIVE k AS (SELECT doc_id, [0] AS key FROM documents WHERE doc_id = 0
      UNION ALL SELECT d.doc_id, list_append(k.key, CASE (d.doc_id - 1) % 3 WHEN 2 THEN 0 WHEN 0 THEN 1 ELSE 2 END::INT) FROM k JOIN documents d ON d.doc_id > 0 AND (d.doc_id - 1) // 3 = k.doc_id)
    SELECT doc_id, row_number() OVER (ORDER BY key) - 1 AS file_ord FROM k""",
)
def _(spark, sf):
    ids = table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    edges = ids.select(F.col("id").alias("src"), F.posexplode(F.array(*(F.col("id") * 3 + k for k in _INCLUDED))).alias("ord", "dst"))
    return tex.walked(ids, edges.join(ids.select(F.col("id").alias("dst")), "dst")).select(F.col("id").alias("doc_id"), "file_ord")


@add("path_order", "SELECT page_id, row_number() OVER (ORDER BY string_split(url, '/'), page_id) - 1 AS place FROM pages")
def _(spark, sf):
    return tex.placed(table(spark, sf, "pages").select("page_id", "url"), [F.split("url", "/"), "page_id"]).select("page_id", "place")


#: A file around each document: what is said before its statement, within it, and after.  @ is the doc_id.
_BEFORE = r"""\documentclass{article} % \begin{lemma} in a comment \end{lemma}
\section{S@}
\begin{document}
"""
_WITHIN = r"""\begin{equation}\label{eq:@} x_@ \end{equation} {\label{group:@}} $\label{math:@}$ \[ \begin{lem} in math \end{lem} \]
\begin{lemma} inner \label{inner:@} \end{lemma} % \label{comment:@}
\label{late:@} \label{later:@} \section{No} """
_AFTER = r"""
{\begin{thm} in a group \end{thm}} \verb|\begin{thm}| \begin{verbatim} \begin{thm} \end{thm} \end{verbatim}
\begin{figure} \subsection*{T@} \begin{rem}\label{ rem:@ } last @ \end{rem} \end{figure}
\begin{theorem*} starred \end{theorem*} \begin{claim} never closed
\end{document} \begin{ex} after @ \end{ex}"""


def _quoted(x: str) -> str:
    return "replace('" + x.replace("'", "''") + "', '@', doc_id::varchar)"


@add(
    "parse_blocks",
    f"""WITH {BLK_SQL},
    f AS (SELECT doc_id, env_raw, '\\begin{{' || env_raw || '}}' || words || {_quoted(_WITHIN)} || '\\end{{' || env_raw || '}}' AS body FROM blk1)
    SELECT doc_id, 1 AS place, 'section' AS kind, 'section' AS name, 'S' || doc_id AS title, '' AS label, '' AS body FROM f
    UNION ALL SELECT doc_id, 2, 'block', env_raw, '', 'late:' || doc_id, body FROM f
    UNION ALL SELECT doc_id, 3, 'section', 'subsection', '*', '', '' FROM f
    UNION ALL SELECT doc_id, 4, 'block', 'rem', '', 'rem:' || doc_id, '\\begin{{rem}}\\label{{ rem:' || doc_id || ' }} last ' || doc_id || ' \\end{{rem}}' FROM f
    UNION ALL SELECT doc_id, 5, 'block', 'ex', '', '', '\\begin{{ex}} after ' || doc_id || ' \\end{{ex}}' FROM f""",
)
def _(spark, sf):
    said = lambda x: F.replace(F.lit(x), F.lit("@"), F.col("doc_id").cast("string"))
    env = lambda edge: F.concat(F.lit(f"\\{edge}{{"), "env_raw", F.lit("}"))
    text = F.concat(said(_BEFORE), env("begin"), "words", said(_WITHIN), env("end"), said(_AFTER))
    documents_as_blocks(spark, sf, ids=False).select("doc_id", text.alias("text")).createOrReplaceTempView("lemmata_sources")
    spark.udtf.register("latex_events", latex.latex_events)
    return spark.sql("SELECT doc_id, nth AS place, kind, name, title, label, body FROM lemmata_sources, LATERAL latex_events(text)")


# --- queries --------------------------------------------------------------------------

_TYPE_SQL = r"""CASE WHEN NOT regexp_matches(query, '\$\$[^$]+\$\$|\$[^$]+\$|\\[\(\[\]\)]|\\[a-zA-Z]+[{\s]|\\[a-zA-Z]+') THEN 'TEXT'
 WHEN regexp_matches(regexp_replace(regexp_replace(query, '\$\$[^$]+\$\$|\$[^$]+\$|\\[\(\[\]\)]|\\[a-zA-Z]+[{\s]|\\[a-zA-Z]+', '', 'g'), '[_^{}\[\]()|,.\p{Nd}]', ' ', 'g'), '[\p{L}\p{Nl}\p{No}]{3,}') THEN 'MIXED' ELSE 'MATH' END"""


@add("query_type", f"WITH {QRY_SQL} SELECT item_id, {_TYPE_SQL} AS query_type FROM qry")
def _(spark, sf):
    return questions(spark, sf).select("item_id", Q.query_type(F.col("query")).alias("query_type"))


@add("query_type_counts", f"WITH {QRY_SQL} SELECT {_TYPE_SQL} AS query_type, count(*) AS n FROM qry GROUP BY 1")
def _(spark, sf):
    return questions(spark, sf).groupBy(Q.query_type(F.col("query")).alias("query_type")).agg(F.count("*").alias("n"))


@add("boost_flag", f"WITH {QRY_SQL} SELECT item_id, regexp_matches(query, '(?i)\\b(definition|define|defined|meaning)\\b') AS boost FROM qry")
def _(spark, sf):
    return questions(spark, sf).select("item_id", Q.wants_definitions(F.col("query")).alias("boost"))


@add("query_prompt", f"WITH {QRY_SQL} SELECT item_id, 'Instruct: Retrieve relevant mathematical theorems, definitions, lemmas, or proofs' || chr(10) || 'Query: ' || query AS prompt FROM qry")
def _(spark, sf):
    return questions(spark, sf).select("item_id", Q.prompt(F.col("query")).alias("prompt"))


@add("embed_route", f"WITH {QRY_SQL} SELECT item_id, {_TYPE_SQL} IN ('TEXT', 'MIXED') AS in_text, {_TYPE_SQL} IN ('MATH', 'MIXED') AS in_math FROM qry")
def _(spark, sf):
    kind = Q.query_type(F.col("query"))
    return questions(spark, sf).select("item_id", Q.in_text(kind).alias("in_text"), Q.in_math(kind).alias("in_math"))


# --- vectors --------------------------------------------------------------------------


@add("fake_embedding", "WITH h AS (SELECT doc_id, ('0x' || right(md5('d' || doc_id), 8))::BIGINT AS h FROM documents), e AS (SELECT doc_id, h, unnest(range(0, 8)) AS i FROM h) SELECT doc_id, i::int AS i, CASE WHEN (h >> i::int) & 1 = 1 THEN 1 ELSE -1 END::int AS sign FROM e")
def _(spark, sf):
    v = B.hashed_vector(F.concat(F.lit("d"), F.col("doc_id").cast("string")), 8)
    return table(spark, sf, "documents").select("doc_id", F.posexplode(v).alias("i", "x")).select("doc_id", "i", F.signum("x").cast("int").alias("sign"))


def _numpy(of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Query:
    """(vec_id, i, x): all components of what ``of`` makes of ids and vectors."""

    def run(spark, sf):
        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    made = of(b["vec_id"].to_numpy(), np.stack(b["embedding"]).astype(float))
                    n = made.shape[1]
                    yield pd.DataFrame({"vec_id": np.repeat(b["vec_id"].to_numpy(), n), "i": np.tile(np.arange(n), len(b)), "x": made.round(9).ravel() + 0.0})

        return table(spark, sf, "embeddings").select("vec_id", "embedding").mapInPandas(work, "vec_id long, i int, x double")

    return run


# a vector as 16 tokens of 4 numbers, of which a third is masked
add(
    "mean_pool",
    """WITH t AS (SELECT vec_id, embedding, list_filter(range(0, 16), lambda k : (k + vec_id) % 3 <> 0) AS kept FROM embeddings), u AS (SELECT *, unnest(range(0, 4)) AS i FROM t)
    SELECT vec_id, i::int AS i, round(list_sum(list_transform(kept, lambda k : embedding[k * 4 + i + 1]::DOUBLE)) / greatest(len(kept), 1e-9), 9) AS x FROM u""",
)(_numpy(lambda ids, v: embed.mean_pool(v.reshape(len(v), 16, -1), (np.arange(16) + ids[:, None]) % 3 != 0)))
add(
    "l2_normalize",
    """WITH v AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x : x * (vec_id + 1)) AS v FROM embeddings), n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x : x * x))) AS n, unnest(range(0, len(v))) AS i FROM v)
    SELECT vec_id, i::int AS i, round(v[i + 1] / n, 9) AS x FROM n""",
)(_numpy(lambda ids, v: embed.normalized(v * (ids[:, None] + 1))))


# two vectors for each id, of which the later counts
@add("embed_join", "WITH e AS (SELECT vec_id // 2 AS block_id, max(vec_id) AS last_id FROM embeddings GROUP BY 1) SELECT doc_id AS block_id, last_id FROM documents JOIN e ON doc_id = block_id")
def _(spark, sf):
    e = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 2).alias("block_id"), F.col("vec_id").alias("last_id"), F.col("vec_id").alias("o"))
    return storing.joined(table(spark, sf, "documents").select(F.col("doc_id").alias("block_id")), e, "o")


# --- store ----------------------------------------------------------------------------

_UPSERT_SQL = f"""WITH {BLK_SQL},
o AS (SELECT block_id, folder, doc_id AS seq FROM (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY doc_id DESC) AS k FROM blk WHERE folder < '/src5') WHERE k = 1),
n AS (SELECT block_id, folder, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY doc_id DESC) AS k FROM blk WHERE folder >= '/src5') WHERE k = 1),
u AS (SELECT * FROM o WHERE block_id NOT IN (SELECT block_id FROM n)
      UNION ALL SELECT n.block_id, n.folder, coalesce(o.seq, (SELECT max(seq) + 1 FROM o) + n.doc_id) FROM n LEFT JOIN o ON o.block_id = n.block_id)"""


def _two_loads(spark: SparkSession, sf: str) -> DataFrame:
    b = documents_as_blocks(spark, sf)
    rank = F.row_number().over(Window.partitionBy("block_id").orderBy(F.desc("doc_id")))
    old = b.where("folder < '/src5'").withColumn("k", rank).where("k = 1").select("block_id", "folder", F.col("doc_id").alias("seq"))
    return storing.upserted(old, b.where("folder >= '/src5'").select("block_id", "folder", F.col("doc_id").alias("_ord")))


@add("upsert_merge", f"{_UPSERT_SQL} SELECT block_id, folder, seq FROM u")
def _(spark, sf):
    return _two_loads(spark, sf)


@add("delete_folder", f"WITH {BLK_SQL} SELECT doc_id, block_id FROM blk WHERE folder <> '/src3'")
def _(spark, sf):
    return storing.without_folder(documents_as_blocks(spark, sf), "/src3").select("doc_id", "block_id")


@add("delete_count", f"WITH {BLK_SQL} SELECT count(*) AS n FROM blk WHERE folder = '/src3'")
def _(spark, sf):
    return storing.removed_count(documents_as_blocks(spark, sf, ids=False), "/src3")


def _filter(folder: str | None, env: str | None) -> Query:
    def run(spark, sf):
        scope = B.where(folder, env)
        b = documents_as_blocks(spark, sf, ids=False)
        return (b if scope is None else b.where(scope)).select("doc_id", "folder", "env_type")

    return run


for _n, _f, _e, _sql in (
    ("none", "", None, "true"),
    ("folder", "/src1", "", "folder = '/src1'"),
    ("env", None, "definition", "env_type = 'definition'"),
    ("both", "/src1", "definition", "folder = '/src1' AND env_type = 'definition'"),
):
    add(f"filter_where_{_n}", f"WITH {BLK_SQL} SELECT doc_id, folder, env_type FROM blk WHERE {_sql}")(_filter(_f, _e))


def _label(label: str, folder: str | None) -> Query:
    def run(spark, sf):
        hit = storing.by_label(documents_as_blocks(spark, sf).withColumn("seq", F.col("doc_id")), label, folder)
        return hit.select("block_id", "label", "folder", "score", "matched_view")

    return run


for _n, _l, _f in (("hit", "lbl:33", None), ("scoped", "shared", "/src7"), ("empty", "", None), ("miss", "lbl:x", ""), ("shared", "shared", None), ("elsewhere", "lbl:33", "/nowhere")):
    _scope = f" AND folder = '{_f}'" if _f else ""
    add(f"label_lookup_{_n}", f"WITH {BLK_SQL} SELECT block_id, label, folder, 1.0::DOUBLE AS score, 'label' AS matched_view FROM blk WHERE label = '{_l}'{_scope} ORDER BY doc_id LIMIT 1")(_label(_l, _f))


#: A store of the blocks below the shared folder, for queries that go through the engine's own tables.
def stored(spark: SparkSession, sf: str, b: DataFrame) -> storing.Store:
    store = storing.Store(spark, f"{session_dir(spark)}/store-{uuid.uuid4().hex}")
    store.upsert(b)
    return store


def _loaded(spark: SparkSession, sf: str) -> storing.Store:
    """Two loads and a removal: blocks of /src5 and above come second, with the ids that files of the
    same name have in other folders; then /src3 goes."""
    b = documents_as_blocks(spark, sf).select("env_type", "text", "label", F.lit("").alias("section"), "source_file", "folder", "block_id", F.col("doc_id").alias("_ord"))
    store = stored(spark, sf, b.where("folder < '/src5'"))
    store.upsert(b.where("folder >= '/src5'"))
    store.remove_folder("/src3")
    return store


_STORED_SQL = f"""{_UPSERT_SQL}, s AS (SELECT u.block_id, u.folder, u.seq, b.label, b.source_file, b.env_type FROM u JOIN blk b ON b.block_id = u.block_id AND b.folder = u.folder
  WHERE u.folder <> '/src3' QUALIFY row_number() OVER (PARTITION BY u.block_id ORDER BY b.doc_id DESC) = 1)"""


@add("store_blocks", f"{_STORED_SQL} SELECT block_id, folder, env_type, label, source_file FROM s")
def _(spark, sf):
    return _loaded(spark, sf).read().select("block_id", "folder", "env_type", "label", "source_file")


@add("store_folders", f"{_STORED_SQL} SELECT folder, count(DISTINCT source_file) AS file_count, count(*) AS block_count FROM s GROUP BY folder")
def _(spark, sf):
    return _loaded(spark, sf).list_folders()


@add("store_label", f"{_STORED_SQL} SELECT block_id, folder, label FROM s WHERE label = 'shared' ORDER BY seq LIMIT 1")
def _(spark, sf):
    return _loaded(spark, sf).get_by_label("shared").select("block_id", "folder", "label")


@add("list_folders", f"WITH {BLK_SQL} SELECT folder, count(DISTINCT source_file) AS file_count, count(*) AS block_count FROM blk GROUP BY folder")
def _(spark, sf):
    return storing.listed(documents_as_blocks(spark, sf, ids=False))


@add("index_summary", f"WITH {BLK_SQL} SELECT count(DISTINCT source_file) AS files, count(*) AS blocks FROM blk")
def _(spark, sf):
    return plans.summary(documents_as_blocks(spark, sf, ids=False))


# --- search ---------------------------------------------------------------------------


def asked(spark: SparkSession, sf: str, text: str = "true", math: str = "true", boost: str = "false", sign: float = 1.0, which: str = "vec_id % 100 = 0") -> DataFrame:
    """Queries are the vectors of the rows whose id is divisible by 100; the conditions say what each asks."""
    v = table(spark, sf, "embeddings").where(which)
    e = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * sign)
    return v.select(F.col("vec_id").alias("query_id"), F.expr(boost).alias("boost"), F.when(F.expr(text), F.slice(e, 1, 32)).alias("text_vec"), F.when(F.expr(math), F.slice(e, 33, 32)).alias("math_vec"))


def _search_sql(n: int, text: str = "true", math: str = "true", boost: str = "false", sign: str = "1.0", which: str = "vec_id % 100 = 0", where: str = "true", view: int | None = None) -> str:
    cos = "list_cosine_similarity({}, {})"
    part = " UNION ALL ".join(
        f"SELECT query_id, boost, block_id, env_type, {i} AS view_ord, {cos.format(a, 'q' + a)} AS score FROM vec, q WHERE q{a} IS NOT NULL AND ({where})" for i, a in enumerate("tm")
    )
    head = f"""WITH {VEC_SQL},
    q AS (SELECT vec_id AS query_id, {boost} AS boost, CASE WHEN {text} THEN list_transform(embedding[1:32]::DOUBLE[], lambda x : x * {sign}) END AS qt,
                 CASE WHEN {math} THEN list_transform(embedding[33:64]::DOUBLE[], lambda x : x * {sign}) END AS qm FROM embeddings WHERE {which}),
    s AS ({part}),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id, view_ord ORDER BY score DESC, block_id) AS view_rank FROM s),
    k AS (SELECT * FROM r WHERE view_rank <= {2 * n})"""
    if view is not None:
        return f"{head} SELECT query_id, block_id, view_rank::int AS view_rank, round(score, 9) AS score FROM k WHERE view_ord = {view}"
    return f"""{head},
    g AS (SELECT query_id, block_id, min(env_type) AS env_type, bool_or(boost) AS boost, max(score) AS base, count(*) AS views, min(view_ord) AS v, min(view_ord * 1000000000 + view_rank) AS first_seen FROM k GROUP BY 1, 2),
    z AS (SELECT *, CASE WHEN boost AND env_type = 'definition' THEN least(base * 1.15, 1.0) ELSE base END AS score FROM g),
    f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_seen) AS rank FROM z)
    SELECT query_id, rank::int AS rank, block_id, env_type, round(score, 9) AS score, CASE WHEN views > 1 THEN 'both' WHEN v = 0 THEN 'text' ELSE 'math' END AS matched_view FROM f WHERE rank <= {n}"""


def _top(view: int, where: str = "true") -> Query:
    def run(spark, sf):
        q = asked(spark, sf, text=str(view == 0), math=str(view == 1))
        hits = searching.candidates(vectors(spark, sf), q, 5, F.expr(where))
        return hits.where(F.col("view_ord") == view).select("query_id", "block_id", "view_rank", F.round("score", 9).alias("score"))

    return run


def _search(n: int = 5, where: str = "true", **how) -> Query:
    def run(spark, sf):
        out = searching.search(vectors(spark, sf), asked(spark, sf, **how), n, F.expr(where))
        return out.withColumn("score", F.round("score", 9))

    return run


for _n, _v, _w in (("text", 0, "true"), ("math", 1, "true"), ("filtered", 0, "folder = '/f1' AND env_type = 'proof'")):
    add(f"topk_{_n}", _search_sql(5, where=_w, view=_v))(_top(_v, _w))
for _n, _k, _how in (
    ("text", 5, {"math": "false"}),
    ("math", 5, {"text": "false"}),
    ("mixed", 5, {}),
    ("boosted", 5, {"boost": "true"}),
    ("boost_clamped", 20, {"boost": "true"}),
    ("negative_boost", 400, {"boost": "true", "sign": -1.0}),
    ("batch", 7, {"text": "floor(vec_id / 100) % 3 <> 1", "math": "floor(vec_id / 100) % 3 <> 2", "boost": "floor(vec_id / 100) % 2 = 0"}),
):
    add(f"search_{_n}", _search_sql(_k, **{k: str(v) for k, v in _how.items()}))(_search(_k, **_how))
add("search_filtered", _search_sql(5, where="folder = '/f2' AND env_type = 'theorem'"))(_search(5, "folder = '/f2' AND env_type = 'theorem'"))


def _indexed(spark: SparkSession, sf: str) -> tuple[DataFrame, cells.Index]:
    """The blocks with their cells, written to the shared folder, and the index."""
    path = f"{session_dir(spark)}/cells-{uuid.uuid4().hex}"
    cells.fit(vectors(spark, sf)).write.parquet(f"{path}/centroids")
    index = cells.Index(spark.read.parquet(f"{path}/centroids"))
    index.assigned(vectors(spark, sf)).write.parquet(f"{path}/blocks")
    return spark.read.parquet(f"{path}/blocks"), index


# Approximate, so there is no SQL for all of it; the tests measure the recall.
@add("topk_indexed")
def _(spark, sf):
    blocks, index = _indexed(spark, sf)
    hits = cells.candidates(blocks, index, asked(spark, sf, math="false"), 5)
    return hits.select("query_id", "block_id", "view_rank", F.round("score", 9).alias("score"))


# As many probes as there can be cells: the exact result through the index.
@add("topk_indexed_all", _search_sql(5, view=0))
def _(spark, sf):
    blocks, index = _indexed(spark, sf)
    hits = cells.candidates(blocks, index, asked(spark, sf, math="false"), 5, probes=cells.CELLS)
    return hits.select("query_id", "block_id", "view_rank", F.round("score", 9).alias("score"))


# --- texts ----------------------------------------------------------------------------


def _texts(of: Callable[[dict], str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "shown": [of(r) for r in b.to_dict("records")]})

    return run


_HEAD = "upper(env_type) || '  (label: ' || label || ')' || chr(10) || '  file: ' || source_file"


@add(
    "render_label",
    f"""WITH {BLK_SQL} SELECT doc_id, CASE WHEN label = '' THEN 'No block with label ''' || doc_id || ''' found in ' || folder || '.'
    ELSE {_HEAD} || chr(10) || '  section: S' || chr(10) || '  ---' || chr(10) || text END AS shown FROM blk""",
)
def _(spark, sf):
    b = documents_as_blocks(spark, sf, ids=False).withColumn("section", F.lit("S"))
    show = _texts(lambda r: render.label(r if r["label"] else None, str(r["doc_id"]), r["folder"]))
    return b.select("doc_id", "label", "env_type", "source_file", "section", "folder", "text").mapInPandas(show, "doc_id long, shown string")


@add("render_folders", f"WITH {BLK_SQL}, g AS (SELECT folder, count(DISTINCT source_file) AS f, count(*) AS b FROM blk GROUP BY folder) SELECT 'Indexed folders:' || chr(10) || string_agg('  ' || folder || '  (' || f || ' file(s), ' || b || ' block(s))', chr(10) ORDER BY folder) AS shown FROM g")
def _(spark, sf):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"folder": b["folder"], "line": [render.folder_line(r) for r in b.to_dict("records")]})

    lines = storing.listed(documents_as_blocks(spark, sf, ids=False)).mapInPandas(run, "folder string, line string")
    return lines.agg(F.concat(F.lit(f"{render.FOLDERS}\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("folder", "line"))), lambda x: x["line"]), "\n")).alias("shown"))


@add("render_counts", f"WITH {BLK_SQL} SELECT folder, 'Indexed ' || count(DISTINCT source_file) || ' file(s), ' || count(*) || ' block(s) from ' || folder || '.' AS indexed, 'Removed ' || count(*) || ' block(s) from ' || folder || '.' AS removed FROM blk GROUP BY folder")
def _(spark, sf):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(r.folder, render.indexed(r.file_count, r.block_count, r.folder), render.removed(r.block_count, r.folder)) for r in b.itertuples()]
            yield pd.DataFrame(rows, columns=["folder", "indexed", "removed"])

    return storing.listed(documents_as_blocks(spark, sf, ids=False)).mapInPandas(run, "folder string, indexed string, removed string")


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    """What each vector's block says; the text is that of the document with its id."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("block_id"), "text")
    i = F.col("block_id")
    label, section = F.when(i % 2 == 0, F.concat(F.lit("l:"), i.cast("string"))).otherwise(""), F.when(i % 3 == 0, "S").otherwise("")
    text = F.concat(F.lit("<"), F.coalesce("text", F.lit("")), F.lit(">"))
    return vectors(spark, sf).join(docs, "block_id", "left").withColumns({"label": label, "section": section, "source_file": F.concat("folder", F.lit("/a.tex")), "text": text})


@add(
    "render_search",
    f"""WITH hits AS ({_search_sql(5)}), {VEC_SQL}, b AS (SELECT vec.*, '<' || coalesce(text, '') || '>' AS text FROM vec LEFT JOIN documents ON doc_id = vec.block_id),
    t AS (SELECT query_id, rank, '[' || rank || '] ' || upper(hits.env_type) || '  (score: ' || printf('%.3f', score) || ', view: ' || matched_view || ')' || chr(10) || '  file: ' || folder || '/a.tex' ||
      CASE WHEN b.block_id % 3 = 0 THEN chr(10) || '  section: S' ELSE '' END || CASE WHEN b.block_id % 2 = 0 THEN chr(10) || '  label:   l:' || b.block_id ELSE '' END || chr(10) || '  ---' || chr(10) || text AS shown
      FROM hits JOIN b ON hits.block_id = b.block_id)
    SELECT query_id, string_agg(shown, chr(10) || chr(10) ORDER BY rank) AS shown FROM t GROUP BY query_id""",
)
def _(spark, sf):
    blocks = _facts(spark, sf)
    best = searching.search(blocks, asked(spark, sf), 5)

    def show(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"query_id": rows["query_id"][:1], "shown": [render.search(rows.sort_values("rank").to_dict("records"))]})

    # five rows a query
    return searching.with_texts(best, blocks).groupBy("query_id").applyInPandas(show, "query_id long, shown string")
