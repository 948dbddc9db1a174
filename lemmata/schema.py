"""Types and fixed values of the engine."""

from __future__ import annotations

from pyspark.sql import types as T

# The environments that count as statements, and their aliases.
ENVIRONMENTS = (
    "theorem", "thm",
    "lemma", "lem",
    "proposition", "prop",
    "corollary", "cor",
    "definition", "defn", "dfn",
    "proof",
    "remark", "rem",
    "example", "ex",
    "conjecture", "conj",
    "claim",
    "notation",
    "observation",
)
ALIASES = {
    "thm": "theorem",
    "lem": "lemma",
    "prop": "proposition",
    "cor": "corollary",
    "defn": "definition",
    "dfn": "definition",
    "rem": "remark",
    "ex": "example",
    "conj": "conjecture",
}
SECTIONS = ("chapter", "section", "subsection", "subsubsection")

# Patterns and numbers of the query side (Java syntax).
INCLUDE = r"\\(?:input|include)\{([^}]+)\}"
LATEX = r"\$\$[^$]+\$\$|\$[^$]+\$|\\[\(\[\]\)]|\\[a-zA-Z]+[{\s]|\\[a-zA-Z]+"
NOISE = r"[_^{}\[\]()|,.\p{Nd}]"
LETTERS = r"[\p{L}\p{Nl}\p{No}]{3,}"
DEFINITION = r"(?i)\b(definition|define|defined|meaning)\b"
PROMPT = "Instruct: Retrieve relevant mathematical theorems, definitions, lemmas, or proofs\nQuery: "
BOOST, CEILING, OVERFETCH, RESULTS = 1.15, 1.0, 2, 5
TEXT_DIM, MATH_DIM, MAX_TOKENS, POOL_FLOOR = 1024, 768, 512, 1e-9


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType(), False) for n in names]


BLOCK = T.StructType(_strings("env_type", "text", "label", "section", "source_file", "folder", "block_id"))
VECTOR = T.ArrayType(T.FloatType(), False)
EMBEDDING = T.StructType([*_strings("block_id"), T.StructField("text_vec", VECTOR), T.StructField("math_vec", VECTOR)])
#: model: whose vectors they are; the cells: those of the search index.
STORED = T.StructType([*BLOCK.fields, *EMBEDDING.fields[1:], T.StructField("seq", T.LongType()), T.StructField("model", T.StringType()), T.StructField("text_cell", T.IntegerType()), T.StructField("math_cell", T.IntegerType())])
RESULT = T.StructType([*_strings("block_id", "env_type", "label", "section", "source_file", "folder", "text"), T.StructField("score", T.DoubleType()), *_strings("matched_view")])
