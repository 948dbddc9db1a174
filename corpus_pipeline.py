"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept.
``run`` writes each stage's rows as Parquet to the shared folder and reads them again; only
the last stage's table stays there.

Null and empty texts: language ID rejects them.  Very long texts are read whole by every
stage, and packing cuts them into as many pieces as they need.  Repeated rows pass or go
together, and near-dedup keeps one of them; rows that share a doc_id are judged each by its own
text.  Ties: of linked texts the least doc_id stays (nulls last), then the least MD5 of id and
text; equal language scores go to the first language by name; pieces of one length are numbered
in the order of the parts that they come from.  An empty table gives an empty result.  Further columns, whatever
their names, stay as they are until packing, which returns its own.

Near-dedup finds candidates by the pigeonhole search of ``simhash``, over two fingerprints and
within eight bits; pairs that are farther apart in both come from rare shingles and SimHash sketches
of 1024 bits.  All are compared by their shingles exactly (see ``jaccard``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lemmata.llm import langid, packing, quality, simhash
from lemmata.llm.common import read, scratch, stage, unstage


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts that are mostly in one language that the labelled rows have."""
    return langid.accept(docs, langid.fit(docs.select("doc_id", "text", "lang")))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts that no rule of the newest policy fails."""
    return quality.accept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of copies and near copies."""
    return simhash.keep_one(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of power-of-two length that training reads.  The workers hold less than in
    op1, as the executors have grown by the stages before."""
    return packing.pack(docs, ["doc_id"], with_ids=False, encoder=packing.SMALL).select(*packing.COLUMNS)


STAGES = [
    ("language ID", language),
    ("quality rules", rules),
    ("near-dedup by SimHash pigeonhole search and exact Jaccard", near_duplicates),
    ("packing", sequences),
]

#: A network and a tokenizer decide the rows; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, f in STAGES:
        with scratch() as made:
            out = stage(f(spark, docs, sf_dir), "pipeline")
            made.pop()  # what a stage keeps for itself goes, its result stays
        unstage(docs)
        docs = out
    return docs
