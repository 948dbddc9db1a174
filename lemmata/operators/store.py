"""The block table: Parquet by folder, with narrow tables beside it.

The key is block_id alone.  An upsert replaces whole rows and keeps a replaced row's seq
(first-insert order), wherever its folder is.  Rows that vanished from the source stay until
their folder is removed.

==========  =============================  =================================================
table       partitioned by                 rows
==========  =============================  =================================================
blocks      part: MD5 of the folder        STORED: both views' vectors and cells
counts      part                           one a folder: files, blocks, greatest seq, and the
                                           least seq of blocks without a label
labels      bucket: hash of the label      (label, part): where a label is, or once was
centroids   -                              the search index's cells, if one was built
==========  =============================  =================================================

A change writes the folders anew that it puts blocks into or takes blocks from (dynamic
partition overwrite), and those folders' counts; labels are only added to, and what they say is
looked up in the block table (``compact`` drops what is no longer so).  A folder that loses all
its blocks loses its directory.  One writer works at a time; a reader that holds rows of a folder
that is then changed has to read again.  Labels are written first and counts last: after a change
that didn't end, repeat it.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.blocks import where
from ..schema import STORED
from . import cells

#: Directories of the label table; folders that a query names one by one.
BUCKETS, NAMED = 64, 1000
PART = T.StructField("part", T.StringType())
TABLES = {
    "blocks": T.StructType([*STORED.fields, PART]),
    "counts": T.StructType([*(T.StructField(n, t) for n, t in (("folder", T.StringType()), ("file_count", T.LongType()), ("block_count", T.LongType()), ("top", T.LongType()), ("bare", T.LongType()))), PART]),
    "labels": T.StructType([T.StructField("label", T.StringType()), PART, T.StructField("bucket", T.IntegerType())]),
}


def part_of(folder: Column) -> Column:
    return F.md5(folder.cast("binary"))


def bucket_of(label: Column) -> Column:
    return F.pmod(F.xxhash64(label), F.lit(BUCKETS)).cast("int")


def last_embeddings(embeddings: DataFrame, order: str | None = None) -> DataFrame:
    """One row a block_id: the last by ``order``."""
    if order is None:
        return embeddings.dropDuplicates(["block_id"])
    rank = F.row_number().over(Window.partitionBy("block_id").orderBy(F.desc(order)))
    return embeddings.withColumn("_n", rank).where("_n = 1").drop("_n", order)


def joined(blocks: DataFrame, embeddings: DataFrame, order: str | None = None) -> DataFrame:
    """Blocks with their vectors; what has no partner goes."""
    return blocks.join(last_embeddings(embeddings, order), "block_id")


def upserted(old: DataFrame, new: DataFrame, top: int | None = None, seqs: DataFrame | None = None) -> DataFrame:
    """old(.., seq), new without seq but with ``_ord`` -> the next rows.  ``top`` is the greatest
    seq so far and ``seqs`` (block_id, seq) what the new ids had, if old isn't all there is."""
    seqs = old.select("block_id", "seq") if seqs is None else seqs
    if top is None:
        top = old.agg(F.max("seq")).first()[0]
        top = -1 if top is None else top
    one = new.withColumn("_n", F.row_number().over(Window.partitionBy("block_id").orderBy(F.desc("_ord")))).where("_n = 1").drop("_n")
    aged = one.join(seqs, "block_id", "left")
    # new ids are numbered after the old; (top, order) keeps first-insert order
    fresh = aged.withColumn("seq", F.coalesce("seq", F.col("_ord").cast("long") + (top + 1))).select(*old.columns)
    return old.join(new.select("block_id").distinct(), "block_id", "left_anti").select(*old.columns).unionByName(fresh)


def listed(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("folder").agg(F.count_distinct("source_file").alias("file_count"), F.count("*").alias("block_count")).orderBy("folder")


def counted(blocks: DataFrame) -> DataFrame:
    """The counts table's rows of these blocks."""
    bare = F.min(F.when(F.coalesce("label", F.lit("")) == "", F.col("seq")))
    return blocks.groupBy("folder", "part").agg(F.count_distinct("source_file").alias("file_count"), F.count("*").alias("block_count"), F.max("seq").alias("top"), bare.alias("bare")).select(*TABLES["counts"].names)


def removed_count(blocks: DataFrame, folder: str) -> DataFrame:
    """(n): how many blocks a removal of the folder takes."""
    return blocks.where(where(folder)).agg(F.count("*").alias("n"))


def by_label(blocks: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """The first inserted block of that label; score 1.0, view ``label``."""
    scope = where(folder)
    hit = blocks.where(F.col("label") == label)
    hit = hit if scope is None else hit.where(scope)
    # rows that others wrote may lack metadata: nulls are shown as ""
    known = ("env_type", "label", "section", "source_file", "folder", "text")
    hit = hit.withColumns({c: F.coalesce(c, F.lit("")) for c in known if c in hit.columns})
    return hit.orderBy("seq", "block_id").limit(1).withColumn("score", F.lit(1.0)).withColumn("matched_view", F.lit("label"))


def without_folder(blocks: DataFrame, folder: str) -> DataFrame:
    return blocks.where(~F.col("folder").eqNullSafe(folder))


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.fs = self._hadoop("").getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._hadoop(""))

    def _hadoop(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _drop(self, name: str) -> None:
        self.fs.delete(self._hadoop(name), True)

    def table(self, name: str) -> DataFrame:
        if not self.fs.exists(self._hadoop(name)):
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{name}")

    def _write(self, df: DataFrame, name: str, by: str, mode: str = "overwrite", to: str | None = None) -> None:
        # rows of a partition are split among tasks only if they are many
        dealt = df.select(*TABLES[name].names).hint("rebalance", by)
        dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(f"{self.path}/{to or name}")

    def rows(self, folder: str | None = None) -> DataFrame:
        """All blocks and their parts, or a folder's: a partition filter."""
        rows = self.table("blocks")
        if folder:
            rows = rows.where((F.col("part") == hashlib.md5(folder.encode()).hexdigest()) & (F.col("folder") == folder))
        return rows

    def read(self, folder: str | None = None) -> DataFrame:
        return self.rows(folder).drop("part")

    def _of_parts(self, name: str, parts: DataFrame) -> DataFrame:
        """A table's rows of these parts: named one by one, if they are few."""
        some = [r["part"] for r in parts.limit(NAMED + 1).collect()]
        rows = self.table(name)
        return rows.where(F.col("part").isin(some)) if len(some) <= NAMED else rows.join(parts, "part", "left_semi")

    def index(self) -> cells.Index | None:
        if not self.fs.exists(self._hadoop("centroids")):
            return None
        return cells.Index(self.spark.read.schema(cells.CENTROID).parquet(f"{self.path}/centroids"))

    def build_index(self, aim: float = 0.95) -> cells.Index:
        """Fits cells on a sample of the blocks and writes every block's cells."""
        fitted = f"centroids-{uuid.uuid4().hex}"
        cells.fit(self.read(), aim).write.parquet(f"{self.path}/{fitted}")
        self._drop("centroids")
        self.fs.rename(self._hadoop(fitted), self._hadoop("centroids"))
        index = self.index()
        if self.fs.exists(self._hadoop("blocks")):
            self._write(index.assigned(self.table("blocks")), "blocks", "part")
        return index

    def upsert(self, blocks: DataFrame, embeddings: DataFrame | None = None) -> None:
        """blocks carry ``_ord`` (their order) and, without ``embeddings``, both vectors."""
        new = blocks if embeddings is None else joined(blocks, embeddings)
        missing = [f for f in STORED.fields if f.name not in new.columns and f.name != "seq"]
        new = new.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing})
        if index := self.index():
            new = index.assigned(new)
        held = f"staging-{uuid.uuid4().hex}"
        try:
            # models run once: what follows reads their vectors from here
            new.withColumn("part", part_of(F.col("folder"))).write.parquet(f"{self.path}/{held}/new")
            new = self.spark.read.parquet(f"{self.path}/{held}/new")
            most = new.agg(F.max("_ord")).first()[0]
            if most is None:
                return
            # of the block table only these columns are read
            was = self.table("blocks").select("block_id", "seq", "part").join(new.select("block_id").distinct(), "block_id")
            was.write.parquet(f"{self.path}/{held}/was")
            was = self.spark.read.schema(was.schema).parquet(f"{self.path}/{held}/was")
            parts = new.select("part").union(was.select("part")).distinct()
            top = self.table("counts").agg(F.max("top")).first()[0]
            # folders that lose all their blocks are in no row that is written
            lost = was.groupBy("part").agg(F.count("*").alias("n")).join(self.table("counts").select("part", "block_count"), "part").where("n = block_count")
            emptied = [r["part"] for r in lost.join(new.select("part"), "part", "left_anti").toLocalIterator()]
            self._write(new.where("label <> ''").select("label", "part", bucket_of(F.col("label")).alias("bucket")).distinct(), "labels", "bucket", "append")
            made = upserted(self._of_parts("blocks", parts), new, -1 if top is None else top, was.select("block_id", "seq"))
            self._write(made, "blocks", "part")
            for part in emptied:
                self._drop(f"blocks/part={part}")
                self._drop(f"counts/part={part}")
            self._write(counted(self._of_parts("blocks", parts)), "counts", "part")
        finally:
            self._drop(held)

    def compact(self) -> None:
        """Writes the label table anew: one entry for each label and folder that there is."""
        now = self.table("blocks").where("label <> ''").select("label", "part", bucket_of(F.col("label")).alias("bucket")).distinct()
        made = f"labels-{uuid.uuid4().hex}"
        self._write(now, "labels", "bucket", to=made)
        self._drop("labels")
        self.fs.rename(self._hadoop(made), self._hadoop("labels"))

    def list_folders(self) -> DataFrame:
        return self.table("counts").select("folder", "file_count", "block_count").orderBy("folder")

    def get_by_label(self, label: str, folder: str | None = None) -> DataFrame:
        """A bucket of the label table says which folders to read."""
        if folder:
            return by_label(self.read(folder), label, folder)
        if label:
            parts = self.table("labels").where((F.col("bucket") == bucket_of(F.lit(label))) & (F.col("label") == label)).select("part").distinct()
        else:
            parts = self.table("counts").where("bare is not null").orderBy("bare").limit(1).select("part")
        return by_label(self._of_parts("blocks", parts).drop("part"), label)

    def remove_folder(self, folder: str) -> int:
        """Deletes the folder's directories; no block is read or written."""
        part = hashlib.md5(folder.encode()).hexdigest()
        found = self.table("counts").where((F.col("part") == part) & (F.col("folder") == folder)).first()
        if not found:
            return 0
        self._drop(f"blocks/part={part}")
        self._drop(f"counts/part={part}")
        return found["block_count"]
