"""From parser events to blocks, all in Catalyst."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.blocks import block_id, canonical, is_statement
from ..sources import tex


def with_sections(events: DataFrame) -> DataFrame:
    """The last title before each row of the same file, "" before any."""
    before = Window.partitionBy("folder", "source_file", "file_ord").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    title = F.last(F.when(F.col("kind") == "section", F.col("title")), ignorenulls=True).over(before)
    return events.withColumn("section", F.coalesce(title, F.lit("")))


#: Files whose numbers of rows one task sums up.
FILES = 4096


def offsets(counts: DataFrame, keys: list[str]) -> DataFrame:
    """counts(*keys, file_ord, n) -> with ``before``: the sum of n over earlier files of the same
    keys.  Sums within runs of FILES files, then over the runs."""
    run = counts.withColumn("_run", F.floor(F.col("file_ord") / FILES))
    totals = run.groupBy(*keys, "_run").agg(F.sum("n").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    within = Window.partitionBy(*keys, "_run").orderBy("file_ord").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(within), F.lit(0)) + F.col("_start")
    return run.join(totals, [*keys, "_run"]).withColumn("before", before).drop("_run", "_start", "n")


def running_number(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds n: the place among the rows of the same keys, by file_ord and then ``order``.  Rows are
    dealt by file; over files only their counts are summed, so that no task has all rows of a key."""
    counts = rows.groupBy(*keys, "file_ord").agg(F.count("*").alias("n"))
    own = F.row_number().over(Window.partitionBy(*keys, "file_ord").orderBy(*order))
    placed = rows.withColumn("_own", own).join(offsets(counts, keys), [*keys, "file_ord"])
    return placed.withColumn("n", F.col("before") + F.col("_own")).drop("_own", "before")


def numbered(events: DataFrame) -> DataFrame:
    """Statements with their number among those of the folder and kind, in file order."""
    kept = events.where((F.col("kind") == "block") & is_statement(F.col("name"))).withColumn("env_type", canonical(F.col("name")))
    return running_number(kept, ["folder", "env_type"], ["pos"]).withColumn("block_id", block_id(F.col("source_file"), F.col("env_type"), F.col("n")))


def blocks(events: DataFrame) -> DataFrame:
    """The columns of a block, and (file_ord, pos) for order."""
    return numbered(with_sections(events)).select("env_type", F.col("body").alias("text"), "label", "section", "source_file", "folder", "block_id", "file_ord", "pos")


def summary(found: DataFrame) -> DataFrame:
    """(files, blocks): files with a block, blocks."""
    return found.agg(F.count_distinct("source_file").alias("files"), F.count("*").alias("blocks"))


def of_folder(spark: SparkSession, folder: str, held: list[DataFrame] | None = None) -> DataFrame:
    return blocks(tex.folder_events(spark, folder, held))


def of_file(spark: SparkSession, path: str, folder: str | None = None) -> DataFrame:
    return blocks(tex.file_events(spark, path, folder))
