"""The five tools over one store."""

from __future__ import annotations

import traceback

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import render
from .functions.blocks import where
from .functions.query import wants_definitions
from .operators import cells
from .operators import search as searching
from .operators.embed import Embedder
from .operators.store import Store
from .plans import blocks as plans
from .schema import RESULT, RESULTS
from .sources import tex

#: Below all characters of ids, so ids keep their order with what follows it.
AFTER_ID = "\0"
_TEXT = {"type": "string"}
#: name -> (what it does, properties, required)
TOOLS = {
    "index_folder": ("Parse, embed and store all .tex files below a folder; known blocks are replaced.", {"folder_path": _TEXT}, ["folder_path"]),
    "search": ("Search the stored blocks by meaning, in prose, LaTeX or both.", {"query": _TEXT, "folder_path": _TEXT, "env_type": _TEXT, "n_results": {"type": "integer", "default": RESULTS}}, ["query"]),
    "get_by_label": ("The block with a \\label.", {"label": _TEXT, "folder_path": _TEXT}, ["label"]),
    "list_folders": ("Stored folders with their numbers of files and blocks.", {}, []),
    "remove_folder": ("Remove a folder's blocks.", {"folder_path": _TEXT}, ["folder_path"]),
}


class Engine:
    def __init__(self, spark: SparkSession, path: str, embedder: Embedder | None = None):
        self.spark, self.store, self.embedder = spark, Store(spark, path), embedder or Embedder()

    def index_folder(self, folder: str) -> tuple[int, int]:
        """(files with a block, blocks).  Texts that the folder had with this model keep their
        vectors; the models see each other text once."""
        held: list[DataFrame] = []
        found = plans.of_folder(self.spark, folder, held).persist()
        try:
            files, blocks = plans.summary(found).first()
            if blocks:
                name = self.embedder.name
                old = self.store.read(tex.resolved(folder)).where(F.col("model") == name).select("text", "text_vec", "math_vec").dropDuplicates(["text"])
                fresh = found.select("text").distinct().join(old, "text", "left_anti")
                vectors = old.unionByName(self.embedder.blocks(fresh))
                # a string has fewer than 2**31 characters, so this orders by file, then place
                order = F.shiftleft("file_ord", 31) + F.col("pos")
                made = found.join(vectors, "text").withColumns({"_ord": order, "model": F.lit(name)})
                self.store.upsert(made.drop("file_ord", "pos"))
            return files, blocks
        finally:
            for x in (found, *held):
                x.unpersist()

    def build_index(self) -> None:
        """Gives the stored blocks cells; from then on searches look into some cells only."""
        self.store.build_index()

    def search(self, query: str, folder_path: str | None = None, env_type: str | None = None, n_results: int = RESULTS) -> DataFrame:
        asked = self.spark.createDataFrame([(0, query)], "query_id int, query string").withColumn("boost", wants_definitions(F.col("query")))
        rows, asked, scope = self.store.rows(folder_path), self.embedder.queries(asked), where(folder_path, env_type)
        # a hit carries its part after its id, so that texts are read from the hits' parts only
        blocks = rows.withColumn("block_id", F.concat("block_id", F.lit(AFTER_ID), "part"))
        if index := self.store.index():
            best = cells.search(blocks, index, asked, n_results, scope)
        else:
            best = searching.search(blocks, asked, n_results, scope, few=True)
        best = best.withColumns({"part": F.substring_index("block_id", AFTER_ID, -1), "block_id": F.substring_index("block_id", AFTER_ID, 1)})
        return searching.with_texts(best, rows, ("part", "block_id"), few=True).orderBy("rank").select(*RESULT.names)

    def get_by_label(self, label: str, folder_path: str | None = None) -> DataFrame:
        return self.store.get_by_label(label, folder_path).select(*RESULT.names)

    def list_folders(self) -> DataFrame:
        return self.store.list_folders()

    def remove_folder(self, folder_path: str) -> int:
        return self.store.remove_folder(folder_path)

    def list_tools(self) -> list[dict]:
        return [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p} | ({"required": r} if r else {})} for n, (d, p, r) in TOOLS.items()]

    def dispatch(self, name: str, args: dict) -> str:
        """A tool's text.  Unknown names raise ValueError, missing arguments KeyError."""
        if name not in TOOLS:
            raise ValueError(f"Unknown tool: {name}")
        for needed in TOOLS[name][2]:
            args[needed]
        folder = args.get("folder_path")
        if name == "index_folder":
            return render.indexed(*self.index_folder(folder), folder)
        if name == "search":
            return render.search(self.search(args["query"], folder, args.get("env_type"), int(args.get("n_results", RESULTS))).collect())
        if name == "get_by_label":
            return render.label(self.get_by_label(args["label"], folder).first(), args["label"], folder)
        if name == "list_folders":
            return render.folders(self.list_folders().collect())
        return render.removed(self.remove_folder(folder), folder)

    def call(self, name: str, args: dict) -> str:
        """As dispatch, but an error is a text too."""
        try:
            return self.dispatch(name, args)
        except Exception:
            return f"Error:\n{traceback.format_exc()}"
