"""Re-index folders as their files change.

A folder's numbering depends on all its files, so each micro-batch names the folders that
have new files, and each such folder is indexed whole.  A batch's folders are as many as were
changed since the last one; their names come to the driver one after the other."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..engine import Engine


def watch(engine: Engine, root: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Watches the folders directly below ``root``, each of which is indexed on its own, and
    the files directly in ``root``, which make it a folder too (with all below it)."""
    files = engine.spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.tex").option("recursiveFileLookup", True).load(re.sub(r"([\\[\]{}*?])", r"\\\1", root))
    base = re.sub(r"^file:/*", "/", root.rstrip("/"))
    path = F.regexp_replace("path", "^file:/*", "/")
    quoted = "".join(c if c.isalnum() or c in "/_" else f"\\{c}" for c in base)
    below = F.regexp_extract(path, f"^({quoted}/[^/]+)/", 1)
    folder = F.when(below != "", below).when(path.startswith(base + "/"), base)

    def batch(changed: DataFrame, _: int) -> None:
        for r in changed.select("folder").distinct().toLocalIterator():
            if r["folder"]:
                engine.index_folder(r["folder"])

    writer = files.select(folder.alias("folder")).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
