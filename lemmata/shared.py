"""The folder that driver and executors share, and what a session keeps there."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """What spark.checkpoint.dir says.  Only a session on one machine may go without that setting; it
    then gets a temporary folder.  On a cluster the missing setting is an error."""
    if where := spark.conf.get("spark.checkpoint.dir", None):
        return where.rstrip("/")
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lemmata-"))
    return sc.getCheckpointDir()


_made: set[str] = set()


def session_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one.  The driver deletes it when it ends; what
    is to outlive the application is written elsewhere."""
    path = f"{shared_dir(spark)}/lemmata/{spark.sparkContext.applicationId}"
    if path not in _made:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _made.add(path)
    return path
