"""Folders that all executors share, and tables in them that cut a plan in two."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_root: list[str] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder on storage that the cluster shares (spark.checkpoint.dir), or a local one where all
    runs on one machine."""
    root, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not root:
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own_root:
            _own_root.append(tempfile.mkdtemp(prefix="spark-"))
        root = _own_root[0]
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table, for what reads it more than once. The folder stays for the result's
    readers; whoever ends the session clears spark.checkpoint.dir."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
