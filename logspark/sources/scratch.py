"""Folders for what a job writes on its way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, spark.checkpoint.dir. Where none is set, a local master gets a folder of its own, as in
    tests; on a cluster that is an error, as executors would not see each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own under the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
