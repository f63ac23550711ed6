"""Fresh paths below the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A path in spark.checkpoint.dir. Where none is set, a session on one machine gets a temporary folder; on a cluster that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir isn't set: name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="locusweave-")
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever Spark's file systems reach."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
