"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a temporary one on a local master; else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir is not set: on {master}, driver and executors share no temporary folder")
        found = getattr(spark, "_vecloom_shared", None) or "file://" + tempfile.mkdtemp(prefix="vecloom-")
        spark._vecloom_shared = found
    return found.rstrip("/")
