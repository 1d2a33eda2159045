"""Session settings the jobs rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """Pin UTC and adaptive execution; keep everything else as the cluster set it.

    A few hundred kilobytes of readings are seconds of detector work, so small
    shuffles are not merged below that.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "256k")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a local session without that setting gets one of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
            folder = tempfile.mkdtemp(prefix="labtide-checkpoints-")  # one machine is all there is
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpointed(df):
    """Cut lineage into the shared checkpoint folder, so a lost executor does not replay the job."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
