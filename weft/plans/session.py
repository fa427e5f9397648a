"""What a session needs before lineage is cut."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def checkpointed(spark: SparkSession) -> None:
    """Takes the checkpoint folder that the cluster names; makes one only on one machine, where none is named."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="weft-"))


def copartitioned(spark: SparkSession) -> None:
    """Rows that are dealt by a part of the keys of a join (by sent_id, say) stay where they are."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
