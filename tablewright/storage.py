"""Tables that are written once, so that later reads agree on them."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    It is the one that the cluster names in ``spark.checkpoint.dir``.  Where none
    is named, a local session, whose executors are the driver itself, gets a
    temporary one; on a cluster that is an error.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not named:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="tablewright-")
        context.setCheckpointDir(named)
    return context._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and cut its lineage.

    Row numbers and hashes of partitions inside are then fixed: a lost executor
    rereads them, it never deals them anew.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
